"""Language identification: multinomial naive Bayes over hashed character n-grams, scored in numpy."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, map_arrow

BITS = 15
ORDERS = (1, 2, 3)


@functools.lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """For each code point, itself if it is a letter, else a space."""
    return np.fromiter((c if chr(c).isalpha() else 32 for c in range(0x110000)), dtype=np.uint32, count=0x110000)


def ngrams(text: str) -> np.ndarray | None:
    """Buckets of the n-grams of the lower-cased text, non-letters standing as spaces; None without a letter."""
    points = _letters()[np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]
    points = np.concatenate((np.array([32], np.uint32), points, np.array([32], np.uint32)))
    if not (points != 32).any():
        return None
    points = points[np.concatenate(([True], (points[1:] != 32) | (points[:-1] != 32)))]
    out = []
    value = points.copy()
    for n in ORDERS:
        if n > 1:
            if len(points) < n:
                break
            value = value[:-1] * np.uint32(0x01000193) + points[n - 1 :]
        mixed = (value ^ np.uint32(n * 0x9E3779B9 & 0xFFFFFFFF)) * np.uint32(0x85EBCA6B)
        mixed = (mixed ^ (mixed >> np.uint32(15))) * np.uint32(0xC2B2AE35)
        out.append(mixed >> np.uint32(32 - BITS))
    return np.concatenate(out)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[str, np.ndarray] = {}
    docs: dict[str, int] = {}
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            grams = ngrams(text.as_py() or "")
            if grams is not None:
                counts.setdefault(lang, np.zeros(1 << BITS, np.int64))
                counts[lang] += np.bincount(grams, minlength=1 << BITS)
                docs[lang] = docs.get(lang, 0) + 1
    for lang, c in counts.items():
        at = np.flatnonzero(c)
        yield pa.record_batch([pa.array([lang] * (len(at) + 1)), pa.array(np.append(at, -1).astype(np.int32)), pa.array(np.append(c[at], docs[lang]))], ["lang", "bucket", "n"])


def fit(rows: DataFrame, alpha: float = 0.5, lang_col: str = "lang", text_col: str = "text") -> tuple[list[str], np.ndarray]:
    """Languages and their matrix of log-probabilities, with the log-prior in the last column.

    What reaches the driver is a count for each language and bucket: 2**15 rows a language, whatever the input.
    """
    found = map_arrow(rows.where(F.col(lang_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")), _count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow().to_pydict()
    langs = sorted(set(found["lang"]))
    row = {lang: i for i, lang in enumerate(langs)}
    counts = np.zeros((len(langs), (1 << BITS) + 1))
    counts[[row[x] for x in found["lang"]], found["bucket"]] = found["n"]
    grams, docs = counts[:, :-1] + alpha, counts[:, -1:]
    return langs, np.hstack((np.log(grams / grams.sum(axis=1, keepdims=True)), np.log((docs + 1) / (docs.sum() + len(langs))))).astype(np.float32) if langs else np.zeros((0, 1), np.float32)


def _scorer(model):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, table = model.value
        table = np.ascontiguousarray(table.T)  # a row for each bucket
        for batch in batches:
            ids, best, scores = batch.column(0), [], []
            group, ends, held = [], [0], 0

            def settle():
                nonlocal group, ends, held
                if not group:
                    return
                flat = np.concatenate(group)
                sums = np.add.reduceat(table[flat], np.array(ends[:-1]), axis=0, dtype=np.float64) + table[-1]
                top = sums.argmax(axis=1)
                chance = 1 / np.exp(sums - sums.max(axis=1, keepdims=True)).sum(axis=1)
                for i, k in enumerate(slots):
                    best[k], scores[k] = langs[top[i]], float(chance[i])
                slots.clear()
                group, ends, held = [], [0], 0

            slots: list[int] = []
            for text in batch.column(1):
                text = text.as_py()
                grams = ngrams(text) if text and langs else None
                best.append("und")
                scores.append(0.0)
                if grams is not None:
                    slots.append(len(best) - 1)
                    group.append(grams)
                    held += len(grams)
                    ends.append(held)
                    if held > 1 << 20:
                        settle()
            settle()
            yield pa.record_batch([ids, pa.array(best, pa.string()), pa.array(scores, pa.float64())], ["id", "lang_pred", "score"])

    return work


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score) for each row; the text is all that a prediction sees.

    The matrix is broadcast: 128 KB a language. score is the posterior of lang_pred. Null text, text without a
    letter, or a model without languages: und, 0. Null and repeated ids pass through; other columns are not read.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return map_arrow(rows, _scorer(spark.sparkContext.broadcast(model)), "id long, lang_pred string, score double").withColumnRenamed("id", id_col)


def bounded(rows: DataFrame, most: int, id_col: str, seed: str, by: str | None = None, least: int = 1_000) -> DataFrame:
    """About ``most`` rows by a keyed hash of the id, all if there are fewer; the same rows at each run.

    With ``by``, of each of its values about ``least`` rows at least, or all; a count a value reaches the driver.
    """
    counts = {r[0]: r[1] for r in rows.groupBy(F.col(by) if by else F.lit(0)).count().collect()}
    n = sum(counts.values())
    if n <= most:
        return rows
    rate = F.lit(most / n)
    if by:
        # One map, as a chain of conditions would be as deep as there are values; no value is the key of null.
        rates = [F.lit(x) for value, k in counts.items() if value is not None for x in (value, max(most / n, least / k))]
        missing = F.lit(max(most / n, least / counts[None]) if None in counts else 0.0)
        rate = F.coalesce(F.element_at(F.create_map(*rates), F.col(by)), missing) if rates else missing
    share = F.conv(F.substring(F.md5(F.concat(F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.lit("")))), 1, 8), 16, 10).cast("double") / 2**32
    return rows.where(share < rate)


def held_out(id_col: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def op7_language(spark: SparkSession, sf_dir: str, fit_docs: int = 20_000) -> DataFrame:
    """fit_docs bounds the labelled documents that the model is fitted on, beside 1,000 a language; every document is predicted."""
    docs = documents(spark, sf_dir)
    train = bounded(docs.where(~held_out() & F.col("lang").isNotNull()).select("doc_id", "text", "lang"), fit_docs, "doc_id", "lang", "lang")
    found = identify(docs, fit(train))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
