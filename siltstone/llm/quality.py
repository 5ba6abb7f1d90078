"""Quality by importance resampling: hashed n-gram models of target and raw text, and Gumbel top-k."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import discard, documents, map_arrow, written
from .language import bounded

BITS = 16
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


@functools.lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """Of a byte: 0 space or control, 1 letter or digit (all bytes of non-ASCII characters too), 2 other."""
    return np.array([0 if c <= 32 or c == 127 else 1 if c >= 128 or chr(c).isalnum() else 2 for c in range(256)], dtype=np.uint8)


class _Powers:
    """Powers of the base and of its inverse, modulo 2**64, grown on demand."""

    up = down = np.ones(1, np.uint64)

    @classmethod
    def to(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            n = max(n, 1 << 18)
            for name, base in (("up", _BASE), ("down", _INVERSE)):
                steps = np.full(n, base, np.uint64)
                steps[0] = 1
                setattr(cls, name, np.multiply.accumulate(steps))
        return cls.up[:n], cls.down[:n]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (x ^ (x >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)


def features(data: bytes) -> np.ndarray:
    """Buckets of the one- and two-token sequences of UTF-8 text; tokens are runs of alphanumerics or of signs."""
    x = np.frombuffer(data, dtype=np.uint8)
    if not len(x):
        return np.empty(0, np.int64)
    kind = np.concatenate(([0], _classes()[x], [0])).astype(np.int8)
    change = np.flatnonzero(kind[1:] != kind[:-1])
    starts, ends = change[:-1], change[1:]
    held = kind[starts + 1] != 0
    starts, ends = starts[held], ends[held]
    if not len(starts):
        return np.empty(0, np.int64)
    up, down = _Powers.to(len(x) + 1)
    sums = np.zeros(len(x) + 1, np.uint64)
    np.cumsum((x.astype(np.uint64) + np.uint64(1)) * up[: len(x)], out=sums[1:])
    token = _mixed((sums[ends] - sums[starts]) * down[starts])
    pair = _mixed(token[:-1] * np.uint64(31) + token[1:] + np.uint64(1))
    return (np.concatenate((token, pair)) >> np.uint64(64 - BITS)).astype(np.int64)


#: Strata whose counts a worker holds at once.
HELD = 16


def _counter(targets):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = targets.value
        held: dict = {}

        def made() -> Iterator[pa.RecordBatch]:
            for stratum, (raw, wanted) in held.items():
                at = np.flatnonzero(raw)
                yield pa.record_batch([pa.array([stratum] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(raw[at]), pa.array(wanted[at])], ["stratum", "bucket", "raw", "wanted"])
            held.clear()

        for batch in batches:
            for key, stratum, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                found = features(text.as_py() or b"")
                if not len(found):
                    continue
                if stratum not in held:
                    if len(held) >= HELD:
                        yield from made()
                    held[stratum] = np.zeros(1 << BITS, np.int64), np.zeros(1 << BITS, np.int64)
                raw, wanted = held[stratum]
                counts = np.bincount(found, minlength=1 << BITS) if len(found) > 1 << 14 else None
                for into in (raw, wanted) if key in ids else (raw,):
                    if counts is None:
                        np.add.at(into, found, 1)
                    else:
                        into += counts
        yield from made()

    return work


def fit(docs: DataFrame, targets: list[int], shrink: float = 10.0, id_col: str = "doc_id", text_col: str = "text", by: str | None = None) -> np.ndarray:
    """log p(bucket | target) - log p(bucket | raw), drawn to 0 as if ``shrink`` more occurrences were as expected.

    Else a text would be told by its own rare words, by which labelled and other texts differ most. The raw model
    counts all rows, the target model those whose id is in targets. With ``by``, what is expected of the target is
    told for each value of that column by itself and summed up: a language that has few targets, or none, is not
    marked down for it. The driver gets a row a bucket.
    """
    spark = docs.sparkSession
    ids = spark.sparkContext.broadcast(frozenset(targets))
    stratum = F.coalesce(F.col(by).cast("string"), F.lit("")) if by else F.lit("")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), stratum.alias("stratum"), F.col(text_col).cast("binary").alias("data"))
    counted = map_arrow(rows, _counter(ids), "stratum string, bucket int, raw long, wanted long").groupBy("stratum", "bucket").agg(F.sum("raw").alias("raw"), F.sum("wanted").alias("wanted"))
    counted = written(counted, "quality-counts")
    whole = counted.groupBy("stratum").agg((F.sum("wanted") / F.sum("raw")).alias("share"))
    got = counted.join(whole, "stratum").groupBy("bucket").agg(F.sum("wanted").alias("wanted"), F.sum(F.col("raw") * F.col("share")).alias("expected")).toArrow().to_pydict()
    discard(counted)
    expected, wanted = np.zeros(1 << BITS), np.zeros(1 << BITS)
    at = np.array(got["bucket"], dtype=np.int64)
    expected[at] = got["expected"]
    wanted[at] = got["wanted"]
    return np.log((wanted + shrink) / (expected + shrink))


def _scorer(model):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = model.value
        for batch in batches:
            weights, counts = [], []
            for text in batch.column(batch.num_columns - 1):
                found = features(text.as_py() or b"")
                weights.append(float(table[found].sum()) if len(found) else None)
                counts.append(len(found))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(weights, pa.float64()), pa.array(counts, pa.int64())], [*batch.schema.names[:-1], "log_weight", "n_features"])

    return work


def gumbel(id_col: str, seed: int) -> Column:
    """Standard Gumbel noise from a hash of seed and id, the same at each run."""
    u = (F.xxhash64(F.lit(seed), F.col(id_col)).bitwiseAND(F.lit((1 << 52) - 1)) + F.lit(0.5)) / float(1 << 52)
    return -F.log(-F.log(u))


def weigh(docs: DataFrame, table: np.ndarray, id_col: str = "doc_id", text_col: str = "text", seed: int = 29, border: float = 0.0) -> DataFrame:
    """docs with log_weight, n_features and sort_key (log_weight above ``border`` a feature, plus Gumbel noise; null
    without features)."""
    keep = [c for c in docs.columns if c.lower() not in ("log_weight", "n_features", "sort_key")]
    rows = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(text_col).cast("binary").alias("__data"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    out = map_arrow(rows, _scorer(docs.sparkSession.sparkContext.broadcast(table)), f"{kinds}, log_weight double, n_features long")
    return out.withColumn("sort_key", F.col("log_weight") - border * F.col("n_features") + gumbel(id_col, seed))


def kth_largest(keys: DataFrame, k: int, bins: int = 2048) -> float | None:
    """The k-th largest non-null sort_key, exactly: the bin that holds it is split again until all its keys are equal.

    Each round brings one row a bin to the driver.
    """
    low, high, n = keys.agg(F.min("sort_key"), F.max("sort_key"), F.count("sort_key")).first()
    if k < 1 or not n:
        return None
    if k >= n:
        return low
    above = 0
    while low < high:
        width = (high - low) / bins
        if not width or low + width == low:
            rest = [r[0] for r in keys.where((F.col("sort_key") >= low) & (F.col("sort_key") <= high)).groupBy("sort_key").count().orderBy(F.desc("sort_key")).collect()]
            counts = dict(keys.where((F.col("sort_key") >= low) & (F.col("sort_key") <= high)).groupBy("sort_key").count().collect())
            for value in rest:
                above += counts[value]
                if above >= k:
                    return value
        inside = keys.where((F.col("sort_key") >= low) & (F.col("sort_key") <= high))
        at = F.least(F.lit(bins - 1), F.floor((F.col("sort_key") - low) / width)).cast("int")
        found = {r["at"]: r for r in inside.groupBy(at.alias("at")).agg(F.count(F.lit(1)).alias("n"), F.min("sort_key").alias("low"), F.max("sort_key").alias("high")).collect()}
        for i in sorted(found, reverse=True):
            if above + found[i]["n"] >= k:
                low, high = found[i]["low"], found[i]["high"]
                break
            above += found[i]["n"]
    return low


def told(labels: DataFrame, docs: DataFrame, good: bool, id_col: str, by: str | None) -> DataFrame:
    """(doc_id, stratum) of the rows of docs labelled as good and not toxic, or as bad."""
    asked = "quality = 1 and coalesce(toxic, 0) = 0" if good else "quality = 0"
    stratum = F.coalesce(F.col(by).cast("string"), F.lit("")) if by else F.lit("")
    found = labels.where(f"{asked} and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), stratum.alias("stratum")).join(found, "doc_id", "left_semi").dropDuplicates(["doc_id"])


def _held() -> Column:
    """One labelled row in four, which no model is fitted on."""
    return F.crc32(F.concat(F.lit("border"), F.col("doc_id").cast("string"))) % 4 == 3


def least_weight(scored: DataFrame, good: DataFrame, bad: DataFrame, id_col: str) -> float:
    """The log_weight a feature that best parts good from bad rows: the largest difference of the shares at or above it.

    Tried are 200 quantiles of the good rows, and of equal ones the least is taken, as texts without labels may stand
    lower than good ones. 0 without good rows.
    """
    rows = scored.where("n_features > 0").select(F.col(id_col).cast("long").alias("doc_id"), (F.col("log_weight") / F.col("n_features")).alias("each"))
    held = [np.array([r[0] for r in rows.join(x.select("doc_id"), "doc_id").select("each").collect()]) for x in (good, bad)]
    if not len(held[0]):
        return 0.0
    tried = np.quantile(held[0], np.linspace(0, 1, 201))
    gap = [(held[0] >= t).mean() - ((held[1] >= t).mean() if len(held[1]) else 0) for t in tried]
    return float(tried[int(np.argmax(gap))])


def resample(docs: DataFrame, labels: DataFrame, fit_docs: int = 20_000, seed: int = 29, id_col: str = "doc_id", text_col: str = "text", by: str = "lang") -> tuple[DataFrame, DataFrame]:
    """Importance resampling of docs towards the good rows of labels: (all rows weighed, rows kept).

    log_weight sums log p(target) - log p(raw) over a text's hashed one- and two-token sequences. Both are told within
    each value of ``by``, if docs have that column. A border for log_weight a feature comes from labelled rows that
    the models do not know as targets. k is the number of rows at or above it; kept are the k rows of largest
    log_weight beyond the border plus Gumbel noise, which is sampling without replacement in proportion to the weights.
    Both models cover whole texts; the raw one all rows, the target one about fit_docs labelled rows (the bound of
    that fit), of each value of ``by`` 1,000 at least.

    The first frame has the id, log_weight, n_features, sort_key and keep for each row; the second docs' own columns
    for the kept. Null, empty or signless texts have no weight and are not kept. Ties at the border are all kept.
    Without target rows nothing can be told apart and every row with features is kept. Null ids share one noise value.
    """
    by = by if by in docs.columns else None
    good = written(told(labels, docs, True, id_col, by), "quality-good")
    ids = [r[0] for r in bounded(good.where(~_held()), fit_docs, "doc_id", "target", "stratum").select("doc_id").collect()]
    table = fit(docs, ids, id_col=id_col, text_col=text_col, by=by) if ids else np.zeros(1 << BITS)
    scored = written(weigh(docs.select(id_col, text_col), table, id_col, text_col, seed).drop(text_col, "sort_key"), "quality")
    # Bad rows are in no model as targets, so all may stand; of both, a bounded number reaches the driver.
    bad = told(labels, docs, False, id_col, by)
    least = least_weight(scored, *[bounded(x, fit_docs, "doc_id", "border", "stratum") for x in (good.where(_held()), bad)], id_col) if ids else 0.0
    scored = scored.withColumn("sort_key", F.col("log_weight") - least * F.col("n_features") + gumbel(id_col, seed))
    k = scored.where(F.col("log_weight") >= least * F.col("n_features")).count()
    border = kth_largest(scored, k)
    keep = F.coalesce(F.col("sort_key") >= F.lit(border), F.lit(False)) if border is not None else F.lit(False)
    kept = weigh(docs, table, id_col, text_col, seed, least).where(keep).select(*[F.col(f"`{c}`") for c in docs.columns])
    return scored.withColumn("keep", keep), kept


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored, _ = resample(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return scored.select("doc_id", "log_weight", "n_features", "sort_key", "keep")
