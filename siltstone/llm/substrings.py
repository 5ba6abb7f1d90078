"""Repeated substrings: every byte inside a long enough string that starts earlier in the corpus goes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import documents, map_arrow, written
from .quality import _Powers, _mixed
from .suffixes import suffix_array

LENGTH = 100
#: Bytes of an anchor; each string of LENGTH bytes holds LENGTH - ANCHOR + 1 of them.
ANCHOR = 28
#: Contexts are dealt to shards of about so many bytes.
SHARD_BYTES = 2 << 20
#: Suffixes of a shard that wait in memory in each pass, in bytes.
QUEUE_BYTES = 48 << 20


def _value() -> np.ndarray:
    return _mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


_VALUE = _value()


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` neighbours, from minima of blocks' beginnings and ends."""
    n = len(x)
    pad = -n % width
    full = np.concatenate((x, np.full(pad, np.iinfo(x.dtype).max, x.dtype))).reshape(-1, width)
    ahead = np.minimum.accumulate(full, axis=1).ravel()
    back = np.minimum.accumulate(full[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - width + 1], ahead[width - 1 : n])


def owned_runs(data: bytes, length: int = LENGTH, anchor: int = ANCHOR) -> tuple[np.ndarray, ...]:
    """For runs of ``length``-byte strings that one anchor owns: its hash, the hash of all the bytes of the run's
    strings (with the anchor's place in it), the first start, and the number of starts less one.

    The owner of a string is, of the anchors in it, the one of the smallest hash, the leftmost if several are equal;
    it depends on the string alone, so equal strings anywhere have owners of equal hash at equal places.
    """
    x = np.frombuffer(data, dtype=np.uint8)
    n = len(x)
    if n < length:
        none = np.empty(0, np.int64)
        return none, none, none, none
    up, down = _Powers.to(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_VALUE[x] * up[:n], out=sums[1:])
    grams = _mixed((sums[anchor:] - sums[:-anchor]) * down[: n - anchor + 1])
    key = (grams & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=np.uint64)
    owner = (_sliding_min(key, length - anchor + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    first = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
    more = np.append(first[1:], len(owner)) - 1 - first
    owner = owner[first]
    whole = _mixed((sums[first + more + length] - sums[first]) * down[first])
    shape = ((owner - first) << 8 | more).astype(np.uint64)
    return grams[owner].view(np.int64), _mixed(whole + shape * np.uint64(0x9E3779B97F4A7C15)).view(np.int64), first, more


def _anchors(length: int, anchor: int, names: list[str]):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, out, held = [], [], 0

            def ready():
                columns = [np.concatenate(c) for c in zip(*out)]
                columns = {"anchor": columns[0], "whole": columns[1], "doc": np.concatenate(ids), "start": columns[2], "more": columns[3].astype(np.int32)}
                return pa.record_batch([pa.array(columns[n]) for n in names], names)

            for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                got = owned_runs(text.as_py() or b"", length, anchor)
                if len(got[0]):
                    ids.append(np.full(len(got[0]), key, np.int64))
                    out.append(got)
                    held += len(got[0])
                if held > 200_000:
                    yield ready()
                    ids, out, held = [], [], 0
            if held:
                yield ready()

    return work


def repeats(contexts: list[bytes], mores: np.ndarray, docs: np.ndarray, starts: np.ndarray, length: int = LENGTH, limit: int = QUEUE_BYTES) -> pd.DataFrame:
    """Spans (doc, first, end) of the strings owned by contexts of one shard that start earlier in another.

    The contexts' suffixes are sorted with their common-prefix values; where neighbours share ``length`` bytes the
    string is the same, and all but its earliest start are spans.
    """
    sizes = np.fromiter(map(len, contexts), dtype=np.int64, count=len(contexts))
    begin = np.cumsum(sizes + 1) - sizes - 1
    t = np.frombuffer(b"\0".join(contexts) + b"\0", dtype=np.uint8).astype(np.int16) + 1
    t[begin + sizes] = 0
    which = np.repeat(np.arange(len(contexts), dtype=np.int32), sizes + 1)
    sa, lcp = suffix_array(t, cap=length, limit=limit)
    inside = sa - begin[which[sa]]
    group = np.cumsum(lcp < length)
    owned = inside <= mores[which[sa]]
    context, inside, group = which[sa][owned], inside[owned], group[owned]
    start = starts[context] + inside
    doc = docs[context]
    order = np.lexsort((start, doc, group))
    doc, start, group = doc[order], start[order], group[order]
    later = np.append(False, group[1:] == group[:-1])
    doc, start = doc[later], start[later]
    order = np.lexsort((start, doc))
    doc, start = doc[order], start[order]
    if not len(doc):
        return pd.DataFrame({"doc": doc, "first": start, "end": start})
    fresh = np.append(True, (doc[1:] != doc[:-1]) | (start[1:] > start[:-1] + length))
    heads = np.flatnonzero(fresh)
    tails = np.append(heads[1:], len(doc)) - 1
    return pd.DataFrame({"doc": doc[heads], "first": start[heads], "end": start[tails] + length})


def _sort_shard(shard: pd.DataFrame) -> pd.DataFrame:
    shard = shard.drop_duplicates(["doc", "start"])  # of a row that stands several times
    return repeats(shard["context"].tolist(), shard["more"].to_numpy(), shard["doc"].to_numpy(), shard["start"].to_numpy())


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc, id, data): doc is a whole number that puts rows in order, one for each document.

    It is the id, unless ids are null or shared: then rows are documents of their own if they differ in id or text, and
    doc is their place by id, null first, and a hash of the text.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("data"))
    if rows.groupBy("id").count().where("id is null or count > 1").isEmpty():
        return rows.select(F.col("id").alias("doc"), "id", "data")
    pairs = rows.select("id", F.xxhash64("data").alias("h")).distinct()
    # Written, since the bounds of ranges are sampled anew if a lost part is made again.
    pairs = written(pairs.repartitionByRange(F.col("id").asc_nulls_first(), "h").withColumn("part", F.spark_partition_id()), "substring-keys")
    sizes = pairs.groupBy("part").agg(F.count(F.lit(1)).alias("size"))
    before = sizes.select("part", (F.sum("size").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, 0)) - F.col("size")).alias("before"))
    inside = F.row_number().over(W.partitionBy("part").orderBy(F.col("id").asc_nulls_first(), "h"))
    keys = pairs.withColumn("inside", inside).join(before, "part").select(F.col("id").alias("k_id"), F.col("h").alias("k_h"), (F.col("before") + F.col("inside")).cast("long").alias("doc"))
    return rows.join(keys, F.col("id").eqNullSafe(F.col("k_id")) & (F.xxhash64("data") == F.col("k_h"))).select("doc", "id", "data")


def repeated_spans(rows: DataFrame) -> DataFrame:
    """(doc, spans array<struct<first, end>>) of rows (doc, data): byte spans of strings of 100 bytes that also start earlier.

    Exact and over all rows, but only what can repeat is sorted:
    1. Every string of 100 bytes belongs to one of its anchors (a minimizer). Anchors whose hash stands once in the
       corpus own nothing that repeats. Counting is a plain aggregation.
    2. Of runs of strings with the same anchor and the same bytes (by two 64-bit hashes), all but the earliest are
       spans at once. So however many copies there are, one row stands for them from here on.
    3. Where an anchor has runs of different bytes, their contexts (some 130 bytes each) are sent to the anchor's
       shard, sorted there as suffixes (see ``suffixes``), and strings found equal give up all starts but the first.
    """
    rows = rows.select("doc", "data").where("data is not null")
    names = ["anchor", "whole"]
    seen = map_arrow(rows, _anchors(LENGTH, ANCHOR, names), "anchor long, whole long")
    shared = seen.groupBy("anchor").agg(F.count(F.lit(1)).alias("n"), (F.min("whole") < F.max("whole")).alias("mixed")).where("n > 1").select("anchor", "mixed")
    names = ["anchor", "whole", "doc", "start", "more"]
    runs = map_arrow(rows, _anchors(LENGTH, ANCHOR, names), "anchor long, whole long, doc long, start long, more int")
    live = written(runs.join(shared, "anchor"), "runs")
    firsts = live.groupBy("anchor", "whole").agg(F.min(F.struct("doc", "start")).alias("head"), F.first("more").alias("more"), F.first("mixed").alias("mixed"), F.count(F.lit(1)).alias("n"))
    firsts = written(firsts.select("anchor", "whole", "head.doc", "head.start", "more", "mixed", "n"), "firsts")
    heads = firsts.where("n > 1").select("anchor", "whole", F.col("doc").alias("h_doc"), F.col("start").alias("h_start"))
    copies = live.join(heads, ["anchor", "whole"]).where("doc <> h_doc or start <> h_start").select("doc", F.col("start").alias("first"), (F.col("start") + F.col("more") + LENGTH).alias("end"))
    mixed = firsts.where("mixed")
    total = mixed.agg(F.sum(F.col("more") + LENGTH)).first()[0] or 0
    shards = max(1, -(-total // SHARD_BYTES))
    wanted = mixed.groupBy("doc").agg(F.collect_list("start").alias("starts"), F.collect_list("more").alias("mores"), F.collect_list("anchor").alias("anchors"))
    cut = F.transform(F.arrays_zip("starts", "mores", "anchors"), lambda r: F.struct(r["starts"].alias("start"), r["mores"].alias("more"), r["anchors"].alias("anchor"), F.substring(F.col("data"), (r["starts"] + 1).cast("int"), r["mores"] + LENGTH).alias("context")))
    contexts = rows.join(wanted, "doc").select("doc", F.explode(cut).alias("c")).select(F.pmod(F.xxhash64("c.anchor"), F.lit(shards)).alias("shard"), "doc", "c.start", "c.more", "c.context")
    sorted_out = contexts.groupBy("shard").applyInPandas(_sort_shard, "doc long, first long, end long")
    return copies.union(sorted_out).groupBy("doc").agg(F.collect_list(F.struct("first", "end")).alias("spans"))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        kept, sizes, removed, counts = [], [], [], []
        for data, spans in zip(batch.column(1), batch.column(2)):
            data, spans = data.as_py() or b"", spans.as_py()
            sizes.append(len(data))
            if not spans:
                kept.append(data)
                removed.append(0)
                counts.append(0)
                continue
            out, at, gone, n = [], 0, 0, 0
            end = -1
            for first, last in sorted((s["first"], s["end"]) for s in spans):
                if first > end:  # else it touches or overlaps the span before
                    if end > 0:
                        at = end
                    out.append(data[at:first])
                    n += 1
                    gone += last - first
                    end = last
                elif last > end:
                    gone += last - end
                    end = last
            out.append(data[end:])
            kept.append(b"".join(out))
            removed.append(gone)
            counts.append(n)
        yield pa.record_batch([batch.column(0), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(counts, pa.int64()), pa.array(kept, pa.binary())], ["doc", "n_bytes", "n_removed", "n_spans", "kept"])


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept): whole texts as UTF-8 bytes without what repeats earlier strings.

    A byte goes if a string of 100 bytes that covers it also starts earlier: in a row of a smaller id, or before it
    in the same row; judged on the input, overlaps counted. n_spans counts maximal removed runs; kept is binary, as a
    cut may fall inside a character. Null text: no bytes. Texts under 100 bytes are left alone. Rows of null id come
    first. Rows that share an id, or have none, are documents of their own if they differ in text, in the order of a hash;
    an exact repetition of a row counts as the same document and loses no more than the row does. No rows: no rows.
    """
    rows = _keyed(docs, id_col, text_col)
    spans = repeated_spans(rows)
    return map_arrow(rows.join(spans, "doc", "left").select("id", "data", "spans"), _cut, "doc long, n_bytes long, n_removed long, n_spans long, kept binary").withColumnRenamed("doc", id_col)


def op2_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = without_repeats(documents(spark, sf_dir))
    return made.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
