"""Corpus assembly: unions, merge summaries, ordered limits, splits, token tables, sequence batches and page windows."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siltstone.functions import text as T
from siltstone.operators import chunks, order


def union(named: Mapping[str, DataFrame]) -> DataFrame:
    """Rows of all frames in the order of their names, columns that one lacks being null; adds file, the name."""
    out = None
    for name in sorted(named):
        rows = named[name].withColumn("file", F.lit(name))
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    if out is None:
        raise ValueError("nothing to unite")
    return out


def merge_summary(rows: DataFrame, kept: Column, n_tokens: Column) -> DataFrame:
    """One row: processed, kept, dropped, tokens, kept_tokens; a null verdict counts as dropped."""
    stays = F.coalesce(kept, F.lit(False))
    n, k = F.count(F.lit(1)), F.count_if(stays)
    tokens = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return rows.agg(n.alias("processed"), k.alias("kept"), (n - k).alias("dropped"), tokens(n_tokens).alias("tokens"), tokens(F.when(stays, n_tokens)).alias("kept_tokens"))


def limited(rows: DataFrame, seq: str, readable: Column, most: int) -> DataFrame:
    """rows with taken (among the first ``most`` readable ones by seq) and skipped (unreadable, met before these were full)."""
    ok = F.coalesce(readable, F.lit(False))
    out = order.running_total(rows, seq, ok.cast("long"), "__n")
    return out.withColumns({"taken": ok & (F.col("__n") <= most), "skipped": ~ok & (F.col("__n") < most)}).drop("__n")


def shuffled(rows: DataFrame, key: str = "doc_id", seed: int = 42) -> DataFrame:
    """rows with turn, from 0: their place in the order of a keyed MD5 of the key, the same at each run.

    Rows are ranked within 65,536 buckets of the digest, and bucket sizes are added up in one place.
    """
    luck = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))))
    d = rows.withColumn("__luck", luck).withColumn("__bucket", F.substring("__luck", 1, 4))
    sizes = d.groupBy("__bucket").agg(F.count(F.lit(1)).alias("__size"))
    before = sizes.select("__bucket", (F.sum("__size").over(W.orderBy("__bucket").rowsBetween(W.unboundedPreceding, 0)) - F.col("__size")).alias("__before"))
    inside = F.row_number().over(W.partitionBy("__bucket").orderBy("__luck", key)) - 1
    return d.withColumn("__inside", inside).join(before, "__bucket").withColumn("turn", (F.col("__before") + F.col("__inside")).cast("long")).drop("__luck", "__bucket", "__inside", "__before")


def train_validation(docs: DataFrame, share: float = 0.05, key: str = "doc_id", text: str = "text", seed: int = 42) -> DataFrame:
    """docs, shuffled, with turn and split: the last max(2, int(n * share)) rows are validation, or half of them, one at
    least, if there are no more than these. Rows of blank text go after splitting; validation texts are stripped."""
    n = docs.agg(F.count(F.lit(1)).alias("__n"))
    d = shuffled(docs, key, seed).crossJoin(F.broadcast(n))  # n is one row
    val = F.greatest(F.lit(2), F.floor(F.col("__n") * share))
    val = F.when(F.col("__n") <= val, F.greatest(F.lit(1), F.floor(F.col("__n") / 2))).otherwise(val)
    is_val = F.col("turn") >= F.col("__n") - val
    bare = T.strip(F.coalesce(F.col(text), F.lit("")))
    d = d.withColumn("split", F.when(is_val, "validation").otherwise("train")).where(bare != "")
    return d.withColumn(text, F.when(F.col("split") == "validation", T.strip(F.col(text))).otherwise(F.col(text))).drop("__n")


def token_table(split: DataFrame, text: str = "text", vocab: int = 50_257, end_id: int = 0) -> DataFrame:
    """split with ids: array<int> of hashed tokens (the engine's own tokenizer; no vocabulary file), closed by end_id."""
    ids = F.transform(T.tokens(F.coalesce(F.col(text), F.lit(""))), lambda t: (F.pmod(F.xxhash64(t), F.lit(vocab - 1)) + 1).cast("int"))
    return split.withColumn("ids", F.concat(ids, F.array(F.lit(end_id))))


def token_metadata(tokens: DataFrame, model: str, vocab: int = 50_257) -> DataFrame:
    """One row: base_model_name, vocab_size, documents and tokens of either split."""
    is_val, size = F.col("split") == "validation", F.size("ids").cast("long")
    of = lambda c: F.coalesce(F.sum(F.when(c, size)), F.lit(0)).cast("long")
    return tokens.agg(F.lit(model).alias("base_model_name"), F.lit(vocab).alias("vocab_size"), F.count_if(~is_val).alias("train_docs"), F.count_if(is_val).alias("val_docs"), of(~is_val).alias("train_tokens"), of(is_val).alias("val_tokens"))


def write_tokens(tokens: DataFrame, model: str, path: str) -> None:
    """Token arrays by split as Parquet in the order of turn, and their metadata as JSON beside them."""
    tokens.select("split", "turn", "ids").repartitionByRange("split", "turn").sortWithinPartitions("split", "turn").write.mode("overwrite").partitionBy("split").parquet(f"{path}/tokens")
    token_metadata(tokens, model).write.mode("overwrite").json(f"{path}/metadata")


def joined_tokens(parts: list[DataFrame], seq: str = "turn") -> DataFrame:
    """Token rows (seq, ids) of several streams as one, each stream's places behind those of the one before."""
    out = None
    for i, part in enumerate(parts):
        rows = part.select(F.lit(i).alias("stream"), F.col(seq).alias("seq"), "ids")
        out = rows if out is None else out.union(rows)
    return out


def sequence_batches(tokens: DataFrame, length: int, id_col: str = "doc_id", ids: str = "tokens") -> DataFrame:
    """(id, block_no, input, label): whole slices of length + 1 tokens; the input lacks the last, the label the first."""
    b = chunks.blocks(tokens.select(id_col, F.col(ids).alias("tokens")), length + 1, id_col)
    return b.select(id_col, "block_no", F.slice("tokens", 1, length).alias("input"), F.slice("tokens", 2, length).alias("label"))


def checked_range(ids: Column, vocab: int, length: int, first: int = 20_000) -> Column:
    """struct(ok, usable): whether the first tokens are below vocab, and how many make whole slices of length + 1."""
    most = F.array_max(F.slice(ids, 1, first))
    return F.struct(F.coalesce(most < vocab, F.lit(True)).alias("ok"), (F.floor(F.size(ids) / (length + 1)) * (length + 1)).cast("long").alias("usable"))


def batch_tokens(mask: Column, ids: Column) -> Column:
    """Tokens of a batch: the sum of its attention mask, or the number of its ids if it has none."""
    return F.coalesce(F.aggregate(mask, F.lit(0).cast("long"), lambda s, x: s + x.cast("long")), F.size(ids).cast("long"))


def by_length(rows: DataFrame, length: Column, seq: str) -> DataFrame:
    """rows in partitions of similar length, longest first, so batches cut from them have little padding; seq restores the order."""
    d = rows.withColumn("__length", length)
    return d.repartitionByRange(F.desc("__length"), F.col(seq)).sortWithinPartitions(F.desc("__length"), seq).drop("__length")


def restored(rows: DataFrame, seq: str) -> DataFrame:
    return rows.repartitionByRange(F.col(seq)).sortWithinPartitions(seq)


def page_windows(pages: DataFrame, size: int, id_col: str = "doc_id", n_pages: str = "n_pages") -> DataFrame:
    """(id, window_no, first_page, last_page), pages from 1: windows of max(2, size) pages that share one page."""
    size = max(2, size)
    w = pages.select(id_col, n_pages, F.posexplode(chunks.windows(F.col(n_pages), size, 1)).alias("window_no", "start"))
    return w.select(id_col, "window_no", (F.col("start") + 1).cast("int").alias("first_page"), F.least(F.col("start") + size, F.col(n_pages)).cast("int").alias("last_page"))


def clean_of_headers(chunks_: DataFrame, least_chars: int = 300, id_col: str = "doc_id", source: str = "source") -> DataFrame:
    """(id, source, text, token_count) of a whole corpus without running headers, chunks that become too short left out."""
    out = chunks.strip_boilerplate(chunks_, id_col, source)
    return out.where(F.char_length(T.strip(F.col("text"))) >= least_chars).withColumn("token_count", T.token_count(F.col("text")))
