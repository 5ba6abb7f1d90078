"""Window chunking, line-frequency boilerplate and fixed blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siltstone.functions import text as T


def windows(length: Column, size: int, overlap: int) -> Column:
    """Starts (from 0) of windows of ``size`` with ``overlap``; the first that reaches the end is the last."""
    step = size - overlap if size > overlap else size
    n = F.when(length <= size, F.lit(1)).otherwise(F.ceil((length - size) / step).cast("int") + 1)
    return F.when(length > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: i * step)).otherwise(F.array().cast("array<int>"))


def chunk(docs: DataFrame, size: int, overlap: int, id_col: str = "doc_id") -> DataFrame:
    """(id, chunk_no, text, token_count) of overlapping windows of whitespace words; empty texts give no rows."""
    w = docs.select(id_col, F.filter(F.split(F.col("text"), r"\s+"), lambda x: x != "").alias("w"))
    w = w.select(id_col, "w", F.posexplode(windows(F.size("w"), size, overlap)).alias("chunk_no", "start"))
    piece = F.slice("w", F.col("start") + 1, size)
    return w.select(id_col, "chunk_no", F.array_join(piece, " ").alias("text"), F.size(piece).alias("token_count"))


def boilerplate_lines(chunks: DataFrame, source: str = "source", most: int = 15, share: float = 0.10, longest: int = 79) -> DataFrame:
    """(source, line, n): stripped lines of up to 79 characters that stand in a source of at least three chunks at
    least min(15, max(3, int(share * chunks))) times, every occurrence counted."""
    sizes = chunks.groupBy(source).agg(F.count(F.lit(1)).alias("chunks")).where("chunks >= 3")
    lines = chunks.select(source, F.explode(F.split("text", "\n")).alias("line")).select(source, T.strip(F.col("line")).alias("line"))
    counts = lines.where(F.char_length("line").between(1, longest)).groupBy(source, "line").agg(F.count(F.lit(1)).alias("n"))
    need = F.least(F.lit(most), F.greatest(F.lit(3), F.floor(F.col("chunks") * share)))
    return counts.join(sizes, source).where(F.col("n") >= need).select(source, "line", "n")


def strip_boilerplate(chunks: DataFrame, id_col: str = "doc_id", source: str = "source") -> DataFrame:
    """chunks' id, source and text without boilerplate lines; order of lines is kept."""
    common = boilerplate_lines(chunks, source).select(source, F.col("line").alias("common"))
    lines = chunks.select(id_col, source, F.posexplode(F.split("text", "\n")).alias("pos", "line")).withColumn("common", T.strip(F.col("line")))
    kept = lines.join(common, [source, "common"], "left_anti")
    back = kept.groupBy(id_col).agg(F.sort_array(F.collect_list(F.struct("pos", "line"))).alias("lines"))
    back = back.select(id_col, F.array_join("lines.line", "\n").alias("kept"))
    return chunks.join(back, id_col, "left").select(id_col, source, F.coalesce("kept", F.lit("")).alias("text"))


def blocks(tokens: DataFrame, block: int, id_col: str = "doc_id") -> DataFrame:
    """(id, block_no, tokens): whole blocks of a token array; the tail is dropped."""
    n = F.floor(F.size("tokens") / block).cast("int")
    starts = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    made = tokens.select(id_col, "tokens", F.explode(starts).alias("block_no"))
    return made.select(id_col, "block_no", F.slice("tokens", F.col("block_no") * block + 1, block).alias("tokens"))


def lexicon(docs: DataFrame, least: int = 3) -> DataFrame:
    """(word, n): words of four or more ASCII letters that stand at least three times."""
    each = docs.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{4,}"), F.lit(0))).alias("word"))
    return each.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
