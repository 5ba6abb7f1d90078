"""Scans and sinks: documents, JSON lines, evaluation files, trace CSVs and metrics."""

from __future__ import annotations

from collections.abc import Callable
from html import unescape

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as D

from siltstone.sources.shared import fresh_path as shared_path  # noqa: F401

#: Columns of a trace file (fixed values).
TRACE_FIELDS = ["eval_num", "seq_num", "prompt", "target_answer", "model_output", "matching_score", "result", "category", "checkpoint_name", "timestamp"]


def document_files(spark: SparkSession, path: str, kinds: tuple[str, ...] = ("pdf", "txt", "html")) -> DataFrame:
    """(path, name, content) of files below path with these endings in any case; any store Spark reads, s3a too."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.where(F.lower("path").rlike(rf"\.({'|'.join(kinds)})$")).select("path", F.regexp_extract("path", "([^/]+)$", 1).alias("name"), "content")


def json_lines(spark: SparkSession, path: str, schema: str, strict: bool = False) -> DataFrame:
    """JSON lines; blank lines go. Malformed lines are errors if strict, else left out."""
    if strict:
        return spark.read.option("mode", "FAILFAST").schema(schema).json(path)
    return json_lines_counted(spark, path, schema)[0]


def with_ids(rows: DataFrame) -> DataFrame:
    """Rows with doc_id from id, else doc_id; rows without either or without text go."""
    known = [F.nullif(F.col(c).cast("string"), F.lit("")) for c in ("id", "doc_id") if c in rows.columns]
    return rows.withColumn("doc_id", F.coalesce(*known)).where("doc_id is not null and text <> ''")


def cloze_items(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("multiLine", True).schema("prompt string, target_term string, category string").json(path)


def aligned(spark: SparkSession, prompts: str, references: str) -> DataFrame:
    """(seq, prompt, reference) of two JSON arrays of strings of the same length."""
    def read(path: str):
        return spark.read.option("wholetext", True).text(path).select(F.from_json("value", "array<string>").alias("a"))

    both = read(prompts).select(F.col("a").alias("p")).crossJoin(read(references).select(F.col("a").alias("r")))
    both = both.withColumn("p", F.when(F.size("p") == F.size("r"), F.col("p")).otherwise(F.raise_error(F.lit("prompts and references differ in number")).cast("array<string>")))
    return both.select(F.posexplode(F.arrays_zip("p", "r")).alias("seq", "x")).select("seq", F.col("x.p").alias("prompt"), F.col("x.r").alias("reference"))


def json_lines_counted(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(rows of JSON lines, one row with skipped: how many lines could not be read); blank lines are neither."""
    # By way of text, as Spark's JSON scan refuses to read the corrupt lines alone.
    lines = spark.read.text(path).where(F.trim("value") != "")
    read = F.from_json("value", f"{schema}, _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    rows = lines.select(read.alias("r"))
    bad = F.col("r").isNull() | F.col("r._corrupt").isNotNull()
    return rows.where(~bad).select("r.*").drop("_corrupt"), rows.agg(F.count_if(bad).alias("skipped"))


def first_items(spark: SparkSession, path: str, schema: str, most: int) -> tuple[DataFrame, int, int]:
    """(the first ``most`` readable rows of a folder's JSON lines, how many unreadable lines stand before the last of them, files read).

    Lines are in the order of file names, then of places in the file. Files are read in groups of 1, 2, 4 and so on until there are
    enough rows, so what is read depends on most and not on the folder. Of a group only counts reach the driver.
    """
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    listed = where.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(where)
    files = sorted(f.getPath().toString() for f in listed if f.isFile() and f.getPath().getName()[0] not in "._")
    read = F.from_json("value", f"{schema}, _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    order = ["_file", "_block", "_line"]
    out, got, skipped, at, step = None, 0, 0, 0, 1
    while got < most and at < len(files):
        lines = spark.read.text(files[at : at + step]).select("value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_line"))
        rows = lines.where(F.trim("value") != "").select(read.alias("r"), *order)
        rows = rows.withColumn("_ok", F.col("r").isNotNull() & F.col("r._corrupt").isNull())
        n = rows.agg(F.count_if("_ok").alias("ok"), F.count_if(~F.col("_ok")).alias("bad")).first()
        some = rows.where("_ok")
        if got + n.ok > most:
            some = some.orderBy(*order).limit(most - got)
            last = some.orderBy(*[F.desc(c) for c in order]).select(*order).first()
            skipped += rows.where(~F.col("_ok") & (F.struct(*order) < F.struct(F.lit(last[0]).alias("_file"), *[F.lit(v).cast("long").alias(c) for c, v in zip(order[1:], last[1:])]))).count()
        else:
            skipped += n.bad
        some = some.select("r.*").drop("_corrupt")
        out = some if out is None else out.unionByName(some)
        got, at, step = got + n.ok, at + step, step * 2
    return (spark.createDataFrame([], schema) if out is None else out), skipped, min(at, len(files))


def write_json_lines(rows: DataFrame, path: str, mode: str = "errorifexists") -> None:
    rows.write.mode(mode).json(path)


def trace_files(spark: SparkSession, path: str) -> DataFrame:
    """Trace CSVs below path: ten fields as text, missing ones empty, numbers 0 where they can't be read, with file, modified
    and batch, from 0 for the newest file by (modified, file).

    Each file is read by its own header: files are grouped by their first lines, of which there are few, and a line a file
    reaches the driver.
    """
    reader = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv")
    lines = reader.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_modification_time").alias("modified"), F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("line"))
    heads = lines.where("at = 0").groupBy("file").agg(F.min_by("value", "line").alias("head"), F.max("modified").alias("modified")).collect()
    if not heads:
        kinds = ", ".join(f"{f} {dict(seq_num='int', matching_score='double').get(f, 'string')}" for f in TRACE_FIELDS)
        return spark.createDataFrame([], f"{kinds}, file string, modified timestamp, batch int")
    by_head: dict[str, list[str]] = {}
    for r in heads:
        by_head.setdefault(r["head"], []).append(r["file"])
    out = None
    for files in by_head.values():
        rows = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(files)
        fields = [F.coalesce(F.col(f"`{f}`").cast("string"), F.lit("")).alias(f) if f in rows.columns else F.lit("").alias(f) for f in TRACE_FIELDS]
        rows = rows.select(*fields, F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_modification_time").alias("modified"))
        out = rows if out is None else out.union(rows)
    newest = sorted(heads, key=lambda r: (r["modified"], r["file"]), reverse=True)
    batches = spark.createDataFrame([(r["file"], i) for i, r in enumerate(newest)], "file string, batch int")
    out = out.withColumns({"seq_num": F.coalesce(F.col("seq_num").try_cast("int"), F.lit(0)), "matching_score": F.coalesce(F.col("matching_score").try_cast("double"), F.lit(0.0))})
    return out.join(batches, "file").select(*TRACE_FIELDS, "file", "modified", "batch")


def scanner(spark: SparkSession, kind: str, path: str) -> DataFrame:
    """document_files of a store: local (or windows), by a path of this file system, or s3, by bucket and prefix."""
    if kind in ("local", "windows"):
        return document_files(spark, path)
    if kind == "s3":
        return document_files(spark, path if path.startswith("s3a://") else f"s3a://{path.removeprefix('s3://')}")
    raise ValueError(f"unknown store: {kind}")


def read_metrics(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Metrics that append_metrics wrote; lines that can't be read are left out, and no file at all gives no rows."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return spark.createDataFrame([], schema)
    return json_lines(spark, path, schema)


def write_index(vectors: DataFrame, chunks: DataFrame, path: str) -> DataFrame:
    """A vector index as Parquet (chunk_id, normalised vector) beside its chunks; returns its manifest: chunks, tokens."""
    from siltstone.operators.retrieval import normalised

    vectors.select("chunk_id", normalised(F.col("vector")).alias("vector")).write.mode("overwrite").parquet(f"{path}/vectors")
    chunks.write.mode("overwrite").parquet(f"{path}/chunks")
    manifest = chunks.agg(F.count(F.lit(1)).alias("chunks"), F.coalesce(F.sum("token_count"), F.lit(0)).alias("tokens"))
    manifest.write.mode("overwrite").json(f"{path}/manifest")
    return manifest


def with_cached_vectors(chunks: DataFrame, cache: DataFrame, embed: Callable[[Column], Column], text: str = "text") -> DataFrame:
    """chunks with key, the SHA-256 of the text, and vector: from the cache (key, vector), else embedded. A changed text has another
    key, so a stale vector is never used; write key and vector of the result for the next time."""
    keyed = chunks.withColumn("key", F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256))
    met = keyed.join(cache.select("key", F.col("vector").alias("__known")).dropDuplicates(["key"]), "key", "left")
    return met.withColumn("vector", F.coalesce("__known", embed(F.col(text)))).drop("__known")


def append_metrics(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


@F.pandas_udf(D.StringType())
def unescaped(text: pd.Series) -> pd.Series:
    """All named and numeric entities resolved, for which Spark has no table."""
    return text.map(lambda t: unescape(t) if t and "&" in t else t)


def html_text(html: str = "html"):
    """Plain text of an HTML column: scripts and styles cut, tags to spaces, entities decoded. Null: empty."""
    t = F.regexp_replace(F.coalesce(F.col(html), F.lit("")), r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " ")
    t = F.regexp_replace(t, r"(?s)<(?=[a-zA-Z/!?])[^>]*>", " ")
    return F.trim(F.regexp_replace(unescaped(t), r"[\s\u00a0]+", " "))
