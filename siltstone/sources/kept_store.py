"""The kept trace store: Parquet by probe and run, of which an upsert rewrites only the partitions it touches; and its directory sync."""

from __future__ import annotations

import csv
import io
import itertools
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from siltstone.operators import trace_store, traces
from siltstone.sources.shared import delete, exists

PARTS = ["probe", "run_id"]
#: Partitions that a batch touches are broadcast to prune the store's scan if they are at most so many.
MOST_BROADCAST = 10_000
FIELDS = ["seq_num", "prompt", "target_answer", "model_output", "matching_score", "result", "category", "error_category", "notes", "timestamp"]


def _folders(spark: SparkSession, path: str) -> list[str]:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(f.getPath().toString() for f in fs.listStatus(where)) if fs.exists(where) else []


def applied(spark: SparkSession, path: str) -> DataFrame:
    """(batch_id, probe, n): rows that each batch brought, by probe."""
    schema = "batch_id long, probe string, n long"
    found = f"{path}/_applied"
    return spark.read.schema(schema).parquet(found).distinct() if exists(spark, found) else spark.createDataFrame([], schema)


def _publish(spark: SparkSession, path: str, staged: str) -> None:
    """Put staged partitions in the place of the store's, note the batch, and drop the stage: the same however often it is begun."""
    new = spark.read.schema(trace_store.STORE_SCHEMA).parquet(f"{staged}/data")
    new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*PARTS).parquet(f"{path}/data")
    spark.read.parquet(f"{staged}/counts").write.mode("append").parquet(f"{path}/_applied")
    delete(spark, staged)


def recover(spark: SparkSession, path: str) -> int:
    """Finish what a failed write has staged as a whole, drop what it has staged in part; how many batches were finished."""
    done = 0
    for staged in _folders(spark, f"{path}/_staged"):
        if exists(spark, f"{staged}/counts/_SUCCESS"):  # written last
            _publish(spark, path, staged)
            done += 1
        else:
            delete(spark, staged)
    return done


def load(spark: SparkSession, path: str) -> DataFrame:
    """The store's rows; none if there is no store yet."""
    if exists(spark, f"{path}/data"):
        return spark.read.schema(trace_store.STORE_SCHEMA).parquet(f"{path}/data")
    return spark.createDataFrame([], trace_store.STORE_SCHEMA)


def upsert(spark: SparkSession, path: str, new: DataFrame, batch_id: int | None = None) -> DataFrame:
    """Merge new (the store's columns and batch) into the store at path by the rules of traces.upsert; rows by probe.

    Only the partitions of new's probes and runs are read and written. They are staged whole, then published; a write that fails
    in between is finished or dropped by the next one. A batch_id that was applied before changes nothing. One writer at a time.
    """
    recover(spark, path)
    if batch_id is not None and not applied(spark, path).where(F.col("batch_id") == batch_id).isEmpty():
        return applied(spark, path).where(F.col("batch_id") == batch_id).select("probe", "n")
    staged = f"{path}/_staged/{uuid.uuid4().hex if batch_id is None else f'{batch_id:020d}'}"
    new.write.parquet(f"{staged}/new")
    new = spark.read.schema(new.schema).parquet(f"{staged}/new")
    touched = new.select(*PARTS).distinct()
    few = touched.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST
    there = load(spark, path).join(F.broadcast(touched) if few else touched, PARTS, "left_semi")
    out = traces.upsert(there, new, ["probe", *traces.KEYS])
    out.repartition(*PARTS, F.pmod(F.xxhash64("seq_num"), F.lit(16))).write.partitionBy(*PARTS).parquet(f"{staged}/data")
    counts = new.groupBy("probe").agg(F.count(F.lit(1)).alias("n")).select(F.lit(batch_id).cast("long").alias("batch_id"), "probe", "n")
    counts.coalesce(1).write.parquet(f"{staged}/counts")
    told = spark.createDataFrame(counts.select("probe", "n").collect(), "probe string, n long")  # a row a probe
    _publish(spark, path, staged)
    return told


#: Rows of a file that a task makes at a time.
ROWS_AT_ONCE = 5_000


def _rows_of_files(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows of whole CSV files by their own headers, as text, some at a time; missing fields are empty."""
    names = ["path", "modified", "place", *FIELDS]
    for files in batches:
        for name, modified, content in zip(files["path"], files["modificationTime"], files["content"]):
            # Decoded as it is read: neither the whole text nor all rows of a file stand in memory beside its bytes.
            read = csv.DictReader(io.TextIOWrapper(io.BytesIO(content), "utf-8", "replace", newline=""))
            rows = ((name, modified, i, *[r.get(f) or "" for f in FIELDS]) for i, r in enumerate(read))
            while some := list(itertools.islice(rows, ROWS_AT_ONCE)):
                yield pd.DataFrame(some, columns=names)


def file_rows(files: DataFrame, now: str = "") -> DataFrame:
    """The store's rows, with batch, of CSV files (path, modificationTime, content): metadata by path, defaults by trace_store.ingested,
    batch from 0 for the newest file. A file is one value, and its rows are made in one task."""
    kinds = ", ".join(f"{f} string" for f in FIELDS)
    read = files.select("path", "modificationTime", "content").mapInPandas(_rows_of_files, f"path string, modified timestamp, place long, {kinds}")
    order = trace_store.newest_first(files.select("path", F.col("modificationTime").alias("modified")).distinct(), "modified", "path").select("path", "batch")
    d = read.join(order, "path").select("*", trace_store.path_metadata(F.col("path")).alias("m")).select("*", "m.*").drop("m")
    made = trace_store.ingested(d, now)
    names = [x.split()[0] for x in trace_store.STORE_SCHEMA.split(", ")]
    return made.select(*names, "batch")


def sync(spark: SparkSession, folder: str, path: str, checkpoint: str, files_a_batch: int = 1_000) -> StreamingQuery:
    """Begin to merge CSV files below folder that are new since the checkpoint into the store at path, and end when all are in.

    Each batch of the stream is one upsert under its number, so a batch that is begun again changes nothing. Within a batch the oldest
    file's rows stay, as for a whole directory; later batches win over earlier ones.
    """
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv").option("maxFilesPerTrigger", files_a_batch).load(folder)
    put = lambda batch, number: upsert(batch.sparkSession, path, file_rows(batch), number) and None
    return files.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def write_trace_files(rows: DataFrame, path: str, legacy: bool = False) -> list[str]:
    """Write rows (run_id, probe, eval_num and a trace file's fields), a file for each run, probe and evaluation, and return their paths:
    run/probe/eval_0001.csv, or the older probe/run_eval_0001.csv. Files of other evaluations stay, one of the same is replaced.

    Spark writes a folder for each; its one file is then renamed on the driver, a call a file.
    """
    spark = rows.sparkSession
    staged = f"{path}/_staged-{uuid.uuid4().hex}"
    keys = ["run_id", "probe", "eval_num"]
    d = rows.withColumn("probe", trace_store.category_name(F.col("probe")))
    d.repartition(*keys).sortWithinPartitions(*keys, "seq_num").write.partitionBy(*keys).option("header", True).option("escape", '"').csv(staged)
    jvm = spark._jvm.org.apache.hadoop.fs.Path
    out = []
    for run in (f for f in _folders(spark, staged) if "run_id=" in f):
        for probe in _folders(spark, run):
            for number in _folders(spark, probe):
                value = lambda f: f.rstrip("/").rsplit("=", 1)[1]
                name = f"eval_{int(value(number)):04d}.csv"
                target = f"{path}/{value(probe)}/{value(run)}_{name}" if legacy else f"{path}/{value(run)}/{value(probe)}/{name}"
                fs = jvm(target).getFileSystem(spark._jsc.hadoopConfiguration())
                fs.mkdirs(jvm(target).getParent())
                fs.delete(jvm(target), False)
                part = next(f for f in _folders(spark, number) if f.endswith(".csv"))
                if not fs.rename(jvm(part), jvm(target)):
                    raise RuntimeError(f"cannot move {part} to {target}")
                out.append(target)
    delete(spark, staged)
    return out
