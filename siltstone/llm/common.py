"""Helpers that the training-data operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of characters other than space and U+0009 to U+000D.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or, where all runs in one process, a local one."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = f"file://{tempfile.mkdtemp(prefix='siltstone-')}"
        sc.setCheckpointDir(found)
        found = sc.getCheckpointDir() or found
    return found


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


#: For each ``settled`` in progress, the tables written since it began.
_OPEN: list[list[DataFrame]] = []


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage of df: write it as Parquet in the shared folder and read that back."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._siltstone_path = path
    if _OPEN:
        _OPEN[-1].append(out)
    return out


def settled(make: Callable[[], DataFrame], name: str) -> DataFrame:
    """What make returns, written; the tables that it wrote on the way are deleted."""
    _OPEN.append([])
    try:
        out = written(make(), name)
    finally:
        made = _OPEN.pop()
    for table in made[:-1]:
        discard(table)
    if _OPEN:
        _OPEN[-1].append(out)
    return out


def discard(df: DataFrame) -> None:
    """Delete what ``written`` stored, when nothing will read it again."""
    path = getattr(df, "_siltstone_path", None)
    if path:
        spark = df.sparkSession
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def boxed(docs: DataFrame, **made: Column) -> DataFrame:
    """docs as one struct column ``row`` beside the columns made from it, so that no name of docs can clash."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *[c.alias(n) for n, c in made.items()])


def unboxed(df: DataFrame, columns: list[str], *more: str) -> DataFrame:
    """The reverse of boxed; the named new columns take the place of old ones of the same name."""
    lower = {m.lower() for m in more}
    return df.select(*[F.col("row").getField(c).alias(c) for c in columns if c.lower() not in lower], *more)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """Connected components by alternating large-star and small-star rounds.

    edges: columns a and b of one orderable type; no nulls. Returns (node, component) for each node that has an
    edge, component being the smallest node reachable. Each round is written to the shared folder, so a lost
    executor costs one round at most, and only per-key minima are aggregated: no adjacency list is ever gathered.
    """
    now = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
    mark, done = None, now.isEmpty()
    while not done:
        both = now.select("a", "b").union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").union(least.select("a", F.col("m").alias("b"))).distinct()
        after = written(small, name)
        seen = after.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        discard(now)
        now = after
        mark, done = seen, seen == mark
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


#: Rows that go to a Python worker at once. Texts are long, and the JVM, the worker and Arrow each hold a batch.
ARROW_ROWS = 1_000
_ARROW_SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"


def map_arrow(df: DataFrame, work: Callable, schema: str) -> DataFrame:
    """mapInArrow with small batches; the session's setting is lowered if it is larger (0 means no bound)."""
    conf = df.sparkSession.conf
    if not 0 < int(conf.get(_ARROW_SETTING, "10000")) <= ARROW_ROWS:
        conf.set(_ARROW_SETTING, str(ARROW_ROWS))
    return df.mapInArrow(work, schema)
