"""A corpus pipeline: quality, line dedup, near-duplicate documents, mixing to target weights, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which ``run`` writes and reads again as the next
stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from siltstone.llm import lines, mixing, packing, quality, simhash
from siltstone.llm.common import discard, written


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that importance resampling keeps; the labels come from sf_dir."""
    _, kept = quality.resample(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return kept


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines of 24 characters or more that repeat earlier ones, or are one character apart; n_chars follows the text."""
    return _counted(lines.without_repeated_lines(docs, exact=lines.MIN_CHARS, words=None), docs)


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: fingerprints of 24 words over five-word shingles, and a Jaccard
    similarity of 0.8 or more to the document that stays."""
    return simhash.one_each(docs, shingle=5, similarity=0.8)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources: documents left out, taken, cut short or repeated as the targets ask."""
    return _counted(mixing.mix(docs), docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in windows of 4,096 tokens, with their ids."""
    return packing.pack(docs, packing.vocabulary())


def _counted(out: DataFrame, docs: DataFrame) -> DataFrame:
    from pyspark.sql import functions as F

    return out.withColumn("n_chars", F.char_length("text").cast("long")).select(docs.columns) if "n_chars" in docs.columns else out


STAGES = [("quality classifier", quality_stage), ("line dedup", line_stage), ("SimHash near-dedup", simhash_stage), ("mixing", mixing_stage), ("packing", packing_stage)]

#: No stage but mixing can be told in SQL, so the tests hold run() against a brute-force version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before, docs = docs, written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        discard(before)  # what the stage before wrote; the input has no such path
    return STAGES[-1][1](spark, docs, sf_dir)
