"""Order-dependent operators without a global window: rows are ordered in range partitions, whose totals are added up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siltstone.sources.shared import written


def running_total(df: DataFrame, seq: str, value: Column, out: str) -> DataFrame:
    """df with the sum of value over rows up to this one in the order of seq (unique; rows without one go).

    Numbers and values alone are range-partitioned and written, as the borders of ranges may move if a lost part is made again; sums of
    the partitions, a row each, are added up in one place, and rows are met by seq. How the numbers are spread doesn't matter.
    """
    narrow = df.select(F.col(seq).alias("__seq"), value.alias("__value")).where("__seq is not null")
    d = written(narrow.repartitionByRange(F.col("__seq")).withColumn("__part", F.spark_partition_id()), "ordered")
    sums = d.groupBy("__part").agg(F.sum("__value").alias("__sum"))
    before = sums.select("__part", (F.sum("__sum").over(W.orderBy("__part").rowsBetween(W.unboundedPreceding, 0)) - F.col("__sum")).alias("__before"))
    inside = F.sum("__value").over(W.partitionBy("__part").orderBy("__seq").rowsBetween(W.unboundedPreceding, 0))
    total = d.withColumn("__inside", inside).join(F.broadcast(before), "__part").select("__seq", (F.col("__before") + F.col("__inside")).alias(out))
    return df.join(total, F.col(seq) == F.col("__seq")).drop("__seq")


def reindex(df: DataFrame, seq: str, template: str = "domain_doc_%06d") -> DataFrame:
    """df with new_id, counted from 0 in the order of seq."""
    return running_total(df, seq, F.lit(1).cast("long"), "__n").withColumn("new_id", F.format_string(template, F.col("__n") - 1)).drop("__n")


def token_budget(df: DataFrame, seq: str, n_tokens: str, budget: int) -> DataFrame:
    """Rows in order until their tokens reach the budget, the crossing row included; adds cumulative."""
    out = running_total(df.where(F.col(n_tokens) > 0), seq, F.col(n_tokens), "cumulative")
    return out.where(F.col("cumulative") - F.col(n_tokens) < budget)


def exact_cut(df: DataFrame, seq: str, n_tokens: str, budget: int) -> DataFrame:
    """Like token_budget, the crossing row giving only what is left: adds taken."""
    out = token_budget(df, seq, n_tokens, budget)
    return out.withColumn("taken", F.least(F.col(n_tokens), budget - (F.col("cumulative") - F.col(n_tokens))))
