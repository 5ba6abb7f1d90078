"""Looking up words of texts in tables of any size, and putting what is found back into the texts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions import text as T
from siltstone.sources.shared import written

#: Up to so many rows of what was found are broadcast; beyond, keys that hold one row in so many are, HOT_SHARE at most.
BROADCAST_ROWS = 200_000
HOT_SHARE = 1_000


def met(asked: DataFrame, table: DataFrame, key: str = "word") -> DataFrame:
    """asked joined with table by key (unique in table; rows of asked without a match go).

    Only the distinct keys of asked meet the table, counted, so that nothing of a frequent key is shuffled twice. What they
    find is broadcast if it is small, by count; if not, the hot keys alone are, of which there are HOT_SHARE at most by
    their counts, and the others are shuffled.
    """
    found = written(asked.groupBy(key).agg(F.count(F.lit(1)).alias("__often")).join(table, key), "lookup")
    plain = found.drop("__often")
    if found.count() <= BROADCAST_ROWS:
        return asked.join(F.broadcast(plain), key)
    total = found.agg(F.sum("__often")).first()[0]
    is_hot = F.col("__often") * HOT_SHARE > total
    hot = F.broadcast(found.where(is_hot).drop("__often"))
    rest = asked.join(hot.select(key), key, "left_anti").join(found.where(~is_hot).drop("__often").hint("merge"), key)
    return asked.join(hot, key).unionByName(rest)


def looked_up(rows: DataFrame, asked: Column, table: DataFrame, out: str, stored: bool = False) -> DataFrame:
    """rows with ``out``, a map from those of the words ``asked`` (an array) that are in table (word, value) to their values.

    Rows that ask the same share one answer, found under a digest of the words. What is found is broadcast
    if it is small, by count; if not, rows are shuffled, but for those that ask nothing. As rows are
    read three times, they are written first, unless the caller has stored them.
    """
    d = rows.withColumn("__asked", F.array_sort(F.array_distinct(F.coalesce(asked, F.array().cast("array<string>")))))
    d = d if stored else written(d, "asking")
    d = d.withColumn("__digest", F.md5(F.array_join("__asked", "\0")))
    some, none = d.where(F.size("__asked") > 0), d.where(F.size("__asked") == 0)
    pairs = some.select("__digest", "__asked").distinct().select("__digest", F.explode("__asked").alias("word"))
    found = written(met(pairs, table).groupBy("__digest").agg(F.map_from_entries(F.collect_list(F.struct("word", "value"))).alias(out)), "found")
    empty = F.map_from_arrays(F.array(), F.array()).cast(found.schema[out].dataType)
    if (found.agg(F.sum(F.size(out))).first()[0] or 0) <= BROADCAST_ROWS:  # words found, so the rows needn't be shuffled
        return d.join(F.broadcast(found), "__digest", "left").withColumn(out, F.coalesce(out, empty)).drop("__asked", "__digest")
    both = some.join(found, "__digest", "left").withColumn(out, F.coalesce(out, empty)).unionByName(none.withColumn(out, empty))
    return both.drop("__asked", "__digest")


def replaced(text: Column, pattern: str, by: Callable[[Column], Column]) -> Column:
    """text with each match of the pattern, as in a scan from the left, replaced by what ``by`` makes of it; linear in the text."""
    between, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def whole(x: Column) -> Column:
        return F.array_join(F.zip_with(x["between"], F.concat(F.transform(x["found"], by), F.array(F.lit(""))), lambda a, b: F.concat(a, b)), "")

    return F.when(text.rlike(pattern), T.let(F.struct(between.alias("between"), found.alias("found")), whole)).otherwise(text)
