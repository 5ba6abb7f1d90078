"""Ranks with ties inside groups: multiplicity compression, range-partitioned weighted prefix sums, sequences exploded.

Nothing that grows with the input goes through one task, to the driver or into a broadcast: a group of any size is cut
into the chunks of a range partitioning, and a row that stands any number of times is carried as a count until the end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import written

#: A pair of group and rank key is hot if it holds one row in so many; there are at most so many hot ones.
HOT_SHARE = 1_000
#: Equal rows are exploded in blocks of so many, dealt out anew.
BLOCK = 4_096
#: Chunks of a range partitioning for each shuffle partition, so that chunks of a hot group spread evenly.
CHUNKS = 4


def _ordered(names: list[str]) -> list[Column]:
    """A name that begins with a minus sign is descending; nulls are last either way."""
    return [F.col(n[1:]).desc_nulls_last() if n[0] == "-" else F.col(n).asc_nulls_last() for n in names]


def prefix_sums(rows: DataFrame, keys: list[str], order: list[str], weight: str, name: str = "ranged") -> DataFrame:
    """Adds before (the weights of earlier rows with the same keys) and nth (their number plus one).

    The rows, which differ in keys and order, are range-partitioned by both and written with the number of their chunk, as
    the borders of a range partitioning may move if a lost part is made again. Sums are then taken inside chunks; of each
    chunk only the first keys can have begun in an earlier one, and what they had there comes in as one more row, so
    that no join is needed. Null keys are equal to each other.
    """
    n = CHUNKS * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = written(rows.repartitionByRange(n, *_ordered(keys), *_ordered(order)).withColumn("_chunk", F.spark_partition_id()), name)
    earlier = W.partitionBy(*keys).orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1)
    parts = ranged.groupBy(*keys, "_chunk").agg(F.sum(weight).alias("_w"), F.count(F.lit(1)).alias("_c"))
    carried = parts.select(*keys, "_chunk", F.sum("_w").over(earlier).alias("_w"), F.sum("_c").over(earlier).alias("_c")).where("_c > 0")
    rest = [c for c in ranged.columns if c not in (*keys, "_chunk")]
    both = ranged.select(*keys, "_chunk", F.lit(1).alias("_own"), F.col(weight).cast("long").alias("_w"), F.lit(1).cast("long").alias("_c"), *rest)
    both = both.unionByName(carried.withColumn("_own", F.lit(0)), allowMissingColumns=True)
    run = W.partitionBy(*keys, "_chunk").orderBy("_own", *_ordered(order)).rowsBetween(W.unboundedPreceding, 0)
    both = both.select(*keys, *rest, "_own", (F.sum("_w").over(run) - F.col("_w")).alias("before"), F.sum("_c").over(run).alias("nth"))
    return both.where("_own = 1").drop("_own")


def ranked_ties(rows: DataFrame, group: list[str], rank: list[str], ties: list[str], most: int = 5) -> DataFrame:
    """The rows of the first ``most`` places of each group, one by one, with pos, place and tied.

    rank and ties name the columns of the order, descending with a minus sign before the name; nulls are last and equal to
    each other. place is 1 plus the number of different earlier values of the rank columns in the group, tied the number of the
    group's rows with the same ones, and pos counts rows from 1 by rank, then by ties. Rows that agree in all named columns are told
    apart by pos only. Null groups are groups. Other columns of rows are not looked at and not returned, so none can clash;
    an empty table gives an empty one.
    """
    names = lambda cs: [c.removeprefix("-") for c in cs]
    sign = lambda c: "-" if c[0] == "-" else ""
    g, r, t = ([f"{k}{i}" for i in range(len(cs))] for k, cs in (("g", group), ("r", rank), ("t", ties)))
    d = rows.select(*[F.col(f"`{c}`").alias(k) for c, k in zip([*group, *names(rank), *names(ties)], [*g, *r, *t])])
    by_rank = [sign(c) + k for c, k in zip(rank, r)]
    by_ties = [sign(c) + k for c, k in zip(ties, t)]
    # Places: equal values of the rank columns are one row with a count.
    values = prefix_sums(d.groupBy(*g, *r).agg(F.count(F.lit(1)).alias("tied")), g, by_rank, "tied", "rank-values")
    places = written(values.where(F.col("nth") <= most).select(*g, *r, "tied", F.col("nth").alias("place"), F.col("before").alias("ahead")), "places")
    # Rows of those places. What is hot is joined by a broadcast of at most HOT_SHARE rows, the rest by a shuffle.
    total = d.agg(F.count(F.lit(1)).alias("n")).first().n
    at = [*g, *r]
    same = lambda a, b: [a[k].eqNullSafe(b[f"h_{k}"]) for k in at]
    named = places.select(*[F.col(k).alias(f"h_{k}") for k in at], "tied", "place", "ahead")
    is_hot = F.col("tied") * HOT_SHARE > total
    hot, cold = F.broadcast(named.where(is_hot)), named.where(~is_hot).hint("merge")
    found = [d.join(hot, same(d, hot)), d.join(hot, same(d, hot), "left_anti").join(cold, same(d, cold))]
    found = [f.groupBy(*g, "place", "tied", "ahead", *r, *t).agg(F.count(F.lit(1)).alias("n")) for f in found]
    counted = prefix_sums(found[0].union(found[1]), [*g, "place"], by_ties, "n", "tie-values")
    counted = written(counted.withColumn("low", F.col("ahead") + F.col("before") + 1), "ranked-ties")
    few, many = counted.where(F.col("n") <= BLOCK), counted.where(F.col("n") > BLOCK)
    steps = many.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(n - 1) div {BLOCK}"))).alias("step")).repartition(*g, "low", "step")
    ends = F.least(F.col("n"), (F.col("step") + 1) * BLOCK)
    each = few.select("*", F.explode(F.sequence(F.col("low"), F.col("low") + F.col("n") - 1)).alias("pos"))
    each = each.unionByName(steps.select("*", F.explode(F.sequence(F.col("low") + F.col("step") * BLOCK, F.col("low") + ends - 1)).alias("pos")).drop("step"))
    return each.select(*[F.col(k).alias(c) for k, c in zip([*g, *r, *t], [*group, *names(rank), *names(ties)])], "pos", "place", "tied")


def _cents(c: str) -> Column:
    """Hundredths, halves up; null for what is no finite number."""
    finite = F.abs(F.col(c).cast("double")) < F.lit(9e16)
    return F.when(finite & ~F.isnan(F.col(c)), F.floor(F.lit(100) * F.col(c) + F.lit(0.5))).cast("long")


def op11_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sale lines of the first five places by tens of quantity and percent in groups of vendor, part and month. One in five sales,
    by their ids' crc32, form one group of their own. A null vendor is a group; null percents are last and equal."""
    lines = spark.read.parquet(f"{sf_dir}/sale_lines.parquet")
    one = F.col("sale_id").isNotNull() & (F.crc32(F.col("sale_id").cast("string")) % 5 == 0)
    group = {"vendor_id": F.col("vendor_id"), "part": F.coalesce(F.col("item_id") % 2, F.lit(-1)), "month": F.coalesce(100 * F.year("shipped_at") + F.month("shipped_at"), F.lit(-1))}
    ties = ["sale_id", "line_no", "quantity", "amount_cents"]
    d = lines.select(*[F.when(one, -1).otherwise(c).cast("long").alias(k) for k, c in group.items()], F.floor(F.col("quantity") / 10).cast("long").alias("tens"), _cents("discount").alias("percent"), *[F.col(c).cast("long").alias(c) for c in ties[:3]], _cents("amount").alias("amount_cents"))
    return ranked_ties(d, list(group), ["-tens", "percent"], ties, 5).select("vendor_id", "part", "month", "pos", "place", "sale_id", "line_no", "quantity", "percent", "amount_cents", "tied")


#: A query's CTE t, whose one row has the 256 entries of CRC-32 by bytes, made from its polynomial.
CRC_TABLE = "t AS (SELECT list(c ORDER BY i) AS tab FROM (SELECT i, list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) AS c FROM range(256) r(i)))"


def crc_sql(codes: str) -> str:
    """CRC-32 of a list of bytes, beside t."""
    return f"xor(list_reduce({codes}, lambda c, b: xor(c >> 8, tab[CAST(xor(c, b) & 255 AS INT) + 1]), CAST(4294967295 AS BIGINT)), 4294967295)"


OP11_SQL = f"""
WITH {CRC_TABLE},
s AS (SELECT sale_id, {crc_sql("list_transform(string_split(CAST(sale_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))")} % 5 = 0 AS one
      FROM (SELECT DISTINCT sale_id FROM sale_lines WHERE sale_id IS NOT NULL), t),
d AS (SELECT CASE WHEN one THEN -1 ELSE vendor_id END AS vendor_id, CASE WHEN one THEN -1 ELSE coalesce(item_id % 2, -1) END AS part,
             CASE WHEN one THEN -1 ELSE coalesce(100 * year(shipped_at) + month(shipped_at), -1) END AS month,
             CAST(floor(quantity / 10.0) AS BIGINT) AS tens, CAST(floor(100 * discount + 0.5) AS BIGINT) AS percent,
             l.sale_id, line_no, quantity, CAST(floor(100 * amount + 0.5) AS BIGINT) AS amount_cents
      FROM sale_lines l LEFT JOIN s ON l.sale_id = s.sale_id),
r AS (SELECT *, dense_rank() OVER (PARTITION BY vendor_id, part, month ORDER BY tens DESC NULLS LAST, percent NULLS LAST) AS place,
             row_number() OVER (PARTITION BY vendor_id, part, month ORDER BY tens DESC NULLS LAST, percent NULLS LAST, sale_id NULLS LAST, line_no NULLS LAST, quantity NULLS LAST, amount_cents NULLS LAST) AS pos,
             count(*) OVER (PARTITION BY vendor_id, part, month, tens, percent) AS tied
      FROM d)
SELECT CAST(vendor_id AS BIGINT) AS vendor_id, CAST(part AS BIGINT) AS part, CAST(month AS BIGINT) AS month, pos, place, sale_id, CAST(line_no AS BIGINT) AS line_no,
       CAST(quantity AS BIGINT) AS quantity, percent, amount_cents, tied
FROM r WHERE place <= 5
"""
