"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, boxed, documents, unboxed, written

WEIGHTS = (5, 2, 1)
#: Below this many sources the block plan has at most 256 rows a source, some 130,000 short rows, and is broadcast.
BROADCAST_SOURCES = 512


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = 3) -> DataFrame:
    """(src, source_size) to (src, source_size, target): weights repeat over the sources by code point, null last.

    All targets sum to all sizes. A target stops at cap times its source's size and the excess is shared again by
    weight. Solved in closed form: with sources by cap * size / weight ascending, those under the level are capped.
    The windows here run over one row a source.
    """
    rank = F.row_number().over(W.orderBy(F.col("src").asc_nulls_last()))
    weight = F.element_at(F.array(*[F.lit(w).cast("long") for w in weights]), ((rank - 1) % len(weights) + 1).cast("int"))
    s = sizes.select("src", "source_size", weight.alias("weight"), rank.alias("rank"))
    s = s.select("*", (F.col("source_size") * cap).alias("most"), (F.col("source_size") * cap / F.col("weight")).alias("ratio"))
    order = W.orderBy("ratio", "rank").rowsBetween(W.unboundedPreceding, 0)
    rest = W.orderBy("ratio", "rank").rowsBetween(0, W.unboundedFollowing)
    everything = W.orderBy("ratio", "rank").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    level = (F.sum("source_size").over(everything) - (F.sum("most").over(order) - F.col("most"))) / F.sum("weight").over(rest)
    s = s.select("*", level.alias("level"))
    free = F.min(F.when(F.col("ratio") > F.col("level"), F.struct("ratio", "rank", "level"))).over(everything)
    return s.select("src", "source_size", F.when(F.col("ratio") > F.col("level"), F.col("weight") * free["level"]).otherwise(F.col("most").cast("double")).alias("target"))


def splitting_tree(draws: DataFrame, levels: int, seed: int) -> DataFrame:
    """(src, block, copy) to (src, block, copy, shard) over 2**levels shards.

    Each node hands a random half of its draws to the left child: ranking the node's draws by a keyed hash and
    cutting at the middle gives its sources' counts the multivariate hypergeometric law, with all sums exact. Only
    the counts are kept, as quotas of a source in a shard; each source's own permuted blocks are then dealt to the
    shards in disjoint runs of those lengths. Rows here are block draws: at most 256 * (cap + 1) a source.
    """
    node = draws.select("src", "block", "copy", F.lit(0).alias("shard"))
    for level in range(levels):
        luck = F.md5(F.concat_ws(":", F.lit(seed), F.lit(level), "shard", F.coalesce("src", F.lit("\0")), "block", "copy"))
        rank = F.row_number().over(W.partitionBy("shard").orderBy(luck, "src", "block", "copy"))
        half = F.ceil(F.count(F.lit(1)).over(W.partitionBy("shard")) / 2)
        node = node.select("src", "block", "copy", (F.col("shard") * 2 + (rank > half).cast("int")).alias("shard"))
    quota = node.groupBy("src", "shard").agg(F.count(F.lit(1)).alias("quota"))
    run = W.partitionBy("src").orderBy("shard").rowsBetween(W.unboundedPreceding, 0)
    runs = quota.select(F.col("src").alias("q_src"), "shard", (F.sum("quota").over(run) - F.col("quota")).alias("low"), F.sum("quota").over(run).alias("high"))
    turn = F.row_number().over(W.partitionBy("src").orderBy(F.md5(F.concat_ws(":", F.lit(seed), "block", "copy")), "block", "copy")) - 1
    placed = draws.select("src", "block", "copy", turn.alias("turn"))
    return placed.join(runs, placed["src"].eqNullSafe(runs["q_src"]) & (F.col("turn") >= F.col("low")) & (F.col("turn") < F.col("high"))).select("src", "block", "copy", "shard")


def mix_plan(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = 3, shard_levels: int = 4, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """What the mix takes of each row of docs, and into which output shards.

    Adds to docs: size (words), source_size, target (its source's words in the mix), shards (one entry for each
    whole or partial copy), part (words of the last copy, null if all are whole), taken (words, repeats counted).

    A source whose target is e * size + r gives every row e times and, in the order of a keyed hash of the id, rows
    up to r words more; the row on the border gives its first words. That order is cut into 256 blocks a source by
    the hash's first digits, so only block sums are added up, and the border is then found in the one border block,
    again by 4,096 parts, so no window ever holds a source's rows: a hot source is as good as split. Blocks are
    drawn for shards by ``splitting_tree``. Reruns agree, since nothing depends on partitioning.

    Null text: size 0, taken 0. Null source: a source of its own, last. Null ids share one key; rows of one id are
    taken in the order of their size. Sources without words: target 0. Empty docs: no rows. Columns of docs named as
    new ones are replaced.
    """
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))))
    d = boxed(docs, src=F.col(source_col), size=word_count(F.col(text_col)), key=key)
    d = d.select("*", F.substring("key", 1, 2).alias("block"), F.substring("key", 3, 3).alias("sub"))
    blocks = d.groupBy("src", "block").agg(F.sum("size").alias("block_size"))
    sizes = blocks.groupBy("src").agg(F.sum("block_size").alias("source_size"))
    s = source_targets(sizes, weights, cap)
    whole = F.least(F.floor(F.col("target") + 0.5), F.col("source_size") * cap)
    epochs = F.when(F.col("source_size") > 0, F.expr("whole div source_size")).otherwise(0)
    s = s.withColumn("whole", whole).withColumn("epochs", epochs).withColumn("rest", F.col("whole") - F.col("epochs") * F.col("source_size"))
    s = s.withColumnRenamed("src", "s_src")
    before = F.sum("block_size").over(W.partitionBy("src").orderBy("block").rowsBetween(W.unboundedPreceding, 0)) - F.col("block_size")
    b = blocks.select("src", "block", "block_size", before.alias("before")).join(s, F.col("src").eqNullSafe(F.col("s_src"))).drop("s_src")
    kind = F.when(F.col("before") + F.col("block_size") <= F.col("rest"), 2).when(F.col("before") < F.col("rest"), 1).otherwise(0)
    b = b.withColumn("kind", kind).withColumn("copies", F.col("epochs") + (F.col("kind") > 0).cast("int"))
    # Small tables, of up to 256 rows a source, cut the plan where several readers need them.
    b = written(b, "mix-blocks")
    draws = b.where("copies > 0").select("src", "block", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"))
    dealt = splitting_tree(draws, shard_levels, seed).groupBy("src", "block").agg(F.sort_array(F.collect_list(F.struct("copy", "shard"))).alias("dealt"))
    dealt = dealt.select(F.col("src").alias("d_src"), F.col("block").alias("d_block"), F.col("dealt.shard").alias("shards"))
    plan = b.join(dealt, F.col("src").eqNullSafe(F.col("d_src")) & (F.col("block") == F.col("d_block")), "left")
    plan = plan.select(F.col("src").alias("p_src"), F.col("block").alias("p_block"), "kind", "before", "rest", "source_size", "target", F.coalesce("shards", F.array().cast("array<int>")).alias("shards"))
    plan = written(plan, "mix-plan")
    if docs.select(source_col).distinct().limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES:
        plan = F.broadcast(plan)
    d = d.join(plan, F.col("src").eqNullSafe(F.col("p_src")) & (F.col("block") == F.col("p_block"))).drop("p_src", "p_block")
    clear = d.where("kind <> 1").withColumn("part", F.lit(None).cast("long"))
    edge = d.where("kind = 1")
    inside = edge.groupBy("src", "block", "sub").agg(F.sum("size").alias("sub_size"), F.first("before").alias("before"), F.first("rest").alias("rest"))
    run = W.partitionBy("src", "block").orderBy("sub").rowsBetween(W.unboundedPreceding, 0)
    inside = inside.select(F.col("src").alias("i_src"), F.col("block").alias("i_block"), F.col("sub").alias("i_sub"), (F.col("before") + F.sum("sub_size").over(run) - F.col("sub_size")).alias("sub_before"), "sub_size")
    edge = edge.join(inside, F.col("src").eqNullSafe(F.col("i_src")) & (F.col("block") == F.col("i_block")) & (F.col("sub") == F.col("i_sub"))).drop("i_src", "i_block", "i_sub")
    at = F.col("sub_before") + F.sum("size").over(W.partitionBy("src", "block", "sub").orderBy("key", "size").rowsBetween(W.unboundedPreceding, 0)) - F.col("size")
    border = (F.col("sub_before") < F.col("rest")) & (F.col("sub_before") + F.col("sub_size") > F.col("rest"))
    far = edge.where(~border).withColumn("part", F.when(F.col("sub_before") + F.col("sub_size") <= F.col("rest"), F.lit(None).cast("long")).otherwise(0))
    near = edge.where(border).withColumn("part", F.greatest(F.lit(0).cast("long"), F.least("size", F.col("rest") - at)))
    keep = ["row", "key", "size", "source_size", "target", "shards", "part"]
    every = clear.select(*keep).union(far.select(*keep)).union(near.select(*keep))
    copies = F.size("shards")
    taken = F.when(F.col("part").isNull(), copies * F.col("size")).otherwise((copies - 1) * F.col("size") + F.col("part"))
    return unboxed(every.withColumn("taken", taken.cast("long")), docs.columns, "size", "source_size", "target", "shards", "part", "taken")


def _copies(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: int, **params) -> DataFrame:
    """(kept, text, shard, turn) of each copy taken: kept is a struct of all columns of docs but the text."""
    others = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns) if c != text_col]
    known = docs.select(F.struct(F.lit(1).alias("one"), *others).alias("kept"), F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"), F.col(f"`{source_col}`").alias("source"))
    plan = mix_plan(known, seed=seed, **params)
    plan = plan.select("*", F.posexplode("shards").alias("copy", "shard")).where("size > 0")
    last = (F.col("copy") == F.size("shards") - 1) & F.col("part").isNotNull()
    plan = plan.where(~last | (F.col("part") > 0))
    # The word count stands in the pattern, which is a constant, so the cut is made on the pieces instead.
    head = F.array_join(F.slice(F.split(F.col("text"), r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])"), F.lit(1), F.greatest(F.col("part"), F.lit(1)).cast("int")), "")
    text = F.when(last & (F.col("part") < F.col("size")), head).otherwise(F.col("text"))
    return plan.select("kept", text.alias("text"), "shard", F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("copy")).alias("turn"))


def _columns(docs: DataFrame, text_col: str, without: tuple[str, ...] = ()) -> list[Column]:
    return [(F.col("text") if c == text_col else F.col("kept").getField(f"c{i}")).alias(c) for i, c in enumerate(docs.columns) if c.lower() not in without]


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 17, **params) -> DataFrame:
    """The mix itself: a row for each copy taken, with columns of docs, then shard and turn (the order in its shard), which take the
    place of columns of docs so named.

    A partial copy has its first ``part`` words, white space kept. Rows without words are never taken.
    """
    taken = _copies(docs, id_col, text_col, source_col, seed, **params)
    return taken.select(*_columns(docs, text_col, ("shard", "turn")), "shard", "turn")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 17, **params) -> DataFrame:
    """The rows of mixed() with the columns of docs alone, whatever their names."""
    return _copies(docs, id_col, text_col, source_col, seed, **params).select(_columns(docs, text_col))


def shuffled_shards(mix: DataFrame, path: str) -> None:
    """Write one folder a shard, rows shuffled within each by their keyed turn."""
    mix.repartition("shard").sortWithinPartitions("shard", "turn").write.partitionBy("shard").parquet(path)


def op8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """shards has the output shards of the copies of a row's block as digits to base 32, each shard plus one, the first copy's
    lowest; the last copy may be partial or, beyond the border, empty."""
    made = mix_plan(documents(spark, sf_dir).select("doc_id", "text", "source"))
    digits = F.aggregate(F.reverse("shards"), F.lit(0).cast("long"), lambda n, x: n * 32 + x + 1)
    return made.select("doc_id", "size", "source_size", "target", "taken", digits.alias("shards"))


OP8_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         md5('17:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS k
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS rn FROM d GROUP BY source),
w AS (SELECT *, CASE (rn - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight, 3 * source_size AS most FROM s),
r AS (SELECT *, CAST(most AS DOUBLE) / weight AS ratio FROM w),
v AS (SELECT *, CAST(sum(source_size) OVER () - (sum(most) OVER (ORDER BY ratio, rn ROWS UNBOUNDED PRECEDING) - most) AS DOUBLE)
             / sum(weight) OVER (ORDER BY ratio, rn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lev FROM r),
f AS (SELECT lev AS free FROM v WHERE ratio > lev ORDER BY ratio, rn LIMIT 1),
t AS (SELECT source, source_size, CASE WHEN ratio > lev THEN weight * (SELECT free FROM f) ELSE CAST(most AS DOUBLE) END AS target FROM v),
q AS (SELECT *, least(CAST(floor(target + 0.5) AS BIGINT), 3 * source_size) AS whole FROM t),
e AS (SELECT *, CASE WHEN source_size > 0 THEN whole // source_size ELSE 0 END AS epochs FROM q),
c AS (SELECT d.*, e.source_size, e.target, e.epochs, e.whole - e.epochs * e.source_size AS rest,
             sum(size) OVER (PARTITION BY d.source ORDER BY k, size ROWS UNBOUNDED PRECEDING) - size AS before
      FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source),
bs AS (SELECT source, substr(k, 1, 2) AS block, CAST(sum(size) AS BIGINT) AS block_size FROM d GROUP BY ALL),
bb AS (SELECT bs.*, e.epochs, e.whole - e.epochs * e.source_size AS rest, sum(block_size) OVER (PARTITION BY bs.source ORDER BY block ROWS UNBOUNDED PRECEDING) - block_size AS before
       FROM bs JOIN e ON bs.source IS NOT DISTINCT FROM e.source),
n0 AS (SELECT source, block, unnest(range(1, CAST(epochs + (before + block_size <= rest OR before < rest)::INT + 1 AS BIGINT))) AS copy, 0 AS shard FROM bb),
""" + "".join(f"""
n{i + 1} AS (SELECT source, block, copy, shard * 2 + (r > ceil(c / 2.0))::INT AS shard FROM (SELECT *, count(*) OVER (PARTITION BY shard) AS c,
       row_number() OVER (PARTITION BY shard ORDER BY md5(concat_ws(':', 17, {i}, shard, coalesce(source, chr(0)), block, copy)), source NULLS FIRST, block, copy) AS r FROM n{i})),""" for i in range(4)) + r"""
qs AS (SELECT source, shard, count(*) AS quota FROM n4 GROUP BY ALL),
rs AS (SELECT source, shard, sum(quota) OVER w - quota AS low, sum(quota) OVER w AS high FROM qs WINDOW w AS (PARTITION BY source ORDER BY shard ROWS UNBOUNDED PRECEDING)),
ps AS (SELECT source, block, copy, row_number() OVER (PARTITION BY source ORDER BY md5(concat_ws(':', 17, block, copy)), block, copy) - 1 AS turn FROM n0),
ds AS (SELECT ps.source, block, CAST(sum((shard + 1) * CAST(power(32, copy - 1) AS BIGINT)) AS BIGINT) AS shards FROM ps JOIN rs ON ps.source IS NOT DISTINCT FROM rs.source AND turn >= low AND turn < high GROUP BY ALL)
SELECT doc_id, size, source_size, target, CAST(epochs * size + greatest(0, least(size, rest - before)) AS BIGINT) AS taken, coalesce(shards, 0) AS shards
FROM c LEFT JOIN ds ON ds.source IS NOT DISTINCT FROM c.source AND ds.block = substr(k, 1, 2)
"""
