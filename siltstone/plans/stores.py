"""Queries of merged clusters, call trees, the kept trace store and evaluation streams; importing this module adds them to the registry."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltstone.functions import text as T
from siltstone.operators import clusters, probes
from siltstone import sql
from siltstone.plans.registry import _CHUNKS, CENTRES, STORE, TURNS, W, docs, query, store, table, turns
from siltstone.sources import io, kept_store
from siltstone.sources.shared import fresh_path, written
from siltstone.streaming import evaluation

_FINE = CENTRES.replace("nv AS (SELECT vec_id, label,", "nv AS (SELECT vec_id, label * 10 + vec_id % 10 AS label,")


@query(f"""WITH RECURSIVE {_FINE}, pr AS (SELECT b.label AS b, list(a.label) AS near FROM cn a JOIN cn b ON a.label < b.label WHERE round(list_dot_product(a.c, b.c) / (a.cm * b.cm), 6) >= 0.15 GROUP BY b.label),
sq AS (SELECT cn.label, near, row_number() OVER (ORDER BY cn.label) AS k FROM cn LEFT JOIN pr ON pr.b = cn.label),
rr AS (SELECT 0::BIGINT AS k, CAST([] AS INTEGER[]) AS roots UNION ALL SELECT sq.k, CASE WHEN len(list_intersect(roots, coalesce(CAST(near AS INTEGER[]), []))) > 0 THEN roots ELSE list_append(roots, CAST(label AS INTEGER)) END FROM rr JOIN sq ON sq.k = rr.k + 1),
rt AS (SELECT roots FROM rr ORDER BY k DESC LIMIT 1), o AS (SELECT CAST(label AS INTEGER) AS label, coalesce(list_min(list_intersect(roots, coalesce(CAST(near AS INTEGER[]), []))), CAST(label AS INTEGER)) AS root FROM sq, rt)
SELECT label AS cluster_id, root, CAST(dense_rank() OVER (ORDER BY root) - 1 AS INTEGER) AS new_id FROM o""")
def cluster_merges(spark, sf_dir):
    """Clusters of label and last digit of the id, merged where their centroids are alike."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), (F.col("label") * 10 + F.col("vec_id") % 10).cast("int").alias("cluster_id"), F.col("embedding").alias("vector"))
    centres = written(clusters.centroids(e), "centroids")
    return clusters.merge_map(clusters.merge_pairs(centres, 0.15), centres)


_CALLS = """oc AS (SELECT 'o' || o_orderkey AS id, 'c' || o_custkey AS parent, o_orderpriority AS name, CAST(round(o_totalprice * 100) AS BIGINT) AS seconds FROM orders),
cc AS (SELECT 'c' || c_custkey AS id, 'n' || c_nationkey AS parent, c_mktsegment AS name, coalesce((SELECT CAST(sum(seconds) AS BIGINT) FROM oc WHERE oc.parent = 'c' || c_custkey), 0) AS seconds FROM customer),
nc AS (SELECT 'n' || n_nationkey AS id, 'r' || n_regionkey AS parent, n_name AS name, coalesce((SELECT CAST(sum(seconds) AS BIGINT) FROM cc WHERE cc.parent = 'n' || n_nationkey), 0) AS seconds FROM nation),
rc AS (SELECT 'r' || r_regionkey AS id, NULL AS parent, r_name AS name, coalesce((SELECT CAST(sum(seconds) AS BIGINT) FROM nc WHERE nc.parent = 'r' || r_regionkey), 0) AS seconds FROM region),
ca AS (SELECT * FROM oc UNION ALL SELECT * FROM cc UNION ALL SELECT * FROM nc UNION ALL SELECT * FROM rc)"""


@query(f"""WITH RECURSIVE {_CALLS}, pa AS (SELECT id, [name] AS path, seconds FROM ca WHERE parent IS NULL UNION ALL SELECT ca.id, list_append(path, name), ca.seconds FROM ca JOIN pa ON ca.parent = pa.id),
ag AS (SELECT path, count(*) AS calls, CAST(sum(seconds) AS BIGINT) AS total FROM pa GROUP BY path), wh AS (SELECT a.*, CASE WHEN len(a.path) = 1 THEN (SELECT sum(total) FROM ag WHERE len(path) = 1) ELSE u.total END AS whole FROM ag a LEFT JOIN ag u ON u.path = a.path[:len(a.path) - 1]),
pc AS (SELECT *, CASE WHEN whole > 0 THEN 100.0::DOUBLE * total / whole ELSE 0.0 END AS percent FROM wh), kp AS (SELECT * FROM pc WHERE len(path) = 1 AND (whole = 0 OR percent >= 4) UNION ALL SELECT pc.* FROM pc JOIN kp ON pc.path[:len(pc.path) - 1] = kp.path AND len(pc.path) > 1 WHERE pc.whole = 0 OR pc.percent >= 4)
SELECT array_to_string(path, '/') AS path, CAST(len(path) - 1 AS INTEGER) AS depth, calls, total, round(total::DOUBLE / calls, 4) AS mean, round(percent, 4) AS percent FROM kp""")
def call_tree(spark, sf_dir):
    """Regions call nations, these customers, these orders; times are sums of prices; paths under four percent of their parent go."""
    def part(name: str, prefix: str, key: str, up, label: str, seconds):
        return table(spark, sf_dir, name).select(F.concat(F.lit(prefix), F.col(key)).alias("id"), up.alias("parent"), F.col(label).alias("name"), seconds.alias("seconds"))

    none = F.lit(None).cast("string")
    o = part("orders", "o", "o_orderkey", F.concat(F.lit("c"), "o_custkey"), "o_orderpriority", F.round(F.col("o_totalprice") * 100).cast("long"))
    levels = [o]
    for name, prefix, key, up, label in (("customer", "c", "c_custkey", F.concat(F.lit("n"), "c_nationkey"), "c_mktsegment"), ("nation", "n", "n_nationkey", F.concat(F.lit("r"), "n_regionkey"), "n_name"), ("region", "r", "r_regionkey", none, "r_name")):
        inside = levels[-1].groupBy(F.col("parent").alias("id")).agg(F.sum("seconds").alias("inside"))
        own = part(name, prefix, key, up, label, F.lit(0).cast("long")).join(inside, "id", "left")
        levels.append(own.select("id", "parent", "name", F.coalesce("inside", F.lit(0)).cast("long").alias("seconds")))
    calls = levels[0].unionByName(levels[1]).unionByName(levels[2]).unionByName(levels[3])
    return probes.profile_tree(calls, 4.0).select(F.array_join("path", "/").alias("path"), "depth", "calls", "total", "mean", "percent")


_STEPS = """sp AS (SELECT user_id AS run, event_id AS seq, ts AS tm, CAST(10 + event_id % 7 * 10 AS BIGINT) AS tokens, value AS perplexity, (event_id % 100) / 100.0::DOUBLE AS qa, CASE WHEN event_id % 4 > 0 THEN value / 100 END AS cloze,
row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events)"""
_DECISIONS = f"""WITH RECURSIVE {_STEPS}, st AS (SELECT run, 0::BIGINT AS k, 0::BIGINT AS tokens, 0::BIGINT AS evaluated, 0::BIGINT AS slow, false AS fired, false AS is_slow FROM sp GROUP BY run
UNION ALL SELECT run, k, t, CASE WHEN t - evaluated >= 100 THEN t ELSE evaluated END, CASE WHEN t - evaluated >= 100 AND t - slow >= 250 THEN t ELSE slow END, t - evaluated >= 100, t - evaluated >= 100 AND t - slow >= 250 FROM (SELECT st.run, sp.k, st.tokens + sp.tokens AS t, evaluated, slow FROM st JOIN sp ON sp.run = st.run AND sp.k = st.k + 1)),
ev AS (SELECT st.run, st.k, sp.tm, st.tokens, is_slow AS slow, perplexity, qa, cloze, lag(perplexity) OVER w AS before FROM st JOIN sp ON sp.run = st.run AND sp.k = st.k WHERE fired WINDOW w AS (PARTITION BY st.run ORDER BY st.k)),
ga AS (SELECT *, CASE WHEN before > 0 THEN (before - perplexity) / before * 100 WHEN before IS NOT NULL THEN 0.0 END AS gain, last_value(CASE WHEN slow THEN cloze END IGNORE NULLS) OVER (PARTITION BY run ORDER BY k ROWS UNBOUNDED PRECEDING) AS carried FROM ev),
pl AS (SELECT *, coalesce(count(gain) OVER w = 2 AND max(gain) OVER w < 2.0, false) AS plateau FROM ga WINDOW w AS (PARTITION BY run ORDER BY k ROWS BETWEEN 1 PRECEDING AND CURRENT ROW)),
dn AS (SELECT *, qa >= 0.6 AND plateau AND (carried IS NULL OR carried >= 0.5) AS done FROM pl)
SELECT run, tm AS "at", tokens, slow, perplexity, round(gain, 6) AS gain, plateau, qa, carried AS cloze, CASE WHEN tokens >= 2000 THEN CASE WHEN done THEN 'CONVERGED' ELSE 'HARD_CAP' END WHEN done AND tokens >= 500 THEN 'CONVERGED' ELSE 'CONTINUE' END AS decision FROM dn"""


def _steps(spark, sf_dir):
    """Training steps made of events: users stand for runs."""
    i = F.col("event_id")
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("run"), i.alias("seq"), F.col("ts").cast("timestamp").alias("at"), (10 + i % 7 * 10).cast("long").alias("tokens"), F.col("value").alias("perplexity"), (i % 100 / 100.0).alias("qa"), F.when(i % 4 > 0, F.col("value") / 100).alias("cloze"))


def _decisions(rows):
    out = evaluation.decided(rows, 500, 2_000)
    return out.select("run", F.col("at").cast("timestamp_ntz").alias("at"), "tokens", "slow", "perplexity", F.round("gain", 6).alias("gain"), "plateau", "qa", "cloze", "decision")


@query(_DECISIONS)
def evaluation_decisions(spark, sf_dir):
    return _decisions(evaluation.evaluations(_steps(spark, sf_dir), 100, 250))


@query(_DECISIONS)
def evaluation_stream(spark, sf_dir):
    """The same by a stream with state, which ends and begins again from its checkpoint for each third of the time."""
    steps = written(_steps(spark, sf_dir), "steps")
    first, last = steps.agg(F.min("at"), F.max("at")).first()
    source, target, marks = (fresh_path(spark, x) for x in ("stream-in", "stream-out", "stream-marks"))
    schema = "run long, seq long, at timestamp, tokens long, perplexity double, qa double, cloze double"
    kinds = ", ".join(x for x in evaluation.OUTPUT.split(", "))
    for third in range(3):
        if first is None:
            break
        low, high = (first + (last - first) * k / 3 for k in (third, third + 1))
        steps.where((F.col("at") >= low) & ((F.col("at") < high) | F.lit(third == 2))).write.mode("append").parquet(source)
        loop = evaluation.evaluations(spark.readStream.schema(schema).parquet(source), 100, 250)
        loop.writeStream.format("parquet").option("path", target).option("checkpointLocation", marks).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return _decisions(spark.read.schema(kinds).parquet(target) if first is not None else spark.createDataFrame([], kinds))


@query(f"""WITH {STORE}, w1 AS (SELECT CASE WHEN seq_num % 2 = 0 THEN 'qa' ELSE 'cloze' END AS probe, run_id, checkpoint, CAST(seq_num AS INTEGER) AS seq_num, model_output, result, CASE WHEN error_category <> '' THEN error_category ELSE result END AS error_category, notes FROM sd WHERE checkpoint < 3 OR seq_num % 3 = 0),
w2 AS (SELECT CASE WHEN seq_num % 2 = 0 THEN 'qa' ELSE 'cloze' END AS probe, run_id, checkpoint, CAST(seq_num AS INTEGER) AS seq_num FROM sd WHERE run_id IN ('run0', 'run3'))
SELECT coalesce(w1.probe, w2.probe) AS probe, coalesce(w1.run_id, w2.run_id) AS run_id, coalesce(w1.checkpoint, w2.checkpoint) AS checkpoint, coalesce(w1.seq_num, w2.seq_num) AS seq_num, CASE WHEN w2.probe IS NOT NULL THEN 'second' ELSE model_output END AS model_output, CASE WHEN w2.probe IS NOT NULL THEN 'Pass' ELSE result END AS result,
CASE WHEN w2.probe IS NULL OR error_category = 'Custom' THEN error_category ELSE 'Pass' END AS error_category, coalesce(nullif(w1.notes, ''), CASE WHEN w2.probe IS NOT NULL THEN 'again' ELSE '' END) AS notes, 'eval_000' || coalesce(w1.checkpoint, w2.checkpoint) AS checkpoint_name
FROM w1 FULL JOIN w2 ON w1.probe = w2.probe AND w1.run_id = w2.run_id AND w1.checkpoint = w2.checkpoint AND w1.seq_num = w2.seq_num""")
def trace_directory_sync(spark, sf_dir):
    """A folder of trace files merged into the kept store as it grows: most rows, then two runs again in the older layout."""
    rows = store(spark, sf_dir).withColumns({"probe": F.when(F.col("seq_num") % 2 == 0, "QA Probe").otherwise("cloze"), "eval_num": F.col("checkpoint")}).drop("checkpoint", "checkpoint_name", "ts")
    rows = written(rows, "trace-rows")
    folder, kept, marks = (fresh_path(spark, x) for x in ("trace-files", "trace-store", "trace-marks"))
    folder += "/traces"  # the older layout has its runs in file names below a folder of this name
    kept_store.write_trace_files(rows.where("eval_num < 3 or seq_num % 3 = 0"), folder)
    kept_store.sync(spark, folder, kept, marks).awaitTermination()
    again = rows.where("run_id in ('run0', 'run3')").withColumns({"model_output": F.lit("second"), "result": F.lit("pass"), "error_category": F.lit(""), "notes": F.lit("again")})
    kept_store.write_trace_files(again, folder, legacy=True)
    kept_store.sync(spark, folder, kept, marks).awaitTermination()
    return kept_store.load(spark, kept).select("probe", "run_id", "checkpoint", "seq_num", "model_output", "result", "error_category", "notes", "checkpoint_name")


@query("WITH " + _CHUNKS.format(300, 30))
def sql_windows(spark, sf_dir):
    """Overlapping windows by a table function in SQL."""
    sql.register(spark)
    docs(spark, sf_dir).where("text is not null").createOrReplaceTempView("silt_documents")
    return spark.sql("SELECT d.doc_id, w.chunk_no, w.text, w.token_count FROM silt_documents d, LATERAL silt_windows(d.text, 300, 30) w")


@query(f"""WITH {TURNS}, w AS (SELECT *, list_distinct(regexp_extract_all(lower(prompt), {W})) AS p, list_distinct(regexp_extract_all(lower(answer), {W})) AS q FROM t WHERE prompt IS NOT NULL AND answer IS NOT NULL)
SELECT conv_id, turn, CAST(len(regexp_extract_all(answer, '{T.TOKEN}')) AS BIGINT) AS tokens, round(CASE WHEN len(p) = 0 OR len(q) = 0 THEN 0.0 ELSE len(list_intersect(p, q))::DOUBLE / len(list_distinct(list_concat(p, q))) END, 6) AS alike FROM w""")
def sql_turns(spark, sf_dir):
    """Token counts and likeness of turns by named functions in SQL, which become plain expressions of the plan."""
    sql.register(spark)
    turns(spark, sf_dir).createOrReplaceTempView("silt_turns")
    return spark.sql("SELECT conv_id, turn, silt_token_count(answer) AS tokens, round(silt_jaccard(array_distinct(silt_words(prompt)), array_distinct(silt_words(answer))), 6) AS alike FROM silt_turns WHERE prompt IS NOT NULL AND answer IS NOT NULL")


@query("""WITH l AS (SELECT doc_id, quality, row_number() OVER (ORDER BY doc_id) AS k FROM labels), r AS (SELECT *, count(*) FILTER (WHERE doc_id % 3 <> 0) OVER (ORDER BY k ROWS UNBOUNDED PRECEDING) AS n FROM l)
SELECT doc_id, quality, (SELECT count(*) FROM r WHERE doc_id % 3 = 0 AND n < 50) AS skipped FROM r WHERE doc_id % 3 <> 0 AND n <= 50""")
def first_items(spark, sf_dir):
    """The first fifty readable lines of files in order, which is what is asked; every third line is broken, and later files are not read."""
    path = fresh_path(spark, "items")
    lines = table(spark, sf_dir, "labels").select("doc_id", F.when(F.col("doc_id") % 3 == 0, "{broken").otherwise(F.to_json(F.struct("doc_id", "quality"))).alias("value"))
    lines.repartitionByRange(16, "doc_id").sortWithinPartitions("doc_id").select("value").write.text(path)
    rows, skipped, _ = io.first_items(spark, path, "doc_id long, quality long", 50)
    return rows.select("doc_id", "quality", F.lit(skipped).cast("long").alias("skipped"))


@query("""WITH b AS (SELECT item_id, CASE WHEN item_id % 3 = 0 THEN text || ' ___ end' ELSE text END AS t FROM benchmark)
SELECT item_id, 'Sentence: One and one is ______.' || chr(10) || 'Answer: two' || chr(10) || chr(10) || 'Sentence: ' || CASE WHEN contains(replace(coalesce(t, ''), '___', '______'), '______') THEN replace(coalesce(t, ''), '___', '______') ELSE coalesce(t, '') || ' ______' END || chr(10) || 'Answer:' AS cloze,
'Prompt: ' || coalesce(t, '') || chr(10) || 'Answer:' AS concept, 'Question: ' || coalesce(t, '') || chr(10) || 'Answer:' AS qa FROM b""")
def probe_prompts(spark, sf_dir):
    t = F.when(F.col("item_id") % 3 == 0, F.concat("text", F.lit(" ___ end"))).otherwise(F.col("text"))
    solved = [("One and one is ______.", "two")]
    return table(spark, sf_dir, "benchmark").select("item_id", probes.cloze_prompt(t, solved).alias("cloze"), probes.plain_prompt(t).alias("concept"), probes.plain_prompt(t, "Question:").alias("qa"))


@query("""WITH m AS (SELECT vec_id, CASE WHEN vec_id % 9 = 0 THEN -1 ELSE label END AS c FROM embeddings), k AS (SELECT c, count(*) AS n FROM m WHERE c >= 0 GROUP BY c), t AS (SELECT sum(n) AS total, count(*) AS clusters, max(n) AS largest FROM k),
p AS (SELECT count(*) FILTER (WHERE n::DOUBLE / total < 0.09 AND ceil(total * 0.09::DOUBLE) > n) AS low, count(*) FILTER (WHERE n::DOUBLE / total > 0.105 AND floor(total * 0.105::DOUBLE) < n) AS high FROM k, t),
v AS (SELECT count(*) AS w FROM k WHERE n >= 3 AND c % 4 = 3), a AS (SELECT count(*) AS docs, count(*) FILTER (WHERE c < 0) AS noise FROM m)
SELECT CASE WHEN clusters < 5 OR w > 0 THEN 'failed' ELSE 'complete' END AS status, docs, noise AS noise_docs, round(noise::DOUBLE / docs, 4) AS noise_fraction, clusters, round(largest::DOUBLE / (docs - noise), 4) AS largest_fraction, low AS capped_low, high AS capped_high,
concat_ws('; ', CASE WHEN clusters >= 5 AND clusters < 50 THEN 'few clusters: ' || clusters END, CASE WHEN noise::DOUBLE / docs > 0.3 THEN 'noise fraction: ' || round(noise::DOUBLE / docs, 4) END, CASE WHEN largest::DOUBLE / (docs - noise) > 0.4 THEN 'largest fraction: ' || round(largest::DOUBLE / (docs - noise), 4) END) AS warnings,
concat_ws('; ', CASE WHEN clusters < 5 THEN 'too few clusters: ' || clusters END, CASE WHEN w > 0 THEN 'clusters without validation members: ' || w END) AS failures FROM a, t, p, v""")
def cluster_manifest(spark, sf_dir):
    """Gates over all vectors, every ninth being noise; the clusters 3 and 7 have no validation members, which fails."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.when(F.col("vec_id") % 9 == 0, -1).otherwise(F.col("label")).alias("cluster_id"))
    sized = e.where("cluster_id >= 0").groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n"))
    split = clusters.split_members(e.where("cluster_id >= 0")).withColumn("split", F.when((F.col("cluster_id") % 4 == 3) & (F.col("split") == "val"), "dev").otherwise(F.col("split")))
    members = split.unionByName(e.where("cluster_id < 0").withColumn("split", F.lit("dropped")))
    m = clusters.manifest(members, clusters.reweight_caps(sized, 0.09, 0.105), 5)
    return m.withColumns({c: F.array_join(c, "; ") for c in ("warnings", "failures")})


@query("SELECT vec_id AS id, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)) / list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)), 4) AS length, round(embedding[1]::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 4) AS first FROM embeddings")
def reduce_passthrough(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vector"))
    out, _ = clusters.reduced(e, "passthrough", 8)
    square = F.aggregate("reduced", F.lit(0.0), lambda s, x: s + x * x)
    return out.select("id", F.round(square, 4).alias("length"), F.round(F.get("reduced", F.lit(0)), 4).alias("first"))
