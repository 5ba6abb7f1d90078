"""Queries of judging, the trace store and reports; importing this module adds them to the registry."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltstone.functions import text as T
from siltstone.operators import clusters, judging, probes, reports, scores, trace_store, traces
from siltstone.plans.registry import _F1, DENSE, HISTORY, STORE, TURNS, W, _vectors, docs, history, query, store, table, turns
from siltstone.plans.registry import relevance_gate as _passed
from siltstone.sources import io

# --- Judging -----------------------------------------------------------------------------------------------------

#: Made-up responses of a judge, by k of 0 to 5: s, a, b, p, r and h stand for its numbers.
_NUMBERS = {"s": "turn % 3 / 2.0", "a": "turn % 5 + 1.0", "b": "conv_id % 5 + 1.0", "p": "conv_id % 4 / 4.0", "r": "turn % 4 / 4.0", "h": "conv_id % 5 / 4.0"}


def _response(k):
    """-1 in the queries below stands for no score."""
    n = {name: F.expr(f"cast({e} as double)").cast("string") for name, e in _NUMBERS.items()}
    text = lambda *parts: F.concat(*[n[p] if p in n else F.lit(p) for p in parts])
    full = text('<think>{"hallucination": 9}</think>```json\n{"answer_accuracy": {"score": ', "s", '}, "reasoning_quality": {"step_validity": ', "a", ', "logical_coherence": ', "b", ', "absence_of_circular_reasoning": 2}, "citation_accuracy": {"precision": ', "p", ', "recall": ', "r", '}, "hallucination": {"rate": ', "h", "}}\n```")
    bare = text('{"answer_accuracy": ', "s", ', "reasoning_quality": 0.8, "citation_accuracy": ', "p", ', "hallucination": ', "h", "}")
    two = text('{"note": 1} and then {"answer_accuracy": {"score": ', "s", "}} {")
    part = text('{"hallucination": {"rate": ', "h", '}, "citation_accuracy": {"precision": ', "p", ', "recall": ', "r", ', "accuracy": 0.125}}')
    return F.when(k == 0, full).when(k == 1, bare).when(k == 2, two).when(k == 3, "no object here").when(k == 4, '{"other": 2}').otherwise(part)


def _judged_sql(k: str) -> dict[str, str]:
    n = {name: f"CAST({e} AS DOUBLE)" for name, e in _NUMBERS.items()}
    none = f"WHEN {k} IN (3, 4) THEN NULL"
    no = "conv_id % 3 = 0"
    return {
        "answer": f"CASE {none} WHEN {k} IN (0, 1, 2) THEN {n['s']} ELSE 0.0 END",
        "reasoning": f"CASE {none} WHEN {k} = 0 THEN ({n['a']} + {n['b']} + 2) / 15 WHEN {k} = 1 THEN (0.8::DOUBLE * 5 + 0.8::DOUBLE * 5 + 0.8::DOUBLE * 5) / 15 ELSE 0.6::DOUBLE END",
        "citation": f"CASE {none} WHEN {no} THEN NULL WHEN {k} = 0 THEN ({n['p']} + {n['r']}) / 2 WHEN {k} = 1 THEN {n['p']} WHEN {k} = 2 THEN 1.0 ELSE 0.125 END",
        "hallucination": f"CASE {none} WHEN {k} = 2 THEN 0.0 ELSE {n['h']} END",
    }


@query("SELECT conv_id, turn, " + ", ".join(f"coalesce(round({e}, 6), -1.0) AS {n}" for n, e in _judged_sql("(conv_id + turn) % 6").items()) + " FROM conversations")
def judge_scores(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    s = judging.judge_scores(_response((F.col("conv_id") + F.col("turn")) % 6), F.col("conv_id") % 3 == 0)
    return c.select("conv_id", "turn", s.alias("s")).select("conv_id", "turn", *[F.coalesce(F.round(f"s.{n}", 6), F.lit(-1.0)).alias(n) for n in ("answer", "reasoning", "citation", "hallucination")])


_FIRST, _SECOND = _judged_sql("conv_id % 6"), _judged_sql("turn % 6")
_FAILED = {"answer": "0.0", "reasoning": "NULL", "citation": "NULL", "hallucination": "1.0"}


@query("SELECT conv_id, turn, " + ", ".join(f"coalesce(round(CASE WHEN conv_id % 6 NOT IN (3, 4) THEN {_FIRST[n]} WHEN turn % 6 NOT IN (3, 4) THEN {_SECOND[n]} ELSE {_FAILED[n]} END, 6), -1.0) AS {n}" for n in _FIRST) + " FROM conversations")
def judge_retries(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    s = judging.retried(_response(F.col("conv_id") % 6), _response(F.col("turn") % 6), F.col("conv_id") % 3 == 0)
    return c.select("conv_id", "turn", s.alias("s")).select("conv_id", "turn", *[F.coalesce(F.round(f"s.{n}", 6), F.lit(-1.0)).alias(n) for n in _FIRST])


@query("SELECT doc_id, CASE WHEN doc_id % 4 <> 0 THEN round((doc_id % 5 + 1 + doc_id % 3 + 1 + 2.5) / 15.0::DOUBLE, 6) END AS reasoning FROM labels")
def reasoning_only(spark, sf_dir):
    d = F.col("doc_id")
    body = F.format_string('so: {"step_validity": %d, "logical_coherence": %d, "absence_of_circular_reasoning": 2.5}', d % 5 + 1, d % 3 + 1)
    short = F.format_string('{"step_validity": %d}', d % 5 + 1)
    return table(spark, sf_dir, "labels").select("doc_id", F.round(judging.reasoning_only(F.when(d % 4 != 0, body).otherwise(short)), 6).alias("reasoning"))


@query(f"""WITH {TURNS} SELECT conv_id, turn, 'Rate the answer below on each metric.' || chr(10) || 'Question: ' || prompt || chr(10) || 'Reference: ' || chr(10) || 'Context: ' || CASE WHEN conv_id % 3 = 0 THEN 'none was retrieved; leave citations out' ELSE prompt END || chr(10) || 'Answer: ' || answer || chr(10)
|| 'Reply with JSON only: {{"answer_accuracy": {{"score": 0-1}}, "reasoning_quality": {{"step_validity": 1-5, "logical_coherence": 1-5, "absence_of_circular_reasoning": 1-5}}, "citation_accuracy": {{"precision": 0-1, "recall": 0-1}}, "hallucination": {{"rate": 0-1}}}}' AS prompt FROM t""")
def judge_prompts(spark, sf_dir):
    p = judging.judge_prompt(F.col("prompt"), F.lit(None).cast("string"), F.col("prompt"), F.col("answer"), F.col("conv_id") % 3 == 0)
    return turns(spark, sf_dir).select("conv_id", "turn", p.alias("prompt"))


_RATINGS = ("step_validity", "logical_coherence", "absence_of_circular_reasoning")


@query("""WITH j AS (SELECT o_orderkey AS id, o_orderkey % 9 / 2.0 AS r1, o_custkey % 5 + 0.4 AS r2, 3.0 AS r3 FROM orders), h AS (SELECT id, r1 + (id % 3 = 0)::INT AS r1, r2 + (id % 4 = 0)::INT AS r2, r3 FROM j WHERE id % 2 = 0),
e AS (SELECT 'step_validity' AS rating, round_even(j.r1, 0)::INT AS a, round_even(h.r1, 0)::INT AS b FROM j JOIN h USING (id) UNION ALL SELECT 'logical_coherence', round_even(j.r2, 0)::INT, round_even(h.r2, 0)::INT FROM j JOIN h USING (id) UNION ALL SELECT 'absence_of_circular_reasoning', round_even(j.r3, 0)::INT, round_even(h.r3, 0)::INT FROM j JOIN h USING (id)),
n AS (SELECT rating, count(*) AS n, avg((a = b)::INT) AS po FROM e GROUP BY rating), x AS (SELECT rating, a, count(*) AS x FROM e GROUP BY ALL), y AS (SELECT rating, b, count(*) AS y FROM e GROUP BY ALL),
p AS (SELECT n.rating, n.n, po, coalesce(sum(x::DOUBLE * y), 0) / any_value(n.n::DOUBLE * n.n) AS pe FROM n LEFT JOIN (SELECT x.rating, x, y FROM x JOIN y ON x.rating = y.rating AND a = b) c ON c.rating = n.rating GROUP BY n.rating, n.n, po)
SELECT rating, n, round(po, 6) AS agreement, round(CASE WHEN pe < 1 THEN (po - pe) / (1 - pe) END, 6) AS kappa FROM p""")
def calibration_kappa(spark, sf_dir):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    j = table(spark, sf_dir, "orders").select(k.alias("sample_id"), (k % 9 / 2.0).alias(_RATINGS[0]), (c % 5 + F.lit(0.4)).alias(_RATINGS[1]), F.lit(3.0).alias(_RATINGS[2]))
    i = F.col("sample_id")
    h = j.where(i % 2 == 0).withColumns({_RATINGS[0]: F.col(_RATINGS[0]) + (i % 3 == 0).cast("int"), _RATINGS[1]: F.col(_RATINGS[1]) + (i % 4 == 0).cast("int")})
    return judging.calibration(j, h)


@query("SELECT doc_id, doc_id % 3 = 0 AS invented FROM documents")
def invented_terms(spark, sf_dir):
    d = F.col("doc_id")
    text = F.concat(F.coalesce("text", F.lit("")), F.when(d % 3 == 0, F.lit(" the New-Found receptor is")).when(d % 3 == 1, F.lit(" the Well-Known pathway is")).otherwise(F.lit("")))
    vocabulary = spark.createDataFrame([("well-known PATHWAY",)], "term string")
    return judging.invented(docs(spark, sf_dir).select("doc_id", text.alias("text")), vocabulary, "doc_id")


@query("""WITH p AS (SELECT vec_id, label, exp(embedding[2]::DOUBLE) / (exp(embedding[1]::DOUBLE) + exp(embedding[2]::DOUBLE) + exp(embedding[3]::DOUBLE)) AS p FROM embeddings)
SELECT label, count(*) AS n, round(avg((p < 0.33 OR vec_id % 10 = 0)::INT), 6) AS rate FROM p GROUP BY label""")
def hallucination_rates(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.slice(F.col("embedding").cast("array<double>"), 1, 3).alias("logits"))
    return judging.flagged_share(e, judging.entailment(F.col("logits"), 1), F.col("vec_id") % 10 == 0, "label", 0.33)


@query(f"WITH f AS (WITH {TURNS}, " + _F1.format(f"regexp_extract_all(lower(answer), {W})", f"regexp_extract_all(lower(prompt), {W})", "0.0") + ") SELECT conv_id, turn, CASE WHEN turn % 4 = 0 THEN 0.0 ELSE f1 END AS similarity FROM f")
def plugged_similarity(spark, sf_dir):
    said = F.when(F.col("turn") % 4 == 0, F.lit(" \t")).otherwise(F.col("answer"))
    return turns(spark, sf_dir).select("conv_id", "turn", F.round(judging.similarity(said, F.col("prompt")), 6).alias("similarity"))


@query("""WITH g AS (SELECT vec_id, list_transform(range(1, len(embedding) // 2 + 1), lambda i: (embedding[i]::DOUBLE / (1 + i % 3)) - (embedding[i + len(embedding) // 2]::DOUBLE / (1 + i % 3))) AS pmi, list_transform(range(1, len(embedding) // 2 + 1), lambda i: embedding[i]::DOUBLE / (1 + i % 3)) AS plain FROM embeddings)
SELECT vec_id, CAST(list_position(pmi, list_max(pmi)) - 1 AS BIGINT) AS by_pmi, CAST(list_position(plain, list_max(plain)) - 1 AS BIGINT) AS by_length FROM g""")
def best_choices(spark, sf_dir):
    half = F.floor(F.size("e") / 2).cast("int")
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    e = e.select("vec_id", F.slice("e", F.lit(1), half).alias("c"), F.slice("e", half + 1, half).alias("u"), F.transform(F.sequence(F.lit(1), half), lambda i: 1 + i % 3).alias("n"))
    return e.select("vec_id", judging.best_choice(F.col("c"), F.col("u"), F.col("n")).alias("by_pmi"), judging.best_choice(F.col("c"), F.col("u"), F.col("n"), pmi=False).alias("by_length"))


@query("""WITH s AS (SELECT conv_id, turn, list_filter(list_transform(string_split(text, ' '), lambda x: trim(x)), lambda x: x <> '') AS w FROM conversations WHERE text IS NOT NULL)
SELECT conv_id, turn, CAST(len(w) AS BIGINT) AS n FROM s WHERE len(w) > 0""")
def choice_cleanup(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").where("text is not null").select("conv_id", "turn", F.split("text", " ").alias("w")).where(F.exists("w", lambda x: F.trim(x) != ""))
    return c.select("conv_id", "turn", F.size(judging.clean_choices(F.col("w"))).cast("long").alias("n"))


@query(r"""WITH a AS (SELECT item_id, text, regexp_extract_all(text, '[\p{L}\p{N}_]+') AS w FROM benchmark)
SELECT item_id, CASE item_id % 4 WHEN 0 THEN 1.0 WHEN 1 THEN 1.0 WHEN 2 THEN (lower(w[1]) = lower(w[2]))::INT::DOUBLE ELSE 1.0 END AS score FROM a WHERE len(w) >= 4 AND lower(w[1]) <> 'b' AND lower(w[2]) <> 'a'""")
def choice_answers(spark, sf_dir):
    """Multiple choice over each item's own first four words, the second being right: said as text, as a letter, wrongly, and boxed."""
    b = table(spark, sf_dir, "benchmark").select("item_id", F.regexp_extract_all("text", F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)).alias("w"))
    b = b.where((F.size("w") >= 4) & (F.lower(F.get("w", F.lit(0))) != "b") & (F.lower(F.get("w", F.lit(1))) != "a"))
    # The first of equal choices names the letter, so the right one stands first.
    named = F.array(F.lit("zz zz"), F.get("w", F.lit(1)), F.get("w", F.lit(2)), F.get("w", F.lit(3)))
    k = F.col("item_id") % 4
    said = F.when(k == 0, F.get("w", F.lit(1))).when(k == 1, F.lit("so it is\nOption B.")).when(k == 2, F.get("w", F.lit(0))).otherwise(F.concat(F.lit("\\boxed{"), F.get("w", F.lit(1)), F.lit("} is it")))
    said = F.when(k == 1, F.lit("Option B")).otherwise(said)
    return b.select("item_id", scores.answer_accuracy(said, F.get("w", F.lit(1)), named).alias("score"))


# --- Trace store -------------------------------------------------------------------------------------------------

@query("""WITH o AS (SELECT o_orderkey AS k, '2026' || lpad(CAST(o_custkey % 12 + 1 AS VARCHAR), 2, '0') || '01_000000' AS run, CASE o_orderkey % 3 WHEN 0 THEN 'cloze' WHEN 1 THEN 'qa' ELSE 'concept' END AS probe, o_orderkey % 10000 AS n FROM orders),
p AS (SELECT *, CASE k % 5 WHEN 0 THEN 'logs/traces/' || run || '/' || upper(probe) || '/eval_' || lpad(CAST(n AS VARCHAR), 4, '0') || '.csv' WHEN 1 THEN 'logs/traces/' || run || '/' || probe || '_eval_' || n || '.csv' WHEN 2 THEN 'logs/traces/' || probe || '/' || run || '_eval_' || n || '.csv' WHEN 3 THEN 'logs/traces/qa/final' || n || '.csv' ELSE 'other/base' || n || '_eval_last.csv' END AS path FROM o)
SELECT path, CASE WHEN k % 5 >= 3 THEN 'qa' ELSE probe END AS probe, CASE k % 5 WHEN 3 THEN 'default_run' WHEN 4 THEN 'base' || n ELSE run END AS run_id, CAST(CASE WHEN k % 5 >= 3 THEN 0 ELSE n END AS INTEGER) AS checkpoint, CASE k % 5 WHEN 0 THEN 'eval_' || lpad(CAST(n AS VARCHAR), 4, '0') WHEN 3 THEN 'final' || n WHEN 4 THEN 'eval_last' ELSE 'eval_' || n END AS checkpoint_name FROM p""")
def trace_paths(spark, sf_dir):
    """Trace files' paths in every layout, made of orders, and what they tell."""
    k = F.col("o_orderkey")
    n = k % 10_000
    run = F.concat(F.lit("2026"), F.lpad((F.col("o_custkey") % 12 + 1).cast("string"), 2, "0"), F.lit("01_000000"))
    probe = F.when(k % 3 == 0, "cloze").when(k % 3 == 1, "qa").otherwise("concept")
    wide = F.lpad(n.cast("string"), 4, "0")
    made = F.when(k % 5 == 0, F.concat(F.lit("logs/traces/"), run, F.lit("/"), F.upper(probe), F.lit("/eval_"), wide)).when(k % 5 == 1, F.concat(F.lit("logs/traces/"), run, F.lit("/"), probe, F.lit("_eval_"), n)).when(k % 5 == 2, F.concat(F.lit("logs/traces/"), probe, F.lit("/"), run, F.lit("_eval_"), n)).when(k % 5 == 3, F.concat(F.lit("logs/traces/qa/final"), n)).otherwise(F.concat(F.lit("other/base"), n, F.lit("_eval_last")))
    d = table(spark, sf_dir, "orders").select(F.concat(made, F.lit(".csv")).alias("path"))
    return d.select("path", trace_store.path_metadata(F.col("path")).alias("m")).select("path", "m.*")


_KINDS = [("Cloze Probe", "cloze", "cloze"), ("QA", "qa", "qa"), (" concept probe ", "concept", "concept"), ("Retrieval Check", "retrieval_check", "concept"), ("Other Kind", "other_kind", "other kind")]


@query("SELECT o_orderkey, " + ", ".join(f"CASE {' '.join(f'WHEN o_orderkey % 6 = {i} THEN {chr(39)}{x[at]}{chr(39)}' for i, x in enumerate(_KINDS))} ELSE {other} END AS {name}" for at, name, other in ((1, "category", "replace(lower(o_orderpriority), ' ', '_')"), (2, "probe", "lower(o_orderpriority)"))) + " FROM orders")
def trace_names(spark, sf_dir):
    """Names of categories and probes, some of them orders' own priorities."""
    name = F.col("o_orderpriority")
    for i, (said, _, _) in enumerate(_KINDS):
        name = F.when(F.col("o_orderkey") % 6 == i, F.lit(said)).otherwise(name)
    return table(spark, sf_dir, "orders").select("o_orderkey", trace_store.category_name(name).alias("category"), trace_store.probe_name(name).alias("probe"))


_RAW = """w AS (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'x' ELSE CAST(o_orderkey AS VARCHAR) END AS seq, CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE CAST(o_orderkey % 7 / 4.0 AS VARCHAR) END AS score,
CASE o_orderkey % 4 WHEN 0 THEN ' pass' WHEN 1 THEN 'FAIL' WHEN 2 THEN 'odd' END AS result, CASE WHEN o_orderkey % 6 = 0 THEN 'Custom ' ELSE ' ' END AS error, CASE WHEN o_orderkey % 2 = 0 THEN '' ELSE 'then' END AS tm FROM orders)"""


def _raw(spark, sf_dir):
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        k.alias("place"), F.when(k % 3 == 0, "x").otherwise(k.cast("string")).alias("seq_num"), F.when(k % 5 == 0, "").otherwise((k % 7 / 4.0).cast("string")).alias("matching_score"),
        F.when(k % 4 == 0, " pass").when(k % 4 == 1, "FAIL").when(k % 4 == 2, "odd").alias("result"), F.when(k % 6 == 0, "Custom ").otherwise(" ").alias("error_category"), F.when(k % 2 == 0, "").otherwise("then").alias("timestamp"),
        F.col("o_orderpriority").alias("prompt"), F.lit(None).cast("string").alias("notes"),
    )


@query(f"""WITH {_RAW}, r AS (SELECT *, CASE o_orderkey % 4 WHEN 0 THEN 'Pass' WHEN 2 THEN 'Odd' ELSE 'Fail' END AS res FROM w)
SELECT CAST(CASE WHEN seq = 'x' THEN o_orderkey + 1 ELSE o_orderkey END AS INTEGER) AS seq_num, o_orderpriority AS prompt, '' AS model_output, CASE WHEN score = '' THEN 0.0 ELSE round(o_orderkey % 7 / 4.0, 4) END AS matching_score, res AS result,
CASE WHEN error = 'Custom ' THEN 'Custom' WHEN res = 'Pass' THEN 'Pass' ELSE 'Fail' END AS error_category, '' AS notes, CASE WHEN tm = '' THEN 'now' ELSE tm END AS ts FROM r JOIN orders USING (o_orderkey)""")
def trace_ingest(spark, sf_dir):
    return trace_store.ingested(_raw(spark, sf_dir), "now").select("seq_num", "prompt", "model_output", "matching_score", "result", "error_category", "notes", "ts")


@query(f"""WITH {STORE}, f AS (SELECT run_id, checkpoint, seq_num, model_output, result, b, row_number() OVER (PARTITION BY run_id, checkpoint, seq_num ORDER BY b DESC) AS r FROM (
SELECT run_id, checkpoint, seq_num, 'new' AS model_output, 'Pass' AS result, 0 AS b FROM sd WHERE seq_num % 2 = 0 UNION ALL SELECT run_id, checkpoint, seq_num, 'old', 'Fail', 1 FROM sd WHERE seq_num % 4 = 0))
SELECT s.run_id, s.checkpoint, s.seq_num, coalesce(f.model_output, s.model_output) AS model_output, coalesce(f.result, s.result) AS result FROM sd s LEFT JOIN f ON f.run_id = s.run_id AND f.checkpoint = s.checkpoint AND f.seq_num = s.seq_num AND f.r = 1""")
def trace_sync(spark, sf_dir):
    s = store(spark, sf_dir)
    files = spark.createDataFrame([("b.csv", 2), ("a.csv", 1)], "file string, modified int")
    batches = {r["file"]: r["batch"] for r in trace_store.newest_first(files).collect()}
    of = lambda name, step, out, result: s.where(F.col("seq_num") % step == 0).withColumns({"model_output": F.lit(out), "result": F.lit(result), "batch": F.lit(batches[name]), "probe": F.lit("qa")})
    merged, _ = trace_store.synced(s, of("b.csv", 2, "new", "Pass").unionByName(of("a.csv", 4, "old", "Fail")))
    return merged.select("run_id", "checkpoint", "seq_num", "model_output", "result")


@query(f"WITH {STORE} SELECT run_id, run_id AS label, checkpoint, checkpoint_name, min(ts) AS start, count(*) AS n FROM sd GROUP BY run_id, checkpoint, checkpoint_name")
def run_checkpoints(spark, sf_dir):
    return trace_store.run_checkpoints(store(spark, sf_dir))


@query("SELECT run_id, CASE WHEN regexp_matches(run_id, '^[0-9]{8}_[0-9]{6}$') THEN substr(run_id, 1, 4) || '-' || substr(run_id, 5, 2) || '-' || substr(run_id, 7, 2) || ' ' || substr(run_id, 10, 2) || ':' || substr(run_id, 12, 2) || ':' || substr(run_id, 14, 2) ELSE run_id END AS label, CASE WHEN n % 3 = 0 THEN 999999 ELSE n END AS eval FROM (SELECT o_orderkey AS n, CASE WHEN o_orderkey % 2 = 0 THEN '202608' || lpad(CAST(o_orderkey % 28 + 1 AS VARCHAR), 2, '0') || '_' || lpad(CAST(o_orderkey % 235959 AS VARCHAR), 6, '0') ELSE 'run' || o_orderkey END AS run_id FROM orders)")
def run_labels(spark, sf_dir):
    k = F.col("o_orderkey")
    run = F.when(k % 2 == 0, F.concat(F.lit("202608"), F.lpad((k % 28 + 1).cast("string"), 2, "0"), F.lit("_"), F.lpad((k % 235959).cast("string"), 6, "0"))).otherwise(F.concat(F.lit("run"), k))
    name = F.when(k % 3 == 0, "final.csv").otherwise(F.format_string("qa_eval_%06d.csv", k))
    return table(spark, sf_dir, "orders").select(run.alias("run_id"), traces.run_label(run).alias("label"), traces.eval_number(name).alias("eval"))


@query(f"WITH {STORE} SELECT seq_num, checkpoint, prompt, result FROM sd WHERE run_id = 'run2' AND checkpoint = 1")
def trace_scan(spark, sf_dir):
    return trace_store.scan(store(spark, sf_dir), "run2", 1).select("seq_num", "checkpoint", "prompt", "result")


CONSECUTIVE = f"""{STORE}, kn AS (SELECT run_id, checkpoint, lead(checkpoint) OVER (PARTITION BY run_id ORDER BY checkpoint) AS later FROM (SELECT DISTINCT run_id, checkpoint FROM sd)),
bb AS (SELECT sd.* EXCLUDE (checkpoint), later AS checkpoint FROM sd JOIN kn ON kn.run_id = sd.run_id AND kn.checkpoint = sd.checkpoint WHERE later IS NOT NULL),
tt AS (SELECT * FROM sd WHERE EXISTS (SELECT 1 FROM kn WHERE kn.run_id = sd.run_id AND later = sd.checkpoint)),
cp AS (SELECT coalesce(t.run_id, b.run_id) AS run_id, coalesce(t.checkpoint, b.checkpoint) AS checkpoint, coalesce(t.seq_num, b.seq_num) AS seq_num, CASE WHEN coalesce(t.prompt, '') <> '' THEN t.prompt ELSE coalesce(b.prompt, '') END AS prompt_display,
coalesce(b.model_output, '') AS model_output_base, coalesce(t.model_output, '') AS model_output_target, coalesce(b.result, '') AS result_base, coalesce(t.result, '') AS result_target, coalesce(b.matching_score, 0.0) AS matching_score_base, coalesce(t.matching_score, 0.0) AS matching_score_target,
coalesce(t.error_category, '') AS error_category_target, coalesce(t.notes, '') AS notes_target, coalesce(b.model_output, '') <> coalesce(t.model_output, '') AS is_output_changed, coalesce(b.result, '') <> coalesce(t.result, '') AS is_result_changed,
CASE WHEN b.result = 'Fail' AND t.result = 'Pass' THEN 'Improved' WHEN b.result = 'Pass' AND t.result = 'Fail' THEN 'Regressed' WHEN t.result = 'Pass' THEN 'Unchanged Pass' WHEN t.result = 'Fail' THEN 'Unchanged Fail' ELSE 'Unchanged' END AS delta_status
FROM bb b FULL JOIN tt t ON t.run_id = b.run_id AND t.checkpoint = b.checkpoint AND t.seq_num = b.seq_num)"""


@query(f"WITH {CONSECUTIVE} SELECT * FROM cp")
def trace_compare(spark, sf_dir):
    return trace_store.consecutive(store(spark, sf_dir)).drop("target_answer_display", "category_display")


@query(f"WITH {CONSECUTIVE} SELECT run_id, checkpoint, seq_num FROM cp WHERE delta_status = 'Improved' AND error_category_target = 'Custom' AND (regexp_matches(prompt_display, '(?i)high|low') OR regexp_matches(model_output_target, '(?i)high|low')) AND is_output_changed")
def trace_compare_filter(spark, sf_dir):
    rows = trace_store.consecutive(store(spark, sf_dir))
    return trace_store.filtered(rows, "Improved", None, "Custom", "high|low", True).select("run_id", "checkpoint", "seq_num")


@query(f"""WITH {STORE} SELECT seq_num, model_output AS model_output_base, '(No checkpoint data)' AS model_output_target, result AS result_base, 'N/A' AS result_target, matching_score AS matching_score_base, 0.0 AS matching_score_target, error_category AS error_category_target, false AS is_output_changed, 'Baseline Only' AS delta_status FROM sd WHERE run_id = 'run0' AND checkpoint = 0
UNION ALL SELECT seq_num, '(No baseline available)', model_output, 'N/A', result, 0.0, matching_score, error_category, true, 'Single Checkpoint' FROM sd WHERE run_id = 'run1' AND checkpoint = 0""")
def trace_one_sided(spark, sf_dir):
    s = store(spark, sf_dir)
    some = lambda run: s.where((F.col("run_id") == run) & (F.col("checkpoint") == 0))
    both = trace_store.compared(some("run0"), some("none")).union(trace_store.compared(some("none"), some("run1")))
    return both.select("seq_num", "model_output_base", "model_output_target", "result_base", "result_target", "matching_score_base", "matching_score_target", "error_category_target", "is_output_changed", "delta_status")


@query(f"""WITH {STORE}, ba AS (SELECT * FROM sd WHERE run_id = 'run1' AND checkpoint = 0), ta AS (SELECT * FROM sd WHERE run_id = 'run1' AND checkpoint = 1)
SELECT (SELECT count(*) FROM ta) AS total, (SELECT count(*) FROM ba b FULL JOIN ta t ON t.seq_num = b.seq_num WHERE coalesce(b.model_output, '') <> coalesce(t.model_output, '')) AS changed,
(SELECT round(100.0 * avg((result = 'Pass')::INT), 1) FROM ba) AS base_pass_rate, (SELECT round(100.0 * avg((result = 'Pass')::INT), 1) FROM ta) AS target_pass_rate, round(100.0 * ((SELECT avg((result = 'Pass')::INT) FROM ta) - (SELECT avg((result = 'Pass')::INT) FROM ba)), 1) AS delta_rate""")
def trace_pass_rates(spark, sf_dir):
    s = store(spark, sf_dir).where("run_id = 'run1'")
    return trace_store.summary(s.where("checkpoint = 0"), s.where("checkpoint = 1"))


@query(f"WITH {STORE} SELECT run_id, checkpoint, seq_num, CASE WHEN run_id = 'run0' AND checkpoint = 0 AND seq_num = 0 THEN 'Hallucination' ELSE error_category END AS error_category, CASE WHEN run_id = 'run0' AND checkpoint = 0 AND seq_num = 0 THEN 'seen' ELSE notes END AS notes FROM sd")
def trace_annotation(spark, sf_dir):
    out, _ = trace_store.annotated(store(spark, sf_dir), ("run0", 0, 0), "Hallucination", "seen")
    return out.select("run_id", "checkpoint", "seq_num", "error_category", "notes")


@query(f"WITH {STORE} SELECT seq_num, prompt, result, matching_score, 'ck' AS checkpoint_name FROM sd WHERE run_id = 'run3'")
def trace_csv_round_trip(spark, sf_dir):
    path = io.shared_path(spark, "traces")
    s = store(spark, sf_dir).where("run_id = 'run3'").withColumns({"eval_num": F.col("checkpoint"), "category": F.lit("qa")})
    # Two headers: columns in another order, and one that the other lacks.
    s.where("checkpoint < 2").select("seq_num", "prompt", "result", "matching_score", "checkpoint_name").write.option("header", True).option("escape", '"').csv(f"{path}/a")
    s.where("checkpoint >= 2").select("checkpoint_name", "result", "prompt", "seq_num", "matching_score", "category").write.option("header", True).option("escape", '"').csv(f"{path}/b")
    return io.trace_files(spark, path).select("seq_num", "prompt", "result", "matching_score", "checkpoint_name")


@query("""WITH c AS (SELECT doc_id, string_split(text, ' ') AS w FROM documents WHERE text IS NOT NULL), z AS (SELECT doc_id, w[1:3] AS p, CASE WHEN doc_id % 3 = 0 THEN w[1:2] ELSE w[1:3] END AS o FROM c),
b AS (SELECT doc_id, p, o, len(p) = len(o) AS batch FROM z)
SELECT doc_id AS eval_num, CAST(coalesce(CASE WHEN doc_id % 2 = 0 THEN 5 END, 1) + i AS INTEGER) AS seq_num, CASE WHEN batch THEN p[i + 1] ELSE array_to_string(p, chr(10)) END AS prompt, CASE WHEN batch THEN o[i + 1] ELSE array_to_string(o, chr(10)) END AS output FROM (SELECT *, unnest(range(CASE WHEN batch THEN len(p) ELSE 1 END)) AS i FROM b)""")
def call_traces(spark, sf_dir):
    w = F.split("text", " ")
    calls = docs(spark, sf_dir).where("text is not null").select(F.col("doc_id").alias("eval_num"), F.lit("qa").alias("category"), F.when(F.col("doc_id") % 2 == 0, 5).alias("seq_start"), F.lit("now").alias("ts"), F.lit("f").alias("function"), F.lit("{}").alias("parameters"), F.slice(w, 1, 3).alias("prompts"), F.when(F.col("doc_id") % 3 == 0, F.slice(w, 1, 2)).otherwise(F.slice(w, 1, 3)).alias("outputs"))
    return trace_store.unrolled_calls(calls).select("eval_num", "seq_num", "prompt", "output")


# --- Reports -----------------------------------------------------------------------------------------------------


@query(f"""WITH {DENSE}, s AS (SELECT q.vec_id, q.label, count(*) FILTER (WHERE list_dot_product(q.e, i.e) / (q.m * i.m) >= 0.65) < 5 AS no FROM u q CROSS JOIN u i WHERE q.vec_id % 20 = 0 GROUP BY ALL),
o AS (SELECT count(*) FILTER (WHERE NOT no) AS grounded, count(*) FILTER (WHERE no) AS not_grounded FROM s), c AS (SELECT bool_and(rate <= 0.30) AS clusters_ok FROM (SELECT avg(no::INT) AS rate FROM s GROUP BY label))
SELECT grounded, not_grounded, grounded >= floor(0.8 * (grounded + not_grounded)) AS enough, clusters_ok, CASE WHEN grounded >= floor(0.8 * (grounded + not_grounded)) AND clusters_ok THEN 'complete' ELSE 'incomplete' END AS status FROM o, c""")
def retrieval_gates(spark, sf_dir):
    label = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("query_id"), F.col("label").cast("string").alias("cluster"))
    routed = _passed(spark, sf_dir).join(label, "query_id").withColumn("no_retrieval", F.col("n_passed") < 5)
    return reports.retrieval_gates(routed, 0.8)


@query("SELECT CASE WHEN label < 0 THEN 'dropped' ELSE printf('cluster_%03d', label) END AS cluster_label, count(*) AS n FROM embeddings WHERE vec_id % 6 <> 0 GROUP BY ALL")
def active_clusters(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select(clusters.label(F.col("label").cast("int")).alias("cluster_label"), F.when(F.col("vec_id") % 6 == 0, "dropped").otherwise("model").alias("assigned_by"))
    return reports.active(e)


@query("SELECT user_id, array_to_string(list(event_type || '=' || n ORDER BY event_type), ';') AS counts FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL) GROUP BY user_id")
def type_maps(spark, sf_dir):
    n = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    entries = F.transform(F.map_entries("map"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return reports.as_map(n, "event_type", "n", "user_id").select("user_id", F.array_join(F.array_sort(entries), ";").alias("counts"))


@query("""WITH m AS (SELECT s_suppkey AS k, 'models/' || lower(s_name) AS a, CASE s_suppkey % 4 WHEN 0 THEN 'HF/' || upper(s_name) WHEN 1 THEN 'x/' || s_name || '-chat' WHEN 2 THEN 'x/other' ELSE '' END AS b, s_suppkey % 3 AS vocab FROM supplier)
SELECT k, k % 4 < 2 AND (vocab = 0 OR vocab = 1) AS ok FROM m""")
def model_checks(spark, sf_dir):
    """Models named after suppliers against names of the same, a longer, another and no model, and three sizes of vocabulary."""
    k, name = F.col("s_suppkey"), F.col("s_name")
    other = F.when(k % 4 == 0, F.concat(F.lit("HF/"), F.upper(name))).when(k % 4 == 1, F.concat(F.lit("x/"), name, F.lit("-chat"))).when(k % 4 == 2, "x/other").otherwise("")
    return table(spark, sf_dir, "supplier").select(k.alias("k"), reports.model_matches(F.concat(F.lit("models/"), F.lower(name)), other, (k % 3).cast("int"), F.lit(1)).alias("ok"))


@query(r"""WITH s AS (SELECT item_id, text, string_split(text, ' ') AS w FROM benchmark)
SELECT CASE WHEN item_id % 3 = 0 THEN 'sample_' || item_id ELSE 'id' || item_id END AS sample_id, CASE WHEN item_id % 2 = 0 THEN 'named' ELSE CAST(item_id AS VARCHAR) END AS cluster, CASE WHEN item_id % 4 = 0 THEN coalesce(w[2], '') WHEN item_id % 4 = 1 THEN '' ELSE 'own' END AS answer, array_to_string(w[1:2], chr(10) || chr(10)) AS retrieved_context FROM s""")
def normal_samples(spark, sf_dir):
    i, w = F.col("item_id"), F.split("text", " ")
    b = table(spark, sf_dir, "benchmark").select("item_id", F.when(i % 3 != 0, F.concat(F.lit("id"), i)).alias("sample_id"), F.when(i % 2 == 0, "named").alias("cluster"), i.alias("cluster_id"), F.col("text").alias("question"), F.when(i % 4 == 0, w).alias("choices"), F.when(i % 4 == 0, 1).alias("answer_idx"), F.when(i % 4 > 1, "own").alias("answer"), F.slice(w, 1, 2).alias("chunks"))
    return reports.normal_sample(b, "item_id").drop("question")


@query("""WITH n AS (SELECT count(*) AS n FROM benchmark), t AS (SELECT item_id, row_number() OVER (ORDER BY 't' || item_id) - 1 AS rank FROM benchmark),
s AS (SELECT doc_id, md5('s' || doc_id) AS m FROM documents)
SELECT 's' || doc_id AS sample_id, item_id AS trace, true AS fallback FROM s, n, t WHERE rank = (('0x' || substr(m, 1, 16))::UBIGINT::HUGEINT % n * (18446744073709551616::HUGEINT % n) + ('0x' || substr(m, 17, 16))::UBIGINT::HUGEINT % n) % n""")
def sample_fallback(spark, sf_dir):
    t = table(spark, sf_dir, "benchmark").select(F.concat(F.lit("t"), "item_id").alias("sample_id"), F.col("item_id").alias("trace"))
    return reports.with_fallback(docs(spark, sf_dir).select(F.concat(F.lit("s"), "doc_id").alias("sample_id")), t)


@query("""WITH t AS (SELECT 's' || doc_id AS sample_id, doc_id AS trace FROM documents WHERE doc_id % 2 = 0) SELECT 's' || doc_id AS sample_id, trace, false AS fallback FROM documents LEFT JOIN t ON t.sample_id = 's' || doc_id""")
def sample_traces(spark, sf_dir):
    d = docs(spark, sf_dir).select(F.concat(F.lit("s"), "doc_id").alias("sample_id"), F.col("doc_id").alias("trace"))
    return reports.with_fallback(d.select("sample_id"), d.where("trace % 2 = 0"))


_RISK = f"""{HISTORY}, k AS (SELECT *, CASE WHEN eval_id % 4 <> 0 THEN perplexity / 25 END AS gain FROM h),
f AS (SELECT run, eval_id, qa, list_filter([CASE WHEN qa < 0.6 THEN 'qa' END, CASE WHEN gain IS NULL OR gain >= 2.0 THEN 'perplexity' END, CASE WHEN perplexity / 100 < 0.5 THEN 'secondary' END], lambda x: x IS NOT NULL) AS failed FROM k)"""


def _risk(spark, sf_dir):
    gain = F.when(F.col("eval_id") % 4 != 0, F.col("perplexity") / 25)
    r = reports.risk_report(F.col("qa"), gain, F.col("perplexity") / 100, F.lit(None).cast("double"))
    return history(spark, sf_dir).select("run", "eval_id", r.alias("r"))


@query(f"WITH {_RISK} SELECT run, eval_id, array_to_string(failed, ',') AS failed, CASE WHEN qa < 0.4 THEN 1 WHEN qa < 0.6 THEN 2 ELSE 3 END AS priority, CASE WHEN qa < 0.4 THEN 'CORPUS_QUALITY_AUDIT' WHEN qa < 0.6 THEN 'INCREASE_MODEL_SIZE' ELSE 'PROCEED_WITH_RISK_FLAG' END AS action FROM f")
def risk_reports(spark, sf_dir):
    names = F.transform("r.failed", lambda x: F.regexp_extract(x, "^([a-z]+)", 1))
    return _risk(spark, sf_dir).select("run", "eval_id", F.array_join(names, ",").alias("failed"), "r.priority", "r.action")


@query(f"WITH {_RISK} SELECT eval_id, 'run ' || run || ' | tokens ' || eval_id || ' | ' || CASE WHEN len(failed) = 0 THEN 'CONVERGED' ELSE 'CONTINUE' END || ' | failed gates: ' || CASE WHEN len(failed) > 0 THEN array_to_string(failed, ', ') ELSE 'none' END AS line FROM f")
def status_lines(spark, sf_dir):
    names = F.transform("r.failed", lambda x: F.regexp_extract(x, "^([a-z]+)", 1))
    d = _risk(spark, sf_dir).select("run", "eval_id", names.alias("failed"))
    return d.select("eval_id", reports.status_text(F.col("run"), F.col("eval_id"), F.when(F.size("failed") == 0, "CONVERGED").otherwise("CONTINUE"), F.col("failed")).alias("line"))


@query(r"""WITH w AS (SELECT doc_id, list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS w FROM documents), c AS (SELECT doc_id, CASE WHEN w IS NULL THEN [] ELSE w[:doc_id % 4] END AS c, doc_id % 5 - 1 AS i FROM w)
SELECT doc_id, CAST(len(c) AS BIGINT) AS n FROM c WHERE doc_id % 7 <> 0 AND i >= 0 AND i < len(c)""")
def valid_items(spark, sf_dir):
    """Question items whose choices are the first words of a document: those without a question, choices or an index among them go."""
    i = F.col("doc_id")
    choices = F.slice(F.array_distinct(T.words(F.col("text"))), F.lit(1), (i % 4).cast("int"))
    d = docs(spark, sf_dir).select("doc_id", F.when(i % 7 != 0, F.lit("q")).alias("question"), choices.alias("choices"), (i % 5 - 1).cast("int").alias("answer_idx"))
    return probes.valid_questions(d).select("doc_id", F.size("choices").cast("long").alias("n"))
