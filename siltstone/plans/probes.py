"""Queries of the probe operators; importing this module adds them to the registry."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltstone.functions import text as T
from siltstone.operators import gates, probes, scores
from siltstone.plans.registry import _CHUNKS, _F1, HISTORY, STRIP, TURNS, W, docs, history, query, table, turns


@query("SELECT coalesce(event_type, 'unknown') AS \"group\", count(*) AS n, round(avg((value >= 50)::INT), 6) AS accuracy FROM events GROUP BY ALL")
def group_accuracy(spark, sf_dir):
    return probes.group_accuracy(table(spark, sf_dir, "events"), "event_type", F.col("value") >= 50)


@query("SELECT user_id AS run, round(exp(sum(value / 10) / sum(64)), 6) AS perplexity FROM events WHERE event_id % 10 <> 0 GROUP BY user_id")
def perplexity(spark, sf_dir):
    tokens = F.when(F.col("event_id") % 10 == 0, 7).otherwise(64)
    return probes.perplexity(table(spark, sf_dir, "events").select(F.col("user_id").alias("run"), (F.col("value") / 10).alias("nll"), tokens.alias("tokens")), 64)


@query(f"WITH {HISTORY} SELECT run, coalesce(arg_max(qa, eval_id) FILTER (WHERE qa IS NOT NULL), 0.0) AS qa FROM h GROUP BY run")
def latest_metric(spark, sf_dir):
    return probes.latest(history(spark, sf_dir), "qa")


@query("SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events) WHERE r <= 5")
def first_per_group(spark, sf_dir):
    return probes.first_k(table(spark, sf_dir, "events"), 5, "user_id", "ts", "event_id").select("user_id", "event_id")


@query(f"WITH f AS (WITH {TURNS}, " + _F1.format(f"regexp_extract_all(lower(answer), {W})", f"regexp_extract_all(lower(prompt), {W})", "0.0") + """)
SELECT count(f1) AS n, round(avg(f1), 4) AS mean, min(f1) AS least, max(f1) AS most, count(*) FILTER (WHERE f1 < 0.5) AS n_low, coalesce(avg(f1) >= 0.5, false) AS passed FROM f""")
def concept_summary(spark, sf_dir):
    f1 = turns(spark, sf_dir).select(F.round(scores.lexical_f1(F.col("answer"), F.col("prompt")), 6).alias("f1"))
    return probes.score_summary(f1, "f1")


@query("""WITH e AS (SELECT event_type AS name, count(*) AS calls, sum(value) AS total FROM events GROUP BY event_type), w AS (SELECT sum(total) AS whole FROM e)
SELECT name, calls, round(total, 4) AS total, round(total / calls, 4) AS mean, round(CASE WHEN whole > 0 THEN 100 * total / whole ELSE 0.0 END, 4) AS percent FROM e, w""")
def call_profile(spark, sf_dir):
    return probes.profile(table(spark, sf_dir, "events").withColumnRenamed("event_type", "name"), "name", "value")


@query(f"WITH {HISTORY} SELECT run, eval_id, CASE WHEN qa < 0.4 THEN 'audit' WHEN qa < 0.6 THEN 'larger_model' ELSE 'risk_flag' END AS action FROM h")
def remediation(spark, sf_dir):
    return history(spark, sf_dir).select("run", "eval_id", gates.remediation(F.col("qa")).alias("action"))


@query(f"""WITH {HISTORY} SELECT run, eval_id, unnest(list_filter([CASE WHEN qa < 0.6 THEN 'qa' END, CASE WHEN NOT (perplexity < 50) THEN 'plateau' END, CASE WHEN perplexity / 100 < 0.5 THEN 'cloze' END],
lambda x: x IS NOT NULL)) AS gate FROM h""")
def failed_gates(spark, sf_dir):
    failed = probes.failed_gates(F.col("qa"), F.col("perplexity") < 50, F.col("perplexity") / 100, F.lit(None).cast("double"))
    return history(spark, sf_dir).select("run", "eval_id", F.explode(failed).alias("gate"))


@query(f"""WITH n AS (SELECT source, count(DISTINCT doc_id) AS pages FROM documents GROUP BY source),
l AS (SELECT DISTINCT source, doc_id, {STRIP.format('line')} AS line FROM (SELECT source, doc_id, unnest(string_split(text, chr(10))) AS line FROM documents))
SELECT l.source, line, count(*) AS n FROM l JOIN n ON n.source = l.source WHERE length(line) BETWEEN 1 AND 119 GROUP BY l.source, line, pages HAVING count(*) >= greatest(3, floor(pages * 0.15::DOUBLE))""")
def page_furniture(spark, sf_dir):
    return probes.page_furniture(docs(spark, sf_dir), "source", "doc_id")


@query("WITH k AS (WITH " + _CHUNKS.format(400, 40) + ") SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY chunk_no) - 1 AS INTEGER) AS chunk_no, text, token_count FROM k WHERE length(text) >= 300")
def document_windows(spark, sf_dir):
    return probes.document_windows(docs(spark, sf_dir).where("text is not null"))


_SENTENCES = r"list_filter(list_transform(regexp_split_to_array(text, '[.?!]+'), lambda x: regexp_replace(regexp_replace(x, '^\s+', ''), '\s+$', '')), lambda x: x <> '')"


@query(f"SELECT conv_id, turn, CAST(len({_SENTENCES}) AS BIGINT) AS n FROM conversations WHERE text IS NOT NULL")
def sentence_counts(spark, sf_dir):
    return table(spark, sf_dir, "conversations").where("text is not null").select("conv_id", "turn", F.size(T.sentences(F.col("text"))).cast("long").alias("n"))


@query(f"""WITH s AS (SELECT conv_id, turn, text, {_SENTENCES} AS p FROM conversations WHERE text IS NOT NULL)
SELECT conv_id, turn, CASE WHEN len(p) > 0 THEN 'Context:' || chr(10) || array_to_string(list_transform(p[1:5], lambda x, i: '[' || i || '] ' || x), chr(10)) || chr(10) || chr(10) ELSE '' END
 || 'Question: ' || text || chr(10) || 'Answer:' AS prompt FROM s""")
def passage_prompts(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").where("text is not null")
    return c.select("conv_id", "turn", probes.prompt(F.col("text"), T.sentences(F.col("text"))).alias("prompt"))


#: No SQL: word boundaries are those of Unicode, which DuckDB's patterns lack; a test holds the query against Python.
@query()
def term_hits(spark, sf_dir):
    term = F.get(T.words(F.col("prompt")), F.lit(1))
    return turns(spark, sf_dir).select("conv_id", "turn", term.alias("term"), probes.term_hit(F.col("answer"), term).alias("hit"))


@query("""WITH g AS (SELECT vec_id, list_transform(range(1, 5), lambda i: embedding[i]::DOUBLE - embedding[i + 4]::DOUBLE) AS g FROM embeddings)
SELECT vec_id, CAST(list_position(g, list_max(g)) - 1 AS BIGINT) AS choice FROM g""")
def pmi_choice(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    return e.select("vec_id", scores.pmi_choice(F.slice("e", 1, 4), F.slice("e", 5, 4)).alias("choice"))


@query("""SELECT doc_id, (doc_id % 5 < 3)::INT::DOUBLE AS score FROM labels""")
def choice_scores(spark, sf_dir):
    given = F.array(*[F.lit(x) for x in ("B", "Option b.", "the Beta", "gamma", "answer c")])
    named = F.array(F.lit("alpha"), F.lit("the beta"), F.lit("gamma"))
    said = F.get(given, (F.col("doc_id") % 5).cast("int"))
    return table(spark, sf_dir, "labels").select("doc_id", scores.choice_accuracy(said, F.lit("The beta"), named).alias("score"))


@query("""SELECT doc_id, CAST((('0x' || substr(m, 1, 16))::UBIGINT::HUGEINT % 97 * (18446744073709551616::HUGEINT % 97) + ('0x' || substr(m, 17, 16))::UBIGINT::HUGEINT % 97) % 97 AS BIGINT) AS bucket
FROM (SELECT doc_id, md5(doc_id::VARCHAR) AS m FROM documents)""")
def hash_fallback(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", probes.hash_bucket(F.col("doc_id"), F.lit(97)).alias("bucket"))
