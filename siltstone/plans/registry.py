"""The queries over the driver's tables, and DuckDB SQL for their results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions import text as T
from siltstone.operators import chunks, cleaning, clusters, gates, near_dup, order, retrieval, scores, traces
from siltstone.streaming import evaluation

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turns with the assistant's next turn: conv_id, turn, prompt, answer."""
    c = table(spark, sf_dir, "conversations")
    a = c.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    return c.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("prompt")).join(a, ["conv_id", "turn"])


TURNS = "t AS (SELECT u.conv_id, u.turn, u.text AS prompt, a.text AS answer FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant' WHERE u.role = 'user')"
W = r"'[\p{L}\p{N}_]+'"
STRIP = r"regexp_replace(regexp_replace({0}, '^\s+', ''), '\s+$', '')"
HISTORY = "h AS (SELECT user_id AS run, event_id AS eval_id, value AS perplexity, CASE WHEN event_id % 3 = 0 THEN (event_id % 100) / 100.0::DOUBLE END AS qa FROM events)"


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics by run: users stand for runs, events for evaluations, values for perplexities."""
    qa = F.when(F.col("event_id") % 3 == 0, (F.col("event_id") % 100) / 100.0)
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("run"), F.col("event_id").alias("eval_id"), F.col("value").alias("perplexity"), qa.alias("qa"))


# --- Text -------------------------------------------------------------------------------------------------------


@query(r"SELECT doc_id, CAST(coalesce(len(regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]')), 0) AS BIGINT) AS n_tokens FROM documents")
def proxy_tokens(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", T.token_count(F.col("text")).alias("n_tokens"))


@query(rf"SELECT doc_id, text FROM documents WHERE length({STRIP.format('text')}) >= 300")
def min_length_gate(spark, sf_dir):
    return docs(spark, sf_dir).where(F.char_length(T.strip(F.col("text"))) >= 300).select("doc_id", "text")


@query(r"SELECT doc_id, coalesce(length(text) >= 100 AND len(regexp_extract_all(text, ',\s*\d+'))::DOUBLE / length(text) > 0.003, false) AS is_index FROM documents")
def index_density(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.coalesce(cleaning.is_index_page(F.col("text")), F.lit(False)).alias("is_index"))


@query("SELECT word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]{4,}')) AS word FROM documents) GROUP BY word HAVING count(*) >= 3")
def corpus_lexicon(spark, sf_dir):
    return chunks.lexicon(docs(spark, sf_dir))


@query(rf"SELECT item_id, {STRIP.format('lower(translate(text, ' + chr(39) + '()[]:,;.?!`' + chr(39)*2 + chr(34) + '#-*|' + chr(39) + ', ' + chr(39)*2 + '))')} AS normal FROM benchmark")
def match_normaliser(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", T.match_normal(F.col("text")).alias("normal"))


@query(rf"""SELECT item_id, {STRIP.format("regexp_replace(translate(lower(text), '!" + chr(34) + "#$%&''()*+,-./:;<=>?@[\\]^_`{|}~', ''), '\\s+', ' ', 'g')")} AS normal FROM benchmark""")
def answer_normaliser(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", T.answer_normal(F.col("text")).alias("normal"))


def _eval_sql(column: str) -> str:
    out = column
    for pattern, to in T.EVAL_RULES:
        pattern, to = pattern.replace("'", "''"), to.replace("$", "\\").replace("'", "''")
        out = f"regexp_replace({out}, '{pattern}', '{to}', 'g')"
    return STRIP.format(out)


@query(f"SELECT conv_id, turn, {_eval_sql('text')} AS normal FROM conversations")
def eval_text_normaliser(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.eval_normal(F.col("text")).alias("normal"))


# --- Cleaning ----------------------------------------------------------------------------------------------------

BOILERPLATE = rf"""
n AS (SELECT source, count(*) AS chunks FROM documents GROUP BY source HAVING count(*) >= 3),
l AS (SELECT source, {STRIP.format('line')} AS line FROM (SELECT source, unnest(string_split(text, chr(10))) AS line FROM documents)),
b AS (SELECT l.source, line, count(*) AS n FROM l JOIN n ON n.source = l.source WHERE length(line) BETWEEN 1 AND 79
      GROUP BY l.source, line, chunks HAVING count(*) >= least(15, greatest(3, floor(chunks * 0.10))))"""


@query(f"WITH {BOILERPLATE} SELECT * FROM b")
def boilerplate_lines(spark, sf_dir):
    return chunks.boilerplate_lines(docs(spark, sf_dir))


@query(rf"""WITH {BOILERPLATE},
e AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents),
k AS (SELECT doc_id, string_agg(e.line, chr(10) ORDER BY pos) AS kept FROM e
      WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.source = e.source AND b.line = {STRIP.format('e.line')}) GROUP BY doc_id)
SELECT d.doc_id, d.source, coalesce(kept, '') AS text FROM documents d LEFT JOIN k ON k.doc_id = d.doc_id""")
def strip_boilerplate(spark, sf_dir):
    return chunks.strip_boilerplate(docs(spark, sf_dir))


def _re2(pattern: str) -> str:
    return pattern.replace("'", "''")


#: No SQL for the line kinds: word boundaries are those of Unicode, which DuckDB's patterns lack; tests hold them against Python.
@query()
def furniture_lines(spark, sf_dir):
    kinds = docs(spark, sf_dir).select("doc_id", F.explode(cleaning.line_kinds(F.col("text"))).alias("k"))
    return kinds.where("k.kind is not null").groupBy("doc_id", F.col("k.kind").alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query()
def line_filter(spark, sf_dir):
    return docs(spark, sf_dir).where("text is not null").select("doc_id", cleaning.without_furniture(F.col("text")).alias("text"))


@query(f"""SELECT doc_id, {' + '.join(f"regexp_matches(text, '(?i){_re2(p)}')::INT" for p in cleaning.FRONT_MATTER)} >= 2
 OR regexp_matches(text, '(?i){'|'.join(cleaning.STRONG_FRONT_MATTER)}') AS front_matter FROM documents WHERE text IS NOT NULL""")
def front_matter(spark, sf_dir):
    return docs(spark, sf_dir).where("text is not null").select("doc_id", cleaning.is_front_matter(F.col("text")).alias("front_matter"))


@query()
def clean_corpus(spark, sf_dir):
    named = docs(spark, sf_dir).withColumn("source", F.concat("source", F.lit(".pdf")))
    return cleaning.clean(named).select("doc_id", "text")


@query(r"""SELECT doc_id, coalesce(regexp_matches(lower(text), 'contents|list of|directory') AND n > 0 AND (hits >= 4 OR hits::DOUBLE / n > 0.20), false) AS is_contents FROM (
 SELECT doc_id, text, len(ls) AS n, len(list_filter(ls, lambda x: regexp_matches(x, '(\.|\s|-)\s*\d+$') OR regexp_matches(x, '(?i)^\s*(chapter|section|part|unit)\s+\d+'))) AS hits FROM (
 SELECT doc_id, text, list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(regexp_replace(x, '^\s+', ''), '\s+$', '')), lambda x: x <> '') AS ls FROM documents))""")
def contents_pages(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.coalesce(cleaning.is_contents_page(F.col("text")), F.lit(False)).alias("is_contents"))


@query()
def html_text(spark, sf_dir):
    from siltstone.sources import io

    return table(spark, sf_dir, "pages").select("page_id", io.html_text().alias("text"))


# --- Near duplicates ---------------------------------------------------------------------------------------------

SHINGLES = rf"""
w AS (SELECT doc_id, regexp_extract_all(lower(text), {W}) AS w FROM documents WHERE text IS NOT NULL),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))
      WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS sh FROM w)"""


@query(f"WITH {SHINGLES} SELECT doc_id, CAST(len(sh) AS BIGINT) AS n_shingles FROM s")
def shingle_counts(spark, sf_dir):
    return docs(spark, sf_dir).where("text is not null").select("doc_id", F.size(T.shingles(F.col("text"))).cast("long").alias("n_shingles"))


@query(f"""WITH {SHINGLES}, e AS (SELECT doc_id, unnest(sh) AS shingle FROM s), m AS (SELECT doc_id, md5(shingle) AS m FROM e)
SELECT doc_id, min(lpad(CAST(CAST('0x' || m[15:16] || m[13:14] || m[11:12] || m[9:10] || m[7:8] || m[5:6] || m[3:4] || m[1:2] AS UBIGINT) AS VARCHAR), 20, '0')) AS least FROM m GROUP BY doc_id""")
def minhash_shingle_md5(spark, sf_dir):
    # The least of a text is found in its row, so that no shingle is shuffled or sorted; rows of one id share theirs. Hex digits, highest first,
    # are in the order of the numbers. Texts without shingles go last of all, as a filter before would work out all digests twice.
    least = F.array_min(F.transform(T.shingles(F.col("text")), T.shingle_hex))
    each = docs(spark, sf_dir).select("doc_id", least.alias("least")).groupBy("doc_id").agg(F.min("least").alias("least"))
    return each.where("least is not null").select("doc_id", F.lpad(F.conv("least", 16, 10), 20, "0").alias("least"))


@query(f"""WITH {SHINGLES}, e AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS x FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n + b.n - count(*) AS u, count(*) AS i FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n)
SELECT a, b, round(i::DOUBLE / u, 6) AS jaccard FROM p WHERE i::DOUBLE / u >= 0.85""")
def near_dup_pairs(spark, sf_dir):
    d = docs(spark, sf_dir).where("text is not null").select(F.col("doc_id").alias("seq"), "text")
    return near_dup.exact_pairs(d).select("a", "b", F.round("jaccard", 6).alias("jaccard"))


@query()
def near_dup_survivors(spark, sf_dir):
    d = docs(spark, sf_dir).withColumnRenamed("doc_id", "seq")
    return near_dup.survivors(d).withColumnRenamed("seq", "doc_id")


@query("SELECT doc_id, printf('domain_doc_%06d', row_number() OVER (ORDER BY doc_id) - 1) AS new_id FROM documents")
def reindex_ids(spark, sf_dir):
    return order.reindex(docs(spark, sf_dir).select("doc_id"), "doc_id")


BUDGET = r"""n AS (SELECT doc_id, CAST(len(regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]')) AS BIGINT) AS n_tokens FROM documents),
c AS (SELECT *, CAST(sum(n_tokens) OVER (ORDER BY doc_id) AS BIGINT) AS cumulative FROM n WHERE n_tokens > 0)"""


@query(f"WITH {BUDGET} SELECT * FROM c WHERE cumulative - n_tokens < 614400")
def replay_budget(spark, sf_dir):
    return order.token_budget(docs(spark, sf_dir).select("doc_id", T.token_count(F.col("text")).alias("n_tokens")), "doc_id", "n_tokens", 614_400)


@query(f"WITH {BUDGET} SELECT *, least(n_tokens, 614400 - (cumulative - n_tokens)) AS taken FROM c WHERE cumulative - n_tokens < 614400")
def replay_exact(spark, sf_dir):
    return order.exact_cut(docs(spark, sf_dir).select("doc_id", T.token_count(F.col("text")).alias("n_tokens")), "doc_id", "n_tokens", 614_400)


# --- Chunks ------------------------------------------------------------------------------------------------------

_CHUNKS = r"""w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS w FROM documents WHERE text IS NOT NULL),
c AS (SELECT doc_id, w, unnest(range(CASE WHEN len(w) = 0 THEN 0 WHEN len(w) <= {0} THEN 1 ELSE CAST(ceil((len(w) - {0})::DOUBLE / ({0} - {1})) AS BIGINT) + 1 END)) AS i FROM w)
SELECT doc_id, CAST(i AS INTEGER) AS chunk_no, array_to_string(w[i * ({0} - {1}) + 1 : i * ({0} - {1}) + {0}], ' ') AS text, CAST(len(w[i * ({0} - {1}) + 1 : i * ({0} - {1}) + {0}]) AS INTEGER) AS token_count FROM c"""


@query("WITH " + _CHUNKS.format(512, 64))
def chunk_windows(spark, sf_dir):
    return chunks.chunk(docs(spark, sf_dir).where("text is not null"), 512, 64)


@query("WITH " + _CHUNKS.format(256, 32))
def abstract_windows(spark, sf_dir):
    return chunks.chunk(docs(spark, sf_dir).where("text is not null"), 256, 32)


@query(rf"""WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), {W}) AS w FROM documents WHERE text IS NOT NULL),
b AS (SELECT doc_id, w, unnest(range(len(w) // 128)) AS i FROM w) SELECT doc_id, CAST(i AS INTEGER) AS block_no, md5(array_to_string(w[i * 128 + 1 : i * 128 + 128], ' ')) AS block FROM b""")
def training_blocks(spark, sf_dir):
    w = docs(spark, sf_dir).where("text is not null").select("doc_id", T.words(F.col("text")).alias("tokens"))
    return chunks.blocks(w, 128).select("doc_id", "block_no", F.md5(F.array_join("tokens", " ")).alias("block"))


# --- Retrieval ---------------------------------------------------------------------------------------------------

BM25 = rf"""e AS (SELECT doc_id AS chunk_id, unnest(regexp_extract_all(lower(text), {W})) AS word FROM documents),
l AS (SELECT doc_id AS chunk_id, coalesce(len(regexp_extract_all(lower(text), {W})), 0) AS dl FROM documents),
g AS (SELECT count(*) AS docs, avg(dl) AS avgdl FROM l),
a AS (SELECT item_id AS query_id, word, count(*) AS qn FROM (SELECT item_id, unnest(regexp_extract_all(lower(text), {W})) AS word FROM benchmark) GROUP BY ALL),
tf AS (SELECT chunk_id, word, count(*) AS tf FROM e GROUP BY ALL), df AS (SELECT word, count(*) AS df FROM tf GROUP BY word),
p AS (SELECT query_id, chunk_id, round(sum(qn * ln((docs - df + 0.5) / (df + 0.5) + 1.0) * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / avgdl))), 6) AS score
      FROM tf JOIN df USING (word) JOIN l USING (chunk_id) JOIN a USING (word), g GROUP BY ALL),
z AS (SELECT item_id AS query_id, doc_id AS chunk_id, coalesce(score, 0.0) AS score FROM benchmark CROSS JOIN documents LEFT JOIN p ON query_id = item_id AND chunk_id = doc_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM z)"""


def _items(spark, sf_dir):
    d, b = docs(spark, sf_dir), table(spark, sf_dir, "benchmark")
    return d.select(F.col("doc_id").alias("chunk_id"), "text"), b.select(F.col("item_id").alias("query_id"), "text")


@query(f"WITH {BM25} SELECT query_id, chunk_id, CAST(rank AS INTEGER) AS rank, round(score, 4) AS score FROM r WHERE rank <= 10")
def bm25_topk(spark, sf_dir):
    return retrieval.bm25(*_items(spark, sf_dir), k=10).select("query_id", "chunk_id", "rank", F.round("score", 4).alias("score"))


DENSE = """v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
u AS (SELECT vec_id, label, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS m FROM v)"""


def _vectors(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector")), e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))


@query(f"""WITH {DENSE}, s AS (SELECT q.vec_id AS query_id, i.vec_id AS chunk_id, round(list_dot_product(q.e, i.e) / (q.m * i.m), 6) AS score FROM u q CROSS JOIN u i WHERE q.vec_id % 20 = 0)
SELECT query_id, chunk_id, CAST(rank AS INTEGER) AS rank, round(score, 4) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM s) WHERE rank <= 10""")
def dense_topk(spark, sf_dir):
    return retrieval.dense(*_vectors(spark, sf_dir), k=10).select("query_id", "chunk_id", "rank", F.round("score", 4).alias("score"))


@query(f"""WITH {DENSE}, s AS (SELECT q.vec_id AS query_id, i.vec_id AS chunk_id, list_dot_product(q.e, i.e) / (q.m * i.m) AS score FROM u q CROSS JOIN u i WHERE q.vec_id % 20 = 0)
SELECT query_id, count(*) FILTER (WHERE score >= 0.65) AS n_passed FROM s GROUP BY query_id""")
def relevance_gate(spark, sf_dir):
    return retrieval.passed(*_vectors(spark, sf_dir), 0.65)


@query(f"""WITH {BM25}, o AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY hits DESC, chunk_id) AS rank FROM (SELECT query_id, chunk_id, count(*) AS hits FROM tf JOIN a USING (word) GROUP BY ALL)),
f AS (SELECT query_id, chunk_id, round(sum(1.0::DOUBLE / (60 + rank)), 8) AS score FROM (SELECT query_id, chunk_id, rank FROM r WHERE rank <= 20 UNION ALL SELECT * FROM o WHERE rank <= 20) GROUP BY ALL)
SELECT query_id, chunk_id, score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM f) WHERE rank <= 10""")
def rrf_fuse(spark, sf_dir):
    items, asked = _items(spark, sf_dir)
    sparse = retrieval.bm25(items, asked, k=20)
    word = lambda d, i: d.select(i, F.explode(F.array_distinct(T.words(F.col("text")))).alias("word"))
    hits = word(items, "chunk_id").join(word(asked, "query_id"), "word").groupBy("query_id", "chunk_id").agg(F.count(F.lit(1)).alias("score"))
    lists = [x.withColumn("variant", F.lit(0)) for x in (sparse, retrieval.top_k(hits, 20))]
    return retrieval.rrf(lists, 10).select("query_id", "chunk_id", "score", "rank")


@query()
def query_variants(spark, sf_dir):
    return retrieval.variants(table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text"))


@query(f"""WITH {DENSE}, s AS (SELECT q.vec_id, q.label, count(*) FILTER (WHERE list_dot_product(q.e, i.e) / (q.m * i.m) >= 0.65) AS n FROM u q CROSS JOIN u i WHERE q.vec_id % 20 = 0 GROUP BY ALL)
SELECT cluster, count(*) AS n, round(avg(no::INT), 6) AS rate FROM (SELECT CAST(label AS VARCHAR) AS cluster, n < 5 AS no FROM s) GROUP BY ROLLUP (cluster)""")
def routing_rates(spark, sf_dir):
    passed = relevance_gate(spark, sf_dir).join(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("query_id"), F.col("label").cast("string").alias("cluster")), "query_id")
    return retrieval.routing_rates(retrieval.routed(passed, 5))


# --- Clusters ----------------------------------------------------------------------------------------------------

CENTRES = f"""{DENSE}, nv AS (SELECT vec_id, label, list_transform(e, lambda x: x / m) AS n FROM u),
ce AS (SELECT label, pos, avg(x) AS x FROM (SELECT label, unnest(n) AS x, generate_subscripts(n, 1) AS pos FROM nv) GROUP BY ALL),
cl AS (SELECT label, list(x ORDER BY pos) AS c FROM ce GROUP BY label), cn AS (SELECT label, c, sqrt(list_sum(list_transform(c, lambda x: x * x))) AS cm FROM cl)"""
COUNTS = "k AS (SELECT label AS cluster_id, count(*) AS n FROM embeddings GROUP BY label)"


def _points(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("cluster_id"), F.col("embedding").alias("vector"))


def _counts(spark, sf_dir):
    return _points(spark, sf_dir).groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {CENTRES}, s AS (SELECT vec_id AS id, cn.label AS cluster_id, round(list_dot_product(n, c) / cm, 6) AS score FROM nv CROSS JOIN cn)
SELECT id, cluster_id, round(score, 4) AS score FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, cluster_id) AS r FROM s) WHERE r = 1""")
def nearest_centroid(spark, sf_dir):
    p = _points(spark, sf_dir)
    return clusters.nearest_centroid(p, clusters.centroids(p)).select("id", "cluster_id", F.round("score", 4).alias("score"))


@query(f"""WITH {CENTRES} SELECT a.label AS a, b.label AS b, round(list_dot_product(a.c, b.c) / (a.cm * b.cm), 4) AS score FROM cn a JOIN cn b ON a.label < b.label
WHERE list_dot_product(a.c, b.c) / (a.cm * b.cm) >= 0.1""")
def centroid_pairs(spark, sf_dir):
    return clusters.merge_pairs(clusters.centroids(_points(spark, sf_dir)), 0.1).select("a", "b", F.round("score", 4).alias("score"))


@query(f"WITH {COUNTS} SELECT count(*) AS clusters, min(n) AS smallest, max(n) AS largest, round(avg(n), 1) AS mean, round(median(n), 1) AS median, round(stddev_pop(n), 1) AS std FROM k")
def cluster_stats(spark, sf_dir):
    return clusters.statistics(_counts(spark, sf_dir))


@query(f"""WITH {COUNTS}, v AS (SELECT *, CASE WHEN n < 3 THEN 0 ELSE greatest(1, CAST(round_even(n * 0.2, 0) AS BIGINT)) END AS n_val, CASE WHEN n < 3 THEN 0 ELSE CAST(round_even(n * 0.1, 0) AS BIGINT) END AS n_sealed FROM k)
SELECT cluster_id, n, n - n_val - n_sealed AS n_dev, n_val, n_sealed FROM v""")
def cluster_split_counts(spark, sf_dir):
    return clusters.split_counts(_counts(spark, sf_dir))


@query(f"""WITH {COUNTS}, v AS (SELECT *, CASE WHEN n < 3 THEN 0 ELSE greatest(1, CAST(round_even(n * 0.2, 0) AS BIGINT)) END AS n_val, CASE WHEN n < 3 THEN 0 ELSE CAST(round_even(n * 0.1, 0) AS BIGINT) END AS n_sealed FROM k),
m AS (SELECT vec_id AS id, label AS cluster_id, row_number() OVER (PARTITION BY label ORDER BY md5('42:' || vec_id), vec_id) AS turn FROM embeddings)
SELECT id, m.cluster_id, CASE WHEN turn <= n - n_val - n_sealed THEN 'dev' WHEN turn <= n - n_sealed THEN 'val' ELSE 'sealed' END AS split FROM m JOIN v ON v.cluster_id = m.cluster_id""")
def cluster_split(spark, sf_dir):
    return clusters.split_members(_points(spark, sf_dir).select("id", "cluster_id"))


@query(f"""WITH {COUNTS}, t AS (SELECT sum(n) AS total FROM k) SELECT cluster_id, n, round(n::DOUBLE / total, 6) AS fraction,
CAST(CASE WHEN n::DOUBLE / total < 0.02 THEN ceil(total * 0.02::DOUBLE) WHEN n::DOUBLE / total > 0.15 THEN floor(total * 0.15::DOUBLE) END AS BIGINT) AS cap FROM k, t""")
def reweight_caps(spark, sf_dir):
    return clusters.reweight_caps(_counts(spark, sf_dir))


@query(f"WITH {COUNTS} SELECT count(*) < 20 AS too_few, count(*) >= 20 AND count(*) < 50 AS few, coalesce(max(n)::DOUBLE / sum(n) > 0.40, false) AS lopsided, false AS noisy FROM k")
def cluster_gates(spark, sf_dir):
    return clusters.gates(_counts(spark, sf_dir), F.lit(0.0))


@query()
def pca_reduce(spark, sf_dir):
    return clusters.pca(_points(spark, sf_dir), 8)


# --- Scores ------------------------------------------------------------------------------------------------------

_F1 = r"""s AS (SELECT conv_id, turn, {0} AS p, {1} AS q FROM t),
x AS (SELECT conv_id, turn, p, q, list_sum(list_transform(list_distinct(p), lambda z: least(len(list_filter(p, lambda y: y = z)), len(list_filter(q, lambda y: y = z))))) AS i FROM s)
SELECT conv_id, turn, round(CASE WHEN len(p) = 0 AND len(q) = 0 THEN {2} WHEN coalesce(i, 0) = 0 THEN 0.0 ELSE 2.0::DOUBLE * i / (len(p) + len(q)) END, 6) AS f1 FROM x"""


@query(f"WITH {TURNS}, " + _F1.format(f"regexp_extract_all(lower(answer), {W})", f"regexp_extract_all(lower(prompt), {W})", "0.0"))
def lexical_f1(spark, sf_dir):
    return turns(spark, sf_dir).select("conv_id", "turn", F.round(scores.lexical_f1(F.col("answer"), F.col("prompt")), 6).alias("f1"))


_NORMAL = "list_filter(string_split(trim(regexp_replace(translate(lower({0}), '!\"#$%&''()*+,-./:;<=>?@[\\]^_`{{|}}~', ''), '\\s+', ' ', 'g')), ' '), lambda z: z <> '')"


@query(f"WITH {TURNS}, " + _F1.format(_NORMAL.format("answer"), _NORMAL.format("prompt"), "1.0"))
def answer_f1(spark, sf_dir):
    return turns(spark, sf_dir).select("conv_id", "turn", F.round(scores.answer_f1(F.col("answer"), F.col("prompt")), 6).alias("f1"))


_TRI = r"list_distinct(CASE WHEN length(c{0}) >= 3 THEN list_transform(range(1, length(c{0}) - 1), lambda i: substr(c{0}, i, 3)) ELSE [] END)"


@query(rf"""WITH {TURNS}, c AS (SELECT conv_id, turn, regexp_replace(lower(prompt), '[^\p{{L}}\p{{N}}\s]', '', 'g') AS c1, regexp_replace(lower(answer), '[^\p{{L}}\p{{N}}\s]', '', 'g') AS c2 FROM t),
g AS (SELECT conv_id, turn, {_TRI.format(1)} AS p, {_TRI.format(2)} AS q FROM c)
SELECT conv_id, turn, round(CASE WHEN len(p) = 0 OR len(q) = 0 THEN 0.0 ELSE len(list_intersect(p, q))::DOUBLE / len(list_distinct(list_concat(p, q))) END, 6) AS jaccard FROM g""")
def trigram_jaccard(spark, sf_dir):
    return turns(spark, sf_dir).select("conv_id", "turn", F.round(T.jaccard(T.trigrams(F.col("prompt")), T.trigrams(F.col("answer"))), 6).alias("jaccard"))


@query()
def citation_scores(spark, sf_dir):
    quoted = F.concat(F.lit('"'), F.substring("answer", 1, 60), F.lit('". '), F.col("answer"))
    s = turns(spark, sf_dir).select(F.concat_ws(":", "conv_id", "turn").alias("sample_id"), (F.col("conv_id") % 5 == 0).alias("no_retrieval"), quoted.alias("trace"), F.array("prompt", F.substring("answer", 1, 80)).alias("chunks"))
    return scores.citation_scores(s)


@query(r"""WITH s AS (SELECT conv_id, turn, list_filter(list_transform(regexp_split_to_array(text, '[.?!]+'), lambda x: regexp_replace(regexp_replace(x, '^\s+', ''), '\s+$', '')), lambda x: x <> '') AS p, text FROM conversations WHERE role = 'assistant' AND text IS NOT NULL)
SELECT conv_id, turn, CASE WHEN len(p) > 0 THEN p[len(p)] ELSE regexp_replace(regexp_replace(text, '^\s+', ''), '\s+$', '') END AS answer FROM s""")
def extract_answers(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").where("role = 'assistant' and text is not null")
    return c.select("conv_id", "turn", scores.extract_answer(F.col("text")).alias("answer"))


@query("""WITH p AS (SELECT count(*) AS n, avg((quality = toxic)::INT) AS po, (avg((quality = 1)::INT) * avg((toxic = 1)::INT) + avg((quality = 0)::INT) * avg((toxic = 0)::INT)) AS pe FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL)
SELECT n, round(po, 6) AS agreement, round(CASE WHEN pe < 1 THEN (po - pe) / (1 - pe) END, 6) AS kappa FROM p""")
def kappa(spark, sf_dir):
    return scores.kappa(table(spark, sf_dir, "labels").select(F.col("quality").alias("rater_a"), F.col("toxic").alias("rater_b")))


RECORDS = """r AS (SELECT orderkey AS sample_id, 'teacher' || orderkey % 3 AS teacher, 'cluster_00' || linenumber AS cluster, (orderkey % 5) / 4.0::DOUBLE AS answer,
CASE WHEN orderkey % 7 <> 0 THEN (orderkey % 11) / 10.0::DOUBLE END AS reasoning, CASE WHEN orderkey % 6 <> 0 THEN (linenumber % 4) / 3.0::DOUBLE END AS citation, (linenumber % 3) / 4.0::DOUBLE AS hallucination, orderkey % 4 = 0 AS no_retrieval
FROM (SELECT l_orderkey AS orderkey, l_linenumber AS linenumber FROM lineitem))"""


def records(spark, sf_dir):
    """Benchmark records made from order lines."""
    o, n = F.col("l_orderkey"), F.col("l_linenumber")
    return table(spark, sf_dir, "lineitem").select(o.alias("sample_id"), F.concat(F.lit("teacher"), o % 3).alias("teacher"), F.concat(F.lit("cluster_00"), n).alias("cluster"), (o % 5 / 4.0).alias("answer"), F.when(o % 7 != 0, o % 11 / 10.0).alias("reasoning"), F.when(o % 6 != 0, n % 4 / 3.0).alias("citation"), (n % 3 / 4.0).alias("hallucination"), (o % 4 == 0).alias("no_retrieval"))


SCORES = f"""{RECORDS}, ts AS (SELECT teacher, cluster, count(*) AS n, coalesce(round(avg(answer), 4), 0.0) AS answer, coalesce(round(avg(reasoning), 4), 0.0) AS reasoning,
round(avg(citation) FILTER (WHERE NOT no_retrieval), 4) AS citation, coalesce(round(avg(hallucination), 4), 0.0) AS hallucination FROM r GROUP BY teacher, cluster)"""


@query(f"WITH {SCORES} SELECT * FROM ts")
def teacher_scores(spark, sf_dir):
    return scores.teacher_scores(records(spark, sf_dir))


@query(f"WITH {SCORES} SELECT teacher, round(avg(answer), 4) AS answer, round(avg(reasoning), 4) AS reasoning, round(avg(citation), 4) AS citation, round(avg(hallucination), 4) AS hallucination FROM ts GROUP BY teacher")
def teacher_macro(spark, sf_dir):
    return scores.teacher_macro(scores.teacher_scores(records(spark, sf_dir)))


@query(f"WITH {SCORES} SELECT (SELECT count(*) = 21 FROM ts) AS complete, avg((reasoning IS NULL)::INT) <= 0.05 AS null_rate_ok, avg(hallucination) <= 0.50 AS hallucination_ok FROM r")
def benchmark_gates(spark, sf_dir):
    r = records(spark, sf_dir)
    return scores.benchmark_gates(r, scores.teacher_scores(r), 21)


@query(f"""WITH {RECORDS} SELECT sample_id, unnest(list_filter([CASE WHEN answer < 1.0 THEN 'answer' END, CASE WHEN reasoning IS NULL OR reasoning < 0.60 THEN 'reasoning' END,
CASE WHEN NOT no_retrieval AND (citation IS NULL OR citation < 0.30) THEN 'citation' END, CASE WHEN hallucination > 0.25 THEN 'hallucination' END], lambda x: x IS NOT NULL)) AS failure FROM r""")
def failure_classes(spark, sf_dir):
    return scores.failure_classes(records(spark, sf_dir))


# --- Evaluation history ------------------------------------------------------------------------------------------

GAIN = f"{HISTORY}, b AS (SELECT *, lag(perplexity) OVER (PARTITION BY run ORDER BY eval_id) AS p FROM h), g AS (SELECT run, eval_id, CASE WHEN p > 0 THEN (p - perplexity) / p * 100 WHEN p IS NOT NULL THEN 0.0 END AS gain FROM b)"


@query(f"WITH {GAIN} SELECT run, eval_id, round(gain, 6) AS gain FROM g")
def ppl_improvement(spark, sf_dir):
    return gates.improvement(history(spark, sf_dir)).select("run", "eval_id", F.round("gain", 6).alias("gain"))


@query(f"WITH {GAIN} SELECT run, eval_id, count(gain) OVER w = 2 AND coalesce(max(gain) OVER w < 2.0, false) AS plateau FROM g WINDOW w AS (PARTITION BY run ORDER BY eval_id ROWS BETWEEN 1 PRECEDING AND CURRENT ROW)")
def ppl_plateau(spark, sf_dir):
    return gates.plateau(history(spark, sf_dir)).select("run", "eval_id", F.coalesce("plateau", F.lit(False)).alias("plateau"))


@query(f"WITH {HISTORY} SELECT run, eval_id, coalesce(last_value(qa IGNORE NULLS) OVER (PARTITION BY run ORDER BY eval_id ROWS UNBOUNDED PRECEDING), 0.0) AS qa_carried FROM h")
def carry_forward(spark, sf_dir):
    return gates.carry_forward(history(spark, sf_dir), "qa").select("run", "eval_id", "qa_carried")


@query(f"WITH {HISTORY} SELECT run, eval_id FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY qa DESC NULLS LAST, perplexity, eval_id) AS r FROM h) WHERE r = 1")
def best_checkpoint(spark, sf_dir):
    return gates.best(history(spark, sf_dir), [F.col("qa").desc_nulls_last(), F.col("perplexity")]).select("run", "eval_id")


@query(f"WITH {HISTORY} SELECT run, eval_id FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY eval_id DESC) AS r FROM h) WHERE r <= 3")
def keep_last(spark, sf_dir):
    return gates.keep_last(history(spark, sf_dir), 3).select("run", "eval_id")


@query(f"""WITH {HISTORY} SELECT run, eval_id, CASE WHEN done AND eval_id >= 500 THEN 'CONVERGED' WHEN eval_id >= 800 THEN 'HARD_CAP' ELSE 'CONTINUE' END AS decision
FROM (SELECT run, eval_id, coalesce(qa >= 0.6, true) AND coalesce(perplexity / 100 >= 0.5, false) AS done FROM h)""")
def gate_decision(spark, sf_dir):
    tokens = F.col("eval_id")
    d = gates.decision(F.col("qa"), F.lit(None).cast("boolean"), F.col("perplexity") / 100, F.lit(None).cast("double"), tokens, F.lit(500), F.lit(800))
    return history(spark, sf_dir).select("run", "eval_id", d.alias("decision"))


@query()
def interval_triggers(spark, sf_dir):
    h = history(spark, sf_dir).select("run", F.col("eval_id").alias("at"), F.col("perplexity").alias("tokens"))
    return gates.triggers(h, 200.0)


@query("SELECT date_trunc('hour', ts)::TIMESTAMP AS start, event_type, count(*) AS n, round(sum(value), 4) AS value FROM events GROUP BY ALL")
def windowed_counts(spark, sf_dir):
    return evaluation.windowed_counts(table(spark, sf_dir, "events")).withColumn("start", F.col("start").cast("timestamp_ntz"))


# --- Traces ------------------------------------------------------------------------------------------------------

STORE = """st AS (SELECT 'run' || o_custkey % 5 AS run_id, CAST(o_custkey % 4 AS INTEGER) AS checkpoint, o_orderkey // 8 AS seq_num, o_orderpriority AS prompt, 'clerk' || o_custkey % 7 AS model_output,
CASE WHEN o_orderstatus = 'F' THEN 'Fail' ELSE 'Pass' END AS result, round(o_totalprice / 1000000, 4)::DOUBLE AS matching_score, CASE WHEN o_orderkey % 5 = 0 THEN 'Custom' ELSE '' END AS error_category,
CASE WHEN o_orderkey % 7 = 0 THEN 'note' ELSE '' END AS notes, 'ck' AS checkpoint_name, CAST(o_orderdate AS VARCHAR) AS ts, o_orderkey FROM orders),
sd AS (SELECT * EXCLUDE (r, o_orderkey) FROM (SELECT *, row_number() OVER (PARTITION BY run_id, checkpoint, seq_num ORDER BY o_orderkey DESC) AS r FROM st) WHERE r = 1)"""


def store(spark, sf_dir):
    """A trace store made from orders, one row a key."""
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    made = o.select(F.concat(F.lit("run"), F.col("o_custkey") % 5).alias("run_id"), (F.col("o_custkey") % 4).cast("int").alias("checkpoint"), F.floor(k / 8).alias("seq_num"), F.col("o_orderpriority").alias("prompt"), F.concat(F.lit("clerk"), F.col("o_custkey") % 7).alias("model_output"), F.when(F.col("o_orderstatus") == "F", "Fail").otherwise("Pass").alias("result"), F.round(F.col("o_totalprice") / 1000000, 4).cast("double").alias("matching_score"), F.when(k % 5 == 0, "Custom").otherwise("").alias("error_category"), F.when(k % 7 == 0, "note").otherwise("").alias("notes"), F.lit("ck").alias("checkpoint_name"), F.col("o_orderdate").cast("string").alias("ts"), k)
    from pyspark.sql import Window

    w = Window.partitionBy(*traces.KEYS).orderBy(F.desc("o_orderkey"))
    return made.withColumn("r", F.row_number().over(w)).where("r = 1").drop("r", "o_orderkey")


@query(f"WITH {STORE} SELECT run_id, count(DISTINCT checkpoint) AS checkpoints, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS n FROM sd GROUP BY run_id")
def list_runs(spark, sf_dir):
    return traces.runs(store(spark, sf_dir))


@query(f"WITH {STORE} SELECT run_id, checkpoint, count(*) AS n, round(avg((result = 'Pass')::INT), 6) AS pass_rate FROM sd GROUP BY run_id, checkpoint")
def list_checkpoints(spark, sf_dir):
    return traces.checkpoints(store(spark, sf_dir))


DIFF = f"""{STORE}, ba AS (SELECT * FROM sd WHERE run_id = 'run1' AND checkpoint = 0), ta AS (SELECT * FROM sd WHERE run_id = 'run1' AND checkpoint = 1),
df AS (SELECT coalesce(t.seq_num, b.seq_num) AS seq_num, CASE WHEN coalesce(t.prompt, '') <> '' THEN t.prompt ELSE coalesce(b.prompt, '') END AS prompt_display,
trim(coalesce(b.model_output, '')) <> trim(coalesce(t.model_output, '')) AS is_output_changed, coalesce(b.result, '') <> coalesce(t.result, '') AS is_result_changed,
round(coalesce(t.matching_score, 0) - coalesce(b.matching_score, 0), 4) AS score_delta,
CASE WHEN b.result = 'Fail' AND t.result = 'Pass' THEN 'Improved' WHEN b.result = 'Pass' AND t.result = 'Fail' THEN 'Regressed' WHEN t.result = 'Pass' THEN 'Unchanged Pass' WHEN t.result = 'Fail' THEN 'Unchanged Fail' ELSE 'Unchanged' END AS delta_status
FROM ba b FULL JOIN ta t ON t.seq_num = b.seq_num)"""


def _compared(spark, sf_dir):
    s = store(spark, sf_dir).where("run_id = 'run1'")
    return traces.diff(s.where("checkpoint = 0"), s.where("checkpoint = 1"))


@query(f"WITH {DIFF} SELECT * FROM df")
def trace_diff(spark, sf_dir):
    return _compared(spark, sf_dir)


@query(f"WITH {DIFF} SELECT delta_status, count(*) AS n, CAST(sum(is_output_changed::INT) AS BIGINT) AS changed FROM df GROUP BY delta_status")
def trace_summary(spark, sf_dir):
    return traces.summary(_compared(spark, sf_dir))


@query(f"WITH {DIFF} SELECT * FROM df WHERE delta_status IN ('Improved', 'Regressed') AND regexp_matches(prompt_display, '(?i)urgent|high') AND is_output_changed")
def trace_filter(spark, sf_dir):
    return traces.filtered(_compared(spark, sf_dir), ["Improved", "Regressed"], "urgent|high", True)


@query(f"""WITH {STORE}, nw AS (SELECT run_id, checkpoint, seq_num, prompt, model_output || '!' AS model_output, 'Pass' AS result, matching_score + 1 AS matching_score, 'Fail' AS error_category, 'new' AS notes, 'other' AS checkpoint_name, 'later' AS ts FROM sd WHERE seq_num % 2 = 0
UNION ALL SELECT 'run9', 0, seq_num, prompt, model_output, 'Pass', matching_score, '', '', 'c9', ts FROM sd WHERE run_id = 'run0' AND checkpoint = 0)
SELECT coalesce(n.run_id, s.run_id) AS run_id, coalesce(n.checkpoint, s.checkpoint) AS checkpoint, coalesce(n.seq_num, s.seq_num) AS seq_num, coalesce(n.prompt, s.prompt) AS prompt, coalesce(n.model_output, s.model_output) AS model_output,
coalesce(n.result, s.result) AS result, coalesce(n.matching_score, s.matching_score) AS matching_score, CASE WHEN s.error_category NOT IN ('', 'Pass', 'Fail') THEN s.error_category ELSE coalesce(n.error_category, s.error_category) END AS error_category,
CASE WHEN s.notes <> '' THEN s.notes ELSE coalesce(n.notes, s.notes) END AS notes, coalesce(s.checkpoint_name, n.checkpoint_name) AS checkpoint_name, coalesce(s.ts, n.ts) AS ts
FROM sd s FULL JOIN nw n ON n.run_id = s.run_id AND n.checkpoint = s.checkpoint AND n.seq_num = s.seq_num""")
def trace_upsert(spark, sf_dir):
    s = store(spark, sf_dir)
    new = s.where("seq_num % 2 = 0").withColumns({"model_output": F.concat("model_output", F.lit("!")), "result": F.lit("Pass"), "matching_score": F.col("matching_score") + 1, "error_category": F.lit("Fail"), "notes": F.lit("new"), "checkpoint_name": F.lit("other"), "ts": F.lit("later")})
    more = s.where("run_id = 'run0' and checkpoint = 0").withColumns({"run_id": F.lit("run9"), "checkpoint": F.lit(0), "result": F.lit("Pass"), "error_category": F.lit(""), "notes": F.lit(""), "checkpoint_name": F.lit("c9")})
    return traces.upsert(s, new.unionByName(more).withColumn("batch", F.lit(0)))


@query(f"WITH {STORE} SELECT CAST(priority AS INTEGER) AS priority, category FROM (VALUES (0, 'Pass'), (1, 'Fail'), (2, 'Hallucination'), (3, 'Format')) v(priority, category) UNION ALL SELECT DISTINCT 4, error_category FROM sd WHERE error_category <> '' AND error_category NOT IN ('Pass', 'Fail', 'Hallucination', 'Format')")
def error_categories(spark, sf_dir):
    return traces.error_categories(store(spark, sf_dir), ["Hallucination", "Format"])


@query("""WITH k AS (SELECT conv_id, turn, text, unnest(list_distinct(['s' || conv_id, 'd' || turn])) AS key FROM conversations)
SELECT key, conv_id, turn, text FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY turn DESC, conv_id DESC) AS r FROM k) WHERE r = 1""")
def trace_lookup(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").withColumns({"sample_id": F.concat(F.lit("s"), F.col("conv_id")), "doc_id": F.concat(F.lit("d"), F.col("turn")), "id": F.lit(None).cast("string"), "file_rank": F.col("turn"), "seq": F.col("conv_id")})
    return traces.latest_by_key(c).select("key", "conv_id", "turn", "text")


from siltstone.plans import probes as _probes  # noqa: E402, F401  (these add their queries; they need the names above)
from siltstone.plans import corpus as _corpus  # noqa: E402, F401
from siltstone.plans import review as _review  # noqa: E402, F401
from siltstone.plans import words as _words  # noqa: E402, F401
from siltstone.plans import stores as _stores  # noqa: E402, F401
