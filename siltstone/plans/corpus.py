"""Queries of corpus assembly, pages, sources and hybrid retrieval; importing this module adds them to the registry."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltstone.functions import text as T
from siltstone.operators import assembly, cleaning, pages, retrieval
from siltstone.plans.registry import BM25, BOILERPLATE, STRIP, W, _items, docs, query, table
from siltstone.sources import io

TOKENS = r"coalesce(len(regexp_extract_all({0}, '[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_\s]')), 0)"


@query("SELECT 'benchmark' AS file, item_id AS id, text, NULL::VARCHAR AS source FROM benchmark UNION ALL SELECT 'documents', doc_id, text, source FROM documents")
def united_sources(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), "text")
    d = docs(spark, sf_dir).select(F.col("doc_id").alias("id"), "text", "source")
    return assembly.union({"documents": d, "benchmark": b}).select("file", "id", "text", "source")


@query(f"""WITH d AS (SELECT {TOKENS.format('text')} AS n, quality FROM documents LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id) USING (doc_id))
SELECT count(*) AS processed, count(*) FILTER (WHERE quality = 1) AS kept, count(*) - count(*) FILTER (WHERE quality = 1) AS dropped, CAST(sum(n) AS BIGINT) AS tokens, CAST(coalesce(sum(n) FILTER (WHERE quality = 1), 0) AS BIGINT) AS kept_tokens FROM d""")
def merge_summary(spark, sf_dir):
    q = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    d = docs(spark, sf_dir).join(q, "doc_id", "left")
    return assembly.merge_summary(d, F.col("quality") == 1, T.token_count(F.col("text")))


@query("""WITH r AS (SELECT doc_id, quality IS NOT NULL AND quality = 1 AS ok FROM labels), c AS (SELECT *, sum(ok::INT) OVER (ORDER BY doc_id) AS n FROM r)
SELECT doc_id, ok AND n <= 100 AS taken, NOT ok AND n < 100 AS skipped FROM c""")
def limited_items(spark, sf_dir):
    return assembly.limited(table(spark, sf_dir, "labels"), "doc_id", F.col("quality") == 1, 100).select("doc_id", "taken", "skipped")


_SPLIT = f"""s AS (SELECT doc_id, text, row_number() OVER (ORDER BY md5('42:' || doc_id), doc_id) - 1 AS turn, count(*) OVER () AS n FROM documents),
v AS (SELECT *, CASE WHEN n <= greatest(2, floor(n * 0.05)) THEN greatest(1, floor(n / 2)) ELSE greatest(2, floor(n * 0.05)) END AS val FROM s),
p AS (SELECT doc_id, turn, CASE WHEN turn >= n - val THEN 'validation' ELSE 'train' END AS split, CASE WHEN turn >= n - val THEN {STRIP.format('text')} ELSE text END AS text FROM v WHERE {STRIP.format("coalesce(text, '')")} <> '')"""


@query(f"WITH {_SPLIT} SELECT doc_id, turn, split, md5(text) AS text FROM p")
def train_validation_split(spark, sf_dir):
    return assembly.train_validation(docs(spark, sf_dir).select("doc_id", "text")).select("doc_id", "turn", "split", F.md5("text").alias("text"))


@query("SELECT doc_id, row_number() OVER (ORDER BY md5('7:' || doc_id), doc_id) - 1 AS turn FROM documents")
def shuffled_corpus(spark, sf_dir):
    return assembly.shuffled(docs(spark, sf_dir).select("doc_id"), seed=7)


@query(f"""WITH {_SPLIT}, t AS (SELECT split, {TOKENS.format('text')} + 1 AS n FROM p) SELECT 'base' AS base_model_name, 50257 AS vocab_size, count(*) FILTER (WHERE split = 'train') AS train_docs, count(*) FILTER (WHERE split <> 'train') AS val_docs,
CAST(coalesce(sum(n) FILTER (WHERE split = 'train'), 0) AS BIGINT) AS train_tokens, CAST(coalesce(sum(n) FILTER (WHERE split <> 'train'), 0) AS BIGINT) AS val_tokens FROM t""")
def token_metadata(spark, sf_dir):
    return assembly.token_metadata(assembly.token_table(assembly.train_validation(docs(spark, sf_dir).select("doc_id", "text"))), "base")


@query("""SELECT 0 AS stream, doc_id AS seq, n_chars AS n FROM documents UNION ALL SELECT 1, item_id, length(text) FROM benchmark""")
def joined_streams(spark, sf_dir):
    d = docs(spark, sf_dir).select("doc_id", F.array(F.col("n_chars").cast("long")).alias("ids"))
    b = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), F.array(F.char_length("text").cast("long")).alias("ids"))
    return assembly.joined_tokens([d, b], "doc_id").select("stream", "seq", F.get("ids", F.lit(0)).alias("n"))


@query(rf"""WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), {W}) AS w FROM documents WHERE text IS NOT NULL),
b AS (SELECT doc_id, w, unnest(range(len(w) // 65)) AS i FROM w) SELECT doc_id, CAST(i AS INTEGER) AS block_no, md5(array_to_string(w[i * 65 + 1 : i * 65 + 64], ' ')) AS input, md5(array_to_string(w[i * 65 + 2 : i * 65 + 65], ' ')) AS label FROM b""")
def sequence_batches(spark, sf_dir):
    w = docs(spark, sf_dir).where("text is not null").select("doc_id", T.words(F.col("text")).alias("tokens"))
    return assembly.sequence_batches(w, 64).select("doc_id", "block_no", F.md5(F.array_join("input", " ")).alias("input"), F.md5(F.array_join("label", " ")).alias("label"))


@query(rf"""WITH w AS (SELECT doc_id, list_transform(regexp_extract_all(lower(text), {W}), lambda x: length(x)) AS w FROM documents WHERE text IS NOT NULL)
SELECT doc_id, coalesce(list_max(w[1:20000]) < 12, true) AS ok, CAST(len(w) // 65 * 65 AS BIGINT) AS usable FROM w""")
def token_range(spark, sf_dir):
    sizes = F.transform(T.words(F.col("text")), lambda w: F.char_length(w))
    return docs(spark, sf_dir).where("text is not null").select("doc_id", assembly.checked_range(sizes, 12, 64).alias("c")).select("doc_id", "c.ok", "c.usable")


@query("SELECT vec_id, CAST(CASE WHEN vec_id % 3 = 0 THEN len(embedding) ELSE list_sum(list_transform(embedding, lambda x: (x > 0)::INT)) END AS BIGINT) AS n FROM embeddings")
def batch_token_counts(spark, sf_dir):
    mask = F.when(F.col("vec_id") % 3 != 0, F.transform("embedding", lambda x: (x > 0).cast("int")))
    return table(spark, sf_dir, "embeddings").select("vec_id", assembly.batch_tokens(mask, F.col("embedding")).alias("n"))


@query("SELECT doc_id, n_chars FROM documents")
def length_order(spark, sf_dir):
    return assembly.restored(assembly.by_length(docs(spark, sf_dir).select("doc_id", "n_chars"), F.col("n_chars"), "doc_id"), "doc_id")


@query("""WITH p AS (SELECT doc_id, CAST(1 + n_chars // 1000 AS INTEGER) AS n FROM documents), w AS (SELECT doc_id, n, unnest(range(CASE WHEN n <= 4 THEN 1 ELSE CAST(ceil((n - 4) / 3.0) AS BIGINT) + 1 END)) AS i FROM p)
SELECT doc_id, CAST(i AS INTEGER) AS window_no, CAST(i * 3 + 1 AS INTEGER) AS first_page, CAST(least(i * 3 + 4, n) AS INTEGER) AS last_page FROM w""")
def page_ranges(spark, sf_dir):
    p = docs(spark, sf_dir).select("doc_id", (1 + F.floor(F.col("n_chars") / 1000)).cast("int").alias("n_pages"))
    return assembly.page_windows(p, 4)


@query(rf"""WITH {BOILERPLATE},
e AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents),
k AS (SELECT doc_id, string_agg(e.line, chr(10) ORDER BY pos) AS kept FROM e WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.source = e.source AND b.line = {STRIP.format('e.line')}) GROUP BY doc_id)
SELECT doc_id, CAST({TOKENS.format('kept')} AS BIGINT) AS token_count FROM k WHERE length({STRIP.format('kept')}) >= 300""")
def corpus_without_headers(spark, sf_dir):
    return assembly.clean_of_headers(docs(spark, sf_dir)).select("doc_id", "token_count")


# --- Pages -------------------------------------------------------------------------------------------------------

LABELS = "CASE doc_id % 7 WHEN 0 THEN 'Caption' WHEN 1 THEN 'text' WHEN 2 THEN 'footnote' END"


@query(f"""SELECT doc_id, coalesce(lower({LABELS}) IN ('caption', 'picture', 'table', 'footnote'), false) OR coalesce(regexp_matches({STRIP.format('text')}, '(?i)^\\s*(?:FIGURE|Fig\\.|TABLE|BOX)\\s+\\d+.*$'), false) AS is_caption FROM documents""")
def caption_items(spark, sf_dir):
    label = F.when(F.col("doc_id") % 7 == 0, "Caption").when(F.col("doc_id") % 7 == 1, "text").when(F.col("doc_id") % 7 == 2, "footnote")
    return docs(spark, sf_dir).select("doc_id", pages.is_caption(label, F.col("text")).alias("is_caption"))


#: No SQL: page rules use the word boundaries of Unicode; a test holds them against a small fixture.
@query()
def page_items(spark, sf_dir):
    d = docs(spark, sf_dir).select("source", "doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("seq", "text"))
    items = d.withColumn("label", F.lit("text"))
    return pages.kept_items(items, "source", "doc_id", "seq").select("source", "doc_id", "seq")


@query("""WITH i AS (SELECT user_id, event_id, event_type, CASE WHEN event_id % 5 = 0 THEN 1 + event_id % 3 END AS level FROM events),
b AS (SELECT *, max(event_id) FILTER (WHERE level = 1) OVER w AS h1, max(event_id) FILTER (WHERE level <= 2) OVER w AS h2, max(event_id) FILTER (WHERE level <= 3) OVER w AS h3 FROM i WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
m AS (SELECT event_id, level, regexp_matches(event_type, '(?i)click|view') AS hit FROM i WHERE level IS NOT NULL)
SELECT b.user_id, b.event_id FROM b LEFT JOIN m m1 ON m1.event_id = h1 LEFT JOIN m m2 ON m2.event_id = h2 LEFT JOIN m m3 ON m3.event_id = h3
WHERE NOT (coalesce(m1.hit AND m1.level = 1, false) OR coalesce(m2.hit AND m2.level = 2, false) OR coalesce(m3.hit AND m3.level = 3, false))""")
def section_skip(spark, sf_dir):
    level = F.when(F.col("event_id") % 5 == 0, (1 + F.col("event_id") % 3).cast("int"))
    items = table(spark, sf_dir, "events").select("user_id", "event_id", level.alias("level"), F.col("event_type").alias("text"))
    return pages.outside_sections(items, "click|view", 3, "user_id", "event_id").select("user_id", "event_id")


#: No SQL: a fold over blocks; a test holds it against plain Python.
@query()
def unwrapped_paragraphs(spark, sf_dir):
    blocks = F.filter(F.transform(F.split("text", "\n"), T.strip), lambda x: x != "")
    return docs(spark, sf_dir).where("text is not null").select("doc_id", F.array_join(cleaning.unwrapped(blocks), "\n").alias("text"))


@query(f"""SELECT doc_id, regexp_matches(text, '(?im)^#+\\s+(?:References|Selected Readings?|Suggested Readings?|Further Readings?|Bibliography)\\b.*$') AS cut,
CASE WHEN regexp_matches(text, '(?im)^#+\\s+(?:References|Selected Readings?|Suggested Readings?|Further Readings?|Bibliography)\\b.*$') THEN {STRIP.format("regexp_split_to_array(text, '(?im)^#+\\s+(?:References|Selected Readings?|Suggested Readings?|Further Readings?|Bibliography)\\b.*$')[1]")} ELSE text END AS head
FROM (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN chr(128512) || text || chr(10) || '# References' || chr(10) || 'x' ELSE text END AS text FROM documents WHERE text IS NOT NULL)""")
def reference_cut(spark, sf_dir):
    text = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("\U0001F600"), F.col("text"), F.lit("\n# References\nx"))).otherwise(F.col("text"))
    d = docs(spark, sf_dir).where("text is not null").select("doc_id", text.alias("text"))
    return d.select("doc_id", F.col("text").rlike(cleaning.REFERENCES).alias("cut"), cleaning.before_references(F.col("text")).alias("head"))


# --- Sources -----------------------------------------------------------------------------------------------------


@query("SELECT doc_id, text, source FROM documents WHERE text <> ''")
def jsonl_round_trip(spark, sf_dir):
    path = io.shared_path(spark, "jsonl")
    io.write_json_lines(docs(spark, sf_dir).select(F.col("doc_id").cast("string").alias("id"), "text", "source"), path)
    return io.with_ids(io.json_lines(spark, path, "id string, text string, source string")).select(F.col("doc_id").cast("long").alias("doc_id"), "text", "source")


@query("SELECT count(*) FILTER (WHERE item_id % 7 = 0) AS skipped, count(*) FILTER (WHERE item_id % 7 <> 0) AS n FROM benchmark")
def jsonl_skipped(spark, sf_dir):
    path = io.shared_path(spark, "jsonl")
    b = table(spark, sf_dir, "benchmark")
    # Every seventh line is cut off, and a blank one follows every fifth.
    whole = F.to_json(F.struct("item_id", "text"))
    lines = b.select(F.when(F.col("item_id") % 7 == 0, F.left(whole, F.lit(14))).otherwise(whole).alias("value")).union(b.where("item_id % 5 = 0").select(F.lit(" ").alias("value")))
    lines.write.text(path)
    rows, skipped = io.json_lines_counted(spark, path, "item_id long, text string")
    return skipped.crossJoin(rows.agg(F.count(F.lit(1)).alias("n")))  # one row each


@query("SELECT user_id AS run, event_id AS eval_id, value FROM events")
def metrics_round_trip(spark, sf_dir):
    path = io.shared_path(spark, "metrics")
    h = table(spark, sf_dir, "events").select(F.col("user_id").alias("run"), F.col("event_id").alias("eval_id"), "value")
    io.append_metrics(h.where("event_id % 2 = 0"), path)
    io.append_metrics(h.where("event_id % 2 = 1"), path)
    return io.read_metrics(spark, path, "run long, eval_id long, value double")


@query(f"SELECT count(*) AS chunks, CAST(sum({TOKENS.format('text')}) AS BIGINT) AS tokens FROM documents")
def index_manifest(spark, sf_dir):
    d = docs(spark, sf_dir).select(F.col("doc_id").alias("chunk_id"), T.token_count(F.col("text")).alias("token_count"), "text")
    return io.write_index(d.select("chunk_id", retrieval.embedded(F.col("text")).alias("vector")), d.drop("text"), io.shared_path(spark, "index"))


def _embed(column: str) -> str:
    return rf"list_transform(range(64), lambda i: len(list_filter(regexp_extract_all(lower(coalesce({column}, '')), {W}), lambda w: ('0x' || substr(md5(w), 1, 2))::INT % 64 = i))::DOUBLE)"



@query(f"""SELECT item_id, array_to_string(list_transform(CASE WHEN item_id % 2 = 0 AND item_id % 4 = 0 THEN list_transform(range(64), lambda i: 1.0::DOUBLE) ELSE {_embed('text')} END, lambda x: CAST(x AS INTEGER)), ',') AS vector FROM benchmark""")
def cached_vectors(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark").select("item_id", "text")
    ones = F.transform(F.sequence(F.lit(1), F.lit(64)), lambda i: F.lit(1.0).cast("double"))
    # A key of another text is never met.
    cache = b.where("item_id % 2 = 0").select(F.sha2(F.when(F.col("item_id") % 4 == 0, F.col("text")).otherwise(F.concat("text", F.lit("!"))).cast("binary"), 256).alias("key"), ones.alias("vector"))
    shared = b.join(b.where("item_id % 4 = 0").select("text").distinct(), "text", "left_semi").where("item_id % 4 <> 0")
    made = io.with_cached_vectors(b.join(shared.select("item_id"), "item_id", "left_anti"), cache, retrieval.embedded)
    own = shared.select("item_id", retrieval.embedded(F.col("text")).alias("vector"))
    return made.select("item_id", "vector").union(own).select("item_id", F.array_join(F.transform("vector", lambda x: x.cast("int").cast("string")), ",").alias("vector"))


# --- Retrieval ---------------------------------------------------------------------------------------------------

_VECTORS = f"""dv AS (SELECT doc_id AS chunk_id, {_embed('text')} AS v FROM documents), qv AS (SELECT item_id AS query_id, {_embed('text')} AS v FROM benchmark),
dn AS (SELECT chunk_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS m FROM dv), qn AS (SELECT query_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS m FROM qv),
cs AS (SELECT query_id, chunk_id, round(CASE WHEN dn.m = 0 OR qn.m = 0 THEN 0.0 ELSE list_dot_product(list_transform(qn.v, lambda x: x / qn.m), list_transform(dn.v, lambda x: x / dn.m)) END, 6) AS cosine FROM qn CROSS JOIN dn)"""


def _embedded_items(spark, sf_dir):
    items, asked = _items(spark, sf_dir)
    vector = retrieval.embedded(F.col("text")).alias("vector")
    return items.select("chunk_id", "text", vector), asked.select("query_id", "text", vector)


#: Items of the benchmark whose text is a single variant, as SQL has no list of variants.
_SINGLE = r"(SELECT item_id FROM benchmark WHERE NOT regexp_matches(text, '[''\"]') AND NOT regexp_matches(text, '(?i)^(which|what|describe|definition|best|describes|is)\s'))"


@query(f"""WITH {BM25}, {_VECTORS}, dr AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, chunk_id) AS rank FROM cs),
f AS (SELECT query_id, chunk_id, round(sum(1.0::DOUBLE / (60 + rank)), 8) AS score FROM (SELECT query_id, chunk_id, rank FROM r WHERE rank <= 20 UNION ALL SELECT query_id, chunk_id, rank FROM dr WHERE rank <= 20) GROUP BY ALL)
SELECT query_id, chunk_id, score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM f) WHERE rank <= 10 AND query_id IN {_SINGLE}""")
def hybrid_topk(spark, sf_dir):
    chunks_, asked = _embedded_items(spark, sf_dir)
    single = asked.where(~F.col("text").rlike("['\"]") & ~F.col("text").rlike(r"(?i)^(which|what|describe|definition|best|describes|is)\s"))
    return retrieval.hybrid(chunks_, asked.select("query_id", "text"), 10, 20).join(single.select("query_id"), "query_id", "left_semi").select("query_id", "chunk_id", "score", "rank")


@query(f"WITH {BM25}, {_VECTORS} SELECT r.query_id, r.chunk_id, CAST(rank AS INTEGER) AS rank, cosine, cosine >= 0.65 AS relevant FROM r JOIN cs ON cs.query_id = r.query_id AND cs.chunk_id = r.chunk_id WHERE rank <= 10")
def sparse_gate(spark, sf_dir):
    items, asked = _embedded_items(spark, sf_dir)
    hits = retrieval.bm25(items, asked, 10).select("query_id", "chunk_id", "rank")
    met = retrieval.cosines(hits, items, asked)
    yes = retrieval.relevant(met, "sparse").select("query_id", "chunk_id", F.lit(True).alias("relevant"))
    return met.join(yes, ["query_id", "chunk_id"], "left").select("query_id", "chunk_id", "rank", "cosine", F.coalesce("relevant", F.lit(False)).alias("relevant"))


_LEXICAL = f"""(SELECT CASE WHEN len(p) = 0 OR len(q) = 0 THEN 0.0 ELSE 2.0::DOUBLE * coalesce(list_sum(list_transform(list_distinct(p), lambda z: least(len(list_filter(p, lambda y: y = z)), len(list_filter(q, lambda y: y = z))))), 0) / (len(p) + len(q)) END)"""


@query(f"""WITH {BM25}, h AS (SELECT query_id, chunk_id, regexp_extract_all(lower(b.text), {W}) AS p, regexp_extract_all(lower(d.text), {W}) AS q FROM r JOIN benchmark b ON item_id = query_id JOIN documents d ON doc_id = chunk_id WHERE rank <= 10),
z2 AS (SELECT query_id, chunk_id, round(1 / (1 + exp(-{_LEXICAL})), 6) AS score FROM h)
SELECT query_id, chunk_id, score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM z2) WHERE rank <= 3""")
def reranked_topk(spark, sf_dir):
    items, asked = _items(spark, sf_dir)
    return retrieval.reranked(retrieval.bm25(items, asked, 10), items, asked, 3).select("query_id", "chunk_id", "score", "rank")


@query("""SELECT vec_id, CASE vec_id % 5 WHEN 0 THEN 'score' WHEN 1 THEN 'cosine' WHEN 2 THEN 'cosine' ELSE 'score' END AS gate, CASE vec_id % 5 WHEN 3 THEN 0.30::DOUBLE WHEN 4 THEN 0.5::DOUBLE ELSE 0.65::DOUBLE END AS threshold FROM embeddings""")
def gate_table(spark, sf_dir):
    """What gates the hits of each vector, by a mode of search that its id names."""
    kinds = [retrieval.gate(m) for m in ("dense", "sparse", "hybrid")] + [retrieval.gate("hybrid", reranked=True), retrieval.gate("hybrid", 0.5, True)]
    at = (F.col("vec_id") % 5 + 1).cast("int")
    return table(spark, sf_dir, "embeddings").select("vec_id", *[F.element_at(F.array(*[F.lit(k[i]) for k in kinds]), at).alias(n) for i, n in enumerate(("gate", "threshold"))])
