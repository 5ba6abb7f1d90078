"""Queries against DuckDB on sf0.001, and rules that SQL cannot express against plain Python."""

import random
import re

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from siltstone.functions import text as T
from siltstone.operators import chunks, cleaning, clusters, gates, near_dup, traces
from siltstone.plans import registry

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return c


def rows(df: pd.DataFrame):
    def value(v):
        if v is None or v is pd.NA or v != v:
            return "NULL"
        return round(float(v), 9) + 0.0 if isinstance(v, (int, float)) or getattr(getattr(v, "dtype", None), "kind", "") in "ifb" and hasattr(v, "dtype") else str(v)

    return sorted(tuple(map(value, r)) for r in df[sorted(df.columns)].itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_oracle(spark, duck, name):
    assert rows(registry.queries()[name](spark, DATA).toPandas()) == rows(duck.sql(registry.oracle_sql()[name]).df())


def survivors(texts, threshold=0.85):
    kept, out = [], []
    for i, t in enumerate(texts):
        w = re.findall(r"\w+", t.lower())
        s = {" ".join(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else {" ".join(w)} if w else set()
        if s and any(len(s & k) / len(s | k) >= threshold for k in kept):
            continue
        if s:
            kept.append(s)
        out.append(i)
    return out


def test_greedy_chain(spark):
    rnd = random.Random(1)
    a = [f"w{rnd.randrange(10**6)}" for _ in range(200)]
    b, c = a[13:] + [f"x{i}" for i in range(13)], a[26:] + [f"x{i}" for i in range(13)] + [f"y{i}" for i in range(13)]
    for order in ((a, b, c), (c, b, a), (b, a, c)):
        texts = [" ".join(x) for x in order] + ["", " ".join(a)]
        d = spark.createDataFrame(list(enumerate(texts)), "seq long, text string")
        assert sorted(r[0] for r in near_dup.survivors(d).select("seq").collect()) == survivors(texts)


def test_signatures_are_exact():
    rnd = random.Random(42)
    a = [rnd.randint(1, near_dup.PRIME - 1) for _ in range(16)]
    b = [rnd.randint(0, near_dup.PRIME - 1) for _ in range(16)]
    h = [random.Random(7).getrandbits(64) for _ in range(50)]
    import numpy as np

    assert [int(x) for x in near_dup.signatures(np.array(h, dtype=np.uint64), 16, 42)] == [min((x * k + y) % near_dup.PRIME for k in h) for x, y in zip(a, b)]


@pytest.mark.parametrize("often", [0, 64])
def test_exact_pairs_at_random(spark, monkeypatch, often):
    """Copies, near copies and texts of a common passage, whatever the order of shingles; only prefixes are told apart by shingles."""
    monkeypatch.setattr(near_dup, "OFTEN", often)
    rnd, common = random.Random(3), [f"c{i}" for i in range(40)]
    texts = ["", "One two", "one  TWO", "one two three four five"]
    for _ in range(12):
        w = [f"w{rnd.randrange(10**6)}" for _ in range(rnd.randint(20, 120))] + common
        texts += [" ".join(w), " ".join(w).upper()] + [" ".join(w[k:] + [f"x{i}" for i in range(k)]) for k in (2, 5, 9)]
    grams = [{tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set() for w in (t.lower().split() for t in texts)]
    alike = {(a, b): len(grams[a] & grams[b]) / len(grams[a] | grams[b]) for b in range(len(texts)) for a in range(b) if grams[a] and grams[b]}
    d = spark.createDataFrame(list(enumerate(texts)), "seq long, text string")
    got = [(r.a, r.b, round(r.jaccard, 9)) for r in near_dup.exact_pairs(d).collect()]
    assert sorted(got) == sorted((*k, round(v, 9)) for k, v in alike.items() if v >= 0.85) and len(got) > 24


def test_copies_meet_as_one_set(spark, monkeypatch):
    """Of 40 copies of a text one set is compared; all copies joined by their shingles would be verified pair by pair."""
    seen, verified = [], near_dup.verified
    monkeypatch.setattr(near_dup, "verified", lambda pairs, *rest: seen.append(pairs.count()) or verified(pairs, *rest))
    words = [f"w{i}" for i in range(60)]
    texts = [" ".join(words)] * 40 + [" ".join(words + ["end"])]
    assert near_dup.exact_pairs(spark.createDataFrame(list(enumerate(texts)), "seq long, text string")).count() == 41 * 40 // 2 and seen == [1]


def test_chunk_windows(spark):
    d = spark.createDataFrame([(1, " ".join("w" * 15)), (2, "a b c"), (3, "")], "doc_id long, text string")
    got = {(r.doc_id, r.chunk_no): r.token_count for r in chunks.chunk(d, 10, 2).collect()}
    assert got == {(1, 0): 10, (1, 1): 7, (2, 0): 3}


def test_split_counts(spark):
    c = spark.createDataFrame([(0, 20), (1, 2), (2, 3), (3, 5)], "cluster_id int, n long")
    assert {r.cluster_id: (r.n_dev, r.n_val, r.n_sealed) for r in clusters.split_counts(c).collect()} == {0: (14, 4, 2), 1: (2, 0, 0), 2: (2, 1, 0), 3: (4, 1, 0)}


def test_token_f1(spark):
    d = spark.createDataFrame([("", ""), ("a b", ""), ("a a b", "a b b")], "h string, r string")
    from siltstone.operators import scores

    got = [tuple(round(x, 4) for x in r) for r in d.select(scores.lexical_f1(F.col("h"), F.col("r")), scores.answer_f1(F.col("h"), F.col("r"))).collect()]
    assert got == [(0.0, 1.0), (0.0, 0.0), (0.6667, 0.6667)]


def test_plateau(spark):
    h = spark.createDataFrame([(r, i, float(p)) for r, ps in enumerate(([10, 9.9, 9.85], [10, 9.9], [10, 8, 8.1])) for i, p in enumerate(ps)], "run int, eval_id int, perplexity double")
    last = {r.run: bool(r.plateau) for r in gates.plateau(h).orderBy("eval_id").collect()}
    assert last == {0: True, 1: False, 2: False}


def test_line_kinds(spark):
    texts = ["Contents\nMemory 12 and Sleep 345 here\nplain text", "| a | b |\n|---|---|\nx", "FIGURE 3 A thing\nkept line", "ISBN: 123-4\nthis page intentionally left blank\nok then", "iv\nM\nreal words here"]
    d = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    got = [r[0] for r in d.orderBy("i").select(cleaning.without_furniture(F.col("text"))).collect()]
    assert got == ["", "", "kept line", "ok then", "real words here"]


def test_clean(spark):
    d = spark.createDataFrame([("A B C D are (see Figure 4-2) here &amp; there", "x.pdf"), ("# References\nall", "x.pdf"), ("mem-\nory works", "x")], "text string, source string")
    got = [r.text for r in cleaning.clean(d, frozenset(["memory", "works"])).collect()]
    assert sorted(got) == ["", "ABCD are here & there", "memory works"]  # rows have no order


def test_trace_paths(spark):
    d = spark.createDataFrame([("logs/traces/20260814_081654/qa/eval_0001.csv",), ("logs/traces/qa/20260814_081654_eval_0001.csv",)], "p string")
    assert [tuple(r[0]) for r in d.select(traces.path_parts(F.col("p"))).collect()] == [("qa", "20260814_081654", 1)] * 2


def test_interval_triggers(spark):
    e = spark.createDataFrame([(1, i, 60.0) for i in range(5)], "run int, at int, tokens double")
    assert [r.triggered for r in gates.triggers(e, 100).orderBy("at").collect()] == [False, True, False, True, False]


def test_words_of_null(spark):
    assert spark.range(1).select(T.token_count(F.lit(None).cast("string")).alias("n")).first().n == 0


def test_bm25_shuffles_no_words(spark):
    """Words and scores of chunks stay in their rows: what is stored for a query set has one row a chunk, and k a task and query."""
    from unittest import mock

    from siltstone.operators import retrieval
    from siltstone.sources import shared

    kept = {}

    def written(df, name):
        kept[name] = shared.written(df, name)
        return kept[name]

    chunks = spark.createDataFrame([(i, f"alpha w{i % 7} w{i % 7}" if i else None) for i in range(400)], "chunk_id long, text string").repartition(2)
    asked = spark.createDataFrame([(1, "w3 alpha"), (2, "none such"), (3, "")], "query_id long, text string")
    with mock.patch.object(retrieval, "written", written):
        got = {(r.query_id, r["rank"]): (r.chunk_id, r.score) for r in retrieval.bm25(chunks, asked, 3).collect()}
    assert kept["asked-words"].count() == 400 and kept["best-scores"].count() <= 2 * 3
    assert [got[1, r][0] for r in (1, 2, 3)] == [3, 10, 17]
    assert [got[q, r] for q in (2, 3) for r in (1, 2, 3)] == [(0, 0.0), (1, 0.0), (2, 0.0)] * 2


def test_dense_holds_little_of_a_large_batch():
    """Scores of a batch are worked out a piece at a time, so that their memory doesn't grow with the batch."""
    import tracemalloc
    from types import SimpleNamespace

    import numpy as np
    import pyarrow as pa

    from siltstone.operators import retrieval

    rnd = np.random.default_rng(3)
    queries, items = rnd.normal(size=(1_024, 8)), rnd.normal(size=(5_000, 8))
    batch = pa.record_batch([pa.array(range(5_000), pa.int64()), pa.array(items.tolist(), pa.list_(pa.float64()))], ["chunk_id", "v"])
    best = retrieval._best(3, pa.int64(), pa.int64())(SimpleNamespace(value=(list(range(1_024)), queries)))
    tracemalloc.start()
    (got,) = best(iter([batch]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 80e6
    scores = np.round(queries @ items.T, 6)
    want = np.lexsort((np.broadcast_to(np.arange(5_000), scores.shape), -scores), axis=1)[:, :3]
    assert got.column(1).to_pylist() == want.ravel().tolist()


def test_least_shingle_is_found_in_its_row(spark):
    """No row is made of a shingle, which would then be sorted and shuffled."""
    plan = registry.queries()["minhash_shingle_md5"](spark, DATA)._jdf.queryExecution().toString()
    assert "Generate" not in plan and "xplode" not in plan
