"""Probe operators on small fixtures, against plain Python where that is the plainer statement."""

import hashlib
import re

from pyspark.sql import functions as F

from siltstone.operators import probes


def test_term_hit_needs_whole_words(spark):
    rows = [("The Sulcus, deep", "sulcus"), ("sulci only", "sulcus"), ("xsulcus", "sulcus"), ("éa b", "a"), ("a.b (c)", "a.b"), ("x", ""), (None, "x"), ("x", None)]
    got = [r[0] for r in spark.createDataFrame(rows, "o string, t string").select(probes.term_hit(F.col("o"), F.col("t"))).collect()]

    def plain(o, t):
        drop = str.maketrans("", "", "()[]:,;.?!`'\"#-*|")
        o, t = ((x or "").translate(drop).strip().lower() for x in (o, t))
        return bool(t) and re.search(rf"\b{re.escape(t)}\b", o) is not None

    assert got == [plain(*r) for r in rows]
    assert got[:4] == [True, False, False, False]


def test_hash_bucket_is_the_digest_modulo_n(spark):
    rows = [("a", 7), ("", 1), ("doc_12", 2_147_483_647), ("ü", 1000)]
    got = [r[0] for r in spark.createDataFrame(rows, "k string, n long").select(probes.hash_bucket(F.col("k"), F.col("n"))).collect()]
    assert got == [int(hashlib.md5(k.encode()).hexdigest(), 16) % n for k, n in rows]


def test_page_furniture_counts_a_page_once(spark):
    pages = [("d", i, "head\nbody %d\nhead" % i) for i in range(3)] + [("e", 0, "head\nhead\nhead\nhead"), ("e", 1, None)]
    got = probes.page_furniture(spark.createDataFrame(pages, "doc string, page int, text string"), "doc", "page").collect()
    assert [tuple(r) for r in got] == [("d", "head", 3)]


def test_prompt_with_and_without_passages(spark):
    rows = [("q", ["a", "b"]), ("q", []), (None, None)]
    got = [r[0] for r in spark.createDataFrame(rows, "q string, p array<string>").select(probes.prompt(F.col("q"), F.col("p"))).collect()]
    assert got == ["Context:\n[1] a\n[2] b\n\nQuestion: q\nAnswer:", "Question: q\nAnswer:", "Question: \nAnswer:"]


def test_valid_questions(spark):
    rows = [("q", ["a"], 0), ("q", ["a"], 1), ("q", ["a"], -1), ("q", [], 0), (None, ["a"], 0), ("q", None, 0), ("q", ["a"], None)]
    assert probes.valid_questions(spark.createDataFrame(rows, "question string, choices array<string>, answer_idx int")).count() == 1


def test_document_windows_drop_short_ones_and_number_anew(spark):
    text = " ".join(["x"] * 360 + ["longer"] * 440)  # the first window is of short words
    docs = spark.createDataFrame([(1, text), (2, ""), (3, None)], "doc_id long, text string")
    got = probes.document_windows(docs, least_chars=1_200).orderBy("chunk_no").collect()
    assert [(r.doc_id, r.chunk_no, r.token_count) for r in got] == [(1, 0, 400)]


def test_empty_and_null_summaries(spark):
    none = spark.createDataFrame([], "score double")
    assert tuple(probes.score_summary(none, "score").first()) == (0, None, None, None, 0, False)
    rows = spark.createDataFrame([(None, True), ("a", None), ("a", False)], "g string, hit boolean")
    assert {r.group: (r.n, r.accuracy) for r in probes.group_accuracy(rows, "g", F.col("hit")).collect()} == {"unknown": (1, 1.0), "a": (2, 0.0)}
    h = spark.createDataFrame([(1, 1, 0.5), (1, 2, None), (2, 1, None)], "run int, eval_id int, qa double")
    assert {r.run: r.qa for r in probes.latest(h, "qa").collect()} == {1: 0.5, 2: 0.0}
