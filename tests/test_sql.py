"""Operators by name in SQL, ordered limits that stop early, and sums in order over sparse numbers."""

import os
import random

from pyspark.sql import functions as F

from siltstone import sql
from siltstone.functions import text as T
from siltstone.operators import chunks, order
from siltstone.sources import io


def test_scalars_as_the_columns(spark):
    sql.register(spark)
    names = sql.register(spark)
    rows = [("It's  A test, of_x 3!",), (" é ß日本 a-b ",), ("",), (None,), ("tab\tand\nline",)]
    spark.createDataFrame(rows, "t string").createOrReplaceTempView("silt_texts")
    got = spark.sql("SELECT silt_words(t) AS w, silt_token_count(t) AS n, silt_answer(t) AS a, silt_jaccard(silt_words(t), silt_words('a test')) AS j FROM silt_texts").collect()
    t = F.col("t")
    want = spark.table("silt_texts").select(T.words(t).alias("w"), T.token_count(t).alias("n"), T.answer_normal(t).alias("a"), F.coalesce(T.jaccard(T.words(t), T.words(F.lit("a test"))), F.lit(0.0)).alias("j")).collect()
    for g, w in zip(got, want):
        assert g.w == w.w and g.n == w.n and g.a == w.a and abs((g.j or 0.0) - w.j) < 1e-12
    plan = spark.sql("SELECT silt_token_count(t) FROM silt_texts")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert spark.sql("SELECT silt_plateau(50, 49.5, 49.3, 2.0) AS a, silt_plateau(50, 40, 39.9, 2.0) AS b, silt_plateau(NULL, 40, 40, 2.0) AS c").first() == (True, False, False)
    assert len(names) == len(set(names)) == 8


def test_windows_in_sql(spark):
    sql.register(spark)
    rnd = random.Random(2)
    d = spark.createDataFrame([(i, " ".join("w" * rnd.randint(1, 3) for _ in range(n))) for i, n in enumerate([0, 1, 7, 10, 11, 19, 20, 57])] + [(99, None)], "doc_id int, text string")
    d.createOrReplaceTempView("silt_docs")
    got = spark.sql("SELECT d.doc_id, w.chunk_no, w.text, w.token_count FROM silt_docs d, LATERAL silt_windows(d.text, 10, 2) w").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, chunks.chunk(d.where("text is not null"), 10, 2).collect()))


def test_trace_rows_in_sql(spark):
    sql.register(spark)
    spark.createDataFrame([("a", b'x,"y"\n1,"two\nlines"\n3\n'), ("b", b""), ("c", None)], "path string, content binary").createOrReplaceTempView("silt_files")
    got = spark.sql("SELECT f.path, r.* FROM silt_files f, LATERAL silt_trace_rows(f.content) r ORDER BY place, field").collect()
    assert list(map(tuple, got)) == [("a", 0, "x", "1"), ("a", 0, "y", "two\nlines"), ("a", 1, "x", "3")]


def test_first_items_stop_early(spark, tmp_path):
    path = str(tmp_path / "in")
    os.makedirs(path)
    for k in range(16):
        with open(f"{path}/part-{k:03d}.json", "w") as f:
            f.write("".join("{broken\n" if i == 3 else "\n" if i == 5 else '{"n": %d}\n' % (10 * k + i) for i in range(10)))
    good = [10 * k + i for k in range(16) for i in range(10) if i not in (3, 5)]
    for most, files, skipped in ((3, 1, 0), (4, 1, 1), (8, 1, 1), (9, 3, 1), (24, 3, 3), (25, 7, 3), (1000, 16, 16)):
        rows, bad, read = io.first_items(spark, path, "n int", most)
        assert (sorted(r.n for r in rows.collect()), bad, read) == (good[:most], skipped, files)
    for k in range(3, 16):  # what isn't needed may be gone or broken
        os.remove(f"{path}/part-{k:03d}.json")
        os.makedirs(f"{path}/part-{k:03d}.json")
    assert io.first_items(spark, path, "n int", 20)[0].count() == 20
    assert io.first_items(spark, path, "n int", 0)[0].collect() == []


def test_sums_over_sparse_numbers(spark):
    rnd = random.Random(5)
    seqs = rnd.sample(range(-(10**15), 10**15), 3000)
    d = spark.createDataFrame([(s, rnd.randint(0, 9)) for s in seqs] + [(None, 5)], "seq long, v long").withColumn("__part", F.lit("clash"))
    got = {r.seq: r.total for r in order.running_total(d, "seq", F.col("v"), "total").collect()}
    run, want = 0, {}
    for s, v in sorted((r.seq, r.v) for r in d.where("seq is not null").collect()):
        run += v
        want[s] = run
    assert got == want
