"""Sources, assembly, pages, judging and the trace store on small fixtures, against plain Python."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltstone.operators import assembly, cleaning, clusters, gates, judging, near_dup, pages, reports, retrieval, scores, trace_store, traces
from siltstone.sources import io


def test_json_lines(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id": "x", "text": "one"}\n\n{"id": 1\n[1]\n{"doc_id": "y", "text": ""}\n{"doc_id": "z", "text": "two"}\n')
    rows, skipped = io.json_lines_counted(spark, str(tmp_path), "id string, doc_id string, text string")
    assert rows.count() == 3 and skipped.first().skipped == 2
    assert sorted(r.doc_id for r in io.with_ids(rows).collect()) == ["x", "z"]
    with pytest.raises(Exception):
        io.json_lines(spark, str(tmp_path), "id string, text string", strict=True).collect()


def test_scans(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    for name in ("a.TXT", "sub/b.html", "c.csv"):
        (tmp_path / name).write_text("hello")
    assert sorted(r.name for r in io.scanner(spark, "local", str(tmp_path)).collect()) == ["a.TXT", "b.html"]
    with pytest.raises(ValueError):
        io.scanner(spark, "ftp", str(tmp_path))
    (tmp_path / "p.json").write_text('["p", "q"]')
    (tmp_path / "r.json").write_text('["r", "s"]')
    assert [tuple(r) for r in io.aligned(spark, str(tmp_path / "p.json"), str(tmp_path / "r.json")).collect()] == [(0, "p", "r"), (1, "q", "s")]
    (tmp_path / "cloze.json").write_text('[{"prompt": "a __", "target_term": "b", "category": "c"}]')
    assert [tuple(r) for r in io.cloze_items(spark, str(tmp_path / "cloze.json")).collect()] == [("a __", "b", "c")]
    with pytest.raises(FileNotFoundError, match="qa"):
        reports.require_inputs(spark, {"qa": str(tmp_path / "none"), "cloze": str(tmp_path / "cloze.json")})


def test_trace_files_by_their_own_headers(spark, tmp_path):
    (tmp_path / "one").mkdir()
    (tmp_path / "one" / "eval_0001.csv").write_text('prompt,seq_num,result\n"a, ""b""\nc",1,Pass\n')
    (tmp_path / "eval_0002.csv").write_text("seq_num,prompt,matching_score\nx,second,0.5\n2,third,bad\n")
    got = sorted((r.seq_num, r.prompt, r.result, r.matching_score) for r in io.trace_files(spark, str(tmp_path)).collect())
    assert got == [(0, "second", "", 0.5), (1, 'a, "b"\nc', "Pass", 0.0), (2, "third", "", 0.0)]
    assert sorted({r.batch for r in io.trace_files(spark, str(tmp_path)).collect()}) == [0, 1]
    (tmp_path / "none").mkdir()
    assert io.trace_files(spark, str(tmp_path / "none")).count() == 0


def test_html_text(spark):
    rows = [("<p>a&nbsp;&amp;&#233;&hellip;</p><script>x<y</script><!-- no --><b>b</b>",), (None,), ("",)]
    assert [r[0] for r in spark.createDataFrame(rows, "html string").select(io.html_text()).collect()] == ["a &é… b", "", ""]


@pytest.mark.parametrize(("n", "val"), [(1, 1), (2, 1), (3, 2), (5, 2), (100, 5)])
def test_split_sizes(spark, n, val):
    d = spark.createDataFrame([(i, f" t{i} ") for i in range(n)], "doc_id long, text string")
    got = assembly.train_validation(d).collect()
    assert sorted(r.turn for r in got) == list(range(n)) and sum(r.split == "validation" for r in got) == val
    assert all((r.text == r.text.strip()) == (r.split == "validation") and (r.turn >= n - val) == (r.split == "validation") for r in got)


def test_token_sink(spark, tmp_path):
    d = spark.createDataFrame([(i, f"one two {i}") for i in range(30)] + [(99, " ")], "doc_id long, text string")
    t = assembly.token_table(assembly.train_validation(d))
    assembly.write_tokens(t, "m", str(tmp_path))
    back = spark.read.parquet(f"{tmp_path}/tokens")
    assert back.agg(F.sum(F.size("ids"))).first()[0] == 30 * 4 and back.where("split = 'validation'").count() <= 2
    assert assembly.joined_tokens([t, t]).count() == 60
    assert [tuple(r) for r in assembly.page_windows(spark.createDataFrame([(1, 7)], "doc_id long, n_pages int"), 3).select("first_page", "last_page").collect()] == [(1, 3), (3, 5), (5, 7)]


def test_before_references(spark):
    text = "\U0001F600" * 6 + " kept\n# References\nall"
    assert spark.createDataFrame([(text,), ("no list",)], "t string").select(cleaning.before_references(F.col("t"))).toPandas().iloc[:, 0].tolist() == ["\U0001F600" * 6 + " kept", "no list"]


def test_page_filter(spark):
    toc = "Contents\n" + "\n".join(f"Chapter {i} name {i}" for i in range(1, 6))
    items = [("d", p, 0, "text", t) for p, t in enumerate(["All rights reserved. Copyright 2001 Library of Congress Cataloging", toc, "# Index\nheart, 12\nlung, 13", "real prose of the page", "more prose", "last prose"])]
    items += [("d", p, 1, "text", "Running Head") for p in (3, 4, 5)] + [("d", 3, 2, "Caption", "not prose"), ("d", 4, 2, "text", "Figure 3 shows")]
    got = pages.kept_items(spark.createDataFrame(items, "doc_id string, page int, seq int, label string, text string")).orderBy("page").collect()
    assert [r.text for r in got] == ["real prose of the page", "more prose", "last prose"]


def test_sections(spark):
    rows = [(1, None, "intro"), (2, 2, "References"), (3, None, "x"), (4, 4, "Index"), (5, 3, "Inner"), (6, None, "y"), (7, 2, "Methods"), (8, None, "z"), (9, 1, "Index"), (10, 1, "Part"), (11, None, "w")]
    want, skip = [], None
    for seq, level, text in rows:
        if level is not None:
            if skip is not None and level <= skip:
                skip = None
            if skip is None and re.search("references|index", text, re.I):
                skip = level
        want += [seq] if skip is None else []
    d = spark.createDataFrame([(0, *r) for r in rows], "doc_id int, seq int, level int, text string")
    assert sorted(r.seq for r in pages.outside_sections(d, "references|index").collect()) == want
    assert sorted(r.seq for r in cleaning.skipped_sections(d, "references|index").collect()) == want


def test_unwrapped(spark):
    blocks = [["One line", "goes on.", "New para-", "graph here", "And here: ", "lower"], [], ["x"]]

    def fold(items):
        out = []
        for b in items:
            if out and (not re.search(r"[.!?:]['\")\]]?$", out[-1]) or re.match(r"[a-z]", b)):
                out[-1] = out[-1][:-1] + b if out[-1].endswith("-") else f"{out[-1]} {b}"
            else:
                out.append(b)
        return out

    got = [r[0] for r in spark.createDataFrame([(b,) for b in blocks], "b array<string>").select(cleaning.unwrapped(F.col("b"))).collect()]
    assert got == [fold(b) for b in blocks]


def test_pca(spark):
    x = np.random.default_rng(3).normal(size=(40, 6))
    got = clusters.pca(spark.createDataFrame([(i, 0, v.tolist()) for i, v in enumerate(x)], "id int, cluster_id int, vector array<double>"), 3).toPandas().sort_values("id")
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    unit = unit - unit.mean(axis=0)
    _, _, axes = np.linalg.svd(unit, full_matrices=False)
    want = unit @ axes[:3].T
    want /= np.linalg.norm(want, axis=1, keepdims=True)
    assert np.allclose(np.abs(np.array(got.reduced.tolist())), np.abs(want), atol=1e-6)


def test_density_clusters(spark):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(c, 0.05, (20, 2)) for c in (0, 5)] + [np.array([[50.0, 50.0]])])
    got = clusters.density_clusters(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vector array<double>")).toPandas().sort_values("id").cluster_id.tolist()
    assert len(set(got[:20])) == len(set(got[20:40])) == 1 and got[0] != got[20] and got[40] == -1


def test_variants_and_citations(spark):
    d = spark.createDataFrame([(1, "What is the 'left atrium' called?"), (2, "Which bone is it?"), (3, "plain")], "query_id int, text string")
    got = {}
    for r in retrieval.variants(d).orderBy("query_id", "variant").collect():
        got.setdefault(r.query_id, []).append(r.text)
    assert got == {1: ["What is the 'left atrium' called?", "left atrium definition", "left atrium"], 2: ["Which bone is it?", "bone is it"], 3: ["plain"]}
    rows = [("a", False, 'He said "the heart pumps blood". So.', ["the heart pumps blood", "nothing alike at all"]), ("b", True, '"the heart pumps blood"', ["x"]), ("c", False, "no quote", ["x"])]
    got = {r.sample_id: (r.precision, r.recall, r.f1) for r in scores.citation_scores(spark.createDataFrame(rows, "sample_id string, no_retrieval boolean, trace string, chunks array<string>")).collect()}
    assert got == {"a": (1.0, 0.5, 0.666667), "b": (None, None, None), "c": (0.0, 0.0, 0.0)}


def test_dense_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(60, 5))
    d = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(99, None)], "chunk_id long, vector array<double>")
    q = d.where("chunk_id < 20").withColumnRenamed("chunk_id", "query_id")
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = np.round(unit[:20] @ unit.T, 6)
    want = {(i, int(c)) for i in range(20) for c in np.lexsort((np.arange(60), -s[i]))[:4]}
    for size in (4096, 8):
        monkeypatch.setattr(retrieval, "QUERY_BLOCK", size)
        assert {(r.query_id, r.chunk_id) for r in retrieval.dense(d, q, 4).collect()} == want
        assert {r.query_id: r.n_passed for r in retrieval.passed(d, q, 0.5).collect()} == {i: int((unit[i] @ unit.T >= 0.5).sum()) for i in range(20)}
    with pytest.raises(ValueError):
        retrieval.gate("other")


def test_judge_of_the_usual_form(spark):
    full = '<think>{"answer_accuracy": 0}</think>```json\n{"answer_accuracy": {"score": 1}, "reasoning_quality": {"step_validity": 5, "logical_coherence": 5, "absence_of_circular_reasoning": 5}, "citation_accuracy": {"precision": 0.25, "recall": 0.75}, "hallucination": {"rate": 0.25}}\n``` and {"more": 1}'
    rows = [(full, False), (full, True), ("nothing", False), (None, False), ('{"answer_accuracy": {"score": {"x": 1}}}', False)]
    got = [None if r.s is None else tuple(r.s) for r in spark.createDataFrame(rows, "r string, n boolean").select(judging.judge_scores(F.col("r"), F.col("n")).alias("s")).collect()]
    assert got[:4] == [(1.0, 1.0, 0.25, 0.75, 0.5, 0.25), (1.0, 1.0, None, None, None, 0.25), None, None]
    with pytest.raises(Exception, match="no choices"):
        spark.createDataFrame([([" "],)], "c array<string>").select(judging.clean_choices(F.col("c"))).collect()


def test_one_sided_groups(spark):
    s = spark.createDataFrame([("r", 0, 1, "p", "o", "Pass", 1.0, "", ""), ("r", 0, 2, "p", "o", "Fail", 0.0, "", "n"), ("r", 1, 2, "p", "new", " pass", 0.5, "Custom", "")], "run_id string, checkpoint int, seq_num int, prompt string, model_output string, result string, matching_score double, error_category string, notes string")
    got = {r.seq_num: (r.checkpoint, r.delta_status, r.is_output_changed, r.model_output_target) for r in trace_store.consecutive(s).collect()}
    assert got == {1: (1, "Unchanged", True, ""), 2: (1, "Improved", True, "new")}
    one = trace_store.compared(s.where("checkpoint = 5"), s.where("checkpoint = 1")).collect()
    assert [(r.delta_status, r.result_base, r.is_output_changed) for r in one] == [("Single Checkpoint", "N/A", True)]
    assert trace_store.summary(s.where("checkpoint = 0"), s.where("checkpoint = 1")).first().asDict() == {"total": 1, "changed": 2, "base_pass_rate": 50.0, "target_pass_rate": 100.0, "delta_rate": 50.0}
    assert trace_store.annotated(s, ("r", 9, 9), "x", "y")[1] is False and trace_store.annotated(s, ("r", 0, 1), "x", "y")[1] is True


def test_parameters():
    assert reports.Parameters.from_texts({"chunk_size": "256", "overlap": "AUTO"}) == reports.Parameters(chunk_size=256)
    for wrong in ({"bands": "7"}, {"val": "0.5"}, {"jaccard": "2"}, {"chunk_size": "0"}, {"other": "1"}):
        with pytest.raises(ValueError):
            reports.Parameters.from_texts(wrong)


def test_long_chain_of_suppression(spark):
    """Each document is alike to the next one only, so every second stays, however long the chain is."""
    words = [f"w{i}" for i in range(500)]
    texts = [" ".join(words[4 * i : 4 * i + 64]) for i in range(12)]
    got = sorted(r[0] for r in near_dup.survivors(spark.createDataFrame(list(enumerate(texts)), "seq long, text string"), 0.85).select("seq").collect())
    sets = [{tuple(t.split()[j : j + 5]) for j in range(60)} for t in texts]
    kept = []
    for i, s in enumerate(sets):
        if not any(len(s & sets[k]) / len(s | sets[k]) >= 0.85 for k in kept):
            kept.append(i)
    assert got == kept and 3 < len(kept) < 12


def test_trigger_stream(spark, tmp_path):
    path = str(tmp_path / "in")
    spark.createDataFrame([(1, 60.0), (1, 60.0), (2, 10.0)], "run long, tokens double").coalesce(1).write.json(path)
    stream = spark.readStream.schema("run long, tokens double").json(path)
    q = gates.trigger_stream(stream, 100).writeStream.format("memory").queryName("fired").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {r.run: (r.n_triggers, r.held) for r in spark.table("fired").collect()} == {1: (1, 0.0), 2: (0, 10.0)}


def test_trace_record_fallbacks(spark):
    d = spark.createDataFrame([("", "q", "bad"), ("p", "q", "0.123456")], "prompt string, question string, score string")
    got = [tuple(r) for r in traces.normalised(d, {"prompt": ["prompt", "question"], "matching_score": ["score"], "notes": ["none"]}).collect()]
    assert got == [("q", 0.0, ""), ("p", 0.1235, "")]
