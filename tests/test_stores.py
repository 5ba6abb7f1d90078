"""Merged clusters, call trees, the kept trace store with its sync, and the evaluation stream."""

import datetime
import os
import random
import time

import pandas as pd
import pytest
from pyspark.sql import functions as F

from siltstone.operators import clusters, probes, trace_store
from siltstone.sources import kept_store
from siltstone.streaming import evaluation


def _sequential(ids, near):
    """Merging by pairs in order, comparing the roots."""
    root = {i: i for i in ids}
    for i in ids:
        for j in ids:
            if i < j and root[i] != root[j] and (min(root[i], root[j]), max(root[i], root[j])) in near:
                gone = root[j]
                for k in ids:
                    root[k] = root[i] if root[k] == gone else root[k]
    return root


@pytest.mark.parametrize("kind", ["chain", "random", "none", "all"])
def test_merge_map(spark, kind):
    rnd = random.Random(7)
    ids = sorted(rnd.sample(range(1000), 30))
    pairs = [(a, b) for a in ids for b in ids if a < b]
    near = {"chain": {(a, b) for a, b in zip(ids, ids[1:])}, "random": {p for p in pairs if rnd.random() < 0.1}, "none": set(), "all": set(pairs)}[kind]
    got = {r.cluster_id: r for r in clusters.merge_map(spark.createDataFrame(list(near), "a int, b int"), spark.createDataFrame([(i,) for i in ids], "cluster_id int")).collect()}
    want = _sequential(ids, near)
    assert {k: r.root for k, r in got.items()} == want
    number = {r: i for i, r in enumerate(sorted(set(want.values())))}
    assert all(r.new_id == number[r.root] for r in got.values())


def test_merged_points(spark):
    """Centroids at 0, 25 and 50 degrees: the outer ones are not alike, so the last stays."""
    import math

    at = lambda d: [math.cos(math.radians(d)), math.sin(math.radians(d))]
    p = spark.createDataFrame([(1, 4, at(0)), (2, 6, at(25)), (3, 9, at(50)), (4, -1, at(90))], "id int, cluster_id int, vector array<double>")
    assert {r.id: r.new_id for r in clusters.merged(p, 0.85).collect()} == {1: 0, 2: 0, 3: 1, 4: -1}


def test_profile_tree(spark):
    rows = [(1, None, "main", 10.0), (2, 1, "load", 6.0), (3, 1, "load", 2.0), (4, 2, "read", 5.0), (5, 3, "read", 1.0), (6, 1, "log", 0.1), (7, 6, "io", 0.1), (8, 1, "lost", None), (9, 8, "under", 3.0), (10, None, "idle", 0.0), (11, 10, "wait", 0.0)]
    d = spark.createDataFrame(rows, "id int, parent int, name string, seconds double")
    got = {"/".join(r.path): (r.depth, r.calls, r.total, r.mean, r.percent) for r in probes.profile_tree(d, 5).collect()}
    assert got == {"main": (0, 1, 10.0, 10.0, 100.0), "main/load": (1, 2, 8.0, 4.0, 80.0), "main/load/read": (2, 2, 6.0, 3.0, 75.0)}
    assert set("/".join(r.path) for r in probes.profile_tree(d).collect()) == {"main", "main/load", "main/load/read", "main/log", "main/log/io", "idle", "idle/wait"}
    assert probes.profile_tree(d.limit(0)).collect() == []


ROW = {"probe": "qa", "run_id": "20260101_000000", "checkpoint": 1, "checkpoint_name": "eval_0001", "seq_num": 1, "prompt": "p", "target_answer": "t", "model_output": "o", "matching_score": 0.5, "result": "Pass", "category": "qa", "error_category": "Pass", "notes": "", "ts": "then", "batch": 0}


def _rows(spark, *changes):
    return spark.createDataFrame([tuple((ROW | c).values()) for c in changes], trace_store.STORE_SCHEMA + ", batch int")


def _files(path):
    return {f: os.stat(f).st_mtime_ns for d, _, names in os.walk(f"{path}/data") for f in (os.path.join(d, n) for n in names) if f.endswith(".parquet")}


def test_upsert_rewrites_only_what_it_touches(spark, tmp_path):
    path = f"{tmp_path}/store"
    kept_store.upsert(spark, path, _rows(spark, {}, {"run_id": "b"}, {"probe": "cloze"}, {"seq_num": 2, "notes": "mine", "error_category": "Custom"}))
    before = _files(path)
    told = kept_store.upsert(spark, path, _rows(spark, {"model_output": "new", "ts": "now", "checkpoint_name": "x"}, {"seq_num": 2, "result": "Fail", "error_category": "Fail", "notes": "n"}, {"seq_num": 3}), 7)
    assert [tuple(r) for r in told.collect()] == [("qa", 3)]
    after = _files(path)
    same = {f for f in before if "run_id=b" in f or "probe=cloze" in f}
    assert same and all(after.get(f) == before[f] for f in same) and not (set(before) - same) & set(after)
    got = {(r.probe, r.run_id, r.seq_num): (r.model_output, r.result, r.error_category, r.notes, r.ts, r.checkpoint_name) for r in kept_store.load(spark, path).collect()}
    run = ROW["run_id"]
    assert got == {("qa", run, 1): ("new", "Pass", "Pass", "", "then", "eval_0001"), ("qa", run, 2): ("o", "Fail", "Custom", "mine", "then", "eval_0001"), ("qa", run, 3): ("o", "Pass", "Pass", "", "then", "eval_0001"), ("qa", "b", 1): ("o", "Pass", "Pass", "", "then", "eval_0001"), ("cloze", run, 1): ("o", "Pass", "Pass", "", "then", "eval_0001")}
    # The same batch again changes nothing, other rows under its number neither.
    kept_store.upsert(spark, path, _rows(spark, {"model_output": "other"}), 7)
    assert _files(path) == after and kept_store.applied(spark, path).where("batch_id = 7").count() == 1


@pytest.mark.parametrize("staged", ["whole", "part"])
def test_failed_writes_are_finished_or_dropped(spark, tmp_path, monkeypatch, staged):
    path = f"{tmp_path}/store"
    kept_store.upsert(spark, path, _rows(spark, {}, {"seq_num": 2}))

    def fail(*a):
        raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr(kept_store, "_publish", fail)
        with pytest.raises(OSError):
            kept_store.upsert(spark, path, _rows(spark, {"model_output": "new"}), 3)
    if staged == "part":
        os.remove(next(iter(f"{d}/_SUCCESS" for d, _, _ in os.walk(f"{path}/_staged") if d.endswith("counts"))))
    assert kept_store.recover(spark, path) == (staged == "whole") and kept_store.recover(spark, path) == 0
    assert {r.seq_num: r.model_output for r in kept_store.load(spark, path).collect()} == {1: "new" if staged == "whole" else "o", 2: "o"}
    kept_store.upsert(spark, path, _rows(spark, {"model_output": "newer"}), 3)
    assert {r.seq_num: r.model_output for r in kept_store.load(spark, path).collect()}[1] == ("new" if staged == "whole" else "newer")


def test_sync_of_a_growing_folder(spark, tmp_path):
    folder, path, marks = f"{tmp_path}/traces", f"{tmp_path}/store", f"{tmp_path}/marks"
    os.makedirs(f"{folder}/r1/qa")
    os.makedirs(f"{folder}/cloze")

    def put(name, text, age):
        with open(f"{folder}/{name}", "w") as f:
            f.write(text)
        os.utime(f"{folder}/{name}", (time.time() - age,) * 2)

    put("r1/qa/eval_0001.csv", 'seq_num,prompt,model_output,result\n1,"two\nlines, ""quoted""",a,pass\nx,p,b,fail\n', 900)
    put("r1/qa_eval_0001.csv", "model_output,seq_num,result,matching_score,error_category\nnewer,1,Fail,0.25,\n", 300)
    put("cloze/r2_eval_0003.csv", "seq_num,result\n1,Pass\n", 500)
    put("cloze/notes.txt", "no", 500)
    q = kept_store.sync(spark, folder, path, marks)
    q.awaitTermination(120)
    got = {(r.probe, r.run_id, r.checkpoint, r.seq_num): (r.prompt, r.model_output, r.result, r.matching_score, r.error_category) for r in kept_store.load(spark, path).collect()}
    # Of two files with one key in a batch the older one's row stays.
    assert got == {("qa", "r1", 1, 1): ('two\nlines, "quoted"', "a", "Pass", 0.0, "Pass"), ("qa", "r1", 1, 2): ("p", "b", "Fail", 0.0, "Fail"), ("cloze", "r2", 3, 1): ("", "", "Pass", 0.0, "Pass")}
    assert {r.probe: r.n for r in kept_store.applied(spark, path).collect()} == {"qa": 3, "cloze": 1}
    put("r1/qa/eval_0002.csv", "seq_num,result,model_output\n1,Pass,later\n", 10)
    kept_store.sync(spark, folder, path, marks).awaitTermination(120)
    assert kept_store.load(spark, path).count() == 4 and kept_store.applied(spark, path).select("batch_id").distinct().count() == 2
    kept_store.sync(spark, folder, path, marks).awaitTermination(120)  # nothing new
    assert kept_store.load(spark, path).count() == 4 and kept_store.applied(spark, path).count() == 3


def test_trace_files_of_both_layouts(spark, tmp_path):
    d = spark.createDataFrame([("r1", "QA Probe", 1, 2, "b,\n\"c\""), ("r1", "QA Probe", 1, 1, "a"), ("r2", "cloze", 12, 1, "c")], "run_id string, probe string, eval_num int, seq_num int, model_output string")
    assert sorted(f.removeprefix(f"file:{tmp_path}/n/").removeprefix(f"{tmp_path}/n/") for f in kept_store.write_trace_files(d, f"{tmp_path}/n")) == ["r1/qa/eval_0001.csv", "r2/cloze/eval_0012.csv"]
    kept_store.write_trace_files(d.limit(0), f"{tmp_path}/n")
    assert pd.read_csv(f"{tmp_path}/n/r1/qa/eval_0001.csv").values.tolist() == [[1, "a"], [2, 'b,\n"c"']]
    kept_store.write_trace_files(d.where("run_id = 'r2'"), f"{tmp_path}/o", legacy=True)
    assert os.listdir(f"{tmp_path}/o/cloze")[-1].endswith("r2_eval_0012.csv") or any(x == "r2_eval_0012.csv" for x in os.listdir(f"{tmp_path}/o/cloze"))


STEPS = "run long, seq long, at timestamp, tokens long, perplexity double, qa double, cloze double"


def _plain(rows, interval, slow_interval):
    out = []
    for run in sorted({r[0] for r in rows}):
        total = evaluated = slow = 0
        carried, past = None, []
        for _, _, at, n, ppl, qa, cloze in sorted((r for r in rows if r[0] == run), key=lambda r: (r[2], r[1])):
            total += n or 0
            if total - evaluated >= interval:
                evaluated = total
                is_slow = total - slow >= slow_interval
                if is_slow:
                    slow, carried = total, cloze if cloze is not None else carried
                past.append(ppl)
                gains = [(a - b) / a * 100 for a, b in zip(past, past[1:])]
                out.append((run, at, total, is_slow, gains[-1] if gains else None, len(gains) >= 2 and max(gains[-2:]) < 2.0, carried))
    return out


def test_stream_agrees_with_the_table_and_begins_again(spark, tmp_path):
    rnd = random.Random(3)
    t0 = datetime.datetime(2026, 1, 1)
    rows = [(run, k, t0 + datetime.timedelta(minutes=k), rnd.choice([None, 10, 40, 90]), 50.0 + rnd.random() * 3, rnd.random(), rnd.choice([None, 0.4, 0.7])) for run in (1, 2, 3) for k in range(40)]
    took = lambda d: sorted((r.run, r.at, r.tokens, r.slow, r.gain, r.plateau, r.cloze) for r in d.collect())
    table = took(evaluation.evaluations(spark.createDataFrame(rows, STEPS), 100, 250))
    want = _plain(rows, 100, 250)
    assert [r[:4] + r[5:] for r in table] == [r[:4] + r[5:] for r in want]
    assert all((a[4] is None) == (b[4] is None) and (a[4] is None or abs(a[4] - b[4]) < 1e-9) for a, b in zip(table, want))
    source, target, marks = f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/marks"
    for low, high in ((0, 7), (7, 25), (25, 40)):
        spark.createDataFrame([r for r in rows if low <= r[1] < high], STEPS).write.mode("append").parquet(source)
        q = evaluation.evaluations(spark.readStream.schema(STEPS).parquet(source), 100, 250).writeStream.format("parquet").option("path", target).option("checkpointLocation", marks).trigger(availableNow=True).start()
        q.awaitTermination(120)
    assert took(spark.read.schema(evaluation.OUTPUT).parquet(target)) == table


def test_timer_tells_idle_runs(spark, tmp_path):
    t0 = datetime.datetime(2026, 1, 1)
    step = lambda run, minute: (run, minute, t0 + datetime.timedelta(minutes=minute), 60, 50.0, 0.5, None)
    source, target, marks = f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/marks"
    for rows in ([step(1, 0), step(2, 0)], [step(2, 30)], [step(2, 50)]):
        spark.createDataFrame(rows, STEPS).write.mode("append").parquet(source)
        q = evaluation.decided(evaluation.evaluations(spark.readStream.schema(STEPS).parquet(source), 100, 100, idle="1 minute", idle_ms=600_000), 10, 1_000).writeStream.format("parquet").option("path", target).option("checkpointLocation", marks).trigger(availableNow=True).start()
        q.awaitTermination(120)
    got = [(r.run, r.kind, r.tokens, r.decision) for r in spark.read.parquet(target).orderBy("run", "at").collect()]
    assert (1, "idle", 60, None) in got and (2, "evaluation", 120, "CONTINUE") in got and sum(r[0] == 1 for r in got) == 1


def test_reductions(spark):
    rnd = random.Random(4)
    p = spark.createDataFrame([(i, [rnd.gauss(0, 1) for _ in range(6)]) for i in range(9)], "id int, vector array<double>")
    size = lambda d: {len(r.reduced) for r in d.collect()}
    out, told = clusters.reduced(p, "umap", 4)
    assert size(out) == {4} and told["method"] == "pca" and "plug-in" in told["fallback"]
    out, told = clusters.reduced(p.limit(3), "pca", 5)
    assert size(out) == {3} and told["dimension"] == 3
    out, told = clusters.reduced(p, "pca", 50)
    assert size(out) == {6}
    asked = []

    def embed(points, k):
        asked.append(k)
        return points.select("id", F.slice("vector", 1, k).alias("reduced"))

    out, told = clusters.reduced(p, "umap", 2, embed)
    assert asked == [2] and size(out) == {2} and told == {"method": "umap", "fallback": None, "dimension": 2}
    assert clusters.reduced(p.limit(3), "umap", 2, embed)[1]["method"] == "pca" and asked == [2]
    for few in (p.limit(1), p.limit(0), p):
        out, told = clusters.reduced(few, "none", 2)
        assert told["method"] == "passthrough" and all(abs(sum(x * x for x in r.reduced) - 1) < 1e-9 for r in out.collect())
    assert clusters.reduced(p.limit(1), "pca", 2)[0].count() == 1 and clusters.reduced(p.limit(0), "pca", 2)[0].collect() == []
    with pytest.raises(ValueError, match="tsne"):
        clusters.reduced(p, "tsne", 2)


def test_manifest_raises_what_fails(spark):
    m = spark.createDataFrame([(i, i % 3, "val" if i < 3 else "dev") for i in range(12)] + [(20, -1, "dropped"), (21, 7, "dev")], "id int, cluster_id int, split string")
    caps = clusters.reweight_caps(m.where("cluster_id >= 0").groupBy("cluster_id").agg(F.count("*").alias("n")))
    good = clusters.manifest(m, caps, 2)
    assert clusters.checked(good).first().status == "complete"
    with pytest.raises(ValueError, match="too few clusters: 4"):
        clusters.checked(clusters.manifest(m, caps, 5))
    with pytest.raises(ValueError, match="validation members: 3"):
        clusters.checked(clusters.manifest(m.withColumn("split", F.lit("dev")), caps, 2))
    empty = clusters.manifest(m.limit(0), caps.limit(0), 1).first()
    assert (empty.status, empty.docs, empty.noise_fraction, empty.failures) == ("failed", 0, 0.0, ["too few clusters: 0"])


def test_probe_prompts(spark):
    d = spark.createDataFrame([("A ___ b.",), ("no blank",), ("six ______",), (None,)], "t string")
    got = [r[0] for r in d.select(probes.cloze_prompt(F.col("t"), [("S ______", "x")])).collect()]
    head = "Sentence: S ______\nAnswer: x\n\nSentence: "
    assert got == [head + x + "\nAnswer:" for x in ("A ______ b.", "no blank ______", "six ____________", " ______")]
    assert [r[0] for r in d.select(probes.plain_prompt(F.col("t"), "Question:")).collect()][1::2] == ["Question: no blank\nAnswer:", "Question: \nAnswer:"]


def test_state_is_read_and_written_once_a_batch():
    """A batch asks the store for a run's state once and writes it once, as each is a call out of Python."""
    calls = []

    class Value:
        held = None

        def get(self):
            calls.append("get")
            return self.held

        def update(self, value):
            calls.append("update")
            self.held = value

    class Handle:
        def getValueState(self, name, schema):
            return Value()

    loop = evaluation.EvaluationLoop(100, 250)
    loop.init(Handle())
    t0 = datetime.datetime(2026, 1, 1)
    rows = [(7, k, t0 + datetime.timedelta(minutes=k), 60, None if k == 3 else 50.0 - k, None, 0.5) for k in (2, 0, 1, 5, 3, 4)]
    names = ["run", "seq", "at", "tokens", "perplexity", "qa", "cloze"]
    out = [r for part in (rows[:3], rows[3:]) for r in loop.handleInputRows((7,), iter([dict(zip(names, r)) for r in part]), None)]
    assert calls == ["get", "update"] * 2
    assert [(r.tokens, r.slow, r.perplexity, r.gain) for r in out] == [(120, False, 49.0, None), (240, False, None, None), (360, True, 45.0, 0.0)]


def test_rows_of_a_file_are_made_some_at_a_time(monkeypatch):
    """A file's rows are handed on while it is read, so memory beside its bytes does not grow with it."""
    content = 'seq_num,prompt,extra\r\n' + "".join(f'{i},"a\r\n""{i}"" é",x\n' for i in range(7)) + "7\n"
    files = pd.DataFrame([("f.csv", pd.Timestamp(0), content.encode() + b"\xff,z\n")], columns=["path", "modificationTime", "content"])
    monkeypatch.setattr(kept_store, "ROWS_AT_ONCE", 3, raising=False)
    got = list(kept_store._rows_of_files(iter([files])))
    assert [len(d) for d in got] == [3, 3, 3]
    rows = pd.concat(got)
    assert rows["place"].tolist() == list(range(9)) and rows["seq_num"].tolist() == [*map(str, range(8)), "\ufffd"]
    assert rows["prompt"].tolist() == [*(f'a\r\n"{i}" é' for i in range(7)), "", "z"]
