"""Sentence statistics and boundaries against plain Python."""

import math
import random
from collections import Counter

from pyspark.sql import functions as F

from siltstone.operators import sentences


def _corpus():
    rnd = random.Random(6)
    out = []
    for _ in range(400):
        parts = []
        for _ in range(rnd.randint(1, 8)):
            words = [rnd.choice("river stone cloud market engine letter window garden".split()) for _ in range(rnd.randint(2, 7))]
            if rnd.random() < 0.5:
                words.insert(rnd.randint(1, len(words)), rnd.choice(["Dr. Miller", "e.g. stones", "Mr. Stone", "No. 5 Street", "i.e. rivers"]))
            parts.append(f"{rnd.choice(['The', 'But', 'However'])} {' '.join(words)}{rnd.choice('...!?')}")
        out.append(" ".join(parts))
    return out


def _type(t):
    return t.lstrip(sentences.OPENING).rstrip(sentences.CLOSING).rstrip(".,;:?!").lower()


def test_scores(spark):
    texts = _corpus() + [None, "", "..."]
    d = spark.createDataFrame([(t,) for t in texts], "text string")
    have, lack = Counter(), Counter()
    for t in texts:
        for w in (t or "").split():
            if _type(w):
                core = w.lstrip(sentences.OPENING).rstrip(sentences.CLOSING)
                (have if core.endswith(".") and core[-2:-1] not in (".", "") else lack)[_type(w)] += 1
    n, p = sum(have.values()) + sum(lack.values()), sum(have.values())
    got = {r.word: r for r in sentences.abbreviations(sentences.counted(d)).collect()}
    assert set(got) == {w for w in have if any(c.isalpha() for c in w)}
    for w, r in got.items():
        a, b = have[w], lack[w]
        ratio = -2 * (a * math.log(p / n) + b * math.log(1 - p / n) - a * math.log(0.99) - b * math.log(0.01))
        inner = w.count(".")
        letters = len(w) - inner
        assert (r.with_period, r.without) == (a, b) and abs(r.score - ratio * math.exp(-letters) * (inner + 1) * letters**-b) < 1e-3
    short = {w for w, r in got.items() if r.score >= sentences.ABBREVIATION}
    assert {"dr", "mr", "e.g", "i.e", "no"} <= short and not short & {"river", "stone", "window"}


def test_scores_need_no_pairs(spark, tmp_path, monkeypatch):
    """Scores of the query come of tokens alone, not of pairs of neighbours, and are the same."""
    from siltstone.plans import registry

    texts = _corpus() + [None, "", "..."]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    d.write.parquet(f"{tmp_path}/documents.parquet")
    want = sorted(map(tuple, sentences.abbreviations(sentences.counted(d)).collect()))
    monkeypatch.setattr(sentences, "counted", None)
    assert sorted(map(tuple, registry.queries()["abbreviation_scores"](spark, str(tmp_path)).collect())) == want and want


def test_model_and_split(spark):
    d = spark.createDataFrame([(t,) for t in _corpus()], "text string")
    table = sentences.model(d)
    kinds = {r.word: r.value for r in table.collect()}
    assert kinds["dr"] == "abbreviation" and kinds["dr miller"] == "collocation" and {" the", " but", " however"} <= {k for k, v in kinds.items() if v == "starter"}
    cases = {
        "The river met Dr. Miller. But the stone fell! However it was. ": ["The river met Dr. Miller.", "But the stone fell!", "However it was."],
        "Stones, e.g. rivers. The end": ["Stones, e.g. rivers.", "The end"],
        'He said "stop." The dog (a cat?) ran.': ['He said "stop."', "The dog (a cat?)", "ran."],
        "It was No. 5 Street... and so on. But J. Stone came": ["It was No. 5 Street... and so on.", "But J. Stone came"],
        "Wait... The river\n\nwent on.": ["Wait...", "The river\n\nwent on."],
        "On 3. may it rained. The 5. But": ["On 3. may it rained.", "The 5.", "But"],
        "": [], "  \n ": [], "one": ["one"], None: [],
    }
    rows = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(cases)], "i int, text string, word string")
    got = [r.sentences for r in sentences.split(rows, table).orderBy("i").collect()]
    assert got == list(cases.values())
    again = {r.i: r.sentences for r in sentences.split(rows, table.limit(0)).collect()}
    assert again[0][:2] == ["The river met Dr.", "Miller."]
    assert sentences.split(rows.limit(0), table).collect() == [] and sentences.model(d.limit(0)).collect() == []


def test_nothing_is_lost(spark):
    rnd = random.Random(2)
    texts = ["".join(rnd.choice(["a", "B", ".", "! ", " ", "\n", "(", ")", "é", "1", ". "]) for _ in range(rnd.randint(0, 60))) for _ in range(300)] + ["word. " * 20_000]
    d = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    for r in sentences.split(d, sentences.model(d)).select("text", F.array_join("sentences", " ").alias("s")).collect():
        assert r.s.split() == r.text.split()


def test_counts_apart(spark, monkeypatch):
    """Types, and pairs behind a final sign alone, are those of all pairs, whatever a task counts before it hands on; a model
    that is too large to be held gives the same sentences."""
    rnd = random.Random(4)
    texts = _corpus() + ["".join(rnd.choice(["a", "B.", ".", "! ", " ", "\xa0", "(", ")”", "É", "1", ". ", "?  ", "Σ. "]) for _ in range(rnd.randint(0, 60))) for _ in range(200)] + [None, "", "..."]
    d = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    all_ = sentences.counted(d)
    period = F.sum(F.when(F.col("period"), F.col("n")).otherwise(0))
    rows = lambda x: sorted(map(repr, map(tuple, x.collect())))
    want = rows(all_.groupBy("type").agg(F.sum("n"), period)), rows(all_.where("ends").groupBy("type", "after").agg(F.sum("n"), period))
    monkeypatch.setattr(sentences, "COUNTED", 50)
    assert tuple(map(rows, sentences.counted_apart(d))) == want
    monkeypatch.setattr(sentences, "counted", None)
    table = sentences.model(d)
    held = {r.i: r.sentences for r in sentences.split(d, table).collect()}
    monkeypatch.setattr(sentences, "BROADCAST_ROWS", 1)
    assert {r.i: r.sentences for r in sentences.split(d, table).collect()} == held
