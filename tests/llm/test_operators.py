"""The training-data operators against brute force, and on awkward rows."""

import base64
import hashlib
import random

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from siltstone.llm import entries, language, lines, media, mixing, packing, quality, simhash, substrings, syncmers, warc
from siltstone.llm.suffixes import suffix_array

DATA = "/root/testdata/sf0.001"
AWKWARD = [(None, None, None, None), (1, "", "en", "a"), (2, "word", None, "a"), (2, "word", None, "a"), (3, "x " * 30_000, "en", None), (4, "One line that is long enough to count.\nOne line that is long enough to count!", "de", "b")]
SCHEMA = "doc_id long, text string, lang string, source string"


@pytest.fixture(scope="module")
def documents():
    return pd.read_parquet(f"{DATA}/documents.parquet").sort_values("doc_id")


@pytest.fixture(params=["awkward", "empty"])
def odd(spark, request):
    d = spark.createDataFrame(AWKWARD if request.param == "awkward" else [], SCHEMA)
    return d.withColumns({"size": F.lit("clash"), "row": F.lit(1), "id": F.lit("other"), "key": F.lit(0)})


def test_odd_rows(spark, odd):
    n = odd.count()
    labels = spark.createDataFrame([(2, 1, 0), (None, None, None)], "doc_id long, quality int, toxic int")
    assert lines.line_report(odd).count() >= n
    assert substrings.without_repeats(odd).count() == n
    assert simhash.near_groups(odd).count() == n
    assert media.media_columns(odd).count() == n
    assert quality.resample(odd, labels)[0].count() == n
    assert language.identify(odd, language.fit(odd)).count() == n
    assert mixing.mix_plan(odd).count() == n
    mixing.mixed(odd).collect()
    packed = packing.pack(odd, packing.vocabulary()).toPandas()
    assert packed.length.sum() == (0 if not n else packed.groupby(packed.doc_id.fillna(-1)).length.sum().sum())
    assert syncmers.with_edits(odd).count() == n
    pages = odd.select(F.col("doc_id").alias("page_id"), F.col("lang").alias("url"), F.col("text").alias("html"))
    assert warc.archive_round_trip(pages).count() == n
    simhash.one_each(odd).collect()
    lines.without_repeated_lines(odd).collect()


def test_suffix_array():
    rnd = random.Random(5)
    for _ in range(100):
        cap, n = rnd.choice([5, 20]), rnd.randint(1, 60)
        t = np.array([rnd.randrange(rnd.choice([1, 2, 4])) for _ in range(n)], dtype=np.int16)
        b = bytes(t.astype(np.uint8))
        sa, lcp = suffix_array(t, alphabet=6, cap=cap, limit=rnd.choice([0, 10**6]))
        assert sorted(sa.tolist()) == list(range(n))
        for i in range(1, n):
            x, y = b[sa[i - 1] :][:cap], b[sa[i] :][:cap]
            assert x <= y and lcp[i] == next((k for k in range(min(len(x), len(y))) if x[k] != y[k]), min(len(x), len(y)))


def test_op2(spark, documents):
    got = entries.queries()["op2_substrings"](spark, DATA).toPandas().sort_values("doc_id")
    seen: set[bytes] = set()
    for text, r in zip(documents.text, got.itertuples()):
        b = (text or "").encode()
        gone = np.zeros(len(b) + 1, np.int8)
        for j in range(len(b) - 99):
            k = b[j : j + 100]
            if k in seen:
                gone[j : j + 100] = 1
            seen.add(k)
        kept = bytes(x for x, g in zip(b, gone) if not g)
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (len(b), int(gone.sum()), int((np.diff(gone, prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest())


def test_op3(spark):
    d = entries.queries()["op3_simhash"](spark, DATA).toPandas().sort_values("doc_id")
    bits = np.array([int(x, 16) for x in d.fingerprint], dtype=np.uint64)
    group = np.arange(len(bits))
    for _ in range(len(bits)):
        near = np.bitwise_count(bits[:, None] ^ bits[None]) <= 4
        after = np.where(near, group[None], len(bits)).min(axis=1)
        if (after == group).all():
            break
        group = after
    assert (d.doc_id.to_numpy()[group] == d.component_id.to_numpy()).all()


def test_fingerprint():
    import xxhash

    for text in (b"", b"one two", b"A b c D e f", " é\tb  c d　e".encode()):
        words = [w for w in text.lower().replace(b"\t", b" ").split(b" ") if w]
        sh = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
        h = [xxhash.xxh64_intdigest(s, 42) for s in sh]
        assert simhash.fingerprint(text) == sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def test_one_each(spark):
    """Against brute force: what goes is alike to something that stays, and nothing that stays is alike."""
    rnd = random.Random(3)
    texts = ["", " \t", None, "solo"]
    for _ in range(8):
        base = [f"w{rnd.randrange(10**5)}" for _ in range(250)]
        texts += [" ".join(base)] * 3
        for step in range(1, 12):
            base = list(base)
            for _ in range(rnd.choice([1, 1, 2, 4])):
                base[rnd.randrange(250)] = f"x{rnd.randrange(10**5)}"
            texts.append(" ".join(base))
    d = spark.createDataFrame([(i, t, i % 3) for i, t in enumerate(texts)], "doc_id long, text string, node int")
    sets = [{" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if (w := (t or "").split()) else {""} for t in texts]
    kept = {r.doc_id for r in simhash.one_each(d).collect()}
    alike = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b])
    assert {0, 3} <= kept and not {1, 2} & kept
    for i in range(len(texts)):
        best = max((alike(i, k) for k in kept if k != i), default=0)
        assert best < 0.87 if i in kept else best >= 0.8
    assert len(kept) < 60


def test_one_each_at_the_border(spark):
    """Pairs just above the border, of short and of long texts: nearly every one loses a document."""
    rnd = random.Random(8)
    texts, want = [], 0
    for n in [9] * 40 + [60] * 150 + [400] * 60:
        base = [f"w{rnd.randrange(10**7)}" for _ in range(n)]
        other = [*base[: max(1, round((n - 4) * 0.895)) + 4], *[f"x{rnd.randrange(10**7)}" for _ in range(n - 4 - max(1, round((n - 4) * 0.895)))]]
        a, b = ({" ".join(w[i : i + 5]) for i in range(n - 4)} for w in (base, other))
        if 0.8 <= len(a & b) / len(a | b) < 0.85:
            texts += [" ".join(base), " ".join(other)]
            want += 1
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = {r.doc_id for r in simhash.one_each(d).collect()}
    both = sum({2 * i, 2 * i + 1} <= kept for i in range(want))
    assert want > 150 and both <= 0.01 * want and len(kept) == want + both


@pytest.mark.parametrize("n", [10, 120])
def test_block_links(n):
    """Forests of large blocks have the components of all near pairs."""
    rnd = np.random.default_rng(n)
    base = rnd.integers(0, 1 << 63, (4, 2))
    rows = np.concatenate([np.stack([np.full(n, k), np.arange(n), *[base[rnd.integers(0, 4, n), w] ^ (1 << rnd.integers(0, 63, n)) ^ (1 << rnd.integers(0, 63, n)) for w in (0, 1)]], axis=1) for k in (3, 5)])
    bits = lambda i, j: sum(int(x).bit_count() for x in rows[i, 2:] ^ rows[j, 2:])
    for k in (0, n):
        some = rows[k : k + n]
        near = {(i, j) for i in range(n) for j in range(i + 1, n) if bits(k + i, k + j) <= 7}
        for every in (True, False):
            got = {(int(a), int(b)) for x, y in simhash._earlier(some, 7, every) for a, b in zip(x, y)}
            assert got <= near and (got == near or not every)
            group = list(range(n))
            for i, j in list(got) * 4:
                a, b = group[i], group[j]
                group = [min(a, b) if g in (a, b) else g for g in group]
            assert all(group[i] == group[j] for i, j in near)


def test_rows_without_an_own_id(spark):
    """Rows of a null or shared id are documents of their own if they differ in text."""
    rnd = random.Random(9)
    text = lambda: " ".join(f"w{rnd.randrange(10**6)}" for _ in range(40))
    a, b, c, e, f = (text() for _ in range(5))
    d = spark.createDataFrame([(None, a), (None, b), (None, b), (None, a + " more"), (7, c), (7, e), (7, c), (8, e), (9, f)], "doc_id long, text string")
    kept = sorted((r.doc_id or 0, r.text) for r in simhash.one_each(d).collect())
    assert [k for k in kept if k[1] not in (a, a + " more")] == sorted([(0, b), (7, c), (7, e), (9, f)]) and len(kept) == 5
    d = spark.createDataFrame([(None, f"{a}\n{b}"), (None, f"{c}\n{b}"), (None, f"{e}\n{f}"), (5, f"{f} x\n{text()}"), (5, f"{text()}\n{text()}")], "doc_id long, text string")
    got = [(r.doc_id, len(r.removed)) for r in lines.line_report(d).collect()]
    assert sum(n for i, n in got if i is None) == 1 and sorted(n for i, n in got if i == 5) == [0, 1]
    assert sum(len(r.text.split("\n")) for r in lines.without_repeated_lines(d).collect()) == 8


def test_links_of_words(spark):
    rnd = random.Random(4)
    rows = []
    for _ in range(40):
        w = [rnd.getrandbits(64) for _ in range(2)]
        for _ in range(5):
            rows.append([x ^ sum(1 << b for b in rnd.sample(range(64), rnd.choice([0, 3, 5, 20]))) for x in w])
    signed = [[x - (1 << 64) if x >> 63 else x for x in r] for r in rows]
    d = spark.createDataFrame([(i, *r) for i, r in enumerate(signed)], "id long, w0 long, w1 long")
    got = {(r.node, r.component) for r in simhash.components(simhash.links(d, 7, 2, 20), "t").collect()}
    group = list(range(len(rows)))
    bits = lambda i, j, k: (rows[i][k] ^ rows[j][k]).bit_count()
    pairs = [(i, j) for i in range(len(rows)) for j in range(i) if min(bits(i, j, 0), bits(i, j, 1)) <= 7 and bits(i, j, 0) + bits(i, j, 1) <= 20]
    for i, j in pairs * 3:
        a, b = group[i], group[j]
        group = [min(a, b) if g in (a, b) else g for g in group]
    assert got == {(i, group[i]) for i in {x for p in pairs for x in p}} and len(pairs) > 20


def distance(a, b):
    p = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        q = [i]
        for j, y in enumerate(b, 1):
            q.append(min(q[-1] + 1, p[j] + 1, p[j - 1] + (x != y)))
        p = q
    return p[-1]


@pytest.mark.parametrize("edits", [1, 2])
def test_line_links(spark, edits):
    rnd = random.Random(edits)
    texts = []
    for _ in range(12):
        base = "".join(rnd.choice("abcdef gh") for _ in range(rnd.randint(24, 40)))
        for _ in range(6):
            t = list(base)
            for _ in range(rnd.randint(0, 3)):
                i = rnd.randrange(len(t))
                t[i : i + 1] = rnd.choice([[], ["x"], [t[i], "y"]])
            texts.append("".join(t))
    d = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    names = {(r.h1, r.h2): r.text for r in d.select("text", F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(1), "text").alias("h2")).collect()}
    got = {frozenset((names[r.a1, r.a2], names[r.b1, r.b2])) for r in lines.line_links(d, edits).collect()}
    long = sorted({t for t in texts if len(t) >= 24})
    assert got == {frozenset((a, b)) for a in long for b in long if a < b and distance(a, b) <= edits}


def test_changed_words_and_short_lines(spark):
    rnd = random.Random(6)
    texts = []
    for _ in range(24):
        base = ["".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 9))) for _ in range(rnd.randint(7, 14))]
        for _ in range(6):
            t = list(base)
            for _ in range(rnd.randint(0, 2)):
                i = rnd.randrange(len(t))
                t[i : i + 1] = rnd.choice([[], ["another"], [t[i], "more"]])
            texts.append(" ".join(t))
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    names = {(r.h1, r.h2): r.text for r in d.select("text", F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(1), "text").alias("h2")).collect()}
    got = {frozenset((names[r.a1, r.a2], names[r.b1, r.b2])) for r in lines.word_links(d).collect()}
    long = sorted({t for t in texts if len(t) >= 24 and len(t.split(" ")) >= 8})
    want = {frozenset((a, b)) for a in long for b in long if a < b and distance(a.split(" "), b.split(" ")) <= 1}
    assert got == want and len(want) > 20
    line = "the committee met in the large hall to discuss the matter"
    d = spark.createDataFrame([(1, f"Go.\n\n{line}"), (2, f"Go.\n\n{line.replace('large', 'smaller')}\nno")], "doc_id long, text string")
    got = {r.doc_id: (r.removed, r.links) for r in lines.line_report(d).collect()}
    assert got == {1: ([], 1), 2: ([0, 2], 1)}


def test_op4(spark, documents):
    got = entries.queries()["op4_syncmers"](spark, DATA).toPandas().sort_values("doc_id")
    texts = [t or "" for t in documents.text]
    for i, (t, sha) in enumerate(zip(texts, got.edited_sha256)):
        h = len(t) // 2
        assert hashlib.sha256((t[: len(t) - h] + texts[(i + 1) % len(texts)][:h]).encode()).hexdigest() == sha
    assert got.near_edited.mean() > 0.25 and got.near_next.mean() < 0.05


def test_op5(spark, documents):
    got = entries.queries()["op5_media"](spark, DATA).toPandas().sort_values("doc_id")
    for t, r in zip(documents.text, got.itertuples()):
        p = media.padded((t or "").encode())
        assert (r.payload_bytes, r.payload_sha256) == (len(p), hashlib.sha256(p).hexdigest())
    assert media.from_wav(media.to_wav(p)) == p


def test_op6(spark):
    got = entries.queries()["op6_quality"](spark, "/root/testdata/sf0.01").toPandas().merge(pd.read_parquet("/root/testdata/sf0.01/labels.parquet"), on="doc_id")
    assert got[got.quality == 0].keep.mean() < 0.05 and got[(got.quality == 1) & (got.toxic == 0)].keep.mean() > 0.9


@pytest.mark.parametrize("cut", [False, True])
def test_op6_of_each_language(spark, cut):
    """Documents without a label stay in every language, one of 30 documents and few targets too."""
    d = pd.read_parquet("/root/testdata/sf0.01/documents.parquet")
    labels = pd.read_parquet("/root/testdata/sf0.01/labels.parquet")
    if cut:
        d = d.drop(d[d.lang == "de"].index[30:])
    scored, _ = quality.resample(spark.createDataFrame(d[["doc_id", "text", "lang"]]), spark.createDataFrame(labels))
    got = scored.toPandas().merge(d[["doc_id", "lang"]], on="doc_id")
    free = got[~got.doc_id.isin(labels.doc_id) & (got.n_features > 0)]
    assert (free.groupby("lang").keep.mean() > 0.7).all()
    assert got[got.doc_id.isin(labels[labels.quality == 0].doc_id)].keep.mean() < 0.05


def test_kth_largest(spark):
    keys = [1.5, 2.0, 2.0, -3.0, 8.0, 0.1]
    d = spark.createDataFrame([(k,) for k in [*keys, None]], "sort_key double")
    assert [quality.kth_largest(d, k) for k in range(1, 7)] == sorted(keys, reverse=True)


def test_op7(spark, documents):
    got = entries.queries()["op7_language"](spark, "/root/testdata/sf0.01").toPandas().merge(pd.read_parquet("/root/testdata/sf0.01/documents.parquet"), on="doc_id")
    held = got[got.held_out]
    assert (held.lang_pred == held.lang).mean() > 0.98 and got.score.between(0, 1).all()


def test_bounded_keeps_each_value(spark):
    d = spark.range(20_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 19_990, "en").when(F.col("id") < 19_996, "is").alias("lang"))
    got = {r[0]: r[1] for r in language.bounded(d, 100, "doc_id", "lang", "lang", 50).groupBy("lang").count().collect()}
    assert 50 < got["en"] < 160 and got["is"] == 6 and got[None] == 4


def test_op8(spark):
    c = duckdb.connect()
    c.sql(f"create view documents as select * from '{DATA}/documents.parquet'")
    got = entries.queries()["op8_mix"](spark, DATA).toPandas().sort_values("doc_id").reset_index(drop=True)
    want = c.sql(mixing.OP8_SQL).df().sort_values("doc_id").reset_index(drop=True)[list(got.columns)]
    pd.testing.assert_frame_equal(got.astype(float), want.astype(float))
    mix = mixing.mixed(spark.read.parquet(f"{DATA}/documents.parquet"))
    taken = mix.groupBy("doc_id").agg(F.sum(mixing.word_count(F.col("text"))).alias("n")).toPandas().set_index("doc_id").n
    assert taken.to_dict() == {r.doc_id: r.taken for r in got.itertuples() if r.taken}
    assert mix.groupBy("shard").count().count() > 8


def test_op9(spark):
    rows = [(i, None if i == 3 else f"http://h/{i}", None if i == 0 else ("é" * 40_000 if i in (4, 9) else f"<p>{i % 5}\r\n\r\nWARC/1.1</p>")) for i in range(12)]
    p = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.id: r for r in warc.archive_round_trip(p).collect()}
    data = {i: (h or "").encode() for i, _, h in rows}
    for i, b in data.items():
        last = max(k for k, v in data.items() if v == b)
        assert (got[i].payload_bytes, got[i].payload_digest) == (len(b), base64.b32encode(hashlib.sha1(b).digest()).decode())
        assert (got[i].record_type, got[i].refers_to) == (("response", None) if i == last else ("revisit", last))


def test_op10(spark, documents):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.vocabulary())
    got = packing.pack(spark.read.parquet(f"{DATA}/documents.parquet"), packing.vocabulary()).toPandas()
    pieces = {k: g.sort_values("start") for k, g in got.groupby("doc_id")}
    for r in documents.itertuples():
        ids = np.frombuffer(b"".join(pieces[r.doc_id].ids), dtype="<u4").tolist()
        assert ids == t.encode(r.text or "", add_special_tokens=False).ids + [2]
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert g.length.sum() <= 4096 and (g.offset.to_numpy() == np.cumsum([0, *g.length])[:-1]).all()


def test_pipeline(spark):
    """Each stage against what its operator's brute-force rule says of its own input, where that is cheap."""
    import corpus_pipeline

    d = spark.read.parquet(f"{DATA}/documents.parquet")
    after = corpus_pipeline.line_stage(spark, d, DATA)
    assert after.columns == d.columns
    seen, want = {}, {}
    for r in sorted(d.collect(), key=lambda r: r.doc_id):
        kept = []
        for line in r.text.split("\n"):
            if len(line) < 24 or line not in seen:
                kept.append(line)
            seen.setdefault(line, r.doc_id)
        want[r.doc_id] = "\n".join(kept)
    got = {r.doc_id: r.text for r in after.collect()}
    exact = sum(got.get(k, "") == v for k, v in want.items())
    assert exact >= 0.99 * len(want)
    one = corpus_pipeline.simhash_stage(spark, d, DATA)
    assert one.columns == d.columns and 0.8 * d.count() < one.count() < d.count()
    assert corpus_pipeline.run(spark, DATA).select(F.max(F.col("offset") + F.col("length"))).first()[0] <= 4096
