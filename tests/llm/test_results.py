"""Whole results of operators against brute force: rows without an own id, the splitting tree, weights, posteriors, tokens."""

import base64
import hashlib
import math
import random
import wave
import zlib
from collections import Counter
from io import BytesIO

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from siltstone.llm import entries, language, media, mixing, packing, quality, simhash, substrings

DATA = "/root/testdata/sf0.001"


def test_repeats_of_rows_without_an_own_id(spark):
    """Rows of null and shared ids against brute force: null ids come first, then texts of one id in the order of their hashes."""
    rnd = random.Random(2)
    part = ["".join(rnd.choice("abcdefgh ") for _ in range(150)) for _ in range(6)]
    rows = [(1, part[0] + part[1]), (2, part[1] + part[2]), (2, part[2] + part[3]), (None, part[3] + "x" + part[4]), (None, part[4]), (2, part[1] + part[2]), (3, None), (3, part[5] * 2), (4, ""), (None, part[0])]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    order = {(r.doc_id, r.text): r.h for r in d.select("doc_id", "text", F.xxhash64(F.col("text").cast("binary")).alias("h")).collect()}
    seen, want = set(), {}
    for key in sorted(order, key=lambda k: (k[0] is not None, k[0] or 0, order[k])):
        b = (key[1] or "").encode()
        gone = np.zeros(len(b), bool)
        for j in range(len(b) - 99):
            if b[j : j + 100] in seen:
                gone[j : j + 100] = True
            seen.add(b[j : j + 100])
        want[key] = bytes(x for x, g in zip(b, gone) if not g)
    got = Counter((r.doc_id, r.n_bytes, bytes(r.kept)) for r in substrings.without_repeats(d).collect())
    assert got == Counter((k[0], len((k[1] or "").encode()), want[k]) for k in rows) and sum(map(len, want.values())) < sum(len((k[1] or "").encode()) for k in order)


def test_op8_shards(spark):
    """Result and shards by SQL; each node's halves are equal, every draw is in one shard, and the counts follow the law."""
    c = duckdb.connect()
    c.sql(f"create view documents as select * from '{DATA}/documents.parquet'")
    got = entries.queries()["op8_mix"](spark, DATA).toPandas().sort_values("doc_id").reset_index(drop=True)
    want = c.sql(mixing.OP8_SQL).df().sort_values("doc_id").reset_index(drop=True)
    assert got.shards.tolist() == want.shards.tolist() and got.shards.max() > 32
    draws = spark.createDataFrame([(s, f"{i:02x}", 1) for s, n in (("a", 160), (None, 64), ("b", 32)) for i in range(n)], "src string, block string, copy int")
    shares = []
    for seed in range(6):
        p = mixing.splitting_tree(draws, 3, seed).toPandas()
        assert len(p) == 256 and not p.duplicated(["src", "block", "copy"]).any() and set(p.groupby("shard").size()) == {32}
        shares.append(p[p.src == "a"].groupby("shard").size().reindex(range(8), fill_value=0).to_numpy())
    # Of 32 draws in a shard 20 are of source a on average, with a variance of 32 * 0.625 * 0.375 * 224 / 255 = 6.6.
    assert abs(np.mean(shares) - 20) < 1e-9 and 3.3 < np.var(shares) < 12


def test_op6_weights_and_choice(spark):
    """log_weight by plain counting of features, and the kept rows as the k of largest key."""
    docs = pd.read_parquet(f"{DATA}/documents.parquet")
    labels = pd.read_parquet(f"{DATA}/labels.parquet")
    d, la = spark.createDataFrame(docs[["doc_id", "text", "lang"]]), spark.createDataFrame(labels)
    targets = [int(i) for i in labels[(labels.quality == 1) & (labels.toxic == 0)].doc_id if zlib.crc32(f"border{i}".encode()) % 4 != 3 and i in set(docs.doc_id)]
    found = {r.doc_id: quality.features((r.text or "").encode()) for r in docs.itertuples()}
    expected, wanted = np.zeros(1 << quality.BITS), np.zeros(1 << quality.BITS)
    for _, group in docs.groupby(docs.lang.fillna("")):
        raw, own = (np.bincount(np.concatenate([found[i] for i in ids] or [np.empty(0, np.int64)]), minlength=1 << quality.BITS) for ids in (list(group.doc_id), [i for i in group.doc_id if i in targets]))
        expected += raw * (own.sum() / max(raw.sum(), 1))
        wanted += own
    table = np.log((wanted + 10) / (expected + 10))
    scored, kept = quality.resample(d, la)
    got = {r.doc_id: r for r in scored.collect()}
    for i, f in found.items():
        assert got[i].n_features == len(f) and (got[i].log_weight is None if not len(f) else math.isclose(got[i].log_weight, table[f].sum(), rel_tol=1e-6, abs_tol=1e-6))
    keys = sorted((r.sort_key for r in got.values() if r.sort_key is not None), reverse=True)
    stay = {i for i, r in got.items() if r.keep}
    assert stay == {r.doc_id for r in kept.collect()} and stay == {i for i, r in got.items() if r.sort_key is not None and r.sort_key >= keys[len(stay) - 1]}


def test_op7_posteriors(spark):
    """Predictions and scores by plain Bayes over the same n-grams."""
    docs = pd.read_parquet(f"{DATA}/documents.parquet").sort_values("doc_id")
    train = [r for r in docs.itertuples() if zlib.crc32(str(r.doc_id).encode()) % 4 != 2 and r.lang is not None and r.lang == r.lang]
    langs = sorted({r.lang for r in train})
    counts, n = {x: np.full(1 << language.BITS, 0.5) for x in langs}, Counter()
    for r in train:
        grams = language.ngrams(r.text or "")
        if grams is not None:
            np.add.at(counts[r.lang], grams, 1)
            n[r.lang] += 1
    logs = np.array([np.log(counts[x] / counts[x].sum()) for x in langs])
    prior = np.array([math.log((n[x] + 1) / (sum(n.values()) + len(langs))) for x in langs])
    got = {r.doc_id: r for r in entries.queries()["op7_language"](spark, DATA).collect()}
    for r in docs.itertuples():
        grams = language.ngrams(r.text or "")
        if grams is None:
            assert (got[r.doc_id].lang_pred, got[r.doc_id].score) == ("und", 0.0)
            continue
        p = logs[:, grams].sum(axis=1) + prior
        assert got[r.doc_id].lang_pred == langs[int(p.argmax())] and abs(got[r.doc_id].score - 1 / np.exp(p - p.max()).sum()) < 1e-2
        assert got[r.doc_id].held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)


def test_op5_values(spark):
    """Stored form, read-back payload and peak pairs by plain means."""
    docs = pd.read_parquet(f"{DATA}/documents.parquet").sort_values("doc_id").head(25)
    got = {r.doc_id: r for r in entries.queries()["op5_media"](spark, DATA).collect()}
    for r in docs.itertuples():
        data = (r.text or "").encode()
        payload = data + b"\xff" * (-len(data) % 576 or (576 if not data else 0))
        out = BytesIO()
        with wave.open(out, "wb") as w:
            w.setparams((1, 1, 8000, 0, "NONE", ""))
            w.writeframes(payload)
        g = got[r.doc_id]
        assert (g.n_bytes, g.payload_bytes, g.payload_sha256) == (len(data), len(payload), hashlib.sha256(payload).hexdigest())
        assert (g.tail_crc32, g.media_bytes, g.media_sha256) == (zlib.crc32(payload[-32:]), len(out.getvalue()), hashlib.sha256(out.getvalue()).hexdigest())
    x = np.frombuffer(payload[:1152], dtype=np.uint8).astype(np.float64) - 128
    tops = []
    for at in range(0, len(x) - 191, 96):
        p = np.abs(np.fft.rfft(x[at : at + 192] * np.hanning(192))) ** 2
        crest = [k for k in range(1, 96) if p[k] > p[k - 1] and p[k] >= p[k + 1] and p[k] > 1e-3]
        tops.append(sorted(crest, key=lambda k: -p[k])[:2])
    want = Counter((t, a << 12 | b << 4 | gap) for t in range(len(tops)) for gap in (1, 2) if t + gap < len(tops) for a in tops[t] for b in tops[t + gap])
    time, code = media.landmarks(payload[:1152])
    assert Counter(zip(time.tolist(), code.tolist())) == want


def test_op10_pieces(spark):
    """Pieces, checksums and padding of the query against the tokenizer."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.vocabulary())
    got = entries.queries()["op10_pack"](spark, DATA).toPandas()
    ids = {r.doc_id: np.array(t.encode(r.text or "", add_special_tokens=False).ids + [2], dtype="<u4") for r in pd.read_parquet(f"{DATA}/documents.parquet").itertuples()}
    for r in got.itertuples():
        assert r.doc_tokens == len(ids[r.doc_id]) and r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes())
    for k, g in got.sort_values("start").groupby("doc_id"):
        assert g.start.tolist() == [0, *np.cumsum(g.length)[:-1]] and g.length.sum() == len(ids[k])
    used = got.groupby("sequence_id").length.sum()
    assert used.max() <= 4096 and 4096 * len(used) - used.sum() <= 0.05 * used.sum() + 2 * 4096


def test_op9_query(spark):
    pages = pd.read_parquet(f"{DATA}/pages.parquet")
    data = {r.page_id: (r.html or "").encode() for r in pages.itertuples()}
    last = {}
    for i in sorted(data):
        last[data[i]] = i
    for r in entries.queries()["op9_warc"](spark, DATA).collect():
        b = data[r.page_id]
        assert (r.payload_bytes, r.payload_digest) == (len(b), base64.b32encode(hashlib.sha1(b).digest()).decode())
        assert (r.record_type, r.refers_to) == (("response", None) if last[b] == r.page_id else ("revisit", last[b]))


@pytest.mark.parametrize("strength", [0.81, 0.85, 0.92])
def test_planted_near_copies(spark, strength):
    """Copies with words put in place of others, at several strengths: at least nine in ten pairs lose a document."""
    rnd = random.Random(int(100 * strength))
    texts, pairs = [], 0
    while pairs < 60:
        n = rnd.choice([40, 120, 400])
        base = [f"w{rnd.randrange(10**7)}" for _ in range(n)]
        copy = list(base)
        sets = lambda w: {tuple(w[i : i + 5]) for i in range(n - 4)}
        alike = 1.0
        while alike > strength + 0.02:
            copy[rnd.randrange(n)] = f"x{rnd.randrange(10**7)}"
            alike = len(sets(base) & sets(copy)) / len(sets(base) | sets(copy))
        if alike >= 0.8:
            texts += [" ".join(base), " ".join(copy)]
            pairs += 1
    kept = {r.doc_id for r in simhash.one_each(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert sum(not {2 * i, 2 * i + 1} <= kept for i in range(pairs)) >= 0.95 * pairs and all({2 * i, 2 * i + 1} & kept for i in range(pairs))


def test_deeper_upper_trees_find_the_same_links(spark):
    rnd = np.random.default_rng(4)
    base = rnd.integers(0, 1 << 63, 60)
    bits = np.unique(np.concatenate([base, *[base ^ (1 << int(a)) ^ (1 << int(b)) for a, b in rnd.integers(0, 63, (6, 2))]]))
    near = np.bitwise_count(bits[:, None] ^ bits[None]) <= 4
    group = np.arange(len(bits))
    while True:
        after = np.where(near, group[None], len(bits)).min(axis=1)
        if (after == group).all():
            break
        group = after
    d = spark.createDataFrame([(int(b), int(b)) for b in bits], "id long, w0 long")
    for depth in (simhash.SHALLOW, 7, len(simhash.VANTAGE)):
        e = simhash.links(d, 4, depth=depth).toPandas()
        parent = {int(b): int(b) for b in bits}

        def find(x, parent=parent):
            while parent[x] != x:
                x = parent[x]
            return x

        for a, b in zip(e.a, e.b):
            x, y = find(int(a)), find(int(b))
            parent[max(x, y)] = min(x, y)
        assert [find(int(b)) for b in bits] == bits[group].tolist()


def test_op4_likeness(spark):
    """Anchors and likeness by plain Python, on texts of few words, without spaces, and long."""
    from siltstone.llm import syncmers

    rnd = random.Random(5)
    long = [" ".join(f"w{rnd.randrange(10**4)}" for _ in range(90)) for _ in range(3)]
    texts = ["", "one", "some few words only here", "今日は天気が良いので散歩に行きました。お弁当も食べました", "a\tb  c", *long]
    rows = [(i, t, t[: len(t) - len(t) // 2] + texts[(i + 1) % len(texts)][: len(t) // 2]) for i, t in enumerate(texts)]
    d = spark.createDataFrame(rows, "i int, a string, b string")
    d = d.select("i", syncmers.anchors(F.col("a")).alias("a"), syncmers.anchors(F.col("b")).alias("b"))
    d = d.select("*", *[syncmers.sketch(F.col(c)).alias(f"s_{c}") for c in "ab"]).select("*", syncmers.likeness(F.col("s_a"), F.col("s_b")).alias("near"), syncmers.aligned(F.col("a"), F.col("b")).alias("aligned"))
    for r in d.orderBy("i").collect():
        a, b = ({x.hash for x in side} for side in (r.a, r.b))
        low = sorted(a | b)[: syncmers.SKETCH]
        assert abs(r.near - (1.0 if sorted(a)[:64] == sorted(b)[:64] else len(set(low) & a & b) / max(1, len(low)))) < 1e-9
        assert r.aligned == len({tuple(x) for x in r.a} & {tuple(x) for x in r.b})
        words = texts[r.i].split()
        if len(words) >= 5:
            h = spark.createDataFrame([(w,) for w in words], "w string").select(F.xxhash64("w")).toPandas().iloc[:, 0].tolist()
            assert [x.pos for x in r.a if x.pos >= 0] == [i for i in range(len(h) - 4) if min(h[i], h[i + 4]) <= min(h[i + 1 : i + 4])]
        if 2 <= r.i <= 3 or r.i >= 5:
            assert r.near > 0.05, texts[r.i]
