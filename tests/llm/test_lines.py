"""Links of lines against brute force, in groups below and above the bound of pair-by-pair comparison."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from siltstone.llm import lines


def distance(a, b):
    p = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        q = [i]
        for j, y in enumerate(b, 1):
            q.append(min(q[-1] + 1, p[j] + 1, p[j - 1] + (x != y)))
        p = q
    return p[-1]


def changed(rnd, tokens, choices):
    out = list(tokens)
    for _ in range(rnd.choice([0, 1, 1, 2])):
        i = rnd.randrange(len(out))
        x = rnd.choice(choices)
        out[i : i + 1] = rnd.choice([[], [x], [out[i], x]])
    return out


def classes(links):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for link in links:
        a, b = map(find, link)
        parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in parent}


@pytest.mark.parametrize(("words", "heavy"), [(8, 3), (None, 32)])
def test_near_lines(spark, monkeypatch, words, heavy):
    """Links, their classes and each line's number of links, though groups above the bound give no pairs."""
    monkeypatch.setattr(lines, "HEAVY", heavy)
    rnd = random.Random(1)
    texts = set()
    for size in (3, 7, 8, 8, 9, 20):
        base = " ".join("".join(rnd.choice("abc") for _ in range(rnd.randint(1, 6))) for _ in range(size)).ljust(24, "a")
        texts |= {"".join(changed(rnd, base, ["x", "y", " ", "b"])) for _ in range(22)} | {" ".join(changed(rnd, base.split(" "), ["new", "q"])) for _ in range(12)}
    texts = sorted(t for t in texts if len(t) >= 24 and t.strip())
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    name = {(r.h1, r.h2): r.text for r in d.select("text", F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(1), "text").alias("h2")).collect()}
    pairs, edges, counts = lines.near_lines(lines._lines(d, "doc_id", "text", 24), 24, words)
    link = lambda r: frozenset((name[r.a1, r.a2], name[r.b1, r.b2]))
    pairs, edges = [link(r) for r in pairs.collect()], {link(r) for r in edges.collect()}
    got = Counter(x for p in pairs for x in p)
    for r in counts.collect():
        got[name[r.h1, r.h2]] += r.links
    near = lambda a, b: abs(len(a) - len(b)) <= 1 and distance(a, b) <= 1
    long = lambda t: words and len(t.split(" ")) >= words
    want = {frozenset((a, b)) for i, a in enumerate(texts) for b in texts[:i] if near(a, b) or long(a) and long(b) and near(a.split(" "), b.split(" "))}
    assert len(set(pairs)) == len(pairs) and set(pairs) | edges <= want
    assert classes({*pairs, *edges}) == classes(want) and +got == Counter(x for p in want for x in p)
    assert bool(edges) == (heavy == 3)


def test_removal(spark):
    """The first of each class of lines stays, wherever the others stand; blank lines and those of null texts don't count."""
    line = "the committee met in the large hall to discuss the matter"
    rows = [(1, f"{line}\nGo.\n\nthis line stands alone in the whole corpus"), (2, f"Go.\n{line.replace('large', 'small')}\n\n{line}s"), (3, None), (4, ""), (None, f"{line}\nanother line that nobody else has written")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_lines, r.removed, r.links) for r in lines.line_report(d).collect()}
    # Rows of null id come first in the order.
    assert got == {None: (2, [], 2), 1: (4, [0], 2), 2: (4, [0, 1, 3], 2), 3: (0, [], 0), 4: (1, [], 0)}
