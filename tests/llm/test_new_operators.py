"""Ranking with ties, spelling variants and main text, against brute force and on awkward rows."""

import math
import random
import zlib

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from siltstone.llm import entries, html_text, ranking, spelling

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op11_ranking", "op12_spelling", "op13_html"])
def test_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "pages", "sale_lines"):
        c.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    want, got = c.sql(entries.oracle_sql()[name]).df(), entries.queries()[name](spark, DATA).toPandas()
    assert sorted(want.columns) == sorted(got.columns) and len(got)
    whole = lambda d: sorted(map(repr, d[sorted(d.columns)].astype(object).where(d[sorted(d.columns)].notna(), None).map(lambda x: int(x) if isinstance(x, float) else x).values.tolist()))
    assert whole(want) == whole(got)


# Ranking


def _ranks(rows, most):
    """rows of (group, down, up, tie): what stands in places up to most, by loops."""
    key = lambda v, down=False: (v is None, 0 if v is None else -v if down else v)
    out = []
    for g in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == g), key=lambda r: (key(r[1], True), key(r[2]), key(r[3])))
        pairs = [r[1:3] for r in mine]
        seen = []
        for pos, r in enumerate(mine, 1):
            if r[1:3] not in seen:
                seen.append(r[1:3])
            if len(seen) <= most:
                out.append((*r, pos, len(seen), pairs.count(r[1:3])))
    return sorted(out, key=repr)


@pytest.mark.parametrize("block", [2, 4096])
def test_ranked_ties(spark, monkeypatch, block):
    monkeypatch.setattr(ranking, "BLOCK", block)
    rnd = random.Random(4)
    some = lambda k: rnd.choice([None, *range(-1, k)])
    rows = [(rnd.choice([None, 1, 1, 1, 2]), some(6), some(3), some(3)) for _ in range(600)] + [(1, 5, 0, 0)] * 300
    d = spark.createDataFrame(rows, "g long, a long, b long, c long").withColumns({"n": F.lit("clash"), "pos": F.lit("clash"), "chunk": F.lit(1)})
    got = ranking.ranked_ties(d, ["g"], ["-a", "b"], ["c"], 4).collect()
    assert sorted(map(tuple, got), key=repr) == _ranks(rows, 4)
    assert ranking.ranked_ties(d.limit(0), ["g"], ["-a", "b"], ["c"], 4).collect() == []


def test_names_of_columns_may_clash(spark):
    d = spark.createDataFrame([(1, 2, 3)] * 3, "`g0` long, `r 0` long, t0 long")
    got = ranking.ranked_ties(d, ["t0"], ["r 0"], ["g0"]).collect()
    assert sorted(r.pos for r in got) == [1, 2, 3] and {(r["t0"], r["r 0"], r["g0"], r.tied) for r in got} == {(3, 2, 1, 3)}


def test_prefix_sums_cut_a_group(spark, monkeypatch):
    """A group that lies in many chunks has the sums of one that lies in one."""
    monkeypatch.setattr(ranking, "CHUNKS", 16)
    rnd = random.Random(2)
    rows = [(None if i % 7 == 0 else i % 3 // 2, i, rnd.randrange(1, 9)) for i in range(2000)]
    d = spark.createDataFrame(rows, "k long, o long, w long")
    got = {(r.k, r.o): (r.before, r.nth) for r in ranking.prefix_sums(d, ["k"], ["-o"], "w").collect()}
    run = {}
    for k, o, w in sorted(rows, key=lambda r: -r[1]):
        before, nth = run.get(k, (0, 1))
        assert got[k, o] == (before, nth)
        run[k] = (before + w, nth + 1)


def test_op11_broken_rows(spark, tmp_path):
    """Nulls everywhere, infinite and absent numbers, repeated rows."""
    schema = "sale_id long, line_no int, item_id long, vendor_id long, quantity int, amount double, discount double, flag string, shipped_at timestamp"
    rows = [(None,) * 9] * 2 + [(5, 1, 3, None, 9, math.nan, math.inf, None, None), (5, 1, 3, None, 9, math.nan, math.nan, None, None), (6, None, 4, 1, 50, 1e300, 0.005, "x", None)]
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/sale_lines.parquet")
    got = ranking.op11_ranking(spark, str(tmp_path)).collect()
    assert len(got) == 5 and all(r.tied == 2 for r in got if r.sale_id is None)
    assert all(t == "bigint" for _, t in ranking.op11_ranking(spark, str(tmp_path)).dtypes)


# Spelling


def _near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return len(long) == len(short) + 1 and any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


@pytest.mark.parametrize("letters,low,high", [("ab", 4, 9), ("abc", 4, 8), ("abcdefghijé", 6, 12), ("a", 4, 30)])
def test_near_pairs(spark, letters, low, high):
    rnd = random.Random(high)
    words = {"".join(rnd.choice(letters) for _ in range(rnd.randint(low, high))) for _ in range(500)}
    for w in list(words)[:250]:  # words one or two edits from others
        for _ in range(2):
            i, kind = rnd.randrange(len(w)), rnd.randrange(3)
            w = w[:i] + rnd.choice(letters) * (kind > 0) + w[i + (kind < 2) :]
            if len(w) >= low:
                words.add(w)
    got = [(r.word, r.other) for r in spelling.near_pairs(spark.createDataFrame([(w, 1) for w in words], "word string, n long")).collect()]
    assert len(got) == len(set(got))
    assert {tuple(sorted(p)) for p in got} == {(a, b) for a in words for b in words if a < b and _near(a, b)}


def test_forms_and_roots(spark):
    n = {"mañana": 3000, "manana": 500, "manna": 1, "mananan": 90, "mananas": 100, "mananass": 20, "mananasss": 4, "banana": 500, "canana": 99, "single": 7}
    got = {r.word: r for r in spelling.variants(spark.createDataFrame(list(n.items()), "word string, n long")).collect()}
    assert set(got) == set(n)
    for w, c in n.items():
        near = [o for o in n if _near(w, o)]
        best = min(near, key=lambda o: (-n[o], o), default=None)
        form = best if best and n[best] >= 5 * c else None
        assert (got[w].form, got[w].n_near, got[w].form_n) == (form, len(near), n[form] if form else None)
        assert got[w].root == (got[form].root if form else w)
    assert got["mananasss"].root == "mañana" and got["single"].root == "single"


def test_words_of_documents(spark):
    rnd = random.Random(8)
    texts = [" ".join(rnd.choice(["Ährenöl", "WORDS-of", "straße", "aéÉ×÷z", "mixedCASE", "日本wörter"]) for _ in range(400)) for _ in range(6)] + [None, "", "x" * 200_000]
    d = spark.createDataFrame([(i if i else None, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, run int")
    want = {}
    for i, t in enumerate(texts):
        run = ""
        for c in (t or "") + " ":
            if "A" <= c <= "Z" or "a" <= c <= "z" or "À" <= c <= "ÿ":
                run += c.lower() if c < "a" else c
            elif run:
                h = zlib.crc32(f"{i or ''}:{run}".encode())
                at = h % len(run)
                word = run[:at] + run[at + 1 :] if h % 199 == 0 else run
                want[word] = want.get(word, 0) + 1
                run = ""
    got = {r.word: r.n for r in spelling.vocabulary(spelling.spoiled(spelling.runs(d)), 1, 1).collect()}
    assert got == want
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert spelling.variants(spelling.vocabulary(spelling.spoiled(spelling.runs(empty)))).collect() == []


# Main text

P = "Some words of a story, told at length, which go on for a while so that a reader has something to read, and more."
PAGES = {
    # name: (page, text)
    "article": (f"<body><nav><a href=x>Home</a></nav><article><h1>T &amp; U</h1><p>{P}</p><p>Short.</p></article><footer>c</footer>", f"T & U\n{P}\nShort."),
    "unclosed": (f"<article><h1>T</h1><p><b>{P}<br><p>next <i>one<p>third</article><p>after", f"T\n{P}\nnext one\nthird"),
    "divs": (f"<div class=top><ul><li><a href=a>A</a><li><a href=b>B</a></ul></div><div id=content><h2>T</h2><p>{P}</p><p>{P}</p><p>tiny</p></div><div class='sidebar'><p>{P}</p></div><div id=comments><p>{P}</p><p>{P}</p><p>{P}</p><p>{P}</p></div>", f"T\n{P}\n{P}\ntiny"),
    "siblings": (f"<body><div class=wrap><h1>T</h1><div><p>{P}</p><p>{P}</p></div><div><p>{P}</p><p>{P}</p></div><div class='ad-slot'>Buy, buy, buy</div><p>End.</p></div><div><a href=1>one</a> <a href=2>two</a> <a href=3>three</a></div>", f"T\n{P}\n{P}\n{P}\n{P}\nEnd."),
    "comments as articles": (f"<main><article><p>{P}</p></article><section class=comments><article class=comment><p>{P} {P} {P}</p></article></section></main>", P),
    "names that say has": (f"<body class='has-sidebar no-comments'><div class='page with-banner'><article class=post><p>{P}</p></article></div>", P),
    "wrapper named badly": (f"<div class=widget><h1>T</h1><p>{P}</p><p>{P}</p></div>", f"T\n{P}\n{P}"),
    "raw": (f"<article><script>var a='</p><p>no';</script><style>p{{}}</style><!-- <p>no</p> --><p>{P}</p><noscript><p>no</p></noscript><textarea><p>no</textarea></article>", P),
    "hidden": (f"<article><p>{P}</p><p hidden>no</p><div style='display: none'><p>no</p></div><p aria-hidden=true>no</p></article>", P),
    "cookie and form": (f"<div class='cookie-notice'><p>We use, as you know, cookies, and {P}</p></div><div class=c><p>{P}</p><form><p>Your mail, please, {P}</p></form><p>x</p></div>", f"{P}\nx"),
    "menu inside": (f"<article><p>{P}</p><ul><li><a href=a>Alpha</a><li><a href=b>Beta</a></ul><ul><li>One <a href=x>x</a> thing</li><li>Two</li></ul></article>", f"{P}\nOne x thing\nTwo"),
    "headers": (f"<header><h1>Site</h1><p>{P}</p></header><article><header><h1>T</h1><p>By me</p></header><p>{P}</p><footer>f</footer></article>", f"T\n{P}"),
    "quotes": (f"<article><p title=\"a > b\" data-x='<p>'>{P}</p><p>it's 5 < 6 &lt; 7 &#8364;&nbsp;&copy</p></article>", f"{P}\nit's 5 < 6 < 7 € ©"),
    "white space": ("<article><p> a \n\t b&nbsp;c </p>\n\n<p>\n</p> d, <b>e</b>f <br>g</article>", "a b c\nd, ef g"),
    "table": (f"<table><tr><td><p>{P}</p><td class=nav><a href=x>x</a></table>", P),
    "plain": ("just text, no markup", "just text, no markup"),
    "empty": ("", ""),
    "null": (None, ""),
    "only junk": ("<nav>a</nav><script>b", ""),
    "a quote without an end": (f"<article><p class=\"x>{P}</p><p>{P}</p></article>", None),
}


@pytest.mark.parametrize("name", PAGES)
def test_main_text(name):
    page, text = PAGES[name]
    got = html_text.main_text(page)
    assert got == text if text is not None else P in got


@pytest.mark.parametrize("part", ["<", "<!--", "<p", "<a \"", "<a b='", "</", "<b>", "<div>", "<p><b>", "</x>", "&", "<script>", "<td>", "<li><a>", "x<p ", "<a \"='", "<ul><li>"])
def test_broken_pages_take_linear_time(part):
    """A page of some MB of one broken part ends in seconds."""
    import time

    began = time.time()
    html_text.main_text(part * (1_000_000 // len(part)))
    assert time.time() - began < 20


def test_extract(spark):
    d = spark.createDataFrame([(i, p, i) for i, (p, _) in enumerate(PAGES.values())] + [(None, f"<article><p>{'word, ' * 500_000}</p>", 0)], "page_id long, html string, row int").withColumn("text", F.lit("clash"))
    got = html_text.extract(d)
    assert got.columns == ["page_id", "html", "row", "text", "n_chars"] and got.limit(0).collect() == []
    rows = {r.page_id: r for r in got.collect()}
    for i, (p, text) in enumerate(PAGES.values()):
        assert rows[i].n_chars == len(rows[i].text) and (text is None or rows[i].text == text)
    assert rows[None].n_chars == 500_000 * 6 - 1
    assert html_text.extract(d.where("false")).collect() == []


def test_given_pages():
    """Every page of the table: all that the article element holds, and nothing else."""
    import html as H
    import re

    for page in pd.read_parquet(f"{DATA}/pages.parquet").html:
        body = re.search("(?s)<article>(.*)</article>", page)[1]
        parts = re.split(r"</?(?:p|h1)>", re.sub("</?b>", "", body.replace("<br>", " ")))
        assert html_text.main_text(page) == "\n".join(x for x in (" ".join(H.unescape(p).split()) for p in parts) if x)
