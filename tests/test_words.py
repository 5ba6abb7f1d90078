"""Broken, run-together and spaced-out words, and the line filter, against plain Python."""

import itertools
import math
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from siltstone.operators import cleaning, lookup, repair, segments

KNOWN = frozenset("the this other differ suffer effect effective refer identify organization support defend set see able model define classification science genetics releasing corticotropin interventricular memory long".split())


def _texts(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "i int, text string").withColumn("word", F.lit("clash"))


def _mended(d):
    return [r.text for r in d.orderBy("i").collect()]


def test_broken_by_hyphens(spark):
    texts = ["sup- ported", "defend-\n\ning", "Organi-\nzation", "INTERVENTRICU-\nLAR", "corticotropin-\nreleasing", "corticotropin - releasing", "long -memory", "GABA- ergic", "well-known", "a - b", "aa - bb - cc", "", None, "éa - th - is"]
    want = ["supported", "defending", "Organization", "INTERVENTRICULAR", "corticotropin-releasing", "corticotropin-releasing", "long-memory", "GABA-ergic", "well-known", "a - b", "aa-bb-cc", "", "", "éa - this"]
    assert _mended(repair.without_breaks(_texts(spark, texts), KNOWN)) == want


def test_broken_by_hyphens_needs_no_row_of_a_text(spark, monkeypatch):
    """A sieve that takes every word for known, its errors told by the join, mends as the table does, and so does the way for too many errors."""
    rnd = random.Random(3)
    bits = ["sup", "ported", "defend", "ing", "Organi", "zation", "long", "memory", "éa", "q", "x9", "THE", "ORY", "stop", "ped", "a_b"]
    texts = ["".join(rnd.choice(bits) + rnd.choice(["-", "- ", " - ", " -", "-\n", "- \n ", " ", ".", "\u2003-", "-\x1c"]) for _ in range(rnd.randint(1, 12))) for _ in range(300)]
    known = ["supported", "defend", "organization", "long", "memory", "theory", "stop", "zation"]
    judged = repair.judged
    monkeypatch.setattr(repair, "judged", None)
    want = _mended(repair.without_breaks(_texts(spark, texts), known))
    monkeypatch.setattr(repair, "sieve", lambda words: spark.sparkContext.broadcast((1023, b"\xff" * 128)))
    assert _mended(repair.without_breaks(_texts(spark, texts), known)) == want
    monkeypatch.setattr(repair, "MOST_ERRORS", 1)
    monkeypatch.setattr(repair, "judged", judged)
    assert _mended(repair.without_breaks(_texts(spark, texts), known)) == want


def test_broken_by_spaces(spark):
    texts = ["Th e brain", "th is is a test.", "The results diff er.", "(diff er), they", "identifi able", "see ing", "sett ing", "neuro science", "opto genetics", "a ble", "T he", "EFF ECT", "  one", "x   y\nsuff er", "o th er", "re fer red", "", None]
    want = ["The brain", "this is a test.", "The results differ.", "(differ), they", "identifiable", "seeing", "setting", "neuroscience", "optogenetics", "a ble", "T he", "EFFECT", "  one", "x y\nsuffer", "other", "referred", "", ""]
    assert _mended(repair.joined_words(_texts(spark, texts), KNOWN)) == want


def _plain_join(text, words, passes=repair.PASSES):
    """The rule by a walk over each line."""

    def known(w):
        return any(f in words for f in _plain_forms(w))

    for _ in range(passes):
        lines = []
        for line in text.split("\n"):
            w, out = line.split(), []
            if len(w) < 2:
                lines.append(line)
                continue
            while w:
                a = w.pop(0)
                if w:
                    x, y = a.strip(repair.SIGNS), w[0].strip(repair.SIGNS)
                    if x.isalpha() and y.isalpha() and x.lower() not in repair.NEVER_FIRST and not (len(x) == 1 and x.isupper()) and (known((x + y).lower()) or x.lower() in repair.PREFIXES and known(y.lower())):
                        whole = (x + y).lower()
                        whole = whole.upper() if x.isupper() else whole.capitalize() if x[0].isupper() else whole
                        a = a.replace(x, whole) + w.pop(0).replace(y, "")
                out.append(a)
            lines.append(" ".join(out))
        text = "\n".join(lines)
    return text


def _plain_forms(w):
    out = [w]
    for e in repair.ENDINGS:
        if w.endswith(e) and len(w) > len(e):
            s = w[: -len(e)]
            out += [s, s + "e"] + ([s[:-1]] if len(s) > 2 and s[-1] == s[-2] else []) + ([s[:-1] + "y"] if e in repair.Y_ENDINGS and s.endswith("i") else [])
    return set(out)


@pytest.mark.parametrize("broadcast,hot", [(200_000, 1_000), (0, 1_000), (0, 3)])
def test_joined_words_at_random(spark, monkeypatch, broadcast, hot):
    """Against a walk over each line, with the words found being broadcast, shuffled, or both by how often they are asked."""
    monkeypatch.setattr(lookup, "BROADCAST_ROWS", broadcast)
    monkeypatch.setattr(lookup, "HOT_SHARE", hot)
    rnd = random.Random(hot + broadcast)
    words = frozenset("".join(rnd.choice("abei") for _ in range(rnd.randint(2, 6))) for _ in range(300))
    token = lambda: rnd.choice(["", "("]) + rnd.choice([str.lower, str.upper, str.capitalize])("".join(rnd.choice("abei") for _ in range(rnd.randint(1, 3))) + rnd.choice(["", "", "ing", "s", "ed"])) + rnd.choice(["", "", ",", "."])
    texts = ["".join(token() + rnd.choice([" ", " ", "  ", "\n"]) for _ in range(rnd.randint(0, 60))) for _ in range(40)] + ["ab " * 3000]
    table = spark.createDataFrame([(w,) for w in words], "word string")
    assert _mended(repair.joined_words(_texts(spark, texts), table)) == [_plain_join(t, words) for t in texts]


def test_forms(spark):
    rnd = random.Random(1)
    words = ["".join(rnd.choice("abies") for _ in range(rnd.randint(1, 4))) + rnd.choice([*repair.ENDINGS, ""]) for _ in range(400)]
    for r in _texts(spark, words).select("text", repair.forms(F.col("text")).alias("f")).collect():
        assert set(r.f) == _plain_forms(r.text) and r.f[0] == r.text


def test_clean_takes_a_table_or_a_set(spark):
    d = spark.createDataFrame([("mem-\nory wor ks", "x"), (None, None)], "text string, source string")
    for words in (frozenset(["memory", "works"]), spark.createDataFrame([("memory",), ("works",)], "word string")):
        assert sorted(r.text for r in cleaning.clean(d, words).collect()) == ["", "memory works"]


def _plain_split(run, price, longest=segments.LONGEST):
    """All splits of a run: the least cost, or None."""
    costs = []

    def go(rest, cost):
        if not rest:
            costs.append(cost)
        for k in range(1, min(longest, len(rest)) + 1):
            if rest[:k] in price:
                go(rest[k:], cost + price[rest[:k]])

    go(run, 0)
    return min(costs, default=None)


@pytest.mark.parametrize("by", ["words", "frequency"])
def test_best_splits(spark, by):
    rnd = random.Random(5)
    n = {"".join(rnd.choice("abc") for _ in range(rnd.randint(1, 4))): rnd.randint(1, 500) for _ in range(40)} | {"y" * 21: 1}
    runs = {"".join(rnd.choice("abc") for _ in range(rnd.randint(1, 12))) for _ in range(150)} | {"", "xyz", "y" * 21, "abz"}
    lexicon = spark.createDataFrame(list(n.items()), "word string, n long")
    total = sum(n.values())
    price = {w: 1 if by == "words" else round(-math.log(c / total) * 1e6) for w, c in n.items()}
    got = {r.run: r for r in segments.best_splits(spark.createDataFrame([(r,) for r in runs], "run string"), lexicon, by).collect()}
    assert set(got) == runs
    for run, r in got.items():
        want = _plain_split(run, price) if run else None
        assert r.cost == want
        if want is not None:
            assert "".join(r.pieces) == run and sum(price[p] for p in r.pieces) == want
    with pytest.raises(ValueError):
        segments.best_splits(lexicon, lexicon, "other")


def test_only_parts_on_a_way_are_asked(spark, monkeypatch):
    """Of runs that no words cover no part meets the lexicon; a sieve that lets everything through changes nothing."""
    lexicon = spark.createDataFrame([("ab", 5), ("abc", 4), ("cd", 3), ("d", 2)], "word string, n long")
    runs = spark.createDataFrame([("abcd",), ("abx",), ("xab",), ("",), (None,)], "run string")
    asked = []
    met = segments.met
    monkeypatch.setattr(segments, "met", lambda parts, table: (asked.append(sorted({r.word for r in parts.collect()})), met(parts, table))[1])
    want = [(None, None, None), ("", None, None), ("abcd", ["abc", "d"], 2), ("abx", None, None), ("xab", None, None)]
    rows = lambda: sorted(map(tuple, segments.best_splits(runs, lexicon, "words").collect()), key=lambda r: (r[0] is not None, r[0]))
    got = rows()
    assert [(r[0], r[2]) for r in got] == [(r[0], r[2]) for r in want] and "".join(got[2][1]) == "abcd" and asked[0] == ["ab", "abc", "cd", "d"]
    monkeypatch.setattr(segments, "sieve", lambda words: spark.sparkContext.broadcast((1023, b"\xff" * 128)))
    assert rows() == got


def test_long_run_is_split_in_linear_time(spark):
    began = time.time()
    run = "abcab" * 4_000
    r = segments.best_splits(spark.createDataFrame([(run,)], "run string"), spark.createDataFrame([("abc", 3), ("ab", 2)], "word string, n long"), "words").first()
    assert r.cost == 8_000 and r.pieces[:2] == ["abc", "ab"] and time.time() - began < 60


def test_spaced_capitals_and_ligatures(spark):
    lexicon = spark.createDataFrame([(w, 5) for w in ("praise", "for", "the", "fort", "forth", "difficult", "specific", "effect", "find")], "word string, n long")
    texts = ["P R A I S E F O R T H E book", "X Q Z W left", "A B C", "Th e di ff icult", "diff icult, eff ect5 speci fi c fi nd Fi nd", "no-\x00b\xa012-book.indd iv x\x07", "a\n\n\n\nb  c\t d ", None, "P R A I S E and F O R T H E"]
    want = ["PRAISE FOR THE book", "X Q Z W left", "A B C", "The di ff icult", "difficult, effect5 speci fi c find Fi nd", "no-b x", "a\n\nb c d", "", "PRAISE and FOR THE"]
    got = _mended(segments.cleaned(_texts(spark, texts), lexicon))
    assert got == want
    d = _texts(spark, texts)
    r = segments.report(d, segments.cleaned(d, lexicon), "i").first()
    assert (r.documents, r.control, r.no_break_spaces, r.running_heads, r.spaced_capitals, r.broken_th) == (9, 2, 1, 1, 4, 1)
    assert r.modified == sum(a != b for a, b in zip([t or "" for t in texts], want)) and r.chars_new == sum(map(len, want))


def test_lookup_of_nothing(spark):
    none = spark.createDataFrame([], "word string, n long")
    d = _texts(spark, ["Th e a fi b", "P R A I S E", None])
    assert _mended(segments.cleaned(d, none)) == ["The a fi b", "P R A I S E", ""]
    assert segments.cleaned(d.limit(0), none).collect() == [] and repair.joined_words(d.limit(0), []  ).collect() == []


def test_replaced_is_a_scan_from_the_left(spark):
    rnd = random.Random(3)
    texts = ["".join(rnd.choice("ab1 ") for _ in range(rnd.randint(0, 30))) for _ in range(200)] + [""]
    for pattern in ("a+", "[ab]1", "ab|b "):
        got = [r[0] for r in _texts(spark, texts).orderBy("i").select(lookup.replaced(F.col("text"), pattern, lambda m: F.concat(F.lit("<"), m, F.lit(">")))).collect()]
        assert got == [re.sub(pattern, lambda m: f"<{m[0]}>", t) for t in texts]


def test_contents_pairs_as_the_plain_pattern(spark):
    """The linear pattern counts what the plain one counts."""
    plain = r"\b[A-Za-z\s,-]{3,}\s+\d{2,4}\b"
    rnd = random.Random(9)
    texts = ["".join(rnd.choice(["a", "B", " ", " ", ",", "-", "12", "3", "4567", "x1", "_", "é", ".", "ab ", "word 12"]) for _ in range(rnd.randint(0, 25))) for _ in range(4000)]
    texts += ["".join(t) for t in itertools.product(["1", "a", " ", ",", "_"], repeat=4) for t in [(*t, " ", "12"), (*t, "a 34")]]
    bad = _texts(spark, texts).where(F.regexp_count("text", F.lit(plain)) != F.regexp_count("text", F.lit(cleaning.CONTENTS_PAIR)))
    assert bad.collect() == []


def test_long_line_is_filtered_in_linear_time(spark):
    line = "some words, and-more of a sentence " * 4_000
    d = _texts(spark, [line]).select(cleaning.without_furniture(F.col("text")).alias("t"))
    began = time.time()
    assert d.first().t == line and time.time() - began < 10


def test_sieve_bounds_what_is_asked(spark):
    """Of many neighbours only those that the words may join meet the table; a sieve never hides a word."""
    rnd = random.Random(5)
    words = ["".join(rnd.choice("abcdefgh") for _ in range(8)) for _ in range(300)]
    held = repair.sieve(spark.createDataFrame([(w,) for w in [*words, None]], "word string"))
    asked = repair._likely(held)
    for w in words:
        assert asked(w[:3], w[3:], w[3:]) == [w] and asked(w[:3], w[3:] + "ing", "") == [w + "ing"]
    others = ["".join(rnd.choice("stuvwxyz") for _ in range(8)) for _ in range(2_000)]
    assert sum(bool(asked(w[:4], w[4:], "")) for w in others) < 300
    text = " ".join([*others, words[0][:3], words[0][3:]])
    of = repair._asked(held)
    row = _texts(spark, [text]).select(of(F.col("text"), F.lit(None).cast("array<long>")).alias("a")).first()
    assert words[0] in row.a and len(row.a) < 300


def test_later_passes_look_at_words_made(spark):
    made = repair._rejoined(F.col("text"), F.array(F.lit("windmill")), F.lit(None).cast("array<long>"))
    row = _texts(spark, ["a  b\nthe wind, mill\nThe wind mill."]).select(made.alias("m")).first()
    assert row.m.text == "a b\nthe windmill,\nThe windmill." and row.m.open == [1 << 31 | 1, 2 << 31 | 1]


def test_long_runs_hold_no_artifacts_in_linear_time(spark):
    """Runs are looked at once; from each of their characters they would take hours. Matches are those of the plain patterns."""
    pieces = ["a", ".indd", ".INDD ", "12", "x", " ", "fi ", "off", "\n", "b.indd iv", "fl", "-"]
    rnd = random.Random(5)
    texts = ["".join(rnd.choice(pieces) for _ in range(rnd.randint(0, 25))) for _ in range(2_000)]
    d = spark.createDataFrame([(t,) for t in texts], "text string")
    found = d.select("text", *[F.regexp_extract_all("text", F.lit(p), F.lit(0)).alias(n) for p, n in ((segments.RUNNING, "r"), (segments.BROKEN_LIGATURE, "l"))]).collect()
    for t, r, lig in found:
        assert r == re.findall(r"(?ai)\S*\.indd\s+[ivxlc\d]+\b", t) and lig == re.findall(r"(?a)\w*(?:fi|ff|fl) \w+", t)
    long = spark.createDataFrame([("ab" * 1_000_000,)], "text string")
    assert tuple(long.select(segments.artifacts(F.col("text")).alias("a")).select("a.*").first()) == (0,) * 6


def test_lines_are_stripped_once(spark):
    """Each line is stripped once for all patterns of its kinds, and shares of lines that are asked twice are worked out once."""
    d = _texts(spark, ["Index\n  12 "])
    plan = lambda c: d.select(c.alias("c"))._jdf.queryExecution().analyzed().toString()
    assert plan(cleaning.line_kinds(F.col("text"))).count(r"(?U)^\s+|\s+$") == 1
    assert plan(cleaning.is_book_list(F.col("text"))).count(cleaning.INDEX_LINE) == 1
