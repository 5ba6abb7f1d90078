"""Near-duplicate lines by a segment-partition edit join (DataFrame functions only)."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, documents, settled, written

#: Edits up to which lines are linked, and characters from which on they are looked at.
EDITS = 1
MIN_CHARS = 24
#: Words from which on lines are linked too if one word is put in, left out or replaced.
MIN_WORDS = 8
#: Classes of words, by hash, whose numbers are compared before words are.
WORD_CLASSES = 16
#: Characters of which a line's counts are compared before the edit distance is worked out.
COUNTED = "abcdefghijklmnopqrstuvwxyz ,."


def _key(line: Column, length: Column, part: int, start: Column, size: Column) -> Column:
    return F.xxhash64(length, F.lit(part), F.substring(line, start + 1, size))


def _part(length: Column, part: int, edits: int) -> tuple[Column, Column]:
    """Start (from 0) and size of one of edits + 1 nearly equal segments; the longer ones come last."""
    n = edits + 1
    base, longer = F.floor(length / n).cast("int"), (length % n).cast("int")
    return (part - 1) * base + F.greatest(F.lit(0), F.lit(part - 1 - n) + longer), base + (F.lit(part) > F.lit(n) - longer).cast("int")


def segment_keys(line: Column, n: Column, edits: int, least: int) -> Column:
    """array<struct<key long, indexed boolean>> of a line of n characters: its own segments, and the substrings to
    probe with; null where a probe would reach outside the line.

    A line within ``edits`` of a shorter or equally long one holds one of that one's edits + 1 segments unchanged. Up
    to so many edits before and behind it, the multi-match-aware rule leaves few places where segment i can stand:
    within i - 1 of its own place, and within edits + 1 - i of it counted from the end. Where length and place are
    the line's own, the probe is its own segment, so that entry serves as both.
    """
    made = []
    for part in range(1, edits + 2):
        start, size = _part(n, part, edits)
        made.append(F.struct(_key(line, n, part, start, size).alias("key"), F.lit(True).alias("indexed")))
    for longer in range(edits + 1):
        length = n - longer
        for part in range(1, edits + 2):
            start, size = _part(length, part, edits)
            low = max(-(part - 1), longer - (edits + 1 - part))
            high = min(part - 1, longer + (edits + 1 - part))
            for shift in range(low, high + 1):
                if longer or shift:
                    fits = (length >= least) & (start + shift >= 0) & (start + shift + size <= n)
                    made.append(F.when(fits, F.struct(_key(line, length, part, start + shift, size).alias("key"), F.lit(False).alias("indexed"))))
    return F.array(*made)


def banded_distance(longer: Column, shorter: Column, most: int) -> Column:
    """Edit distance of two strings, exact up to ``most`` and above it otherwise, by banded bit-parallelism.

    Bits of a word stand for the 2 * most + 2 cells of a column around the diagonal; each character of the shorter
    string moves the band down by one and updates all cells with a few word operations (Hyyrö's form of Myers'
    algorithm). Words are so short that sums cannot overflow. Lengths differ by ``most`` at most and exceed it.
    """
    # split('') of an empty string is one empty string, not none.
    return array_distance(*[F.filter(F.split(x, ""), lambda c: c != "") for x in (longer, shorter)], most)


def array_distance(longer: Column, shorter: Column, most: int) -> Column:
    """banded_distance of two arrays."""
    w = 2 * most + 2
    full = (1 << w) - 1

    def run(ab: Column) -> Column:
        a, b = ab["a"], ab["b"]
        rows, steps = F.size(a), F.size(b)

        def step(s: Column, i: Column) -> Column:
            c = F.get(b, i)
            match = sum((F.when(F.get(a, F.when(i + (j - most - 1) >= 0, i + (j - most - 1))) == c, F.lit(1 << j)).otherwise(F.lit(0)) for j in range(w)), F.lit(0))

            def update(x: Column) -> Column:
                vp, vn = s["vp"], s["vn"]
                d0 = ((x.bitwiseAND(vp) + vp).bitwiseXOR(vp)).bitwiseOR(x).bitwiseOR(vn).bitwiseAND(F.lit(full))

                def rest(d: Column) -> Column:
                    hp = vn.bitwiseOR(F.bitwise_not(d.bitwiseOR(vp)).bitwiseAND(F.lit(full)))
                    hn = d.bitwiseAND(vp)
                    down = F.shiftright(d, 1)
                    diagonal = i < rows - most
                    at = F.when(diagonal, F.lit(0)).otherwise(F.greatest(F.lit(0), F.lit(w - 2) - (i - (rows - most))))
                    mask = F.call_function("shiftleft", F.lit(1), at)
                    by = F.when(diagonal, (d.bitwiseAND(F.lit(1 << (w - 1))) == 0).cast("int")).otherwise((hp.bitwiseAND(mask) != 0).cast("int") - (hn.bitwiseAND(mask) != 0).cast("int"))
                    return F.struct(hn.bitwiseOR(F.bitwise_not(down.bitwiseOR(hp)).bitwiseAND(F.lit(full))).alias("vp"), down.bitwiseAND(hp).alias("vn"), (s["dist"] + by).alias("dist"))

                return F.element_at(F.transform(F.array(d0), rest), 1)

            return F.element_at(F.transform(F.array(match), update), 1)

        start = F.struct(F.lit((full << (w - most - 1)) & full).alias("vp"), F.lit(0).alias("vn"), F.lit(most).alias("dist"))
        return F.when(steps == 0, rows).otherwise(F.aggregate(F.sequence(F.lit(0), F.greatest(steps - 1, F.lit(0))), start, step)["dist"])

    return F.element_at(F.transform(F.array(F.struct(longer.alias("a"), shorter.alias("b"))), run), 1)


def _counts(line: Column) -> Column:
    """How often each counted character stands in the line; an edit changes these by two in sum at most."""
    return F.array(*[(F.char_length(line) - F.char_length(F.replace(line, F.lit(c), F.lit("")))).cast("int") for c in COUNTED])


def _words(line: Column) -> Column:
    return F.split(line, " ")


def _word_counts(line: Column) -> Column:
    """How many of the line's words are of each class; one word put in, left out or replaced changes these by two in sum at most."""
    classes = F.transform(_words(line), lambda x: F.pmod(F.xxhash64(x), F.lit(WORD_CLASSES)))
    return F.transform(F.array(*[F.lit(i) for i in range(WORD_CLASSES)]), lambda i: F.size(F.filter(classes, lambda c: c == i)))


def word_keys(line: Column, n: Column, least: int) -> Column:
    """As segment_keys for one edit, of a line of n words: of two halves one is unchanged, which is its first or last words."""
    made = []
    for length, indexed in ((n, True), (n - 1, False)):
        half = F.floor(length / 2).cast("int")
        for part, words in ((-1, half), (-2, half - length)):
            entry = F.struct(F.xxhash64(length, F.lit(part), F.call_function("substring_index", line, F.lit(" "), words)).alias("key"), F.lit(indexed).alias("indexed"))
            made.append(entry if indexed else F.when(length >= least, entry))
    return F.array(*made)


def _lines(docs: DataFrame, id_col: str, text_col: str, least: int) -> DataFrame:
    """(id, whole, pos, line, n, h1, h2) of the lines of at least ``least`` characters that are not blank.

    The hashes h1 and h2 together name a line, id and the hash of the whole text a document.
    """
    each = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("whole"), F.posexplode(F.split(F.col(text_col), "\n")).alias("pos", "line"))
    each = each.select("id", "whole", "pos", "line", F.char_length("line").alias("n")).where((F.col("n") >= least) & (F.trim("line") != ""))
    return each.select("id", "whole", "pos", "line", "n", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), F.col("line")).alias("h2"))


def _keys(lines: DataFrame, made: Column) -> DataFrame:
    """(h1, h2, key, indexed) of each segment and probe."""
    keys = lines.select("h1", "h2", F.explode(made).alias("k"))
    return keys.where("k is not null").select("h1", "h2", "k.key", "k.indexed")


def line_links(docs: DataFrame, edits: int = EDITS, least: int = MIN_CHARS, text_col: str = "text") -> DataFrame:
    """All pairs of different lines within ``edits`` edits, each once: (a1, a2, b1, b2), the pair of hashes of both.

    Keys that one line alone has, however often it stands in the corpus, go first: an aggregation by key, which
    gathers copies before it shuffles, and a join against the keys left, which may be split where it is skewed.
    Neither moves text. The lines left are fetched, each once, and joined by key, where a pair must also differ
    little in its counts of common characters; only pairs that pass leave the join, to be verified. Lines must be
    longer than ``edits``.
    """
    if least <= 2 * edits:
        raise ValueError("least must be above 2 * edits")
    each = _lines(docs.select(F.lit(0).alias("id"), text_col), "id", text_col, least)

    def far(longer: Column, shorter: Column) -> Column:
        return banded_distance(longer, shorter, edits)

    return _linked(each, segment_keys(F.col("line"), F.col("n"), edits, least), _counts(F.col("line")), far, edits)


def word_links(docs: DataFrame, words: int = MIN_WORDS, least: int = MIN_CHARS, text_col: str = "text") -> DataFrame:
    """As line_links: pairs of lines of at least so many words (parts between spaces) of which one word is put in, left
    out or replaced, however long it is."""
    each = _lines(docs.select(F.lit(0).alias("id"), text_col), "id", text_col, least)
    each = each.withColumn("n", F.char_length("line") - F.char_length(F.replace("line", F.lit(" "), F.lit(""))) + 1).where(F.col("n") >= words)

    def far(longer: Column, shorter: Column) -> Column:
        return array_distance(_words(longer), _words(shorter), 1)

    return _linked(each, word_keys(F.col("line"), F.col("n"), words), _word_counts(F.col("line")), far, 1)


def _linked(each: DataFrame, made: Column, counts: Column, far: Callable[[Column, Column], Column], edits: int) -> DataFrame:
    keys = _keys(each, made)
    shared = keys.groupBy("key").agg(F.min("h1").alias("low"), F.max("h1").alias("high"), F.max("indexed").alias("any")).where("low < high and any").select("key")
    live = written(keys.join(shared, "key", "left_semi").select("h1", "h2").distinct(), "line-keys")
    # Merged at any size: the lines are the whole corpus, and live grows with it, so one plan should hold throughout.
    line = each.select("h1", "h2", "line", "n").join(live.hint("merge"), ["h1", "h2"], "left_semi").groupBy("h1", "h2").agg(F.first("line").alias("line"), F.first("n").alias("n"))
    line = written(line.withColumn("counts", counts), "lines")
    full = _keys(line, made).join(line.select("h1", "h2", "n", "counts"), ["h1", "h2"])
    r = full.where("indexed").select("key", *[F.col(c).alias(f"r_{c}") for c in ("h1", "h2", "n", "counts")])
    s = full.select("key", "indexed", *[F.col(c).alias(f"s_{c}") for c in ("h1", "h2", "n", "counts")])
    once = ~F.col("indexed") | (F.struct("r_h1", "r_h2") < F.struct("s_h1", "s_h2"))
    gap = F.aggregate(F.zip_with("r_counts", "s_counts", lambda x, y: F.abs(x - y)), F.lit(0), lambda x, y: x + y)
    near = (F.abs(F.col("r_n") - F.col("s_n")) <= edits) & ((F.col("r_h1") != F.col("s_h1")) | (F.col("r_h2") != F.col("s_h2")))
    pairs = r.join(s, (r["key"] == s["key"]) & once & near & (gap <= 2 * edits)).select("r_h1", "r_h2", "s_h1", "s_h2")
    one_way = F.struct("r_h1", "r_h2") < F.struct("s_h1", "s_h2")
    pairs = pairs.select(*[F.when(one_way, F.col(x)).otherwise(F.col(y)).alias(n) for n, x, y in (("a1", "r_h1", "s_h1"), ("a2", "r_h2", "s_h2"), ("b1", "s_h1", "r_h1"), ("b2", "s_h2", "r_h2"))]).distinct()
    a = line.select(F.col("h1").alias("a1"), F.col("h2").alias("a2"), F.col("line").alias("a_line"), F.col("n").alias("a_n"))
    b = line.select(F.col("h1").alias("b1"), F.col("h2").alias("b2"), F.col("line").alias("b_line"), F.col("n").alias("b_n"))
    both = pairs.join(a, ["a1", "a2"]).join(b, ["b1", "b2"])
    swap = F.col("a_n") < F.col("b_n")
    distance = far(F.when(swap, F.col("b_line")).otherwise(F.col("a_line")), F.when(swap, F.col("a_line")).otherwise(F.col("b_line")))
    return both.withColumn("distance", distance).where(F.col("distance") <= edits).select("a1", "a2", "b1", "b2", "distance")


#: Lines that share a key up to which they are compared pair by pair; beyond, the key is drawn finer.
HEAVY = 32
CHARS, WORDS = 0, 1


def _prefix(kind: int, line: Column, n: Column, k: Column) -> Column:
    return F.substring(line, F.lit(1), k) if kind == CHARS else F.call_function("substring_index", line, F.lit(" "), k)


def _suffix(kind: int, line: Column, n: Column, k: Column) -> Column:
    return F.substring(line, n - k + 1, k) if kind == CHARS else F.call_function("substring_index", line, F.lit(" "), -k)


def _tokens(kind: int, line: Column) -> Column:
    return F.filter(F.split(line, ""), lambda c: c != "") if kind == CHARS else _words(line)


def _open(kind: int, line: Column, n: Column, length: Column, low: Column, high: Column) -> Column:
    """The key of a line of n tokens as one of, or one token longer than, lines of ``length`` tokens that are equal but
    for the tokens from low to high (exclusive): what stands before and what stands behind these."""
    return F.xxhash64(F.lit(kind), length, low, high, _prefix(kind, line, n, low), _suffix(kind, line, n, length - high))


def _halves(ranges: list[tuple[Column, Column]]) -> list[tuple[Column, Column]]:
    """Each range of tokens that may hold the edit, cut into two."""
    out = []
    for low, high in ranges:
        middle = (low + F.floor((high - low) / 2)).cast("int")
        out += [(middle, high), (low, middle)]
    return out


def _range_keys(kind: int, line: Column, n: Column, least: int, cuts: int) -> Column:
    """array<struct<kind, length, low, high, key>> of a line of n tokens after so many cuts, for its own length and the one below."""
    made = []
    for shorter in (0, 1):
        length = n - shorter
        ranges = [(F.lit(0), length)]
        for _ in range(cuts):
            ranges = _halves(ranges)
        for low, high in ranges:
            entry = F.struct(F.lit(kind).alias("kind"), length.alias("length"), low.alias("low"), high.alias("high"), _open(kind, line, n, length, low, high).alias("key"))
            made.append(F.when(length >= least, entry) if shorter else entry)
    return F.array(*made)


def _half_keys(kind: int, line: Column, n: Column) -> Column:
    """array<long>: the keys of a line of n tokens by its beginning and by its end, for its own length and the one below."""
    made = []
    for length in (n, n - 1):
        half = F.floor(length / 2).cast("int")
        made.append(F.xxhash64(F.lit(2 * kind), length, _prefix(kind, line, n, half)))
        made.append(F.xxhash64(F.lit(2 * kind + 1), length, _suffix(kind, line, n, length - half)))
    return F.array(*made)


def _opened(lines: DataFrame, least: int, words: int | None, cuts: int) -> DataFrame:
    """(h1, h2, kind, length, low, high, key, tokens) of lines (h1, h2, line, n, w): by characters the lines of up to
    ``words`` words, or all, and by words those of as many or more."""
    line, n, w = F.col("line"), F.col("n"), F.col("w")
    none = F.array().cast("array<struct<kind:int,length:int,low:int,high:int,key:bigint>>")
    made = _range_keys(CHARS, line, n, least, cuts)
    if words:
        made = F.concat(F.when(w <= words, made).otherwise(none), F.when(w >= words, _range_keys(WORDS, line, w, words, cuts)).otherwise(none))
    keys = lines.select("h1", "h2", n.alias("chars"), w.alias("words"), F.explode(made).alias("k")).where("k is not null").select("h1", "h2", "chars", "words", "k.*")
    return keys.select("h1", "h2", "kind", "length", "low", "high", "key", F.when(F.col("kind") == CHARS, F.col("chars")).otherwise(F.col("words")).alias("tokens"))


def _at(line: DataFrame, side: str) -> DataFrame:
    return line.select(F.col("h1").alias(f"{side}1"), F.col("h2").alias(f"{side}2"), F.col("line").alias(f"{side}_line"), F.col("n").alias(f"{side}_n"), F.col("w").alias(f"{side}_w"))


def _ordered(pairs: DataFrame, x: str, y: str) -> DataFrame:
    """(a1, a2, b1, b2) of two lines, the smaller pair of hashes first."""
    one_way = F.struct(f"{x}1", f"{x}2") < F.struct(f"{y}1", f"{y}2")
    return pairs.select(*[F.when(one_way, F.col(f"{p}{i}")).otherwise(F.col(f"{q}{i}")).alias(f"{n}{i}") for n, p, q in (("a", x, y), ("b", y, x)) for i in (1, 2)])


def near_lines(each: DataFrame, least: int, words: int | None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Links of lines one edit apart: of a character, or with ``words`` also of a word if both lines have so many words.

    each: h1, h2, line, n (characters). Returns (pairs a1, a2, b1, b2; edges a1, a2, b1, b2; counts h1, h2, links). Pairs
    are links, each once. Edges join each line to the first of a group in which all are linked, and counts has the
    number of its links there, so groups of any size stay linear. No link is in both.

    A line is cut into threshold-plus-one segments, here halves: of two lines one edit apart, one half of the shorter
    stands unchanged at the other's beginning or end. Keys are made of the text before and behind the open half and
    of the length probed, so lines of equal or next length meet. Keys of one line alone go first: an aggregation, which
    gathers copies before it shuffles, and a join with the keys left; neither moves text. The lines left are fetched
    once, and their open halves are halved again. Lines that share such a key are compared if they are up to HEAVY, and the
    bit-parallel distance of what is open decides. Larger groups have their open range halved until they are small, or the
    range is one token: then all of the key's length differ in that token and are linked, and a line one token longer is
    linked to those whose token it holds. Where ``words`` is given, an edit of a character in lines of so many words or more changes one word of
    the one that has fewer, so it is found by words as well; those of just as many words go both ways.
    """
    each = each.withColumn("w", F.char_length("line") - F.char_length(F.replace("line", F.lit(" "), F.lit(""))) + 1)
    halves = _half_keys(CHARS, F.col("line"), F.col("n"))
    if words:
        by_words = _half_keys(WORDS, F.col("line"), F.col("w"))
        halves = F.when(F.col("w") < words, halves).when(F.col("w") > words, by_words).otherwise(F.concat(halves, by_words))
    # Plain numbers here: structs in the arrays of all lines would take twice the time.
    keys = each.select("h1", "h2", F.explode(halves).alias("key"))
    shared = keys.groupBy("key").agg(F.min("h1").alias("low"), F.max("h1").alias("high")).where("low < high").select("key")
    live = written(keys.join(shared, "key", "left_semi").select("h1", "h2").distinct(), "line-keys")
    # Merged at any size: the lines are the whole corpus, and live grows with it, so one plan should hold throughout.
    line = each.select("h1", "h2", "line", "n", "w").join(live.hint("merge"), ["h1", "h2"], "left_semi").groupBy("h1", "h2").agg(*[F.first(c).alias(c) for c in ("line", "n", "w")])
    line = written(line, "lines")
    rows = _opened(line, least, words, 2)
    near, cliques = [], []
    place = ["kind", "length", "low", "high"]
    while True:
        sizes = rows.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.max(F.col("tokens") == F.col("length")).alias("any")).where("size > 1 and any").select("key", "size")
        rows = written(rows.join(sizes, "key"), "line-ranges")
        few = rows.where((F.col("size") <= HEAVY) & (F.col("high") > F.col("low") + 1))
        r = few.where("tokens = length").select("key", *place, F.col("h1").alias("r1"), F.col("h2").alias("r2"))
        s = few.select("key", (F.col("tokens") == F.col("length")).alias("own"), F.col("tokens").alias("s_tokens"), F.col("h1").alias("s1"), F.col("h2").alias("s2"))
        near.append(r.join(s, "key").where(~F.col("own") | (F.struct("r1", "r2") < F.struct("s1", "s2"))).select("r1", "r2", "s1", "s2", F.struct(*place, "s_tokens").alias("at")))
        heavy = rows.where((F.col("size") > HEAVY) | (F.col("high") <= F.col("low") + 1))
        if heavy.isEmpty():
            break
        cliques.append(heavy.where("high <= low + 1"))
        wide = heavy.where("high > low + 1").join(line, ["h1", "h2"])
        cut = (F.col("low") + F.floor((F.col("high") - F.col("low")) / 2)).cast("int")
        wide = wide.withColumn("range", F.explode(F.array(F.struct(cut.alias("low"), F.col("high").alias("high")), F.struct(F.col("low").alias("low"), cut.alias("high")))))
        at = [F.col("line"), F.col("tokens"), F.col("length"), F.col("range.low"), F.col("range.high")]
        key = F.when(F.col("kind") == CHARS, _open(CHARS, *at)).otherwise(_open(WORDS, *at))
        rows = wide.select("h1", "h2", "kind", "length", F.col("range.low").alias("low"), F.col("range.high").alias("high"), key.alias("key"), "tokens")
    # What stands before and behind the open tokens is equal, so only these are compared; any range that two lines share will do.
    found = functools.reduce(DataFrame.union, near).groupBy("r1", "r2", "s1", "s2", "at.kind").agg(F.min("at").alias("at"))
    both = found.join(_at(line, "r"), ["r1", "r2"]).join(_at(line, "s"), ["s1", "s2"])
    both = both.select("kind", "r1", "r2", "s1", "s2", "r_w", "s_w", _middle("r_line", F.col("at.length")).alias("r"), _middle("s_line", F.col("at.s_tokens")).alias("s"))
    r_size, s_size = F.char_length("r"), F.char_length("s")
    swap = r_size < s_size
    linked = (F.abs(r_size - s_size) <= 1) & (F.least(r_size, s_size) > 1) & (banded_distance(F.when(swap, F.col("s")).otherwise(F.col("r")), F.when(swap, F.col("r")).otherwise(F.col("s")), 1) <= 1)
    if words:
        # s has as many words as r, or one more.
        linked = F.when(F.col("kind") == WORDS, (array_distance(_words(F.col("s")), _words(F.col("r")), 1) <= 1) | ((F.col("r_w") < F.col("s_w")) & linked)).otherwise(linked & ((F.col("r_w") < words) | (F.col("s_w") < words)))
    pairs = _ordered(both.where(linked), "r", "s")
    if not cliques:
        none = pairs.limit(0)
        return pairs.distinct(), none, none.select(F.col("a1").alias("h1"), F.col("a2").alias("h2"), F.lit(0).cast("long").alias("links"))
    more, edges, counts = _dense(functools.reduce(DataFrame.union, cliques), line, words)
    return pairs.union(more).distinct(), edges, counts


def _middle(line: str, tokens: Column) -> Column:
    """The open tokens of a line of so many, for which ``at`` has the range in lines of its length."""
    low, size = F.col("at.low"), tokens - F.col("at.length") + F.col("at.high") - F.col("at.low")
    words = F.call_function("substring_index", F.call_function("substring_index", F.col(line), F.lit(" "), low + size), F.lit(" "), -size)
    return F.when(F.col("at.kind") == CHARS, F.substring(F.col(line), low + 1, size)).otherwise(words)


def _dense(cliques: DataFrame, line: DataFrame, words: int | None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The links of keys with one open token, as near_lines returns them."""
    rows = cliques.join(line, ["h1", "h2"])
    gap = lambda kind: F.slice(_tokens(kind, F.col("line")), F.col("low") + 1, F.col("tokens") - F.col("length") + 1)
    rows = rows.select("key", "kind", "h1", "h2", "w", (F.col("tokens") == F.col("length")).alias("own"), F.when(F.col("kind") == CHARS, gap(CHARS)).otherwise(gap(WORDS)).alias("gap"))
    rows = written(rows, "line-cliques")
    own = rows.where("own")
    # By characters, two lines of just so many words are left to the comparison by words.
    both_ways = (F.col("kind") == CHARS) & (F.col("w") >= (words or 1 << 30))
    groups = own.groupBy("key").agg(F.min(F.struct("h1", "h2")).alias("head"), F.count(F.lit(1)).alias("size"), F.count_if(both_ways).alias("twice"))
    met = own.join(groups, "key").where("size > 1")
    edges = _ordered(met.select(F.col("h1").alias("r1"), F.col("h2").alias("r2"), F.col("head.h1").alias("s1"), F.col("head.h2").alias("s2")).where("r1 <> s1 or r2 <> s2"), "r", "s")
    counts = met.groupBy("h1", "h2").agg(F.sum(F.when(both_ways, F.col("size") - F.col("twice")).otherwise(F.col("size") - 1)).alias("links"))
    t = own.select("key", "kind", both_ways.alias("r_both"), F.col("h1").alias("r1"), F.col("h2").alias("r2"), F.get("gap", F.lit(0)).alias("token"), F.char_length(F.get("gap", F.lit(0))).alias("size"))
    s = rows.where("not own").select("key", both_ways.alias("s_both"), F.col("h1").alias("s1"), F.col("h2").alias("s2"), F.get("gap", F.lit(0)).alias("x"), F.get("gap", F.lit(1)).alias("y"), "kind")
    held = F.array_distinct(F.when(F.col("kind") == CHARS, F.array("x", "y")).otherwise(F.array("x", "y", F.concat("x", "y"))))
    put = t.join(s.select("key", "s_both", "s1", "s2", F.explode(held).alias("token")), ["key", "token"]).where("not (r_both and s_both)")
    # A space that another character took the place of.
    by_words = s.where(F.col("kind") == WORDS).select("key", "s1", "s2", "x", "y", (F.char_length("x") + F.char_length("y") + 1).alias("size"))
    changed = t.join(by_words, ["key", "size"]).where(F.startswith("token", "x") & F.endswith("token", "y"))
    return _ordered(put, "r", "s").union(_ordered(changed, "r", "s")).distinct(), edges, counts


def _name(h1: str, h2: str) -> Column:
    return F.concat(F.lpad(F.hex(h1), 16, "0"), F.lpad(F.hex(h2), 16, "0"))


def line_classes(docs: DataFrame, edits: int = EDITS, least: int = MIN_CHARS, id_col: str = "doc_id", text_col: str = "text", exact: int = 1, words: int | None = MIN_WORDS) -> DataFrame:
    """(h1, h2, first_id, first_whole, first_pos, links): of each line that has a copy or a link, its class's first occurrence.

    A class is what links of lines connect, equal lines being one; links counts a line's links to different lines.
    """
    pair = ["a1", "a2", "b1", "b2"]
    if edits == 1:
        each = _lines(docs.select(F.lit(0).alias("id"), text_col), "id", text_col, least)
        found, more, counted = near_lines(each, least, words)
    else:
        found = line_links(docs, edits, least, text_col).select(pair)
        if words:
            found = found.union(word_links(docs, words, least, text_col).select(pair)).distinct()
        more, counted = None, None
    found = written(found, "line-links")
    edges = found.union(more) if more is not None else found
    joined = components(edges.select(_name("a1", "a2").alias("a"), _name("b1", "b2").alias("b")), "line-classes")
    each_end = found.select(F.col("a1").alias("h1"), F.col("a2").alias("h2")).union(found.select("b1", "b2")).withColumn("links", F.lit(1).cast("long"))
    degree = (each_end.union(counted) if counted is not None else each_end).groupBy("h1", "h2").agg(F.sum("links").alias("links"))
    seen = _lines(docs, id_col, text_col, min(exact, least)).groupBy("h1", "h2").agg(F.min(F.struct("id", "whole", "pos")).alias("first"), F.count(F.lit(1)).alias("n"))
    seen = seen.join(degree, ["h1", "h2"], "left").where("n > 1 or links is not null").withColumn("name", _name("h1", "h2"))
    # A line whose only fellows are linked to it otherwise has no links of its own, but a class.
    linked = seen.join(joined.withColumnRenamed("node", "name"), "name", "left")
    linked = linked.withColumn("component", F.coalesce("component", "name"))
    heads = linked.groupBy("component").agg(F.min("first").alias("head"))
    linked = linked.join(heads, "component")
    return linked.select("h1", "h2", F.col("head.id").alias("first_id"), F.col("head.whole").alias("first_whole"), F.col("head.pos").alias("first_pos"), F.coalesce("links", F.lit(0).cast("long")).alias("links"))


def repeated_lines(docs: DataFrame, edits: int = EDITS, least: int = MIN_CHARS, id_col: str = "doc_id", text_col: str = "text", exact: int = 1, words: int | None = MIN_WORDS) -> DataFrame:
    """(id, whole, removed, links) of each document that has any: positions of lines that repeat an earlier one, and links."""
    classes = settled(lambda: line_classes(docs, edits, least, id_col, text_col, exact, words), "line-firsts")
    seen = _lines(docs, id_col, text_col, min(exact, least)).select("id", "whole", "pos", "h1", "h2")
    met = seen.join(classes, ["h1", "h2"])
    again = ~(F.col("id").eqNullSafe(F.col("first_id")) & (F.col("whole") == F.col("first_whole")) & (F.col("pos") == F.col("first_pos")))
    return met.groupBy("id", "whole").agg(F.sort_array(F.collect_set(F.when(again, F.col("pos")))).alias("removed"), F.sum("links").alias("links"))


def line_report(docs: DataFrame, edits: int = EDITS, least: int = MIN_CHARS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: id, n_lines, n_removed, removed (line numbers from 0), links.

    Lines end at U+000A. Lines of at least ``least`` characters are compared; two are linked if at most ``edits``
    insertions, deletions or substitutions of characters apart, or if both have MIN_WORDS words or more and one word is
    put in, left out or replaced. Of each class of linked or equal lines the first (by
    id, then place) stays and the others are removed. links counts, over the document's lines, links to different
    lines. Shorter lines that are not blank are told apart exactly. Null text: no lines; empty text: one empty line. Null ids come first in
    order. Rows of equal id and text are one document in the order, so an exact repetition of a row loses nothing more;
    rows that share an id, or have none, but differ in text are documents of their own.
    """
    found = repeated_lines(docs, edits, least, id_col, text_col)
    rows = docs.select(F.col(id_col).alias("doc"), F.xxhash64(text_col).alias("text_hash"), F.coalesce(F.size(F.split(F.col(text_col), "\n")), F.lit(0)).alias("n"))
    n_lines = F.greatest(F.col("n"), F.lit(0)).cast("long")
    met = rows.join(found, rows["doc"].eqNullSafe(found["id"]) & (rows["text_hash"] == found["whole"]), "left")
    removed = F.coalesce("removed", F.array().cast("array<int>"))
    return met.select(F.col("doc").alias(id_col), n_lines.alias("n_lines"), F.size(removed).cast("long").alias("n_removed"), removed.alias("removed"), F.coalesce("links", F.lit(0).cast("long")).alias("links"))


def without_repeated_lines(docs: DataFrame, edits: int = EDITS, least: int = MIN_CHARS, id_col: str = "doc_id", text_col: str = "text", exact: int = 1, words: int | None = MIN_WORDS) -> DataFrame:
    """docs with the repeated lines of line_report taken out of the text; documents of which nothing is left go.

    Lines of fewer than ``exact`` characters, by default only blank ones, are left alone. Lines of which a word is
    changed are linked if ``words`` tells from how many words on.
    """
    found = repeated_lines(docs, edits, least, id_col, text_col, exact, words).where(F.size("removed") > 0).select(F.col("id").alias("__id"), F.col("whole").alias("__whole"), F.col("removed").alias("__removed"))
    met = docs.join(found, docs[id_col].eqNullSafe(found["__id"]) & (F.xxhash64(docs[text_col]) == found["__whole"]), "left")
    kept = F.array_join(F.filter(F.split(F.col(text_col), "\n"), lambda line, i: ~F.array_contains("__removed", i)), "\n")
    text = F.when(F.col("__removed").isNull(), F.col(text_col)).otherwise(kept)
    out = met.select(*[text.alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns], F.col("__removed").isNotNull().alias("__cut"))
    return out.where(~F.col("__cut") | (F.length(F.col(text_col)) > 0)).drop("__cut")


def op1_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_report(documents(spark, sf_dir).select("doc_id", "text"))
