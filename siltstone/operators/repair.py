"""Broken words mended by a word table of any size: candidates of all texts meet the table in a join, then texts are put back."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Collection, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as D

from siltstone.operators.lookup import looked_up, met, replaced
from siltstone.sources.shared import written

# Words that are never the first piece of a broken word.
NEVER_FIRST = [
    "a", "i", "an", "the", "in", "on", "at", "by", "to", "of", "for", "with", "from", "up", "down",
    "he", "she", "it", "we", "they", "his", "her", "its", "our", "their",
    "is", "are", "was", "were", "be", "been", "has", "have", "had", "do", "does", "did",
    "but", "and", "or", "so", "if", "as", "that", "this", "these", "those",
    "who", "whom", "which", "what", "why", "how",
]
# Prefixes that stand before a known word.
PREFIXES = [
    "neuro", "opto", "pre", "post", "synap", "hyper", "hypo", "retro", "intra", "inter", "extra", "multi",
    "micro", "macro", "bio", "patho", "psycho", "electro", "chemo", "auto", "somato", "vaso", "photo", "mono", "poly",
]
# Endings of inflected forms, those before which a final y becomes i, and signs around a word.
ENDINGS = ["ing", "ed", "s", "es", "er", "est", "ly", "able", "ible", "al", "ive", "tion", "ment", "ty"]
Y_ENDINGS = ["ed", "es", "er", "est", "ly", "able", "al"]
SIGNS = ".,;:()[]\"'"
#: Times that neighbours are looked at, so that up to so many breaks in a word are mended.
PASSES = 3

_SPACE = "[\\s\\x1c-\\x1f\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]"
_PIECE = r"(?<![\p{L}\p{N}_])[a-zA-Z]{2,}", r"[a-zA-Z]{2,}(?![\p{L}\p{N}_])"
#: What stands between two pieces, and whether two known words of four letters keep their hyphen there.
GAPS = [(f"-{_SPACE}*\\n{_SPACE}*", False), (f"{_SPACE}+-{_SPACE}*", True), (f"{_SPACE}*-{_SPACE}+", True)]


def word_table(words: DataFrame | Collection[str], like: DataFrame) -> DataFrame:
    """A table of words (in lower case) as it is, or one made of a small collection."""
    return words.select("word") if isinstance(words, DataFrame) else like.sparkSession.createDataFrame([(w,) for w in words], "word string")


def forms(word: Column) -> Column:
    """Words that a word may be an inflected form of, itself first."""
    out = [word]
    for ending in ENDINGS:
        stem = F.substring(word, F.lit(1), F.char_length(word) - len(ending))
        has = word.endswith(ending) & (F.char_length(word) > len(ending))
        double = (F.char_length(stem) > 2) & (F.right(stem, F.lit(1)) == F.substring(stem, F.char_length(stem) - 1, F.lit(1)))
        shorter = F.substring(stem, F.lit(1), F.char_length(stem) - 1)
        out += [F.when(has, stem), F.when(has, F.concat(stem, F.lit("e"))), F.when(has & double, shorter)]
        if ending in Y_ENDINGS:
            out.append(F.when(has & stem.endswith("i"), F.concat(shorter, F.lit("y"))))
    return F.array_distinct(F.array_compact(F.array(*out)))


def judged(rows: DataFrame, asked: Column, words: DataFrame, out: str) -> DataFrame:
    """rows with ``out``, a map from those words of the array asked that are known: to 2 if they stand in words, to 1 if only as an
    inflected form. Each different word is asked once, with its forms."""
    rows = written(rows.withColumn("__asks", asked), "asking")
    each = rows.select(F.explode("__asks").alias("whole")).distinct()
    tries = each.select("whole", F.posexplode(forms(F.col("whole"))).alias("turn", "word"))
    found = met(tries, words.select("word").distinct()).groupBy("whole").agg(F.when(F.min("turn") == 0, 2).otherwise(1).alias("value"))
    return looked_up(rows, F.col("__asks"), found.select(F.col("whole").alias("word"), "value"), out, stored=True).drop("__asks")


def _in_case(first: Column, whole: Column) -> Column:
    """The whole, in lower case, in capitals, capitalised or small as its first piece is."""
    head = F.left(first, F.lit(1))
    is_upper = lambda c: (F.upper(c) == c) & (F.lower(c) != c)
    return F.when(is_upper(first), F.upper(whole)).when(is_upper(head), F.concat(F.upper(F.left(whole, F.lit(1))), F.substring(whole, F.lit(2), F.char_length(whole)))).otherwise(whole)


def _pieces(match: Column) -> tuple[Column, Column]:
    return F.regexp_extract(match, "^([a-zA-Z]+)", 1), F.regexp_extract(match, "([a-zA-Z]+)$", 1)


def without_breaks(docs: DataFrame, words: DataFrame | Collection[str], text: str = "text") -> DataFrame:
    """docs with words of ASCII letters mended that a hyphen breaks, two letters at least in each piece.

    Broken over lines, or with space at either side of the hyphen, pieces become one word if that is known, itself or as an inflected form,
    and else stay joined by a bare hyphen, as do two known words of four letters or more on one line. Null texts are empty.

    Gap by gap, what a sieve of the words takes for known is collected from all texts, and a join with the table tells where it is wrong, so
    that a task which holds the sieve and its errors knows what the table does. If they are more than MOST_ERRORS, each text is
    given the words that it asks for.
    """
    known = word_table(words, docs).where("word is not null").distinct()
    d = docs.withColumn(text, F.coalesce(F.col(text), F.lit("")))
    held, errors = sieve(known), []
    for _ in GAPS:
        taken = d.select(text).mapInArrow(_taken(held, list(errors)), "word string").distinct()
        wrong = taken.join(known, "word", "left_anti").limit(MOST_ERRORS + 1).toArrow()
        if wrong.num_rows > MOST_ERRORS:
            for gap, keeps in GAPS:
                d = _over_gap(d, known, text, _PIECE[0] + gap + _PIECE[1], keeps)
            return d
        errors.append(docs.sparkSession.sparkContext.broadcast(frozenset(wrong.column(0).to_pylist())))
    return d.withColumn(text, _unbroken(held, errors)(F.col(text)))


#: Errors of a sieve that a task holds at most.
MOST_ERRORS = 1_000_000
#: GAPS in plain Python, whose white space is _SPACE; a piece never gives back letters, as no gap and no edge of a word begins with one.
_BREAKS = [(re.compile(rf"(?<!\w)([a-zA-Z]{{2,}}+){gap}([a-zA-Z]{{2,}}+)(?!\w)"), keeps) for gap, keeps in ((r"-\s*\n\s*", False), (r"\s+-\s*", True), (r"\s*-\s+", True))]


def _mending(pattern: re.Pattern, keeps: bool, held: Broadcast, errors: Broadcast) -> Callable[[str], str]:
    """Of a text, with the breaks of one gap mended by a sieve and its errors."""
    (mask, bits), wrong = held.value, errors.value
    answers: dict[tuple[str, str], str] = {}

    def known(word: str) -> bool:
        at = zlib.crc32(word.encode()) & mask
        return bool(bits[at >> 3] >> (at & 7) & 1) and word not in wrong

    def mend(m: re.Match) -> str:
        first, second = m.groups()
        got = answers.get((first, second))
        if got is None:
            if len(answers) >= REMEMBERED:
                answers.clear()
            whole = (first + second).lower()
            compound = keeps and len(first) > 3 and len(second) > 3 and known(first.lower()) and known(second.lower())
            got = _cased(first, whole) if not compound and any(map(known, _plain_forms(whole))) else f"{first}-{second}"
            answers[first, second] = got
        return got

    return lambda text: pattern.sub(mend, text)


def _taken(held: Broadcast, errors: list[Broadcast]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Different words that a sieve takes for known, of those that have to be known at the gap behind those whose errors are told."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = [_mending(*gap, held, wrong) for gap, wrong in zip(_BREAKS, errors)]
        pattern, keeps = _BREAKS[len(errors)]
        mask, bits = held.value
        seen: set[tuple[str, str]] = set()

        def words() -> pa.RecordBatch:
            asked = {f for a, b in seen for f in _plain_forms(a + b)}
            if keeps:
                asked.update(w for pair in seen for w in pair if len(w) > 3)
            at = ((w, zlib.crc32(w.encode()) & mask) for w in asked)
            out = [w for w, k in at if bits[k >> 3] >> (k & 7) & 1]
            seen.clear()
            return pa.record_batch([pa.array(out, pa.string())], ["word"])

        for batch in batches:
            for text in batch.column(0).to_pylist():
                for mend in before:
                    text = mend(text)
                seen.update((a.lower(), b.lower()) for a, b in pattern.findall(text))
                if len(seen) > REMEMBERED:
                    yield words()
        yield words()

    return of


def _unbroken(held: Broadcast, errors: list[Broadcast]) -> Callable[[Column], Column]:
    @F.pandas_udf(D.StringType())
    def of(text: pd.Series) -> pd.Series:
        each = [_mending(*gap, held, wrong) for gap, wrong in zip(_BREAKS, errors)]

        def one(t: str) -> str:
            for mend in each:
                t = mend(t)
            return t

        return text.map(one)

    return of


def _over_gap(d: DataFrame, known: DataFrame, text: str, pattern: str, keeps: bool) -> DataFrame:
    def asks(m: Column) -> Column:
        first, second = (F.lower(x) for x in _pieces(m))
        return F.array(F.concat(first, second), *([first, second] if keeps else []))

    def mend(m: Column) -> Column:
        first, second = _pieces(m)
        value = lambda x: F.try_element_at("__judged", F.lower(x))
        apart, whole = F.concat(first, F.lit("-"), second), F.concat(first, second)
        long = lambda x: (F.char_length(x) > 3) & F.coalesce(value(x) == 2, F.lit(False))
        compound = long(first) & long(second) if keeps else F.lit(False)
        return F.when(compound | value(whole).isNull(), apart).otherwise(_in_case(first, F.lower(whole)))

    asked = F.flatten(F.transform(F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0)), asks))
    return judged(d, asked, known, "__judged").withColumn(text, replaced(F.col(text), pattern, mend)).drop("__judged")


#: A sieve has so many bits a word, and so many at most (16 MB), as a power of two.
SIEVE_BITS, SIEVE_MOST = 32, 27


def sieve(words: DataFrame) -> Broadcast:
    """(mask, bits): a bit set for each remainder of the words' CRC-32, by which most words that are not in the table are told from it.

    Which of the others are known is for a join with the table to say, so its size bounds what has to be asked and not what is right.
    """
    n = words.count()
    size = 1 << min(SIEVE_MOST, max(10, (SIEVE_BITS * n).bit_length()))
    at = words.where("word is not null").select(F.pmod(F.crc32(F.col("word").cast("binary")), F.lit(size)).alias("at"))
    set_ = at.groupBy(F.floor(F.col("at") / 64).alias("place")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at % 64 as int))")).alias("bits")).toArrow()
    bits = np.zeros(size // 64, dtype="<i8")
    bits[set_.column(0).to_numpy()] = set_.column(1).to_numpy()
    return words.sparkSession.sparkContext.broadcast((size - 1, bits.tobytes()))


def _plain_forms(word: str) -> Iterator[str]:
    """forms() of a word in plain Python."""
    yield word
    if not word.endswith(_ENDINGS):
        return
    for ending in ENDINGS:
        if word.endswith(ending) and len(word) > len(ending):
            stem = word[: -len(ending)]
            yield stem
            yield stem + "e"
            if len(stem) > 2 and stem[-1] == stem[-2]:
                yield stem[:-1]
            if ending in Y_ENDINGS and stem.endswith("i"):
                yield stem[:-1] + "y"


_ENDINGS, _NEVER, _BEFORE = tuple(ENDINGS), frozenset(NEVER_FIRST), frozenset(PREFIXES)
#: Words that a task remembers at most.
REMEMBERED = 1 << 18


class _Pieces(dict):
    """Of words, remembered: their letters in lower case, without the signs around them, as a first piece, as a second one, and alone;
    empty if a word may not be such a piece, as only letters may, and as a first one neither a single capital nor what is in NEVER_FIRST."""

    def __missing__(self, word: str) -> tuple[str, str, str]:
        if len(self) >= REMEMBERED:
            self.clear()
        core = word.strip(SIGNS)
        if core.isalpha():
            single = len(core) == 1 and core.upper() == core and core.lower() != core
            # A letter before or behind, as the small form of a sigma depends on it.
            got = "" if single or core.lower() in _NEVER else (core + "a").lower()[:-1], ("a" + core).lower()[1:], core.lower()
        else:
            got = "", "", ""
        self[word] = got
        return got


def _likely(held: Broadcast) -> Callable[[str, str, str], list[str]]:
    """What has to be known for two neighbours to be joined, the whole or what stands behind a prefix, and may be by a sieve, itself or
    as an inflected form."""
    mask, bits = held.value

    def may(word: str) -> bool:
        at = zlib.crc32(word.encode()) & mask
        if bits[at >> 3] >> (at & 7) & 1:
            return True
        if word.endswith(_ENDINGS):
            for form in _plain_forms(word):
                at = zlib.crc32(form.encode()) & mask
                if bits[at >> 3] >> (at & 7) & 1:
                    return True
        return False

    def asked(first: str, second: str, alone: str) -> list[str]:
        whole = first + second
        out = [whole] if may(whole) else []
        if first in _BEFORE and may(alone):
            out.append(alone)
        return out

    return asked


def _looked(lines: list[str], places) -> Iterator[tuple[int, set[int] | None]]:
    """Numbers of the lines that are looked at, and the first words of the neighbours there (None: all), of places: a line's number times
    2**31 and a word's in it, with both of whose neighbours it is looked at."""
    if places is None:
        yield from ((i, None) for i in range(len(lines)))
        return
    at: dict[int, set[int]] = {}
    for place in map(int, places):
        at.setdefault(place >> 31, set()).update(((place & 0x7FFFFFFF) - 1, place & 0x7FFFFFFF))
    yield from at.items()


def _asked(held: Broadcast) -> Callable[[Column, Column], Column]:
    """Of a text and the places of its words that are looked at (null: all), the words that have to be known of neighbours there and may be."""

    @F.pandas_udf(D.ArrayType(D.StringType()))
    def of(text: pd.Series, lines: pd.Series) -> pd.Series:
        asked, pieces = _likely(held), _Pieces()

        def one(t: str | None, some) -> list[str]:
            each = (t or "").split("\n")
            out: set[str] = set()
            for i, at in _looked(each, some):
                got = [pieces[w] for w in each[i].split()]
                for (first, _, _), (_, second, alone) in zip(got, got[1:]) if at is None else ((got[k], got[k + 1]) for k in at if 0 <= k < len(got) - 1):
                    if first and second:
                        out.update(asked(first, second, alone))
            return list(out)

        return pd.Series([one(t, some) for t, some in zip(text, lines)], dtype=object)

    return of


def _cased(first: str, whole: str) -> str:
    """_in_case() in plain Python."""
    is_upper = lambda c: c.upper() == c and c.lower() != c
    return whole.upper() if is_upper(first) else whole[:1].upper() + whole[1:] if is_upper(first[:1]) else whole


def _joined(words: list[str], known: Collection[str], pieces: _Pieces, looked: set[int] | None = None) -> tuple[list[str], list[int]]:
    """One pass over a line from the left: neighbours that belong together are one word, whose second piece is used up. Also the places of
    such words. looked has the first words of those neighbours that are looked at."""
    got = [pieces[w] for w in words]
    at = [i for i, ((a, _, _), (_, b, alone)) in enumerate(zip(got, got[1:])) if a and b and (a + b in known or a in _BEFORE and alone in known)]
    out, made, i = [], [], 0
    for hit in at:
        if hit >= i and (looked is None or hit in looked):
            a, b = words[hit].strip(SIGNS), words[hit + 1].strip(SIGNS)
            out += [*words[i:hit], words[hit].replace(a, _cased(a, (a + b).lower())) + words[hit + 1].replace(b, "")]
            made.append(len(out) - 1)
            i = hit + 2
    return out + words[i:], made


@F.pandas_udf(D.StructType([D.StructField("text", D.StringType()), D.StructField("open", D.ArrayType(D.LongType()))]))
def _rejoined(text: pd.Series, known: pd.Series, lines: pd.Series) -> pd.DataFrame:
    """One pass: the text with neighbours joined that belong together, and the places of the words made so. All other
    neighbours stood side by side before, so that no later pass has to look at them."""
    out, pieces = [], _Pieces()
    for t, some, places in zip(text, known, lines):
        if t is None:
            out.append((None, []))
            continue
        each, some, changed = t.split("\n"), frozenset(some), []
        for i, at in _looked(each, places):
            words = each[i].split()
            if len(words) > 1:
                made, new = _joined(words, some, pieces, at) if some else (words, [])
                each[i] = " ".join(made)
                changed += [i << 31 | k for k in new]
        out.append(("\n".join(each), changed))
    return pd.DataFrame(out, columns=["text", "open"])


def joined_words(docs: DataFrame, words: DataFrame | Collection[str], text: str = "text", passes: int = PASSES) -> DataFrame:
    """docs with words mended that a space breaks, line by line, in up to ``passes`` passes.

    Two neighbours are joined if, without the signs around them, both are letters only, the first is neither a single
    capital nor in NEVER_FIRST, and the whole is known, itself or as an inflected form, or the first is in PREFIXES and
    the second known. Signs stay. Lines of two words or more have single spaces afterwards. Null texts are empty. Only what
    passes a sieve of the words meets them in a join, and a later pass looks at the words that the one before made.
    """
    known = word_table(words, docs)
    asked = _asked(sieve(known))
    d = docs.withColumns({text: F.coalesce(F.col(text), F.lit("")), "__open": F.lit(None).cast("array<long>")})
    for i in range(passes):
        # Rows that are not looked at again are handed to Python as nulls.
        looked = F.col("__open").isNull() | (F.size("__open") > 0)
        d = judged(d, asked(F.when(looked, F.col(text)), F.when(looked, F.col("__open")).otherwise(F.array().cast("array<long>"))), known, "__judged")
        needed = F.lit(True) if i == 0 else F.size("__judged") > 0
        made = _rejoined(F.when(needed, F.col(text)), F.map_keys("__judged"), F.col("__open"))
        d = d.withColumn("__made", made).withColumns({text: F.coalesce("__made.text", text), "__open": F.col("__made.open")}).drop("__made", "__judged")
    return d.drop("__open")


def joinable(docs: DataFrame, words: DataFrame | Collection[str], text: str = "text") -> DataFrame:
    """(first, second, n): neighbours in lines, without the signs around them, that joined_words would join in its first pass if no other
    pair came in between, and how often they stand so. Pairs that pass a sieve of the words are counted before they meet them."""
    known = word_table(words, docs).distinct()
    held = sieve(known)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, pieces = _likely(held), _Pieces()
        for batch in batches:
            found: Counter[tuple[str, str]] = Counter()
            for t in batch.column(0).to_pylist():
                for line in (t or "").split("\n"):
                    words_ = line.split()
                    got = [pieces[w] for w in words_]
                    for i, ((a, _, _), (_, b, alone)) in enumerate(zip(got, got[1:])):
                        if a and b and asked(a, b, alone):
                            found[words_[i].strip(SIGNS), words_[i + 1].strip(SIGNS)] += 1
            yield pa.record_batch([pa.array([p[0] for p in found], pa.string()), pa.array([p[1] for p in found], pa.string()), pa.array(found.values(), pa.int64())], ["first", "second", "n"])

    each = docs.select(text).mapInArrow(count, "first string, second string, n long")
    pairs = written(each.groupBy("first", "second").agg(F.sum("n").alias("n")), "pairs")
    whole, behind = F.lower(F.concat("first", "second")), F.when(F.lower("first").isin(PREFIXES), F.lower("second"))
    asks = pairs.select(F.explode(F.array_compact(F.array(whole, behind))).alias("whole")).distinct()
    tries = asks.select("whole", F.explode(forms(F.col("whole"))).alias("word"))
    met_ = written(met(tries, known).select("whole").distinct(), "known")
    either = [pairs.join(met_, c == F.col("whole"), "left_semi") for c in (whole, behind)]
    return either[0].union(either[1]).distinct()
