"""Sentence boundaries without a word list: abbreviations, sentence starters and collocations by log-likelihood.

The statistics are those of unsupervised boundary detection by Kiss and Strunk (2006), gathered by aggregates over all texts.
A token is a run without white space; its type is the lower-cased token without signs around it, apart from its
periods.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from unicodedata import category

import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as D

from siltstone.functions import text as T
from siltstone.operators.lookup import BROADCAST_ROWS, looked_up
from siltstone.sources.shared import written

TOKEN = r"[^\s\x0B\x{85}\x{A0}]+"
OPENING, CLOSING = "([{\"'“‘«„*_-", ")]}\"'”’»*_"
# Thresholds of the published method.
ABBREVIATION, COLLOCATION, STARTER = 0.3, 7.88, 30.0


def _core(token: Column) -> Column:
    """A token without opening signs before and closing signs behind it."""
    return F.rtrim(F.ltrim(token, F.lit(OPENING)), F.lit(CLOSING))


def _type(token: Column) -> Column:
    """Its type: in lower case, without the last period and the commas and the like behind."""
    return F.lower(F.rtrim(_core(token), F.lit(".,;:?!")))


def _ends(token: Column) -> Column:
    return _core(token).rlike(r"[.?!]$")


def _period(token: Column) -> Column:
    return _core(token).rlike(r"[^.]\.$")


def counted(docs: DataFrame, text: str = "text") -> DataFrame:
    """(type, period, ends, after, n): how often each type stands with or without a last period and a final sign, before each type of
    the next token (null at the end of a text). Tokens of signs alone are left out as types."""
    w = docs.select(F.regexp_extract_all(F.col(text), F.lit(TOKEN), F.lit(0)).alias("w"))
    one = lambda w: F.transform(w, lambda t, i: F.struct(_type(t).alias("type"), _period(t).alias("period"), _ends(t).alias("ends"), _type(F.get(w, i + 1)).alias("after")))
    d = w.select(F.explode(T.let(F.col("w"), one)).alias("t")).select("t.*").where("type <> ''")
    return d.groupBy("type", "period", "ends", "after").agg(F.count(F.lit(1)).alias("n"))


def counted_alone(docs: DataFrame, text: str = "text") -> DataFrame:
    """(type, period, n): as counted(), whatever stands behind. Tokens are counted as they are, so that types are worked out once for each
    different token, and these alone are shuffled; stored, as abbreviations() reads it twice."""
    each = docs.select(F.explode(F.regexp_extract_all(F.col(text), F.lit(TOKEN), F.lit(0))).alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("n"))
    return written(each.select(_type(F.col("t")).alias("type"), _period(F.col("t")).alias("period"), "n").where("type <> ''"), "tokens")


#: Different tokens and pairs that a task counts before it hands them on.
COUNTED = 1 << 18
_WHITE = " \t\n\x0b\f\r\x85\xa0"
_TOKEN, _PIECE = re.compile(f"[^{_WHITE}]+"), re.compile(f"[^{_WHITE}]+[{_WHITE}]*")
#: A line separator may stand behind what ends a token.
_BEHIND = "[\u2028\u2029]?\\Z"
_FINAL, _SIGN, _PERIOD, _ELLIPSIS, _SEPARATOR = (re.compile(x + _BEHIND) for x in ("[?!]", "[.?!]", r"[^.]\.", r"\.\.", ""))


def _plain_type(token: str) -> str:
    """_type() in plain Python."""
    return token.lstrip(OPENING).rstrip(CLOSING).rstrip(".,;:?!").lower()


def _tallied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(type, after, pair, n, periods): how often each type stands, and that with a period; of tokens that end in a final sign also before
    which type they do."""
    alone: Counter[str] = Counter()
    pairs: Counter[tuple[str, str | None]] = Counter()

    def rows() -> pa.RecordBatch:
        made: dict[tuple[str, str | None, bool], list[int]] = {}
        types = {t: _plain_type(t) for t in alone}
        dotted = {t for t in alone if "." in t and _PERIOD.search(t.lstrip(OPENING).rstrip(CLOSING))}

        def add(token: str, after: str | None, pair: bool, n: int) -> None:
            if types[token]:
                sums = made.setdefault((types[token], after, pair), [0, 0])
                sums[0] += n
                sums[1] += n if token in dotted else 0

        for token, n in alone.items():
            add(token, None, False, n)
        for (token, following), n in pairs.items():
            if _SIGN.search(token.lstrip(OPENING).rstrip(CLOSING)):
                add(token, following if following is None else types[following], True, n)
        alone.clear()
        pairs.clear()
        columns = [pa.array([k[0] for k in made], pa.string()), pa.array([k[1] for k in made], pa.string()), pa.array([k[2] for k in made], pa.bool_()), pa.array([v[0] for v in made.values()], pa.int64()), pa.array([v[1] for v in made.values()], pa.int64())]
        return pa.record_batch(columns, ["type", "after", "pair", "n", "periods"])

    for batch in batches:
        for text in batch.column(0).to_pylist():
            w = _TOKEN.findall(text or "")
            alone.update(w)
            pairs.update((t, w[i + 1] if i + 1 < len(w) else None) for i, t in enumerate(w) if "." in t or "?" in t or "!" in t)
            if len(alone) + len(pairs) > COUNTED:
                yield rows()
    yield rows()


def counted_apart(docs: DataFrame, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(type, n, periods), a row for each type: how often it stands, and that with a period; and (type, after, n, periods) of tokens
    that end in a final sign alone, before each type. Both come of one look at the texts, and of the pairs of neighbours only those that may end
    a sentence are shuffled."""
    each = docs.select(text).mapInArrow(_tallied, "type string, after string, pair boolean, n long, periods long")
    found = written(each.groupBy("type", "after", "pair").agg(F.sum("n").alias("n"), F.sum("periods").alias("periods")), "sentence-pairs")
    return found.where("not pair").select("type", "n", "periods"), found.where("pair").select("type", "after", "n", "periods")


def likelihood(n: Column, a: Column, b: Column, both: Column) -> Column:
    """-2 log lambda of two events in n trials: a, b and both of them occurring; none of the logarithms' zeros counts."""
    part = lambda k, m, p: F.when(k > 0, k * F.log(p)).otherwise(0.0) + F.when(m - k > 0, (m - k) * F.log(1 - p)).otherwise(0.0)
    p, p1, p2 = b / n, both / a, F.when(n > a, (b - both) / (n - a)).otherwise(0.0)
    return 2 * (part(both, a, p1) + part(b - both, n - a, p2) - part(both, a, p) - part(b - both, n - a, p))


def abbreviations(found: DataFrame) -> DataFrame:
    """(word, with_period, without, score), from counted() or counted_alone(), of types with a letter that stand before a period: likelihood that the period belongs to
    the type (against one in a hundred that it doesn't), lowered for letters, raised for inner periods, and lowered by each use without one."""
    of = lambda hit: F.coalesce(F.sum(F.when(hit, F.col("n"))), F.lit(0))
    whole = found.agg(of(F.lit(True)).alias("n"), of(F.col("period")).alias("periods")).first()
    n, periods = float(whole.n), float(whole.periods)
    return _scored(found.groupBy(F.col("type").alias("word")).agg(of(F.col("period")).alias("with_period"), of(~F.col("period")).alias("without")), n, periods)


def _scored(k: DataFrame, n: float, periods: float) -> DataFrame:
    k = k.where((F.col("with_period") > 0) & F.col("word").rlike(r"\p{L}"))
    p = min(max(periods / n, 1e-12), 1 - 1e-12) if n else 0.5
    hits, rest = F.col("with_period"), F.col("without")
    null = hits * F.log(F.lit(p)) + rest * F.log(F.lit(1 - p))
    ratio = -2 * (null - (hits * F.log(F.lit(0.99)) + rest * F.log(F.lit(0.01))))
    inner = F.regexp_count("word", F.lit(r"\."))
    letters = F.char_length("word") - inner
    score = ratio * F.exp(-letters.cast("double")) * (inner + 1) * F.pow(letters.cast("double"), -rest.cast("double"))
    return k.withColumn("score", F.round(score, 4))


def model(docs: DataFrame, text: str = "text") -> DataFrame:
    """(word, value) over all texts: value is abbreviation, starter or collocation (then word is two types with a space between).

    A starter follows sentence ends far more often than other tokens; a collocation is a type with a period that the same type follows
    more often than chance has it, so that no sentence ends between them. Counts are combined before each shuffle.
    """
    types, pairs = counted_apart(docs, text)
    total = lambda d, c: float(d.agg(F.coalesce(F.sum(c), F.lit(0)).alias("n")).first().n)
    whole = total(types, "n")
    dotted = types.where("periods > 0").select(F.col("type").alias("word"), F.col("periods").alias("with_period"), (F.col("n") - F.col("periods")).alias("without"))
    short = written(_scored(dotted, whole, total(types, "periods")).where(F.col("score") >= ABBREVIATION).select("word"), "abbreviations")
    size = types.select(F.col("type").alias("after"), F.col("n").alias("b"))
    breaks = pairs.join(short.select(F.col("word").alias("type")), "type", "left_anti")
    n, a = F.lit(whole), F.lit(total(breaks, "n"))
    begun = breaks.where("after <> ''").groupBy("after").agg(F.sum("n").alias("both")).join(size, "after")
    starters = written(begun.where((likelihood(n, a, F.col("b"), F.col("both")) >= STARTER) & (F.col("both") / a > F.col("b") / n)).select("after"), "starters")
    tied = pairs.where("after <> '' and periods > 1").select("type", "after", F.col("periods").alias("both")).join(types.select("type", F.col("periods").alias("a")), "type").join(size, "after")
    tied = tied.where((likelihood(n, F.col("a"), F.col("b"), F.col("both")) >= COLLOCATION) & (F.col("both") / F.col("a") > F.col("b") / n)).join(starters, "after", "left_anti")
    kind = lambda d, word, value: d.select(word.alias("word"), F.lit(value).alias("value"))
    return kind(short, F.col("word"), "abbreviation").union(kind(starters, F.concat(F.lit(" "), F.col("after")), "starter")).union(kind(tied, F.concat_ws(" ", "type", "after"), "collocation"))


#: White space around a sentence.
_AROUND = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def _ended(token: str, following: str, kind: Callable[[str], str | None]) -> bool:
    """Whether a sentence ends between two tokens, of which the first has a final sign in it, by a model's kinds."""
    core = token.lstrip(OPENING).rstrip(CLOSING)
    if _FINAL.search(core):
        return True
    if not core.endswith("."):
        return False
    behind = following.lstrip(OPENING).rstrip(CLOSING)
    a, head = core.rstrip(".,;:?!").lower(), behind[:1]
    bare = _SEPARATOR.sub("", a)
    number = bare != "" and all(category(c)[0] == "N" for c in bare)
    doubtful = kind(a) == "abbreviation" or (len(bare) == 1 and category(bare)[0] == "L") or _ELLIPSIS.search(core) or (number and head and category(head) == "Ll")
    if not doubtful:
        return True
    if head.upper() != head or head.lower() == head:
        return False
    b = behind.rstrip(".,;:?!").lower()
    return kind(f" {b}") == "starter" and kind(f"{a} {b}") != "collocation"


def _sentences(text: str, kind: Callable[[str], str | None]) -> list[str]:
    pieces = _PIECE.findall(text)
    out, begin = [], 0
    for i in [i for i, p in enumerate(pieces[:-1]) if "." in p or "?" in p or "!" in p]:
        if _ended(pieces[i].rstrip(_WHITE), pieces[i + 1].rstrip(_WHITE), kind):
            out.append("".join(pieces[begin : i + 1]).strip(_AROUND))
            begin = i + 1
    return [*out, "".join(pieces[begin:]).strip(_AROUND)] if pieces else []


def _cut(held: Broadcast | None) -> Callable[..., Column]:
    """Sentences of texts by a model held as a whole, or by the words and kinds of it that each text asks for."""

    @F.pandas_udf(D.ArrayType(D.StringType()))
    def whole(text: pd.Series) -> pd.Series:
        return pd.Series([_sentences(t or "", held.value.get) for t in text], dtype=object)

    @F.pandas_udf(D.ArrayType(D.StringType()))
    def asked(text: pd.Series, words: pd.Series, kinds: pd.Series) -> pd.Series:
        return pd.Series([_sentences(t or "", dict(zip(w, k)).get) for t, w, k in zip(text, words, kinds)], dtype=object)

    return asked if held is None else whole


def split(docs: DataFrame, table: DataFrame, text: str = "text", out: str = "sentences") -> DataFrame:
    """docs with ``out``, the sentences of each text (array<string>, stripped; white space inside stays), by a model's table.

    A token that ends in a question or exclamation mark ends a sentence, and so does one that ends in a period, but for
    abbreviations, single letters, ellipses and numbers before a small letter: these end one only if what follows is capitalised and a sentence
    starter, and the two are no collocation. A null or blank text has no sentences. A model of up to BROADCAST_ROWS words is
    held by each task; of a larger one each text is given the words that it asks for.
    """
    kinds = table.groupBy("word").agg(F.min("value").alias("value"))
    held = kinds.limit(BROADCAST_ROWS + 1).toArrow()
    if held.num_rows <= BROADCAST_ROWS:
        model = docs.sparkSession.sparkContext.broadcast(dict(zip(held["word"].to_pylist(), held["value"].to_pylist())))
        return docs.withColumn(out, _cut(model)(F.col(text)))
    bare = F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(TOKEN), F.lit(0))
    dotted = lambda w: F.filter(F.transform(w, lambda t, i: F.when(_core(t).endswith("."), F.struct(_type(t).alias("a"), _type(F.get(w, i + 1)).alias("b")))), lambda x: x.isNotNull())
    asks = lambda w: F.flatten(F.transform(dotted(w), lambda x: F.array_compact(F.array(x["a"], F.concat(F.lit(" "), x["b"]), F.concat_ws(" ", x["a"], x["b"])))))
    d = looked_up(docs, T.let(bare, asks), kinds, "__model")
    return d.withColumn(out, _cut(None)(F.col(text), F.map_keys("__model"), F.map_values("__model"))).drop("__model")
