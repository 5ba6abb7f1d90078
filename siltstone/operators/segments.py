"""Run-together and spaced-out words: best splits over a lexicon, ligature repair, and a report of artifacts."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as D

from siltstone.functions import text as T
from siltstone.operators.lookup import looked_up, met, replaced
from siltstone.operators.repair import sieve
from siltstone.sources.shared import written

# The longest word of a split, and the patterns of artifacts.
LONGEST = 20
CONTROL = r"[\x00-\x08\x0b-\x1f\x7f]"
SPACED = r"\b(?:[A-Z] ){3,}[A-Z]\b"
# A match begins where a run does or the match before ended, so that a run is not looked at again from each of its characters.
RUNNING = r"(?i)(?:(?<!\S)|\G)\S*\.indd\s+[ivxlc\d]+\b"
BROKEN_TH = r"\bTh ([a-z]+)\b"
BROKEN_LIGATURE = r"(?:(?<!\w)|\G)\w*(?:fi|ff|fl) \w+"


@F.pandas_udf(D.StructType([D.StructField("pieces", D.ArrayType(D.StringType())), D.StructField("cost", D.LongType())]))
def _best(run: pd.Series, arcs: pd.Series) -> pd.DataFrame:
    """The cheapest way through arcs (end, start, cost) from the run's begin to its end; of equals the one whose last word is longest."""
    out = []
    for text, ways in zip(run, arcs):
        ways = [] if ways is None else ways
        best: dict[int, tuple[int, int]] = {0: (0, 0)}
        for way in sorted(ways, key=lambda w: (w["end"], w["start"])):
            if way["start"] in best:
                cost = best[way["start"]][0] + way["cost"]
                if way["end"] not in best or cost < best[way["end"]][0]:
                    best[way["end"]] = (cost, way["start"])
        at, pieces = len(text), []
        while at in best and at:
            pieces.append(text[best[at][1] : at])
            at = best[at][1]
        out.append((pieces[::-1] if pieces and not at else None, best[len(text)][0] if text and len(text) in best else None))
    return pd.DataFrame(out, columns=["pieces", "cost"]).astype({"cost": "Int64"})


_PARTS = pa.list_(pa.struct([("start", pa.int32()), ("word", pa.string())]))


def _on_a_way(held: Broadcast, longest: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Runs with those parts that lie on a way from the run's begin to its end, of words that a sieve takes for known."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mask, bits = held.value

        def parts(run: str) -> list[dict]:
            reached, found = bytearray(len(run) + 1), []
            reached[0] = 1
            for start in range(len(run)):
                if reached[start]:
                    for end in range(start + 1, min(start + longest, len(run)) + 1):
                        at = zlib.crc32(run[start:end].encode()) & mask
                        if bits[at >> 3] >> (at & 7) & 1:
                            reached[end] = 1
                            found.append((start, end))
            if not reached[-1]:
                return []
            leads = bytearray(len(run) + 1)
            leads[-1] = 1
            for start, end in reversed(found):
                leads[start] |= leads[end]
            return [{"start": a, "word": run[a:b]} for a, b in found if leads[b]]

        for batch in batches:
            runs = batch.column(0)
            yield pa.record_batch([runs, pa.array([parts(r) if r else [] for r in runs.to_pylist()], _PARTS)], ["run", "parts"])

    return of


def best_splits(runs: DataFrame, lexicon: DataFrame, by: str = "frequency", longest: int = LONGEST) -> DataFrame:
    """(run, pieces, cost) of runs (run: different words in lower case) over lexicon (word, n); null where no split covers a run.

    A word of the lexicon costs one by "words", and by "frequency" the negative logarithm of its share of all n in millionths, as
    whole numbers. Each run's parts of up to ``longest`` characters that a sieve of the lexicon lets through meet it in a join, so it may
    have any size, if they lie on a way through the run; the way through those that are known is then found run by run.
    """
    if by not in ("words", "frequency"):
        raise ValueError("by must be words or frequency")
    fit = written(runs.select("run").mapInArrow(_on_a_way(sieve(lexicon.select("word")), longest), "run string, parts array<struct<start: int, word: string>>"), "parts")
    some, none = fit.where(F.size("parts") > 0), fit.where(F.size("parts") == 0)
    # A run may be long, so its parts carry a digest of it.
    parts = some.select(F.md5("run").alias("id"), F.inline("parts"))
    if by == "words":
        priced = lexicon.select("word", F.lit(1).cast("long").alias("cost"))
    else:
        total = lexicon.agg(F.sum("n").alias("total")).first().total or 1
        priced = lexicon.select("word", F.round(-F.log(F.col("n") / F.lit(float(total))) * 1e6).cast("long").alias("cost"))
    arcs = met(parts, priced).groupBy("id").agg(F.collect_list(F.struct((F.col("start") + F.char_length("word")).alias("end"), "start", "cost")).alias("arcs"))
    split = some.select("run", F.md5("run").alias("id")).join(arcs, "id", "left")
    ways = split.select("run", F.when(F.col("arcs").isNotNull(), _best("run", "arcs")).alias("s")).select("run", "s.pieces", "s.cost")
    return ways.unionByName(none.select("run", F.lit(None).cast("array<string>").alias("pieces"), F.lit(None).cast("long").alias("cost")))


def unspaced(docs: DataFrame, lexicon: DataFrame, text: str = "text") -> DataFrame:
    """docs with four or more capitals set apart by spaces as words of the lexicon, the fewest that cover them; else left as they are."""
    found = F.regexp_extract_all(F.col(text), F.lit(SPACED), F.lit(0))
    bare = lambda m: F.lower(F.replace(m, F.lit(" "), F.lit("")))
    asked = F.transform(found, bare)
    runs = docs.select(F.explode(asked).alias("run")).distinct()
    table = best_splits(runs, lexicon, "words").where("pieces is not null").select(F.col("run").alias("word"), F.upper(F.array_join("pieces", " ")).alias("value"))
    return looked_up(docs, asked, table, "__words").withColumn(text, replaced(F.col(text), SPACED, lambda m: F.coalesce(F.get(F.array(F.try_element_at("__words", bare(m))), F.lit(0)), m))).drop("__words")


def _core(match: Column) -> Column:
    """A match of BROKEN_LIGATURE drawn together, in lower case, without what is no ASCII letter at its end."""
    return F.lower(F.regexp_replace(F.replace(match, F.lit(" "), F.lit("")), "[^a-zA-Z]+$", ""))


def with_ligatures(docs: DataFrame, lexicon: DataFrame, text: str = "text") -> DataFrame:
    """docs with words broken behind fi, ff or fl drawn together if the whole is in the lexicon, and "Th e" always."""
    d = docs.withColumn(text, F.regexp_replace(text, BROKEN_TH, "Th$1"))
    asked = F.transform(F.regexp_extract_all(F.col(text), F.lit(BROKEN_LIGATURE), F.lit(0)), _core)
    d = looked_up(d, asked, lexicon.select("word", F.lit(True).alias("value")), "__known")
    mend = lambda m: F.when(F.map_contains_key("__known", _core(m)), F.replace(m, F.lit(" "), F.lit(""))).otherwise(m)
    return d.withColumn(text, replaced(F.col(text), BROKEN_LIGATURE, mend)).drop("__known")


def artifacts(text: Column) -> Column:
    """struct of how many artifacts of each kind a text holds; none in null. Those behind are counted in what those before have left."""
    count = lambda t, p: F.coalesce(F.regexp_count(t, F.lit(p)).cast("long"), F.lit(0).cast("long"))
    plain = F.replace(F.regexp_replace(text, CONTROL, ""), F.lit("\u00a0"), F.lit(" "))
    body = F.regexp_replace(plain, RUNNING, "")
    return F.struct(count(text, CONTROL).alias("control"), count(F.regexp_replace(text, CONTROL, ""), "\u00a0").alias("no_break_spaces"), count(plain, RUNNING).alias("running_heads"), count(body, SPACED).alias("spaced_capitals"), count(body, BROKEN_TH).alias("broken_th"), count(F.regexp_replace(body, BROKEN_TH, "Th$1"), BROKEN_LIGATURE).alias("broken_ligatures"))


def cleaned(docs: DataFrame, lexicon: DataFrame, text: str = "text") -> DataFrame:
    """docs without control characters, no-break spaces and running heads of layout files, spaced-out capitals and broken
    ligatures mended by the lexicon, blank lines and spaces squeezed. Null texts are empty."""
    t = F.replace(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), CONTROL, ""), F.lit("\u00a0"), F.lit(" "))
    d = with_ligatures(unspaced(docs.withColumn(text, F.regexp_replace(t, RUNNING, "")), lexicon, text), lexicon, text)
    return d.withColumn(text, T.strip(F.regexp_replace(F.regexp_replace(text, r"\n{3,}", "\n\n"), r"[ \t]{2,}", " ")))


def report(before: DataFrame, after: DataFrame, key: str, text: str = "text") -> DataFrame:
    """One row over two states of the same documents by a unique key: documents, modified, artifacts before by kind,
    chars and tokens of both and the reduction of each in percent."""
    side = lambda d, s: d.select(key, F.coalesce(F.col(text), F.lit("")).alias(s))
    both = side(before, "old").join(side(after, "new"), key)
    kinds = artifacts(F.col("old"))
    names = ["control", "no_break_spaces", "running_heads", "spaced_capitals", "broken_th", "broken_ligatures"]
    each = both.select("old", "new", kinds.alias("a"), *[F.char_length(s).cast("long").alias(f"chars_{s}") for s in ("old", "new")], *[T.token_count(F.col(s)).alias(f"tokens_{s}") for s in ("old", "new")])
    sums = [F.coalesce(F.sum(f"{what}_{s}"), F.lit(0)).alias(f"{what}_{s}") for what in ("chars", "tokens") for s in ("old", "new")]
    one = each.agg(F.count(F.lit(1)).alias("documents"), F.count_if(F.col("old") != F.col("new")).alias("modified"), *[F.coalesce(F.sum(f"a.{n}"), F.lit(0)).alias(n) for n in names], *sums)
    less = lambda what: F.round(F.when(F.col(f"{what}_old") > 0, 100.0 * (F.col(f"{what}_old") - F.col(f"{what}_new")) / F.col(f"{what}_old")).otherwise(0.0), 2).alias(f"{what}_less")
    return one.select("*", less("chars"), less("tokens"))
