"""Probe summaries, prompts from passages, page furniture, document windows and choices from log-probabilities."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siltstone.functions import text as T
from siltstone.operators import chunks
from siltstone.sources.shared import discard, written


def group_accuracy(rows: DataFrame, group: str, hit: Column) -> DataFrame:
    """(group, n, accuracy): share of hits by group, null groups as "unknown"; null hits don't count."""
    name = F.coalesce(F.col(group).cast("string"), F.lit("unknown")).alias("group")
    return rows.groupBy(name).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(hit.cast("double")), 6).alias("accuracy"))


def perplexity(batches: DataFrame, full: int, run: str = "run", nll: str = "nll", tokens: str = "tokens") -> DataFrame:
    """(run, perplexity): exp of summed loss over summed tokens of the batches of ``full`` tokens; others are left out."""
    whole = batches.where(F.col(tokens) == full)
    return whole.groupBy(run).agg(F.round(F.exp(F.sum(nll) / F.sum(tokens)), 6).alias("perplexity"))


def latest(history: DataFrame, metric: str, run: str = "run", at: str = "eval_id") -> DataFrame:
    """(run, metric): the last value that was measured, 0 if none was."""
    known = F.when(F.col(metric).isNotNull(), F.col(at))
    return history.groupBy(run).agg(F.coalesce(F.max_by(metric, known), F.lit(0.0)).alias(metric))


def first_k(rows: DataFrame, k: int, group: str, *order: str) -> DataFrame:
    """The first k rows of each group by order."""
    return rows.withColumn("__rank", F.row_number().over(W.partitionBy(group).orderBy(*order))).where(F.col("__rank") <= k).drop("__rank")


def score_summary(scores: DataFrame, score: str, threshold: float = 0.50) -> DataFrame:
    """One row: n, mean, least, most, n_low (below the threshold) and passed (mean at or above it)."""
    mean = F.avg(score)
    return scores.agg(F.count(score).alias("n"), F.round(mean, 4).alias("mean"), F.min(score).alias("least"), F.max(score).alias("most"), F.count_if(F.col(score) < threshold).alias("n_low"), F.coalesce(mean >= threshold, F.lit(False)).alias("passed"))


def profile(calls: DataFrame, name: str, seconds: str) -> DataFrame:
    """(name, calls, total, mean, percent): calls collapsed by name, percent being the share of all time."""
    each = calls.groupBy(name).agg(F.count(F.lit(1)).alias("calls"), F.sum(seconds).alias("total"))
    whole = each.agg(F.sum("total").alias("whole"))
    joined = each.crossJoin(F.broadcast(whole))  # whole is one row
    return joined.select(name, "calls", F.round("total", 4).alias("total"), F.round(F.col("total") / F.col("calls"), 4).alias("mean"), F.round(F.when(F.col("whole") > 0, 100 * F.col("total") / F.col("whole")).otherwise(0.0), 4).alias("percent"))


def profile_tree(calls: DataFrame, least: float = 0.0) -> DataFrame:
    """(path, depth, name, calls, total, mean, percent) of calls (id, parent, name, seconds), collapsed by the names on their way from
    the root (path, an array); percent is the share of the parent's total, at the root of the roots' sum.

    Paths under ``least`` percent go with all below them, unless their parent took no time. A call without seconds goes with all that it called.
    Levels are joined one after the other, each written, as many as calls are deep; levels only hold paths, not calls, once summed.
    """
    timed = calls.where("seconds is not null").select("id", "parent", "name", "seconds")
    level, levels = written(timed.where("parent is null").select("id", F.array("name").alias("path"), "seconds"), "calls"), []
    while not level.isEmpty():
        levels.append(written(level.groupBy("path").agg(F.count(F.lit(1)).alias("calls"), F.sum("seconds").alias("total")), "paths"))
        below = timed.join(level.select(F.col("id").alias("parent"), "path"), "parent")
        before, level = level, written(below.select("id", F.concat("path", F.array("name")).alias("path"), "seconds"), "calls")
        discard(before)
    kept = []
    for depth, each in enumerate(levels):
        if depth:
            up = kept[-1].select(F.col("path").alias("up"), F.col("total").alias("whole"))
            met = each.withColumn("up", F.slice("path", 1, depth)).join(up, "up")
        else:
            met = each.crossJoin(F.broadcast(each.agg(F.sum("total").alias("whole"))))  # one row
        percent = F.when(F.col("whole") > 0, 100.0 * F.col("total") / F.col("whole")).otherwise(0.0)
        met = met.select("path", F.lit(depth).alias("depth"), "calls", "total", "whole", percent.alias("percent"))
        kept.append(met.where((F.col("whole") == 0) | (F.col("percent") >= least)))
    if not kept:
        kept = [timed.limit(0).select(F.array("name").alias("path"), F.lit(0).alias("depth"), F.lit(0).cast("long").alias("calls"), F.col("seconds").alias("total"), F.col("seconds").alias("whole"), F.lit(0.0).alias("percent"))]
    out = kept[0]
    for more in kept[1:]:
        out = out.unionByName(more)
    return out.select("path", "depth", F.element_at("path", -1).alias("name"), "calls", "total", F.round(F.col("total") / F.col("calls"), 4).alias("mean"), F.round("percent", 4).alias("percent"))


def failed_gates(qa: Column, plateau: Column, cloze: Column, concept: Column, thresholds: tuple[float, float, float] = (0.6, 0.5, 0.5)) -> Column:
    """Names of the enabled gates that do not hold; a disabled gate is a null column."""
    checks = [("qa", qa < thresholds[0]), ("plateau", ~plateau), ("cloze", cloze < thresholds[1]), ("concept", concept < thresholds[2])]
    return F.filter(F.array(*[F.when(failed, F.lit(name)) for name, failed in checks]), lambda x: x.isNotNull())


def page_furniture(pages: DataFrame, doc: str, page: str, text: str = "text", share: float = 0.15, below: int = 120) -> DataFrame:
    """(doc, line, n): stripped lines shorter than ``below`` on at least max(3, int(share * pages)) pages of a document,
    each page counted once. Pairs of line and page are made distinct first, so a frequent line is counted in parts."""
    sizes = pages.groupBy(doc).agg(F.countDistinct(page).alias("pages"))
    lines = pages.select(doc, page, F.explode(F.split(text, "\n")).alias("line")).select(doc, page, T.strip(F.col("line")).alias("line"))
    each = lines.where(F.char_length("line").between(1, below - 1)).distinct()
    counts = each.groupBy(doc, "line").agg(F.count(F.lit(1)).alias("n"))
    return counts.join(sizes, doc).where(F.col("n") >= F.greatest(F.lit(3), F.floor(F.col("pages") * share))).select(doc, "line", "n")


def document_windows(docs: DataFrame, chunk_size: int = 1, per_unit: int = 400, least_chars: int = 300, id_col: str = "doc_id") -> DataFrame:
    """(id, chunk_no, text, token_count): windows of per_unit * chunk_size words that overlap by a tenth; those of fewer
    than least_chars characters go, and the others of a document are numbered anew."""
    size = per_unit * chunk_size
    long = chunks.chunk(docs, size, size // 10, id_col).where(F.char_length("text") >= least_chars)
    number = F.row_number().over(W.partitionBy(id_col).orderBy("chunk_no")) - 1
    return long.withColumn("chunk_no", number.cast("int"))


def numbered_passages(passages: Column, most: int = 5) -> Column:
    """The first passages as numbered lines."""
    return F.array_join(F.transform(F.slice(passages, 1, most), lambda p, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), p)), "\n")


def prompt(question: Column, passages: Column, most: int = 5, context: str = "Context:", ask: str = "Question:", answer: str = "Answer:") -> Column:
    """A prompt from a question and its numbered passages; without passages, the question alone. The wording is a parameter."""
    tail = F.concat(F.lit(f"{ask} "), F.coalesce(question, F.lit("")), F.lit(f"\n{answer}"))
    none = F.coalesce(F.size(passages), F.lit(0)) <= 0
    return F.when(none, tail).otherwise(F.concat(F.lit(f"{context}\n"), numbered_passages(passages, most), F.lit("\n\n"), tail))


def cloze_prompt(text: Column, examples: Sequence[tuple[str, str]] = (), blank: str = "______", ask: str = "Sentence:", answer: str = "Answer:") -> Column:
    """A sentence with a blank to be filled, after solved examples: three underscores become the blank, and a text without one gets it
    at its end. Null is an empty text. The wording is a parameter."""
    plain = F.coalesce(text, F.lit(""))
    filled = F.replace(plain, F.lit("___"), F.lit(blank))
    filled = F.when(filled.contains(blank), filled).otherwise(F.concat(filled, F.lit(f" {blank}")))
    solved = "".join(f"{ask} {s}\n{answer} {a}\n\n" for s, a in examples)
    return F.concat(F.lit(f"{solved}{ask} "), filled, F.lit(f"\n{answer}"))


def plain_prompt(text: Column, ask: str = "Prompt:", answer: str = "Answer:") -> Column:
    """A text and a place for its answer, as concept probes (ask "Prompt:") and questions (ask "Question:") are put."""
    return F.concat(F.lit(f"{ask} "), F.coalesce(text, F.lit("")), F.lit(f"\n{answer}"))


def term_hit(output: Column, term: Column) -> Column:
    """Whether the term stands in the output as whole words, both being normalised for matching; false for no term."""
    out, word = T.match_normal(output), T.match_normal(term)
    edge = F.lit(r"(?U)\b")
    quoted = F.concat(edge, F.lit(r"\Q"), F.replace(word, F.lit(r"\E"), F.lit("")), F.lit(r"\E"), edge)
    return F.coalesce((word != "") & F.regexp_like(out, quoted), F.lit(False))


def valid_questions(items: DataFrame) -> DataFrame:
    """Items with a question, at least one choice, and an answer_idx that points to a choice."""
    n = F.size(F.coalesce("choices", F.array().cast("array<string>")))
    return items.where(F.col("question").isNotNull() & (n > 0) & (F.col("answer_idx") >= 0) & (F.col("answer_idx") < n))


def hash_bucket(key: Column, n: Column) -> Column:
    """The MD5 digest of a key as a 128-bit number, modulo n (below 2**31)."""
    n = n.cast("decimal(20,0)")
    half = lambda at: F.conv(F.substring(F.md5(key.cast("string")), at, 16), 16, 10).cast("decimal(20,0)") % n
    base = F.lit(str(2**64)).cast("decimal(20,0)") % n
    return ((half(1).cast("decimal(18,0)") * base.cast("decimal(18,0)") + half(17).cast("decimal(18,0)")) % n).cast("long")
