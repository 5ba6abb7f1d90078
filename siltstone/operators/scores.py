"""Answer, citation, hallucination and judge scores; reports over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions import text as T

#: Phrases that make a sentence a citation (fixed values).
TRIGGERS = ("according to", "as described in", "the context states")


def _split(text: Column) -> Column:
    return F.filter(F.split(text, " "), lambda x: x != "")


def lexical_f1(a: Column, b: Column) -> Column:
    return T.token_f1(T.words(F.coalesce(a, F.lit(""))), T.words(F.coalesce(b, F.lit(""))), 0.0)


def answer_f1(a: Column, b: Column) -> Column:
    return T.token_f1(_split(T.answer_normal(a)), _split(T.answer_normal(b)), 1.0)


def extract_answer(trace: Column) -> Column:
    """The last boxed answer, one level of braces inside allowed; else the last sentence; else the stripped trace."""
    t = F.coalesce(trace, F.lit(""))
    boxed = F.regexp_extract_all(t, F.lit(r"\\boxed\{([^{}]*(?:\{[^{}]*\}[^{}]*)*)\}"), F.lit(1))
    parts = T.sentences(t)
    return F.when(F.size(boxed) > 0, T.strip(F.get(boxed, F.size(boxed) - 1))).when(F.size(parts) > 0, F.get(parts, F.size(parts) - 1)).otherwise(T.strip(t))


def choice_accuracy(extracted: Column, truth: Column, choices: Column) -> Column:
    """1.0 if the answer is the true choice's text, its letter, or option, choice or answer and that letter."""
    got, want = T.answer_normal(extracted), T.answer_normal(truth)
    at = F.array_position(F.transform(choices, T.answer_normal), want)
    letter = F.char(F.lit(96) + at)
    named = (at > 0) & ((got == letter) | got.isin("\0") | F.exists(F.array(*[F.lit(x) for x in ("option ", "choice ", "answer ")]), lambda p: got == F.concat(p, letter)))
    return F.when((got == want) | F.coalesce(named, F.lit(False)), 1.0).otherwise(0.0)


def answer_accuracy(trace: Column, truth: Column, choices: Column) -> Column:
    got = extract_answer(trace)
    return F.when(F.size(F.coalesce(choices, F.array().cast("array<string>"))) > 0, choice_accuracy(got, truth, choices)).otherwise(answer_f1(got, truth))


def citations(trace: Column) -> Column:
    """Quoted spans of over ten characters, then each trigger sentence with the two that follow it."""
    t = F.coalesce(trace, F.lit(""))
    quotes = F.concat(F.regexp_extract_all(t, F.lit('"([^"\n]+)"'), F.lit(1)), F.regexp_extract_all(t, F.lit("'([^'\n]+)'"), F.lit(1)))
    quotes = F.filter(F.transform(quotes, T.strip), lambda q: F.char_length(q) > 10)
    parts = F.transform(F.split(t, r"[.?!]+"), T.strip)
    hit = F.filter(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.exists(F.array(*[F.lit(x) for x in TRIGGERS]), lambda p: F.contains(F.lower(F.get(parts, i)), p)))
    return F.concat(quotes, F.transform(hit, lambda i: T.strip(F.array_join(F.slice(parts, i + 1, 3), " "))))


def citation_scores(samples: DataFrame, threshold: float = 0.30) -> DataFrame:
    """(sample_id, precision, recall, f1) of trace against chunks; null without retrieval, 0 without either side."""
    cited, chunk = citations(F.col("trace")), F.col("chunks")
    s = samples.select("sample_id", "no_retrieval", F.transform(cited, T.trigrams).alias("c"), F.transform(F.coalesce(chunk, F.array().cast("array<string>")), T.trigrams).alias("k"))
    near = lambda x, y: T.jaccard(x, y) >= threshold
    hits = F.size(F.filter("c", lambda x: F.exists("k", lambda y: near(x, y))))
    found = F.size(F.filter("k", lambda y: F.exists("c", lambda x: near(x, y))))
    none = (F.size("c") == 0) | (F.size("k") == 0)
    s = s.select("sample_id", "no_retrieval", F.when(none, 0.0).otherwise(hits / F.size("c")).alias("precision"), F.when(none, 0.0).otherwise(found / F.size("k")).alias("recall"))
    f1 = F.when(F.col("precision") + F.col("recall") == 0, 0.0).otherwise(2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall")))
    return s.select("sample_id", *[F.when(~F.col("no_retrieval"), F.round(c, 6)).alias(n) for n, c in (("precision", F.col("precision")), ("recall", F.col("recall")), ("f1", f1))])


def kappa(ratings: DataFrame) -> DataFrame:
    """One row of Cohen's kappa over (rater_a, rater_b): n, agreement, kappa; null where chance agreement is 1."""
    cells = ratings.where("rater_a is not null and rater_b is not null").groupBy("rater_a", "rater_b").agg(F.count(F.lit(1)).alias("n"))
    total = cells.agg(F.sum("n").alias("total"), F.sum(F.when(F.col("rater_a") == F.col("rater_b"), F.col("n")).otherwise(0)).alias("same"))
    a, b = cells.groupBy("rater_a").agg(F.sum("n").alias("x")), cells.groupBy("rater_b").agg(F.sum("n").alias("y"))
    chance = a.join(b, F.col("rater_a") == F.col("rater_b")).agg(F.coalesce(F.sum(F.col("x") * F.col("y")), F.lit(0)).alias("both"))
    k = total.crossJoin(chance).select("total", (F.col("same") / F.col("total")).alias("po"), (F.col("both") / (F.col("total") * F.col("total"))).alias("pe"))
    return k.select(F.col("total").alias("n"), F.round("po", 6).alias("agreement"), F.round(F.when(F.col("pe") < 1, (F.col("po") - F.col("pe")) / (1 - F.col("pe"))), 6).alias("kappa"))


def failure_classes(records: DataFrame) -> DataFrame:
    """(sample_id, failure) for each failed check of a benchmark record; null judgements fail."""
    low = lambda c, x: F.col(c).isNull() | (F.col(c) < x)
    checks = [("answer", F.col("answer") < 1.0), ("reasoning", low("reasoning", 0.60)), ("citation", ~F.col("no_retrieval") & low("citation", 0.30)), ("hallucination", F.col("hallucination") > 0.25)]
    found = F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in checks]), lambda x: x.isNotNull())
    return records.select("sample_id", F.explode(found).alias("failure"))


def teacher_scores(records: DataFrame) -> DataFrame:
    """Means by teacher and cluster to four digits: reasoning over non-null, else 0; citation over non-null grounded
    records, else null."""
    mean = lambda c: F.round(F.avg(c), 4)
    return records.groupBy("teacher", "cluster").agg(F.count(F.lit(1)).alias("n"), F.coalesce(mean("answer"), F.lit(0.0)).alias("answer"), F.coalesce(mean("reasoning"), F.lit(0.0)).alias("reasoning"), mean(F.when(~F.col("no_retrieval"), F.col("citation"))).alias("citation"), F.coalesce(mean("hallucination"), F.lit(0.0)).alias("hallucination"))


def teacher_macro(scores: DataFrame) -> DataFrame:
    """Unweighted means of the rounded cluster means."""
    return scores.groupBy("teacher").agg(*[F.round(F.avg(c), 4).alias(c) for c in ("answer", "reasoning", "citation", "hallucination")])


def benchmark_gates(records: DataFrame, scores: DataFrame, expected: int) -> DataFrame:
    """One row: complete, null_rate_ok (at most 5 % of reasoning null), hallucination_ok (micro mean up to 0.50)."""
    c = scores.agg((F.count(F.lit(1)) == expected).alias("complete"))
    r = records.agg((F.avg(F.col("reasoning").isNull().cast("double")) <= 0.05).alias("null_rate_ok"), (F.avg("hallucination") <= 0.50).alias("hallucination_ok"))
    return c.crossJoin(r)


def pmi_choice(conditional: Column, unconditional: Column) -> Column:
    """Position (from 0) of the choice whose mean conditional log-probability gains most over the unconditional."""
    gain = F.zip_with(conditional, unconditional, lambda a, b: a - b)
    return F.array_position(gain, F.array_max(gain)) - 1
