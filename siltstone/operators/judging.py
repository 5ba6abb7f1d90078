"""Judge prompts and responses, human calibration, invented terms, entailment and choice scores."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions import text as T
from siltstone.operators import scores

# The metrics of a judge's response and the parts of its reasoning score.
METRICS = ("answer_accuracy", "reasoning_quality", "citation_accuracy", "hallucination")
REASONING = ("step_validity", "logical_coherence", "absence_of_circular_reasoning")
#: An object, one level of inner objects allowed (fixed value).
CANDIDATE = r"\{[^{}]*(?:\{[^{}]*\}[^{}]*)*\}"
#: A term made of two capitalised words and a kind of thing (fixed value).
COMPOUND_TERM = r"\b[A-Z][a-z]+-[A-Z][a-z]+\s+(?:receptor|protein|cell|neuron|pathway|channel|Receptor|Protein|Cell|Neuron|Pathway|Channel)\b"


def judge_prompt(question: Column, truth: Column, context: Column, trace: Column, no_retrieval: Column) -> Column:
    """The request to a judge: what to weigh, the material, and the form of the reply. The wording is our own."""
    blank = lambda c: F.coalesce(c, F.lit(""))
    shape = ", ".join([f'"{METRICS[0]}": {{"score": 0-1}}', f'"{METRICS[1]}": {{' + ", ".join(f'"{r}": 1-5' for r in REASONING) + "}", f'"{METRICS[2]}": {{"precision": 0-1, "recall": 0-1}}', f'"{METRICS[3]}": {{"rate": 0-1}}'])
    given = F.when(F.coalesce(no_retrieval, F.lit(False)), F.lit("none was retrieved; leave citations out")).otherwise(blank(context))
    return F.concat(F.lit("Rate the answer below on each metric.\nQuestion: "), blank(question), F.lit("\nReference: "), blank(truth), F.lit("\nContext: "), given, F.lit("\nAnswer: "), blank(trace), F.lit(f"\nReply with JSON only: {{{shape}}}"))


def judged(response: Column) -> Column:
    """The JSON text of a judge's response, null if there is none.

    Thinking and fences are cut away; of the objects left the first that parses and has a metric counts, and if none has
    balanced braces, what lies between the outermost ones.
    """
    bare = F.regexp_replace(F.regexp_replace(F.coalesce(response, F.lit("")), r"(?s)<think>.*?</think>", ""), "```(?:json)?", "")
    found = F.regexp_extract_all(bare, F.lit(f"(?s)({CANDIDATE})"), F.lit(1))
    found = F.when(F.size(found) > 0, found).otherwise(F.array(F.regexp_extract(bare, r"(?s)(\{.*\})", 1)))
    known = F.filter(found, lambda c: F.coalesce(F.arrays_overlap(F.json_object_keys(c), F.array(*[F.lit(m) for m in METRICS])), F.lit(False)))
    return F.get(known, F.lit(0))


def _number(json: Column, path: str) -> Column:
    return F.get_json_object(json, path).try_cast("double")


def judge_scores(response: Column, no_retrieval: Column) -> Column:
    """struct(answer, reasoning, precision, recall, citation, hallucination), null if the response has no metric.

    Answer is 0 by default, each part of reasoning 3 (their sum is divided by 15), precision and recall 1, citation the
    mean of these, hallucination 0. A metric given as a bare number is the score itself; reasoning then is that number
    too. Without retrieval the citation scores are null.
    """

    def read(j: Column) -> Column:
        bare = {m: _number(j, f"$.{m}") for m in METRICS}
        of = lambda m, k, default: F.coalesce(bare[m], _number(j, f"$.{m}.{k}"), F.lit(default))
        parts = [F.coalesce(bare[METRICS[1]] * 5, _number(j, f"$.{METRICS[1]}.{k}"), F.lit(3.0)) for k in REASONING]
        precision, recall = of(METRICS[2], "precision", 1.0), of(METRICS[2], "recall", 1.0)
        citation = F.coalesce(bare[METRICS[2]], _number(j, f"$.{METRICS[2]}.accuracy"), (precision + recall) / 2)
        cited = lambda c: F.when(~F.coalesce(no_retrieval, F.lit(False)), c)
        return F.struct(of(METRICS[0], "score", 0.0).alias("answer"), ((parts[0] + parts[1] + parts[2]) / 15).alias("reasoning"), cited(precision).alias("precision"), cited(recall).alias("recall"), cited(citation).alias("citation"), of(METRICS[3], "rate", 0.0).alias("hallucination"))

    return T.let(judged(response), lambda j: F.when(j.isNotNull(), read(j)))


def retried(first: Column, second: Column, no_retrieval: Column) -> Column:
    """judge_scores of the first response, else of the second, else the scores of a failure: answer 0, hallucination 1, the others null."""
    none = F.lit(None).cast("double")
    failed = F.struct(F.lit(0.0).alias("answer"), none.alias("reasoning"), none.alias("precision"), none.alias("recall"), none.alias("citation"), F.lit(1.0).alias("hallucination"))
    return F.coalesce(judge_scores(first, no_retrieval), judge_scores(second, no_retrieval), failed)


def reasoning_only(response: Column) -> Column:
    """The older judge's score: the mean of three ratings over 5, null unless the reply has all of them as numbers."""
    body = F.regexp_extract(F.coalesce(response, F.lit("")), r"(?s)(\{.*\})", 1)
    return T.let(body, lambda j: (_number(j, f"$.{REASONING[0]}") + _number(j, f"$.{REASONING[1]}") + _number(j, f"$.{REASONING[2]}")) / 15)


def calibration(judge: DataFrame, human: DataFrame, ratings: tuple[str, ...] = REASONING, key: str = "sample_id") -> DataFrame:
    """(rating, n, agreement, kappa) for each rating over ids that both have, ratings rounded half to even."""
    both = judge.select(key, *[F.bround(c, 0).cast("int").alias(f"j_{c}") for c in ratings]).join(human.select(key, *[F.bround(c, 0).cast("int").alias(f"h_{c}") for c in ratings]), key)
    each = both.select(F.explode(F.array(*[F.struct(F.lit(c).alias("rating"), F.col(f"j_{c}").alias("a"), F.col(f"h_{c}").alias("b")) for c in ratings])).alias("x")).select("x.*").where("a is not null and b is not null")
    cells = each.groupBy("rating", "a", "b").agg(F.count(F.lit(1)).alias("n"))
    total = cells.groupBy("rating").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0)).alias("same"))
    x, y = cells.groupBy("rating", "a").agg(F.sum("n").alias("x")), cells.groupBy("rating", F.col("b").alias("a")).agg(F.sum("n").alias("y"))
    chance = x.join(y, ["rating", "a"]).groupBy("rating").agg(F.sum(F.col("x") * F.col("y")).alias("both"))
    k = total.join(chance, "rating", "left").select("rating", "n", (F.col("same") / F.col("n")).alias("po"), (F.coalesce("both", F.lit(0)) / (F.col("n") * F.col("n"))).alias("pe"))
    return k.select("rating", "n", F.round("po", 6).alias("agreement"), F.round(F.when(F.col("pe") < 1, (F.col("po") - F.col("pe")) / (1 - F.col("pe"))), 6).alias("kappa"))


def compound_terms(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(COMPOUND_TERM), F.lit(0)), lambda t: F.lower(T.strip(t)))


def invented(rows: DataFrame, vocabulary: DataFrame, key: str, text: str = "text", term: str = "term") -> DataFrame:
    """(key, invented) of rows: whether the text has a compound term that is not in the vocabulary. Terms are joined, so
    the vocabulary may be of any size."""
    terms = rows.select(key, F.explode(F.array_distinct(compound_terms(F.col(text)))).alias("__term"))
    new = terms.join(vocabulary.select(F.lower(F.col(term)).alias("__term")).distinct(), "__term", "left_anti").select(key, F.lit(True).alias("__new")).distinct()
    return rows.select(key).distinct().join(new, key, "left").select(key, F.coalesce("__new", F.lit(False)).alias("invented"))


def entailment(logits: Column, at: int) -> Column:
    """The softmax probability of one class of an array of logits, steady for large ones."""
    most = F.array_max(logits)
    each = F.transform(logits, lambda x: F.exp(x - most))
    return F.get(each, F.lit(at)) / F.aggregate(each, F.lit(0.0), lambda s, x: s + x)


def flagged_share(sentences: DataFrame, probability: Column, invented_: Column, key: str, threshold: float = 0.5) -> DataFrame:
    """(key, n, rate): the share of sentences whose entailment is below the threshold or which hold an invented term."""
    flag = F.coalesce(probability < threshold, F.lit(False)) | F.coalesce(invented_, F.lit(False))
    return sentences.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.round(F.least(F.avg(flag.cast("double")), F.lit(1.0)), 6).alias("rate"))


def similarity(hypothesis: Column, reference: Column, score: Callable[[Column, Column], Column] = scores.lexical_f1) -> Column:
    """The plugged-in score, by default lexical F1; 0 for a blank hypothesis, for which the score is not asked."""
    blank = T.strip(F.coalesce(hypothesis, F.lit(""))) == ""
    return F.when(blank, F.lit(0.0)).otherwise(score(hypothesis, reference))


def best_choice(conditional: Column, unconditional: Column, lengths: Column | None = None, pmi: bool = True) -> Column:
    """Position (from 0) of the choice of largest score, the first of equals: log-probabilities, over the lengths if given,
    less those without the question if pmi."""
    per = (lambda c: F.zip_with(c, lengths, lambda x, n: x / F.greatest(n, F.lit(1)))) if lengths is not None else (lambda c: c)
    score = F.zip_with(per(conditional), per(unconditional), lambda a, b: a - b) if pmi else per(conditional)
    return T.let(score, lambda s: F.array_position(s, F.array_max(s)) - 1)


def clean_choices(choices: Column) -> Column:
    """Stripped choices that are not blank; an error if none is left."""
    kept = F.filter(F.transform(choices, T.strip), lambda c: c != "")
    return F.when(F.size(kept) > 0, kept).otherwise(F.raise_error(F.lit("no choices")).cast("array<string>"))
