"""Phase gates, risk reports, status texts, sample normalisation, checks of inputs and parameters."""

from __future__ import annotations

import dataclasses

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def retrieval_gates(routed: DataFrame, least_share: float, most_rate: float = 0.30) -> DataFrame:
    """One row over decisions (cluster, no_retrieval): grounded, not_grounded, enough (grounded reach int(share * all)),
    clusters_ok (no cluster's rate above most_rate) and status."""
    rates = routed.groupBy(F.coalesce("cluster", F.lit("unknown")).alias("cluster")).agg(F.count_if("no_retrieval").alias("without"), F.count(F.lit(1)).alias("n"))
    one = rates.agg(F.coalesce(F.sum(F.col("n") - F.col("without")), F.lit(0)).alias("grounded"), F.coalesce(F.sum("without"), F.lit(0)).alias("not_grounded"), F.coalesce(F.bool_and(F.col("without") / F.col("n") <= most_rate), F.lit(True)).alias("clusters_ok"))
    enough = F.col("grounded") >= F.floor(least_share * (F.col("grounded") + F.col("not_grounded")))
    return one.select("grounded", "not_grounded", enough.alias("enough"), "clusters_ok", F.when(enough & F.col("clusters_ok"), "complete").otherwise("incomplete").alias("status"))


def active(assignments: DataFrame) -> DataFrame:
    """(cluster_label, n) of assignments that were not dropped as noise."""
    return assignments.where(~F.coalesce(F.col("assigned_by") == "dropped", F.lit(False))).groupBy("cluster_label").agg(F.count(F.lit(1)).alias("n"))


def as_map(rows: DataFrame, key: str, value: str, *group: str) -> DataFrame:
    """A map from key to value for each group: for reports over few keys."""
    made = F.map_from_entries(F.sort_array(F.collect_list(F.struct(key, value)))).alias("map")
    return rows.groupBy(*group).agg(made)


def model_matches(pretokenized: Column, current: Column, vocab: Column, current_vocab: Column) -> Column:
    """Whether a token table fits a model: one name, folder and signs aside, holds the other, and the vocabularies are of one
    size if both are known."""
    bare = lambda c: F.regexp_replace(F.lower(F.regexp_extract(F.coalesce(c, F.lit("")), "([^/]*)/?$", 1)), "[-_.]", "")
    a, b = bare(pretokenized), bare(current)
    named = (a != "") & (b != "") & (a.contains(b) | b.contains(a))
    return named & F.coalesce((vocab <= 0) | (vocab == current_vocab), F.lit(True))


def normal_sample(samples: DataFrame, seq: str) -> DataFrame:
    """(sample_id, cluster, question, answer, retrieved_context) of evaluation samples: the answer is choices[answer_idx] if
    both are there, else answer, else empty; the id sample_{seq} by default; the cluster its name, else its id."""
    has = lambda c: F.col(c) if c in samples.columns else F.lit(None)
    chosen = F.when(has("choices").isNotNull() & has("answer_idx").isNotNull(), F.get(has("choices").cast("array<string>"), has("answer_idx").cast("int")))
    context = F.array_join(F.coalesce(has("chunks").cast("array<string>"), F.array().cast("array<string>")), "\n\n")
    return samples.select(F.coalesce(has("sample_id").cast("string"), F.concat(F.lit("sample_"), F.col(seq))).alias("sample_id"), F.coalesce(has("cluster").cast("string"), has("cluster_id").cast("string")).alias("cluster"), "question", F.coalesce(chosen, has("answer").cast("string"), F.lit("")).alias("answer"), context.alias("retrieved_context"))


def with_fallback(samples: DataFrame, traces: DataFrame, key: str = "sample_id") -> DataFrame:
    """samples with the trace of their key and fallback. If no sample at all has one, each takes the trace whose place among
    the sorted keys is the MD5 of its id, as a number, modulo their count.

    traces: key, trace; one row a key. Places come from counts of key prefixes, so keys are never sorted in one task.
    """
    from siltstone.operators import probes

    met = samples.join(traces.select(key, "trace"), key, "left")
    if not samples.join(traces.select(key), key, "left_semi").isEmpty() or traces.isEmpty():
        return met.withColumn("fallback", F.lit(False))
    n = traces.count()
    placed = ranked(traces.select(F.col(key).alias("__key"), "trace"), "__key").select("__rank", "trace")
    return samples.withColumn("__rank", probes.hash_bucket(F.col(key), F.lit(n))).join(placed, "__rank").drop("__rank").withColumn("fallback", F.lit(True))


def ranked(rows: DataFrame, key: str) -> DataFrame:
    """rows with __rank, from 0, in the order of a text key: range partitions are counted, and each counts on from the ones before."""
    from pyspark.sql import Window as W

    from siltstone.sources.io import shared_path

    path = shared_path(rows.sparkSession, "ranked")
    # Written, since the bounds of ranges are sampled anew if a lost part is made again.
    rows.repartitionByRange(F.col(key)).withColumn("__part", F.spark_partition_id()).write.parquet(path)
    d = rows.sparkSession.read.parquet(path)
    sizes = d.groupBy("__part").agg(F.count(F.lit(1)).alias("__size"))
    before = sizes.select("__part", (F.sum("__size").over(W.orderBy("__part").rowsBetween(W.unboundedPreceding, 0)) - F.col("__size")).alias("__before"))
    inside = F.row_number().over(W.partitionBy("__part").orderBy(key)) - 1
    return d.withColumn("__inside", inside).join(before, "__part").withColumn("__rank", (F.col("__before") + F.col("__inside")).cast("long")).drop("__part", "__inside", "__before")


# Names of the actions, the most urgent first.
ACTIONS = ["CORPUS_QUALITY_AUDIT", "INCREASE_MODEL_SIZE", "PROCEED_WITH_RISK_FLAG"]


def risk_report(qa: Column, gain: Column, cloze: Column, concept: Column, qa_least: float = 0.6, qa_low: float = 0.4, gain_most: float = 2.0, cloze_least: float = 0.5, concept_least: float = 0.5) -> Column:
    """struct(failed array<string>, priority, action): each failed gate with its gap, and what to do first.

    gain is the last fall of perplexity in percent; null: too few evaluations. A disabled probe's column is null. The
    secondary gate fails if neither probe that is on reaches its threshold.
    """
    text = lambda c, digits=4: F.format_string(f"%.{digits}f", c.cast("double"))
    fails = [
        F.when(qa < qa_least, F.concat(F.lit("qa "), text(qa), F.lit(f" < {qa_least} (gap "), text(F.lit(qa_least) - qa), F.lit(")"))),
        F.when(gain.isNull(), F.lit("perplexity: too few evaluations")).when(gain >= gain_most, F.concat(F.lit("perplexity still falls by "), text(gain, 2), F.lit("%"))),
        F.when((cloze.isNotNull() | concept.isNotNull()) & ~F.coalesce(cloze >= cloze_least, F.lit(False)) & ~F.coalesce(concept >= concept_least, F.lit(False)), F.concat(F.lit("secondary: "), F.concat_ws(", ", F.concat(F.lit("cloze "), text(cloze)), F.concat(F.lit("concept "), text(concept))))),
    ]
    failed = F.filter(F.array(*fails), lambda x: x.isNotNull())
    priority = F.when(qa < qa_low, 1).when(qa < qa_least, 2).otherwise(3)
    action = F.element_at(F.array(*[F.lit(a) for a in ACTIONS]), priority)
    return F.struct(failed.alias("failed"), priority.alias("priority"), action.alias("action"))


def status_text(run: Column, tokens: Column, decision: Column, failed: Column) -> Column:
    """A line a run: its tokens, the decision, and the gates that fail."""
    gates = F.when(F.size(failed) > 0, F.array_join(failed, ", ")).otherwise("none")
    return F.format_string("run %s | tokens %s | %s | failed gates: %s", run.cast("string"), tokens.cast("string"), decision, gates)


def require_inputs(spark: SparkSession, wanted: dict[str, str]) -> None:
    """Raise once, naming every input (name to path) that is not there, in any store that Spark knows."""
    missing = []
    for name, path in wanted.items():
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
            missing.append(f"{name} ({path})")
    if missing:
        raise FileNotFoundError(f"missing inputs: {', '.join(missing)}")


@dataclasses.dataclass(frozen=True)
class Parameters:
    """Settings of a run; from_texts reads them from texts, where "auto" or nothing leaves the default."""

    chunk_size: int = 512
    overlap: int = 64
    val_share: float = 0.05
    jaccard: float = 0.85
    permutations: int = 128
    bands: int = 16
    top_k: int = 5
    relevance: float = 0.65
    dev: float = 0.7
    val: float = 0.2
    sealed: float = 0.1

    def __post_init__(self):
        wrong = [f"{n} must be between 0 and 1" for n in ("val_share", "jaccard", "relevance", "dev", "val", "sealed") if not 0 <= getattr(self, n) <= 1]
        wrong += [f"{n} must be positive" for n in ("chunk_size", "permutations", "bands", "top_k") if getattr(self, n) <= 0]
        if self.overlap < 0:
            wrong.append("overlap must not be negative")
        if self.bands > 0 and self.permutations % self.bands:
            wrong.append("permutations must be a multiple of bands")
        if abs(self.dev + self.val + self.sealed - 1) > 1e-9:
            wrong.append("dev, val and sealed must sum to 1")
        if wrong:
            raise ValueError("; ".join(wrong))

    @classmethod
    def from_texts(cls, texts: dict[str, str]) -> Parameters:
        known = {f.name: type(f.default) for f in dataclasses.fields(cls)}
        if unknown := sorted(set(texts) - set(known)):
            raise ValueError(f"unknown parameters: {', '.join(unknown)}")
        return cls(**{k: known[k](v) for k, v in texts.items() if v.strip().lower() not in ("", "auto")})
