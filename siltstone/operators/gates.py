"""Evaluation histories: improvements, plateaus, carried values, best checkpoints and gate decisions."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def improvement(history: DataFrame, run: str = "run", at: str = "eval_id", metric: str = "perplexity") -> DataFrame:
    """history with gain: percent by which the metric fell since the last point; 0 where that was not positive."""
    before = F.lag(metric).over(W.partitionBy(run).orderBy(at))
    return history.withColumn("gain", F.when(before > 0, (before - F.col(metric)) / before * 100).when(before.isNotNull(), 0.0))


def plateau(history: DataFrame, threshold: float = 2.0, window: int = 2, run: str = "run", at: str = "eval_id", metric: str = "perplexity") -> DataFrame:
    """history with gain and plateau: the last ``window`` gains exist and are all below threshold (losses too)."""
    last = W.partitionBy(run).orderBy(at).rowsBetween(-(window - 1), 0)
    h = improvement(history, run, at, metric)
    return h.withColumn("plateau", (F.count("gain").over(last) == window) & (F.max("gain").over(last) < threshold))


def carry_forward(history: DataFrame, metric: str, run: str = "run", at: str = "eval_id") -> DataFrame:
    """history with <metric>_carried: the last value that was measured, 0 before any."""
    w = W.partitionBy(run).orderBy(at).rowsBetween(W.unboundedPreceding, 0)
    return history.withColumn(f"{metric}_carried", F.coalesce(F.last(metric, ignorenulls=True).over(w), F.lit(0.0)))


def best(history: DataFrame, order: list[Column], run: str = "run", at: str = "eval_id") -> DataFrame:
    """Of each run the first row by order, ties by evaluation."""
    return history.withColumn("rank", F.row_number().over(W.partitionBy(run).orderBy(*order, at))).where("rank = 1").drop("rank")


def keep_last(history: DataFrame, n: int, run: str = "run", at: str = "eval_id") -> DataFrame:
    return history.withColumn("rank", F.row_number().over(W.partitionBy(run).orderBy(F.desc(at)))).where(F.col("rank") <= n).drop("rank")


def decision(qa: Column, ppl_plateau: Column, cloze: Column, concept: Column, tokens: Column, corpus: Column, cap: Column, thresholds: tuple[float, float, float] = (0.6, 0.5, 0.5)) -> Column:
    """CONVERGED, CONTINUE or HARD_CAP. Both primary gates and one secondary must hold; a disabled gate is a null
    column. Below the cap a whole pass over the corpus is needed as well."""
    primary = F.coalesce(qa >= thresholds[0], F.lit(True)) & F.coalesce(ppl_plateau, F.lit(True))
    none = cloze.isNull() & concept.isNull()
    second = none | F.coalesce(cloze >= thresholds[1], F.lit(False)) | F.coalesce(concept >= thresholds[2], F.lit(False))
    done = primary & second
    return F.when(tokens >= cap, F.when(done, "CONVERGED").otherwise("HARD_CAP")).when(done & (tokens >= corpus), "CONVERGED").otherwise("CONTINUE")


def remediation(qa: Column, low: float = 0.4, threshold: float = 0.6) -> Column:
    return F.when(qa < low, "audit").when(qa < threshold, "larger_model").otherwise("risk_flag")


def triggers(events: DataFrame, interval: float, run: str = "run", at: str = "at", tokens: str = "tokens") -> DataFrame:
    """events with triggered: tokens since the last trigger of the run reach the interval; the count then restarts."""

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        held, out = 0.0, []
        for n in pdf.sort_values(at)[tokens]:
            held += n or 0
            out.append(held >= interval)
            held = 0.0 if out[-1] else held
        return pdf.sort_values(at).assign(triggered=out)

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in events.schema.fields)
    return events.groupBy(run).applyInPandas(fold, f"{kinds}, triggered boolean")


def trigger_stream(events: DataFrame, interval: float, run: str = "run", tokens: str = "tokens") -> DataFrame:
    """The same over a stream, state being the tokens since the last trigger: (run, n_triggers, held) by batch."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        held, fired = state.get[0] if state.exists else 0.0, 0
        for pdf in batches:
            for n in pdf[tokens].fillna(0):
                held += n
                if held >= interval:
                    held, fired = 0.0, fired + 1
        state.update((held,))
        yield pd.DataFrame({"run": [key[0]], "n_triggers": [fired], "held": [held]})

    return events.groupBy(run).applyInPandasWithState(step, "run long, n_triggers int, held double", "held double", "append", "NoTimeout")
