"""Structured Streaming forms: evaluation triggers and gate decisions by tokens, and windowed counts with late data."""

from __future__ import annotations

import datetime
import math
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from siltstone.operators import gates
from siltstone.operators.gates import trigger_stream

__all__ = ["EvaluationLoop", "decided", "evaluations", "trigger_stream", "windowed_counts"]

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUTPUT = "run long, at timestamp, kind string, tokens long, slow boolean, perplexity double, gain double, plateau boolean, qa double, cloze double"

_OUT = Row(*(x.split()[0] for x in OUTPUT.split(", ")))


class EvaluationLoop(StatefulProcessor):
    """Of one run: when it is evaluated, what is measured then, and whether it has come to rest.

    Steps add tokens. An evaluation is due when the tokens since the last one reach ``interval``; the slow probe is measured with it
    if the tokens since its own last time reach ``slow_interval``, and else keeps its value. gain is the fall of the perplexity in percent since
    the last evaluation, plateau says that the last ``window`` gains all lie below ``threshold``. After ``idle_ms`` of event time without a step
    a timer tells that the run is idle. State is one value (tokens, marks, the slow probe's value, the last perplexities), so that a batch reads and
    writes it once for each run.
    """

    def __init__(self, interval: int, slow_interval: int, threshold: float = 2.0, window: int = 2, idle_ms: int | None = None):
        self.interval, self.slow_interval, self.threshold, self.window, self.idle_ms = interval, slow_interval, threshold, window, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        past = ", ".join(f"past{i} double" for i in range(self.window + 1))
        self.marks = handle.getValueState("marks", f"tokens long, evaluated long, slow long, cloze double, {past}")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        steps = sorted(rows, key=lambda r: (r["at"] is None, r["at"], r["seq"] is None, r["seq"]))
        tokens, evaluated, slow, cloze, *past = self.marks.get() or (0, 0, 0, None)
        past = [p for p in past if p is not None]
        for step in steps:
            tokens += step["tokens"] or 0
            if tokens - evaluated < self.interval:
                continue
            evaluated = tokens
            is_slow = tokens - slow >= self.slow_interval
            if is_slow:
                slow, cloze = tokens, cloze if _number(step["cloze"]) is None else step["cloze"]
            perplexity = math.nan if step["perplexity"] is None else step["perplexity"]
            gain = None if not past else (past[-1] - perplexity) / past[-1] * 100 if past[-1] > 0 else 0.0
            past = [*past, perplexity][-self.window - 1 :]
            gains = [(a - b) / a * 100 if a > 0 else 0.0 for a, b in zip(past, past[1:])]
            rests = len(gains) >= self.window and max(gains[-self.window :]) < self.threshold
            yield _OUT(key[0], step["at"], "evaluation", tokens, is_slow, _number(perplexity), _number(gain), rests, _number(step["qa"]), cloze)
        self.marks.update((tokens, evaluated, slow, cloze, *past, *[None] * (self.window + 1 - len(past))))
        if self.idle_ms is not None:
            for timer in self.handle.listTimers():
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(int(max(r["at"] for r in steps if r["at"] is not None).timestamp() * 1000) + self.idle_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        tokens, _, _, cloze, *_ = self.marks.get()
        at = datetime.datetime.fromtimestamp(expiredTimerInfo.getExpiryTimeInMs() / 1000)
        yield _OUT(key[0], at, "idle", tokens, False, None, None, None, None, cloze)

    def close(self) -> None:
        pass


def _number(x: float | None) -> float | None:
    """None for what is no number."""
    return None if x is None or math.isnan(x) else x


def evaluations(steps: DataFrame, interval: int, slow_interval: int, threshold: float = 2.0, window: int = 2, idle: str | None = None, idle_ms: int = 0) -> DataFrame:
    """Evaluations of training steps (run, seq, at, tokens, perplexity, qa, cloze) by EvaluationLoop, of a table or a stream.

    Steps of a run are taken by at, then seq, within a batch of the stream; they have to come in order from batch to batch. idle, a
    watermark's delay, turns the timer on for streams. The session's state store becomes RocksDB, which the state types need.
    """
    steps.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    steps.sparkSession.streams.active  # noqa: B018  (the manager brings up what places state, which a table needs too)
    timed = idle is not None and steps.isStreaming
    loop = EvaluationLoop(interval, slow_interval, threshold, window, idle_ms if timed else None)
    d = steps.select("run", "seq", "at", "tokens", "perplexity", "qa", "cloze")
    d = d.withWatermark("at", idle) if timed else d
    return d.groupBy("run").transformWithState(loop, OUTPUT, "append", "eventTime" if timed else "none")


def decided(rows: DataFrame, corpus: int, cap: int, thresholds: tuple[float, float, float] = (0.6, 0.5, 0.5)) -> DataFrame:
    """evaluations with the gate decision of each; idle rows have none."""
    said = gates.decision(F.col("qa"), F.col("plateau"), F.col("cloze"), F.lit(None).cast("double"), F.col("tokens"), F.lit(corpus), F.lit(cap), thresholds)
    return rows.withColumn("decision", F.when(F.col("kind") == "evaluation", said))


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "10 minutes", at: str = "ts") -> DataFrame:
    """(start, event_type, n, value) in tumbling windows; rows later than the watermark are left out of a stream."""
    if events.isStreaming:
        events = events.withWatermark(at, late)
    w = events.groupBy(F.window(at, width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("value"))
    return w.select(F.col("window.start").alias("start"), "event_type", "n", "value")
