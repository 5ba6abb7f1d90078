"""The trace store: file metadata, ingestion with defaults, sync, listings, comparisons with all columns and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siltstone.functions import text as T
from siltstone.operators import traces

# Probes, other names of categories, and the store's columns.
PROBES = ("cloze", "qa", "concept")
CATEGORY_NAMES = {"cloze": "cloze", "cloze probe": "cloze", "qa": "qa", "qa probe": "qa", "concept": "concept", "concept probe": "concept"}
STORE_SCHEMA = "probe string, run_id string, checkpoint int, checkpoint_name string, seq_num int, prompt string, target_answer string, model_output string, matching_score double, result string, category string, error_category string, notes string, ts string"


def category_name(category: Column) -> Column:
    """A probe category as the name of its folder: an alias, else lower case with underscores."""
    plain = F.lower(T.strip(category))
    out = F.replace(plain, F.lit(" "), F.lit("_"))
    for alias, name in CATEGORY_NAMES.items():
        out = F.when(plain == alias, F.lit(name)).otherwise(out)
    return out


def probe_name(probe: Column) -> Column:
    """cloze, qa or concept (also for retrieval) if the name holds it, in this order; else the name in lower case."""
    plain = F.lower(T.strip(probe))
    return F.when(plain.contains("cloze"), "cloze").when(plain.contains("qa"), "qa").when(plain.contains("concept") | plain.contains("retrieval"), "concept").otherwise(plain)


def path_metadata(path: Column) -> Column:
    """struct(probe, run_id, checkpoint, checkpoint_name) of a trace file.

    Layouts: run/probe/eval_0001.csv, run/probe_eval_0001.csv and probe/run_eval_0001.csv. By default the probe is qa, the
    run default_run and the checkpoint 0; a file without a number is named by its stem.
    """
    parts = F.split(path, "/")
    at = lambda i: F.coalesce(F.get(parts, F.size(parts) - 1 - i), F.lit(""))
    stem = F.regexp_replace(at(0), r"\.[^.]*$", "")
    folder, above = F.lower(at(1)), F.lower(at(2))
    by_folder = folder.isin(*PROBES)
    in_stem = F.lower(stem).rlike("|".join(PROBES))
    named = F.lit(None).cast("string")
    for p in reversed(PROBES):
        named = F.when(F.lower(stem).contains(p), F.lit(p)).otherwise(named)
    probe = F.when(by_folder, folder).otherwise(F.coalesce(named, F.lit("qa")))
    roots = ("traces", "logs", ".", "")
    run = F.when(by_folder & ~above.isin(*roots), at(2)).when(~by_folder & in_stem & ~folder.isin(*roots), at(1))
    numbered = stem.contains("eval_")
    tail = F.regexp_extract(stem, r"eval_((?:(?!eval_).)*)$", 1)
    prefix = F.nullif(F.rtrim(F.regexp_extract(stem, r"^(.*?)eval_", 1), F.lit("_")), F.lit(""))
    run = F.coalesce(run, F.when(numbered, prefix), F.lit("default_run"))
    number = F.when(numbered, F.coalesce(tail.try_cast("int"), F.lit(0))).otherwise(0)
    return F.struct(probe.alias("probe"), run.alias("run_id"), number.alias("checkpoint"), F.when(numbered, F.concat(F.lit("eval_"), tail)).otherwise(stem).alias("checkpoint_name"))


def ingested(rows: DataFrame, now: str, place: str = "place") -> DataFrame:
    """Rows of trace files (all text) as the store's, with defaults: a bad seq_num is the row's place (from 0) plus one, a
    bad score 0, the error category Pass or Fail by the result, an empty time ``now``. Empty cells stay empty."""
    text = lambda c: F.coalesce(F.col(c), F.lit("")) if c in rows.columns else F.lit("")
    result = F.initcap(F.lower(T.strip(F.coalesce(F.col("result"), F.lit("Fail")))))
    default = F.when(result == "Pass", "Pass").otherwise("Fail")
    made = {
        "seq_num": F.coalesce(F.col("seq_num").try_cast("int"), (F.col(place) + 1).cast("int")),
        "prompt": text("prompt"), "target_answer": text("target_answer"), "model_output": text("model_output"),
        "matching_score": F.round(F.coalesce(F.col("matching_score").try_cast("double"), F.lit(0.0)), 4),
        "result": result, "category": text("category"),
        "error_category": F.coalesce(F.nullif(T.strip(text("error_category")), F.lit("")), default),
        "notes": text("notes"), "ts": F.coalesce(F.nullif(text("timestamp"), F.lit("")), F.lit(now)),
    }
    return rows.select(*[c for c in ("probe", "run_id", "checkpoint", "checkpoint_name", "batch") if c in rows.columns], *[c.alias(n) for n, c in made.items()])


def newest_first(files: DataFrame, modified: str = "modified", name: str = "file") -> DataFrame:
    """files with batch, from 0 for the newest: by time of change, then name, both descending. A window over one row a file."""
    return files.withColumn("batch", F.row_number().over(W.orderBy(F.desc(modified), F.desc(name))) - 1)


def synced(store: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(store with the files' rows merged in, rows by probe). Files are applied newest first, so of rows with one key the
    oldest file's stay; rows carry batch as newest_first numbers it."""
    return traces.upsert(store, rows.select(*store.columns, "batch")), rows.groupBy("probe").agg(F.count(F.lit(1)).alias("n"))


def annotated(store: DataFrame, key: tuple, category: str, notes: str) -> tuple[DataFrame, bool]:
    """(store with the note made, whether a row matched)."""
    hit = store.where((F.col("run_id") == key[0]) & (F.col("checkpoint") == key[1]) & (F.col("seq_num") == key[2]))
    return traces.annotate(store, key, category, notes), not hit.isEmpty()


def scan(store: DataFrame, run_id: str | None = None, checkpoint: int | None = None) -> DataFrame:
    """The store's rows by seq_num, of one run and checkpoint if given."""
    out = store
    if run_id is not None:
        out = out.where(F.col("run_id") == run_id)
    if checkpoint is not None:
        out = out.where(F.col("checkpoint") == checkpoint)
    return out.orderBy("seq_num", "run_id", "checkpoint")


def run_checkpoints(store: DataFrame, run_id: str | None = None) -> DataFrame:
    """(run_id, label, checkpoint, checkpoint_name, start, n), newest run and checkpoint first, of one run if given."""
    of = store if run_id is None else store.where(F.col("run_id") == run_id)
    g = of.groupBy("run_id", "checkpoint", "checkpoint_name").agg(F.min("ts").alias("start"), F.count(F.lit(1)).alias("n"))
    return g.select("run_id", traces.run_label(F.col("run_id")).alias("label"), "checkpoint", "checkpoint_name", "start", "n").orderBy(F.desc("run_id"), F.desc("checkpoint"), "checkpoint_name")


# What a missing side shows.
NO_BASE, NO_TARGET, NO_RESULT = "(No baseline available)", "(No checkpoint data)", "N/A"
TEXTS = ("prompt", "target_answer", "model_output", "result", "category")


def compared(base: DataFrame, target: DataFrame, *more: str) -> DataFrame:
    """Two sets of rows side by side by seq_num (and the columns ``more``): base and target fields, what to display, and
    what changed.

    Where a whole side is empty, delta_status tells so for every row (Single Checkpoint or Baseline Only) and the other
    side holds fixed texts; with ``more``, a side is empty if its group is. Sides are judged by a count a group.
    """
    keys = [*more, "seq_num"]
    side = lambda d, s: d.select(*keys, *[F.col(c).alias(f"{c}_{s}") if c in d.columns else F.lit("").alias(f"{c}_{s}") for c in (*TEXTS, "error_category", "notes")], F.col("matching_score").alias(f"matching_score_{s}"), F.lit(True).alias(f"in_{s}"))
    m = side(base, "base").join(side(target, "target"), keys, "full_outer")
    if more:
        there = m.groupBy(*more).agg(F.max("in_base").alias("any_base"), F.max("in_target").alias("any_target"))
        m = m.join(there, list(more))
    else:
        m = m.crossJoin(F.broadcast(m.agg(F.max("in_base").alias("any_base"), F.max("in_target").alias("any_target"))))  # one row
    no_base, no_target = F.col("any_base").isNull(), F.col("any_target").isNull()
    fill = {f"{c}_{s}": F.coalesce(f"{c}_{s}", F.lit("")) for c in TEXTS for s in ("base", "target")} | {f"matching_score_{s}": F.coalesce(f"matching_score_{s}", F.lit(0.0)) for s in ("base", "target")}
    m = m.withColumns(fill)
    shown = lambda c: F.when(F.col(f"{c}_target") != "", F.col(f"{c}_target")).otherwise(F.col(f"{c}_base")).alias(f"{c}_display")
    before, after = (F.initcap(F.lower(T.strip(F.col(f"result_{s}")))) for s in ("base", "target"))
    status = F.when((before == "Fail") & (after == "Pass"), "Improved").when((before == "Pass") & (after == "Fail"), "Regressed").when(after == "Pass", "Unchanged Pass").when(after == "Fail", "Unchanged Fail").otherwise("Unchanged")
    one_sided = lambda both: F.when(no_base, F.lit("Single Checkpoint")).when(no_target, F.lit("Baseline Only")).otherwise(both)
    put = lambda c, s, missing, text: F.when(missing, F.lit(text)).otherwise(F.col(f"{c}_{s}")).alias(f"{c}_{s}")
    changed = F.when(no_base, True).when(no_target, False).otherwise(T.strip(F.col("model_output_base")) != T.strip(F.col("model_output_target")))
    either = lambda c: F.coalesce(F.when(no_target, F.col(f"{c}_base")).otherwise(F.col(f"{c}_target")), F.lit("")).alias(f"{c}_target")
    return m.select(
        *keys, shown("prompt"), shown("target_answer"), shown("category"),
        put("model_output", "base", no_base, NO_BASE), put("model_output", "target", no_target, NO_TARGET),
        put("result", "base", no_base, NO_RESULT), put("result", "target", no_target, NO_RESULT),
        "matching_score_base", "matching_score_target", either("error_category"), either("notes"),
        changed.alias("is_output_changed"), F.when(no_base | no_target, False).otherwise(before != after).alias("is_result_changed"), one_sided(status).alias("delta_status"),
    )


def consecutive(store: DataFrame) -> DataFrame:
    """Every checkpoint of every run beside the one that follows it: compared() by run_id and checkpoint, the later one's."""
    known = store.select("run_id", "checkpoint").distinct()
    later = F.lead("checkpoint").over(W.partitionBy("run_id").orderBy("checkpoint"))  # a row a checkpoint
    nexts = known.withColumn("later", later).where("later is not null")
    base = store.join(nexts, ["run_id", "checkpoint"]).drop("checkpoint").withColumnRenamed("later", "checkpoint")
    target = store.join(nexts.select("run_id", F.col("later").alias("checkpoint")), ["run_id", "checkpoint"], "left_semi")
    return compared(base, target, "run_id", "checkpoint")


def summary(base: DataFrame, target: DataFrame) -> DataFrame:
    """One row: total, changed, base_pass_rate, target_pass_rate and delta_rate in percent, to one digit. The total is the
    target's rows, or the base's if it has none."""
    passed = F.initcap(F.lower(T.strip(F.coalesce("result", F.lit(""))))) == "Pass"
    of = lambda d, s: d.agg(F.count(F.lit(1)).alias(f"n_{s}"), F.count_if(passed).alias(f"p_{s}"))
    changed = compared(base, target).agg(F.count_if("is_output_changed").alias("changed"))
    one = of(base, "base").crossJoin(of(target, "target")).crossJoin(changed)  # one row each
    rate = lambda s: F.when(F.col(f"n_{s}") > 0, 100.0 * F.col(f"p_{s}") / F.col(f"n_{s}")).otherwise(0.0)
    return one.select(F.when(F.col("n_target") > 0, F.col("n_target")).otherwise(F.col("n_base")).alias("total"), "changed", F.round(rate("base"), 1).alias("base_pass_rate"), F.round(rate("target"), 1).alias("target_pass_rate"), F.round(rate("target") - rate("base"), 1).alias("delta_rate"))


def filtered(rows: DataFrame, status: str | None = None, category: str | None = None, error: str | None = None, pattern: str | None = None, changed_only: bool = False) -> DataFrame:
    """compared() rows by status, category and error category (equal), a pattern in prompt, answer or output of the target
    (any case), and whether the output changed."""
    out = rows
    for column, value in (("delta_status", status), ("category_display", category), ("error_category_target", error)):
        if value is not None:
            out = out.where(F.col(column) == value)
    if pattern:
        hit = [F.col(c).rlike(f"(?i){pattern}") for c in ("prompt_display", "target_answer_display", "model_output_target")]
        out = out.where(hit[0] | hit[1] | hit[2])
    return out.where("is_output_changed") if changed_only else out


def unrolled_calls(calls: DataFrame) -> DataFrame:
    """Model calls (eval_num, category, seq_start, ts, function, prompts, outputs, parameters) as rows: one for each prompt if
    there are as many outputs, numbered from seq_start (1 if null), else one for the whole call."""
    batch = F.coalesce(F.size("prompts") == F.size("outputs"), F.lit(False))
    whole = F.array(F.struct(F.array_join(F.coalesce("prompts", F.array().cast("array<string>")), "\n").alias("prompts"), F.array_join(F.coalesce("outputs", F.array().cast("array<string>")), "\n").alias("outputs")))
    each = F.when(batch, F.arrays_zip("prompts", "outputs")).otherwise(whole)
    rows = calls.select("eval_num", "category", "seq_start", "ts", "function", "parameters", F.posexplode(each).alias("i", "x"))
    return rows.select("eval_num", "category", (F.coalesce("seq_start", F.lit(1)) + F.col("i")).cast("int").alias("seq_num"), "ts", "function", F.col("x.prompts").alias("prompt"), F.col("x.outputs").alias("output"), "parameters")
