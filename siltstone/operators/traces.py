"""The trace store: normalising, upserting, listing, comparing, filtering and annotating probe traces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siltstone.functions import text as T

KEYS = ["run_id", "checkpoint", "seq_num"]


def path_parts(path: Column) -> Column:
    """struct(probe, run_id, eval) of .../{run}/{probe}/eval_0001.csv or the older .../{probe}/{run}_eval_0001.csv."""
    new, old = r"(\d{8}_\d{6})/([^/]+)/eval_(\d+)\.csv$", r"([^/]+)/(\d{8}_\d{6})_eval_(\d+)\.csv$"
    is_new = path.rlike(new)
    pick = lambda a, b: F.when(is_new, F.regexp_extract(path, new, a)).otherwise(F.nullif(F.regexp_extract(path, old, b), F.lit("")))
    return F.struct(pick(2, 1).alias("probe"), pick(1, 2).alias("run_id"), F.try_to_number(pick(3, 3), F.lit("999999")).cast("int").alias("eval"))


def eval_number(name: Column) -> Column:
    return F.coalesce(F.nullif(F.regexp_extract(name, r"eval_(\d+)", 1), F.lit("")).cast("int"), F.lit(999999))


def run_label(run_id: Column) -> Column:
    """YYYYMMDD_HHMMSS as a date and time; other names unchanged."""
    return F.when(run_id.rlike(r"^\d{8}_\d{6}$"), F.regexp_replace(run_id, r"(\d{4})(\d\d)(\d\d)_(\d\d)(\d\d)(\d\d)", "$1-$2-$3 $4:$5:$6")).otherwise(run_id)


def normalised(rows: DataFrame, fallbacks: dict[str, list[str]]) -> DataFrame:
    """Each field from the first of its keys that is not empty; score to four digits, 0 if it is not a number."""
    known = {c.lower() for c in rows.columns}
    out = []
    for field, keys in fallbacks.items():
        found = [F.nullif(F.col(k).cast("string"), F.lit("")) for k in keys if k.lower() in known]
        value = F.coalesce(*found, F.lit(""))
        out.append((F.round(F.coalesce(value.try_cast("double"), F.lit(0.0)), 4) if field == "matching_score" else value).alias(field))
    return rows.select(*out)


def upsert(store: DataFrame, new: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """store with new merged in by run, checkpoint and seq_num, or other keys.

    New data win, but a category set by hand (not null, empty, Pass or Fail) and notes that are not empty stay, and
    so do checkpoint_name and ts of rows already there. Of several new rows with one key the last by ``batch`` wins.
    """
    last = new.withColumn("rank", F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("batch")))).where("rank = 1")
    s = store.select(*[F.col(c).alias(f"s_{c}") for c in store.columns], F.lit(True).alias("there"))
    met = s.join(last, [s[f"s_{k}"] == last[k] for k in keys], "full_outer")
    hand = F.col("s_error_category").isNotNull() & ~F.col("s_error_category").isin("", "Pass", "Fail")
    out = []
    for c in store.columns:
        if c == "error_category":
            v = F.when(hand, F.col("s_error_category"))
        elif c == "notes":
            v = F.nullif("s_notes", F.lit(""))
        elif c in ("checkpoint_name", "ts"):
            v = F.when(F.col("there"), F.col(f"s_{c}"))
        else:
            v = F.lit(None)
        out.append(F.coalesce(v, F.col(c), F.col(f"s_{c}")).alias(c))
    return met.select(*out)


def annotate(store: DataFrame, key: tuple, category: str, notes: str) -> DataFrame:
    """store with category and notes set where the key matches."""
    hit = (F.col("run_id") == key[0]) & (F.col("checkpoint") == key[1]) & (F.col("seq_num") == key[2])
    return store.withColumns({"error_category": F.when(hit, F.lit(category)).otherwise(F.col("error_category")), "notes": F.when(hit, F.lit(notes)).otherwise(F.col("notes"))})


def diff(base: DataFrame, target: DataFrame) -> DataFrame:
    """Two checkpoints side by side by seq_num: changes of output and result, score delta and delta_status."""
    names = ["prompt", "model_output", "result", "matching_score"]
    b = base.select("seq_num", *[F.col(c).alias(f"base_{c}") for c in names])
    t = target.select("seq_num", *[F.col(c).alias(f"target_{c}") for c in names])
    m = b.join(t, "seq_num", "full_outer")
    m = m.withColumns({f"{s}_{c}": F.coalesce(f"{s}_{c}", F.lit(0.0 if c == "matching_score" else "")) for s in ("base", "target") for c in names})
    before, after = (F.initcap(T.strip(F.col(f"{s}_result"))) for s in ("base", "target"))
    status = F.when((before == "Fail") & (after == "Pass"), "Improved").when((before == "Pass") & (after == "Fail"), "Regressed").when(after == "Pass", "Unchanged Pass").when(after == "Fail", "Unchanged Fail").otherwise("Unchanged")
    shown = F.when(F.col("target_prompt") != "", F.col("target_prompt")).otherwise(F.col("base_prompt"))
    return m.select("seq_num", shown.alias("prompt_display"), (T.strip(F.col("base_model_output")) != T.strip(F.col("target_model_output"))).alias("is_output_changed"), (before != after).alias("is_result_changed"), F.round(F.col("target_matching_score") - F.col("base_matching_score"), 4).alias("score_delta"), status.alias("delta_status"))


def summary(compared: DataFrame) -> DataFrame:
    """Rows, rows of changed output, and rows of each status."""
    return compared.groupBy("delta_status").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("is_output_changed").cast("long")).alias("changed"))


def runs(store: DataFrame) -> DataFrame:
    return store.groupBy("run_id").agg(F.countDistinct("checkpoint").alias("checkpoints"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count(F.lit(1)).alias("n"))


def checkpoints(store: DataFrame) -> DataFrame:
    return store.groupBy("run_id", "checkpoint").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg((F.col("result") == "Pass").cast("double")), 6).alias("pass_rate"))


def error_categories(store: DataFrame, defaults: list[str]) -> DataFrame:
    """(priority, category): Pass, Fail, the defaults, then what users added."""
    known = ["Pass", "Fail", *defaults]
    fixed = store.sparkSession.createDataFrame(list(enumerate(known)), "priority int, category string")
    own = store.where("error_category <> ''").select(F.col("error_category").alias("category")).distinct().where(~F.col("category").isin(known))
    return fixed.unionByName(own.select(F.lit(len(known)).alias("priority"), "category"))


def filtered(compared: DataFrame, statuses: list[str] | None = None, pattern: str | None = None, changed_only: bool = False) -> DataFrame:
    out = compared
    if statuses:
        out = out.where(F.col("delta_status").isin(statuses))
    if pattern:
        out = out.where(F.col("prompt_display").rlike(f"(?i){pattern}"))
    return out.where("is_output_changed") if changed_only else out


def latest_by_key(traces: DataFrame) -> DataFrame:
    """Traces under each of sample_id, doc_id and id; of equal keys the row of the largest (file_rank, seq) wins."""
    each = traces.select("*", F.explode(F.array_distinct(F.array("sample_id", "doc_id", "id"))).alias("key")).where("key is not null")
    return each.withColumn("rank", F.row_number().over(W.partitionBy("key").orderBy(F.desc("file_rank"), F.desc("seq")))).where("rank = 1").drop("rank")
