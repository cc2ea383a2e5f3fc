"""Run catalogue, lineage, training runs and chat sessions: keyed tables and their upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from .keyed import KeyedTable

STAGES = ("bronze", "silver", "gold", "documents", "embeddings")
PARENT = {"silver": "bronze", "gold": "silver", "documents": "gold", "embeddings": "documents"}
DATASET_RUNS = "run_id string, stage string, status string, dataset_prefix string, bucket string, source_run_id string, events_key string, artifact_prefix string, manifest_key string, quality_report_key string, files_processed int, rows_read long, rows_output long, quality_summary string, created_at timestamp"
TRAINING_RUNS = "run_id string, model_name string, roc_auc double, f1 double, balanced_accuracy double, log_loss_val double, brier double, feature_importances string, map_segment_metrics string, half_segment_metrics string, params string, search_text string, created_at timestamp"


def upsert(table: DataFrame, rows: DataFrame, keys: list[str], keep: str = "created_at", order: str | None = None) -> DataFrame:
    """`table` with `rows` in place of those of the same key; the first `keep` of a key stays. Among `rows` of one key,
    the last by `order` wins. One shuffle by key."""
    new = rows.withColumn("_new", F.lit(1)).withColumn("_ord", F.col(order) if order else F.lit(0))
    old = table.withColumn("_new", F.lit(0)).withColumn("_ord", F.lit(0))
    own = Window.partitionBy(*keys)
    both = old.unionByName(new, allowMissingColumns=True).withColumn(keep, F.min(keep).over(own))
    return both.withColumn("_rn", F.row_number().over(own.orderBy(F.col("_new").desc(), F.col("_ord").desc()))).where("_rn = 1").drop("_rn", "_new", "_ord")


def run_rows(rows: DataFrame) -> DataFrame:
    """An empty quality summary is stored as none."""
    return rows.withColumn("quality_summary", F.nullif("quality_summary", F.lit("{}")))


def register_runs(spark: SparkSession, path: str, rows: DataFrame) -> None:
    """Upserts completed runs of DATASET_RUNS by (run_id, stage) into the table at `path`, which is made if it is not there."""
    new = run_rows(spark.createDataFrame([], DATASET_RUNS).unionByName(rows, allowMissingColumns=True))
    new = new.withColumns({"status": F.coalesce("status", F.lit("completed")), "created_at": F.coalesce("created_at", F.current_timestamp())})
    dataset_runs(spark, path).upsert(new)


def dataset_runs(spark: SparkSession, path: str) -> KeyedTable:
    return KeyedTable(spark, path, DATASET_RUNS, ["run_id", "stage"])


def training_runs(spark: SparkSession, path: str) -> KeyedTable:
    return KeyedTable(spark, path, TRAINING_RUNS, ["run_id", "model_name"])


def get_run(runs: DataFrame, stage: str, run_id: str) -> DataFrame:
    return runs.where((F.col("stage") == stage) & (F.col("run_id") == run_id))


def latest_run(runs: DataFrame, stage: str, prefix: str | None = None) -> DataFrame:
    """The completed run of a stage that was first registered last."""
    rows = runs.where((F.col("stage") == stage) & (F.col("status") == "completed"))
    return (rows if prefix is None else rows.where(F.col("dataset_prefix") == prefix)).orderBy(F.col("created_at").desc(), "run_id").limit(1)


def lineage(runs: DataFrame, starts: DataFrame) -> DataFrame:
    """starts (start_stage, start_run) -> one row a step up: start_*, hop, stage, run_id, dataset_prefix, source_run_id,
    found and the step's issue. A start takes at most five steps, as each goes to the stage before."""
    parent = F.create_map(*[F.lit(x) for p in PARENT.items() for x in p])
    table = runs.select(F.col("stage").alias("_stage"), F.col("run_id").alias("_run"), "dataset_prefix", "source_run_id")
    level = starts.select("start_stage", "start_run", F.lit(0).alias("hop"), F.col("start_stage").alias("stage"), F.col("start_run").alias("run_id"), F.lit(None).cast("string").alias("first_prefix"))
    out = None
    for _ in STAGES:
        rows = level.join(table, (F.col("stage") == F.col("_stage")) & (F.col("run_id") == F.col("_run")), "left")
        found, source = F.col("_run").isNotNull(), F.nullif("source_run_id", F.lit(""))
        first = F.coalesce("first_prefix", "dataset_prefix")
        issues = F.filter(F.array(
            F.when(~found, "run_not_found"), F.when(found & (F.col("dataset_prefix") != first), "dataset_prefix_mismatch"),
            F.when(found & parent[F.col("stage")].isNull() & source.isNotNull(), "cycle_detected"), F.when(found & parent[F.col("stage")].isNotNull() & source.isNull(), "missing_source_run_id"),
        ), lambda x: x.isNotNull())
        rows = rows.select("start_stage", "start_run", "hop", "stage", "run_id", "dataset_prefix", source.alias("source_run_id"), found.alias("found"), first.alias("first_prefix"), issues.alias("issues"))
        out = rows if out is None else out.union(rows)
        level = rows.where("found AND source_run_id IS NOT NULL").select("start_stage", "start_run", (F.col("hop") + 1).alias("hop"), parent[F.col("stage")].alias("stage"), F.col("source_run_id").alias("run_id"), "first_prefix").where("stage IS NOT NULL")
    return out.drop("first_prefix")


def lineage_issues(chain: DataFrame) -> DataFrame:
    return chain.select("start_stage", "start_run", F.explode("issues").alias("code"), "stage", "run_id")


def lineage_summary(chain: DataFrame) -> DataFrame:
    """start_*, length, hops, complete (from the start to bronze) and status."""
    out = chain.groupBy("start_stage", "start_run").agg(F.count_if("found").alias("length"), F.bool_or(F.col("found") & (F.col("stage") == STAGES[0])).alias("complete"), F.sum(F.size("issues")).alias("n_issues"))
    return out.withColumn("hops", F.greatest(F.col("length") - 1, F.lit(0))).withColumn("status", F.when(F.col("complete") & (F.col("n_issues") == 0), "ok").otherwise("broken"))


def audit(runs: DataFrame, stage: str, run_id: str) -> list[dict]:
    """The chain of one run, which has five rows at most; raises if anything is wrong with it."""
    if stage not in STAGES:
        raise ValueError(f"unknown stage {stage}")
    starts = runs.sparkSession.createDataFrame([(stage, run_id)], "start_stage string, start_run string")
    rows = [r.asDict() for r in lineage(runs, starts).orderBy("hop").collect()]
    if not any(r["found"] for r in rows):
        raise ValueError(f"no metadata for {stage}:{run_id}")
    bad = [f"{x}@{r['stage']}:{r['run_id']}" for r in rows for x in r["issues"]]
    if bad:
        raise ValueError(f"lineage of {stage}:{run_id} is broken: {'; '.join(bad)}")
    return rows


def artifact_flags(runs: DataFrame) -> DataFrame:
    """stage, run_id, evidence (what a run says of itself) and whether each kind of artifact is told."""
    told = lambda c: (F.coalesce(F.col(c), F.lit("")) != "").alias(f"has_{c}")
    kinds = ("events_key", "artifact_prefix", "manifest_key", "quality_report_key", "quality_summary")
    evidence = F.struct("bucket", "source_run_id", "events_key", "artifact_prefix", "manifest_key", "quality_report_key", "files_processed", "rows_read", "rows_output", "quality_summary", "created_at")
    return runs.select("stage", "run_id", "dataset_prefix", "status", evidence.alias("evidence"), *map(told, kinds))


def documentation_runs(document_run: str, embedding_run: str, rows: int, prefix: str = "pipeline-docs"):
    """The two rows that an embedding of documentation registers. There is no run before the first, so its audit tells."""
    return [(document_run, "documents", "completed", prefix, None, rows), (embedding_run, "embeddings", "completed", prefix, document_run, rows)]


def training_rows(run_id: str, metrics: DataFrame, importances: DataFrame, by_map: DataFrame, by_half: DataFrame) -> DataFrame:
    """Tables of a training (model_name, ...) -> a row of TRAINING_RUNS for each model. What a model has no rows of is an
    empty object. Features and segments of one model are few, so they are gathered into its row."""
    from .learning import METRICS

    def gathered(df: DataFrame, key: str, value: Column, name: str) -> DataFrame:
        pairs = F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.col(key).cast("string").alias("k"), value.alias("v")))))
        return df.groupBy(F.col("model_name").alias("_model")).agg(pairs.alias(name))

    scores = F.to_json(F.struct(*METRICS))
    out = metrics
    for df, key, value, name in ((importances, "feature", F.col("importance"), "_f"), (by_map, "segment", scores, "_m"), (by_half, "segment", scores, "_h")):
        out = out.join(gathered(df, key, value, name), F.col("model_name") == F.col("_model"), "left").drop("_model")
    known = F.map_from_arrays(F.array(*map(F.lit, METRICS)), F.array(*METRICS))
    text = search_text(out.select("model_name", F.map_filter(known, lambda k, v: v.isNotNull()).alias("metrics"), F.coalesce(F.map_keys("_f"), F.array()).alias("features"), F.coalesce(F.map_keys("_m"), F.array()).alias("segments")))
    body = lambda c: F.coalesce(F.to_json(c), F.lit("{}"))
    rows = out.select(F.lit(run_id).alias("run_id"), "model_name", *[F.col(c).alias("log_loss_val" if c == "log_loss" else c) for c in METRICS], body("_f").alias("feature_importances"), body("_m").alias("map_segment_metrics"), body("_h").alias("half_segment_metrics"), F.lit("{}").alias("params"), F.current_timestamp().alias("created_at"))
    return rows.join(text, "model_name")


def store_training(spark: SparkSession, path: str, rows: DataFrame) -> None:
    """Upserts rows of TRAINING_RUNS by (run_id, model_name)."""
    training_runs(spark, path).upsert(rows)


def search_text(models: DataFrame) -> DataFrame:
    """model_name, metrics map, features, segments -> model_name, search_text."""
    # The words that a search for models goes by.
    spaced = F.replace("model_name", F.lit("_"), F.lit(" "))
    value = lambda k: F.format_string("%.4f", F.col("metrics")[k])
    named = [F.when(F.col("metrics")[k].isNotNull(), F.concat(F.lit(f"{label} "), value(k))) for k, label in (("roc_auc", "roc auc"), ("balanced_accuracy", "balanced accuracy"), ("log_loss", "log loss"), ("f1", "f1 score"))]
    every = F.concat_ws(" ", F.transform(F.map_entries("metrics"), lambda e: F.concat(e["key"], F.lit(" "), F.format_string("%.4f", e["value"]))))
    text = F.concat_ws(" ", spaced, F.concat(F.lit("modelo "), spaced), F.lit("performance desempenho model ranking comparacao compare metrics metricas"), F.lit("best top winner melhor mais performou melhor modelo melhor desempenho"), every, *named, F.concat_ws(" ", "features"), F.concat_ws(" ", "segments"))
    return models.select("model_name", text.alias("search_text"))


# ---- chat sessions


def session_list(sessions: DataFrame) -> DataFrame:
    return sessions.orderBy(F.col("created_at").desc(), "id")


def session_messages(messages: DataFrame, session_id) -> DataFrame:
    return messages.where(F.col("session_id") == session_id).orderBy("row")


def delete_sessions(sessions: DataFrame, messages: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Without the sessions of `ids` (id) and their messages."""
    return sessions.join(ids, "id", "left_anti"), messages.join(ids.withColumnRenamed("id", "session_id"), "session_id", "left_anti")


def create_sessions(sessions: DataFrame, new: DataFrame) -> DataFrame:
    """`sessions` (id, title, created_at) with those of `new` whose id is not there; no title is the default one."""
    fresh = new.dropDuplicates(["id"]).join(sessions.select("id"), "id", "left_anti")
    return sessions.unionByName(fresh.withColumn("title", S.session_title(F.col("title"))))


def rename_sessions(sessions: DataFrame, names: DataFrame) -> DataFrame:
    """`sessions` with the titles of `names` (id, title)."""
    given = names.dropDuplicates(["id"]).select("id", F.col("title").alias("_title"))
    return sessions.join(given, "id", "left").withColumn("title", F.coalesce("_title", "title")).drop("_title")


def reset_sessions(messages: DataFrame, ids: DataFrame) -> DataFrame:
    """`messages` without those of the sessions of `ids` (id); the sessions stay."""
    return messages.join(ids.select(F.col("id").alias("session_id")), "session_id", "left_anti")


def upsert_messages(messages: DataFrame, new: DataFrame, order: str | None = None) -> DataFrame:
    """`messages` (id, session_id, role, parts, created_at) with `new` in place of those of the same id."""
    return upsert(messages, new, ["id"], order=order)
