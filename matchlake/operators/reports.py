"""Reports and manifests of runs: one row of nested columns, written as one JSON object, and read back with a schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from .documents import part_manifest

JSON = {"ignoreNullFields": "false"}
COUNTERS = "rows_read long, rows_output long, rows_removed long, duplicate_round_keys long"
PART = "struct<part: int, rows: long, first_doc_id: string, last_doc_id: string>"


def _head(run: dict[str, str]) -> list[Column]:
    return [F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX").alias("generated_at"), *[F.lit(v).alias(k) for k, v in run.items()]]


def quality_report(counters: DataFrame, **run: str) -> DataFrame:
    """One row of counters -> one row: generated_at, the run's names, summary."""
    return counters.select(*_head(run), F.struct(*counters.columns).alias("summary"))


def _parts(docs: DataFrame, rows: int) -> DataFrame:
    """One row: the manifest's parts in order. A part stands for PART_ROWS documents, so there are few."""
    listed = F.sort_array(F.collect_list(F.struct("part", "rows", "first_doc_id", "last_doc_id")))
    return part_manifest(docs, rows).agg(listed.alias("parts"), F.coalesce(F.sum("rows"), F.lit(0)).alias("total_documents"))


def document_manifest(docs: DataFrame, part_rows: int, **run: str) -> DataFrame:
    """One row: the run's names, part_size_rows, total_documents, total_parts, parts."""
    return _parts(docs, part_rows).select(*_head(run), F.lit(part_rows).alias("part_size_rows"), "total_documents", F.size("parts").alias("total_parts"), F.lit("multi_tier").alias("aggregation_strategy"), "parts")


def document_report(events: DataFrame, docs: DataFrame, part_rows: int, **run: str) -> DataFrame:
    """One row: the run's names, summary with the counts of tiers and of event types, parts."""
    counts = lambda df, key: df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n")).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(key, "n")))).alias(f"{key}_counts"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    read = counts(events, "event_type").withColumnRenamed("n", "rows_read")
    made = counts(docs, "document_tier").withColumnRenamed("n", "rows_output")
    one = read.join(F.broadcast(made)).join(F.broadcast(_parts(docs, part_rows)))  # one row each
    summary = F.struct("rows_read", "rows_output", F.col("document_tier_counts").alias("tier_document_counts"), "event_type_counts", F.lit(part_rows).alias("part_size_rows"))
    return one.select(*_head(run), summary.alias("summary"), "parts")


def upload_manifest(members: DataFrame, prefix: str, run_id: str) -> DataFrame:
    """member (path within the archive), content -> one row: the run's names and, by path, each raw file's typed path, type,
    size and object key. Its list has a name for each file of an archive."""
    kind = S.file_kind(F.substring_index("member", "/", -1))
    typed = F.concat_ws("/", kind, F.ltrim(F.translate("member", "\\", "/"), F.lit("/")))
    one = F.struct(F.col("member").alias("relative_path"), typed.alias("typed_relative_path"), kind.alias("file_type"), F.concat(F.lit(f"{prefix}/{run_id}/extracted/"), typed).alias("object_key"), F.octet_length("content").cast("long").alias("size_bytes"))
    return members.agg(F.sort_array(F.collect_list(one)).alias("files")).select(*_head({"dataset_prefix": prefix, "run_id": run_id}), "files")


UPLOADED = "generated_at string, dataset_prefix string, run_id string, files array<struct<relative_path: string, typed_relative_path: string, file_type: string, object_key: string, size_bytes: long>>"


def embedding_manifest(docs: DataFrame, vectors: DataFrame, part_rows: int, resume_from: int = 0, **run: str) -> DataFrame:
    """One row: the run's names, summary, and for each part its rows, ids, and how many documents were passed over by
    resuming, read, and indexed in this execution. A part stands for part_rows documents, so there are few."""
    line = S.doc_line(F.col("doc_id"))
    of = lambda n: (F.floor((n - 1) / part_rows) + 1).cast("int")
    done = vectors.groupBy(of(F.col("doc_line")).alias("part")).agg(F.count(F.lit(1)).alias("indexed"))
    parts = docs.groupBy(of(line).alias("part")).agg(F.count(F.lit(1)).alias("rows"), F.min_by("doc_id", line).alias("first_doc_id"), F.max_by("doc_id", line).alias("last_doc_id"), F.count_if(line <= resume_from).alias("skipped"))
    rows = parts.join(done, "part", "left").withColumns({"indexed": F.coalesce("indexed", F.lit(0).cast("long")), "read": F.col("rows") - F.col("skipped")})
    one = rows.agg(F.sort_array(F.collect_list(F.struct("part", "rows", "first_doc_id", "last_doc_id", "skipped", "read", "indexed"))).alias("parts"))
    total = lambda c: F.aggregate("parts", F.lit(0).cast("long"), lambda s, p: s + p[c])
    summary = F.struct(total("rows").alias("total_documents_read"), total("skipped").alias("resume_skipped_documents"), total("read").alias("execution_documents_read"), total("indexed").alias("execution_embeddings_indexed"), F.size("parts").alias("total_parts"), F.size(F.filter("parts", lambda p: p["skipped"] == p["rows"])).alias("resume_skipped_parts"))
    return one.select(*_head(run), summary.alias("summary"), "parts")


EMBEDDED = "embedding_run_id string, summary struct<total_documents_read: long, resume_skipped_documents: long, execution_documents_read: long, execution_embeddings_indexed: long, total_parts: int, resume_skipped_parts: int>, parts array<struct<part: int, rows: long, first_doc_id: string, last_doc_id: string, skipped: long, read: long, indexed: long>>"


def embedding_report(docs: DataFrame, vectors: DataFrame, part_rows: int, resume_from: int = 0, **run: str) -> DataFrame:
    """One row: documents in all, passed over by resuming, read and indexed in this execution, and the parts that had any."""
    line = F.split_part("doc_id", F.lit(":"), F.lit(2)).cast("long")
    read = docs.agg(F.count(F.lit(1)).alias("total_documents_read"), F.count_if(line <= resume_from).alias("resume_skipped_documents"))
    parts = part_manifest(docs, part_rows).agg(F.count(F.lit(1)).alias("total_parts"), F.count_if(F.split_part("last_doc_id", F.lit(":"), F.lit(2)).cast("long") <= resume_from).alias("resume_skipped_parts"))
    done = vectors.agg(F.count(F.lit(1)).alias("execution_embeddings_indexed"))
    one = read.join(F.broadcast(parts)).join(F.broadcast(done))  # one row each
    return one.select(*_head(run), "total_documents_read", "resume_skipped_documents", (F.col("total_documents_read") - F.col("resume_skipped_documents")).alias("execution_documents_read"), "execution_embeddings_indexed", "total_parts", "resume_skipped_parts")


def write_json(report: DataFrame, folder: str) -> None:
    """One row -> one JSON object, nulls kept."""
    report.select(F.to_json(F.struct(*report.columns), JSON).alias("value")).write.mode("overwrite").text(folder)


def read_json(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    return spark.read.text(folder, wholetext=True).select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("x")).select("x.*")


def section_counts(objects: DataFrame, sections: tuple[str, ...], key: str = "object_key") -> DataFrame:
    """One row: how many objects lie in each section of their path."""
    return objects.agg(*[F.count_if(F.contains(F.col(key), F.lit(f"/{s}/"))).alias(s) for s in sections])
