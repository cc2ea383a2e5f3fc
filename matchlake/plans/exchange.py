"""Queries of files: they write what the tables hold in the forms that come from elsewhere, read it back and compare."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..session import new_folder
from ..sources import files
from . import adapter as A
from .telemetry import query, raw

#: Headers of files that mean the same columns, each in an order of its own.
HEADERS = (
    {"demo_file": "File", "round_num": "Round Number", "map": "Map", "winner_side": "winner side", "ct_money": "CT Eq", "t_eq": "T-Eq", "round_type": "Round Type", "src_ord": "N"},
    {"map": "MAP", "round_type": "round type", "t_eq": "T Eq", "ct_money": "ct eq", "demo_file": "FILE", "winner_side": "Winner Side", "src_ord": "n", "round_num": "round number"},
    {"src_ord": "n", "demo_file": " file ", "map": "map", "round_num": "round_number", "t_eq": "t_eq", "winner_side": "winner_side", "ct_money": "ct_eq"},
)
_CSV = {"header": True, "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False, "emptyValue": '""', "escape": '"'}


@query(
    "SELECT 'v' || src_ord % 3 AS variant, src_ord AS n, demo_file AS file, round_num AS round_number, nullif(map, '') AS map, winner_side, ct_money AS ct_eq, t_eq, CASE WHEN src_ord % 3 <> 2 THEN nullif(round_type, '') END AS round_type FROM raw",
    raw=A.RAW,
)
def unlike_headers(spark, d):
    """Some hundred files under three headers, read in one scan; an empty cell is null."""
    folder = new_folder(spark, "exchange", "unlike")
    rows = raw(spark, d)
    for k, names in enumerate(HEADERS):
        part = rows.where(F.col("src_ord") % len(HEADERS) == k).select(*[F.col(c).cast("string").alias(n) for c, n in names.items()])
        part.repartition(60).write.options(**_CSV).csv(f"{folder}/round_meta/v{k}")
    found, _, _ = files.read_round_files(spark, folder)
    of = found.withColumn("n", F.col("n").cast("long"))
    return of.select(F.concat(F.lit("v"), (F.col("n") % len(HEADERS)).cast("string")).alias("variant"), "n", "file", "round_number", "map", "winner_side", "ct_eq", "t_eq", "round_type")


_PARTS = "SELECT conv_id, turn, role, conv_id % 4 AS part, row_number() OVER (PARTITION BY conv_id % 4 ORDER BY conv_id, turn) AS line, (conv_id + turn) % 13 = 0 AS bad FROM conversations"


def _json_parts(spark, d, broken: bool) -> tuple[str, list[str]]:
    folder = new_folder(spark, "exchange", "lines")
    rows = A.read(spark, d, "conversations").withColumn("part", F.col("conv_id") % 4)
    body = F.to_json(F.struct(F.concat_ws(":", "conv_id", "turn").alias("doc_id"), "text", F.create_map(F.lit("role"), "role").alias("metadata")))
    value = F.when((F.col("conv_id") + F.col("turn")) % 13 == 0, F.lit("{not json")).otherwise(body) if broken else body
    rows.repartition("part").sortWithinPartitions("part", "conv_id", "turn").select(value.alias("value"), "part").write.partitionBy("part").text(folder)
    return folder, [f"{folder}/part={k}" for k in range(4)]


@query("SELECT part, line, 'invalid JSON' AS why FROM p WHERE bad", p=_PARTS)
def json_line_errors(spark, d):
    _, parts = _json_parts(spark, d, True)
    found = files.document_errors(spark, *parts)
    return found.select(F.regexp_extract("path", "part=(\\d+)", 1).cast("long").alias("part"), "line", "why")


@query("SELECT conv_id || ':' || turn AS doc_id, role, length(text) AS n_chars FROM conversations")
def json_documents(spark, d):
    _, parts = _json_parts(spark, d, False)
    return files.read_documents(spark, *parts).select("doc_id", F.col("metadata")["role"].alias("role"), F.length("text").cast("long").alias("n_chars"))


@query("SELECT event_id, value, event_type, event_id % 2 = 0 AS even, CASE WHEN event_id % 3 > 0 THEN event_id * 2 END AS some, CASE WHEN event_id = 7 THEN 'seven' ELSE CAST(event_id AS VARCHAR) END AS mixed, DATE '2024-01-31' + CAST(event_id % 50 AS INT) AS day FROM events")
def typed_scan(spark, d):
    """Text files whose columns get the types that all their cells have."""
    folder = new_folder(spark, "exchange", "typed")
    day = F.date_add(F.lit("2024-01-31").cast("date"), (F.col("event_id") % 50).cast("int"))
    rows = A.read(spark, d, "events").select("event_id", "value", "event_type", (F.col("event_id") % 2 == 0).alias("even"), F.when(F.col("event_id") % 3 > 0, F.col("event_id") * 2).alias("some"), F.when(F.col("event_id") == 7, F.lit("seven")).otherwise(F.col("event_id").cast("string")).alias("mixed"), day.alias("day"))
    rows.write.options(**_CSV, maxRecordsPerFile=100_000).csv(folder)  # a file is read by one task
    return files.typed(files.read_files(spark, [folder]).rows.drop("source_file", "src_ord"))


@query("SELECT row_number() OVER (ORDER BY o_totalprice, o_orderkey) + 1 AS line, o_totalprice || ',' || o_orderkey || ',' || o_custkey AS value FROM o UNION ALL SELECT 1, 'price,o_orderkey,o_custkey'", o="SELECT CAST(round(o_totalprice * 100) AS BIGINT) AS o_totalprice, o_orderkey, o_custkey FROM orders")
def one_ordered_file(spark, d):
    path = new_folder(spark, "exchange", "ordered") + ".csv"
    rows = A.read(spark, d, "orders").select(F.round(F.col("o_totalprice") * 100).cast("long").alias("price"), "o_orderkey", "o_custkey")
    files.write_ordered_csv(rows, path, ["price", "o_orderkey"])
    return files.numbered_lines(spark, path).select("line", "value")
