"""Match telemetry made from the tables at hand, by the same SQL in Spark and in DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_K = {"spark": "CAST(get_json_object(props, '$.k') AS INT)", "duckdb": "CAST(json_extract_string(props, '$.k') AS INT)"}
_V = {"spark": "format_string('%.2f', value)", "duckdb": "printf('%.2f', value)"}

MATCH = """
SELECT event_id AS src_ord, 'demo_' || CAST(user_id AS STRING) AS file, 'map_' || CAST(user_id % 5 AS STRING) AS map, 'part_' || CAST(user_id % 3 AS STRING) AS source_file,
  1 + {k} % 40 AS round, event_id AS tick,
  CASE event_type WHEN 'click' THEN 'damage' WHEN 'purchase' THEN 'kill' WHEN 'view' THEN 'grenade' WHEN 'signup' THEN 'round_meta' ELSE 'event' END AS event_type,
  CASE event_id % 5 WHEN 0 THEN 'ct' WHEN 1 THEN ' CounterTerrorist ' WHEN 2 THEN 'T' WHEN 3 THEN 'CT' ELSE 'draw' END AS winner_side,
  'w' || CAST({k} % 7 AS STRING) AS weapon,
  CASE CAST(floor(value) AS BIGINT) % 4 WHEN 0 THEN 'head' WHEN 1 THEN 'Head' WHEN 2 THEN 'chest' END AS hitbox,
  CASE event_id % 2 WHEN 0 THEN 'CT' ELSE 'T' END AS att_side,
  CASE event_id % 3 WHEN 0 THEN 'pistol' WHEN 1 THEN 'eco' END AS round_type,
  CASE event_id % 4 WHEN 0 THEN 'smoke' WHEN 1 THEN 'flash' WHEN 2 THEN 'he' END AS nade,
  CAST(floor(value) AS BIGINT) AS hp_dmg, {k} AS arm_dmg, CAST(floor(value * 100) AS BIGINT) AS ct_eq_val, {k} * 100 AS t_eq_val,
  CAST(floor(value) AS BIGINT) * 10 - 2000 AS att_pos_x, (event_id % 97) * 40 - 2000 AS att_pos_y,
  event_id % 6 AS ct_alive, (event_id + {k}) % 6 AS t_alive, CASE WHEN event_id % 11 = 0 THEN 'True' ELSE 'no' END AS is_bomb_planted,
  {k} AS start_seconds, {k} + event_id % 100 - 10 AS end_seconds
FROM events"""

# Raw rows as a delimited file would hold them: all text, some of it wrong.
RAW = """
SELECT event_id AS src_ord, CASE WHEN event_id % 53 = 0 THEN '  ' ELSE ' demo_' || CAST(user_id AS STRING) END AS demo_file,
  CASE event_id % 17 WHEN 0 THEN '-1' WHEN 1 THEN 'x' WHEN 2 THEN '3.7' WHEN 3 THEN '2e1' ELSE CAST(1 + {k} % 40 AS STRING) END AS round_num,
  CASE WHEN event_id % 59 = 0 THEN '' ELSE 'map_' || CAST(user_id % 5 AS STRING) END AS map,
  CASE event_id % 7 WHEN 0 THEN 'ct' WHEN 1 THEN ' CounterTerrorist ' WHEN 2 THEN 'T' WHEN 3 THEN 'terrorist' WHEN 4 THEN 'Counter-Terrorist' WHEN 5 THEN 'CT' ELSE 'draw' END AS winner_side,
  CASE event_id % 3 WHEN 0 THEN 'pistol' WHEN 1 THEN '' END AS round_type,
  CASE event_id % 13 WHEN 0 THEN '-5' WHEN 1 THEN 'abc' WHEN 2 THEN '1.50' ELSE {v} END AS ct_money, CAST({k} * 100 AS STRING) AS t_eq
FROM events"""

RUNS = """
SELECT 'run' || CAST(c_custkey AS STRING) AS run_id, CASE c_custkey % 3 WHEN 0 THEN 'logistic_regression' WHEN 1 THEN 'hist_gradient_boosting' ELSE 'baseline_repeat_current' END AS model_name,
  CASE WHEN c_custkey % 10 <> 0 THEN CAST((c_custkey * 37 % 1000) AS DOUBLE) / 1000 END AS roc_auc, CAST((c_custkey * 53 % 1000) AS DOUBLE) / 1000 AS f1, CAST((c_custkey * 71 % 1000) AS DOUBLE) / 1000 AS balanced_accuracy,
  CAST((c_custkey * 29 % 1000) AS DOUBLE) / 1000 AS log_loss_val, CAST((c_custkey * 31 % 1000) AS DOUBLE) / 1000 AS brier,
  'modelo ' || lower(c_mktsegment) || ' features eq diff CT ' || lower(c_name) AS search_text, c_custkey AS created_at
FROM customer"""

# A catalogue with whole and with broken chains.
CATALOG = """
SELECT stage || '-' || CAST(n AS STRING) AS run_id, stage, CASE WHEN n % 4 = 3 THEN 'failed' ELSE 'completed' END AS status, 'p' || CAST(CASE WHEN n % 5 = 1 AND stage = 'bronze' THEN 9 ELSE n % 2 END AS STRING) AS dataset_prefix,
  CASE WHEN stage = 'bronze' THEN CASE WHEN n % 7 = 2 THEN 'x' END WHEN stage = 'gold' AND n % 6 = 4 THEN '' WHEN stage = 'documents' AND n % 8 = 5 THEN 'gold-none' ELSE parent || '-' || CAST(n AS STRING) END AS source_run_id, n AS created_at, n * 10 AS rows_output
FROM (SELECT c_custkey AS n FROM customer) CROSS JOIN
  (SELECT 'bronze' AS stage, '' AS parent UNION ALL SELECT 'silver', 'bronze' UNION ALL SELECT 'gold', 'silver' UNION ALL SELECT 'documents', 'gold' UNION ALL SELECT 'embeddings', 'documents') s"""

SOURCES = {"events": "events", "customer": "customer"}


def sql(text: str, engine: str) -> str:
    return text.replace("{k}", _K[engine]).replace("{v}", _V[engine])


def view(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    table = "customer" if "FROM customer" in text else "events"
    return spark.sql(sql(text, "spark").replace(f"FROM {table}", "FROM {t}"), t=spark.read.parquet(f"{sf_dir}/{table}.parquet"))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
