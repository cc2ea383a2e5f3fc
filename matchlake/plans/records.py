"""Queries of what runs leave behind: reports, manifests, catalogue, trainings and sessions, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import catalog, documents, learning, reports, retrieval, rounds
from ..session import new_folder, written
from . import adapter as A
from .telemetry import ORACLES, SILVER, R, T, _docs, _gold_in, _runs, match, query, raw, supervised_features

PART_ROWS = 100


def _folder(spark, name: str) -> str:
    return new_folder(spark, "records", name)


@query(f"SELECT rows_read, rows_output, rows_removed, duplicate_round_keys, 'silver-1' AS silver_run_id FROM ({ORACLES['silver_quality']})")
def silver_report(spark, d):
    folder = _folder(spark, "silver-report")
    reports.write_json(reports.quality_report(rounds.silver_quality(raw(spark, d)), silver_run_id="silver-1"), folder)
    return reports.read_json(spark, folder, f"silver_run_id string, summary struct<{reports.COUNTERS}>").select("summary.*", "silver_run_id")


@query(f"SELECT *, (SELECT sum(rows)::BIGINT FROM ({ORACLES['docs_parts_manifest']})) AS total_documents FROM ({ORACLES['docs_parts_manifest']})")
def document_manifest(spark, d):
    folder = _folder(spark, "document-manifest")
    reports.write_json(reports.document_manifest(_docs(spark, d), PART_ROWS, document_run_id="run-1"), folder)
    return reports.read_json(spark, folder, f"total_documents long, parts array<{reports.PART}>").select("total_documents", F.explode("parts").alias("x")).select("x.*", "total_documents")


@query(f"SELECT document_tier AS kind, documents AS n FROM ({ORACLES['tier_counts']}) UNION ALL SELECT event_type, count(*) FROM m GROUP BY 1", m=A.MATCH)
def document_report(spark, d):
    folder = _folder(spark, "document-report")
    reports.write_json(reports.document_report(match(spark, d), _docs(spark, d), PART_ROWS, document_run_id="run-1"), folder)
    read = reports.read_json(spark, folder, "summary struct<tier_document_counts: map<string, long>, event_type_counts: map<string, long>>")
    return read.select(F.explode(F.map_concat("summary.tier_document_counts", "summary.event_type_counts")).alias("kind", "n"))


@query(f"SELECT total_documents AS total_documents_read, 150 AS resume_skipped_documents, total_documents - 150 AS execution_embeddings_indexed, parts AS total_parts, 1 AS resume_skipped_parts FROM (SELECT sum(rows)::BIGINT AS total_documents, count(*) AS parts FROM ({ORACLES['docs_parts_manifest']}))")
def embedding_report(spark, d):
    docs = _docs(spark, d)
    vectors = retrieval.embed_documents(docs, "emb-1", retrieval.hashing_embedder(16), 16, resume_from=150)
    one = reports.embedding_report(docs, vectors, PART_ROWS, 150, embedding_run_id="emb-1")
    return one.select("total_documents_read", F.col("resume_skipped_documents").cast("int").alias("resume_skipped_documents"), "execution_embeddings_indexed", "total_parts", F.col("resume_skipped_parts").cast("int").alias("resume_skipped_parts"))


@query("SELECT doc_id, 'emb-1' AS embedding_run_id, 'run-1' AS document_source_run_id, 'own' AS dataset_prefix, 'hashing' AS embed_model, document_tier FROM (SELECT 'run-1:' || event_id AS doc_id, 'tier-' || event_id % 5 AS document_tier FROM events)")
def embed_metadata(spark, d):
    rows = A.read(spark, d, "events").select(F.concat(F.lit("run-1:"), F.col("event_id").cast("string")).alias("doc_id"), F.create_map(F.lit("doc_id"), F.lit("old"), F.lit("dataset_prefix"), F.lit("theirs"), F.lit("document_tier"), F.concat(F.lit("tier-"), (F.col("event_id") % 5).cast("string"))).alias("metadata"))
    made = retrieval.run_metadata(F.col("metadata"), F.col("doc_id"), "emb-1", "hashing", "run-1", "own")
    keys = ("doc_id", "embedding_run_id", "document_source_run_id", "dataset_prefix", "embed_model", "document_tier")
    return rows.select(made.alias("m")).select(*[F.col("m")[k].alias(k) for k in keys])


_RUNS = "SELECT run_id, stage, status, dataset_prefix, source_run_id, rows_output, CASE WHEN created_at % 3 = 0 THEN '' WHEN created_at % 3 = 1 THEN 'events/' || run_id END AS events_key, CASE WHEN created_at % 2 = 0 THEN '{}' ELSE '{\"rows\": 1}' END AS quality_summary FROM c"


@query(f"SELECT stage, run_id, rows_output, coalesce(events_key, '') <> '' AS has_events_key, quality_summary <> '{{}}' AS has_quality_summary FROM ({_RUNS})", c=A.CATALOG)
def run_evidence(spark, d):
    """Runs registered twice in a table of their own, and what each tells."""
    path = _folder(spark, "runs")
    text = _RUNS.replace("{", "{{").replace("}", "}}").replace("FROM c", "FROM {c}")
    rows = spark.sql(text, c=A.view(spark, d, A.CATALOG)).withColumn("created_at", F.lit(None).cast("timestamp"))
    catalog.register_runs(spark, path, rows.withColumn("rows_output", F.lit(0).cast("long")))
    catalog.register_runs(spark, path, rows)
    return catalog.artifact_flags(catalog.dataset_runs(spark, path).read()).select("stage", "run_id", "evidence.rows_output", "has_events_key", "has_quality_summary")


@query("SELECT 'documents' AS stage, 'docs-' || c_custkey AS run_id, 'missing_source_run_id' AS code FROM customer")
def documentation_lineage(spark, d):
    """Embeddings of documentation have documents, but nothing before them, and their audit says so."""
    doc, emb = F.concat(F.lit("docs-"), F.col("c_custkey").cast("string")), F.concat(F.lit("emb-"), F.col("c_custkey").cast("string"))
    customers = A.read(spark, d, "customer")
    names = ("run_id", "stage", "status", "dataset_prefix", "source_run_id", "rows_output")
    rows = [customers.select(*[(x if not isinstance(x, str) and x is not None and not isinstance(x, int) else F.lit(x)).alias(n) for n, x in zip(names, row, strict=True)]) for row in catalog.documentation_runs(doc, emb, 3)]
    runs = rows[0].unionByName(rows[1])
    chain = catalog.lineage(runs, runs.where("stage = 'embeddings'").select(F.col("stage").alias("start_stage"), F.col("run_id").alias("start_run")))
    return catalog.lineage_issues(chain).select("stage", "run_id", "code")


@query("SELECT n_name AS model_name, round(n_nationkey / 100.0, 6) AS roc_auc, feature, importance, 'train-1' AS run_id FROM nation LEFT JOIN (SELECT c_nationkey, c_mktsegment AS feature, count(*)::DOUBLE AS importance FROM customer WHERE c_nationkey % 2 = 0 GROUP BY ALL) ON n_nationkey = c_nationkey")
def training_results(spark, d):
    """A training's tables joined by model, stored twice, and the importances read back."""
    path, nation = _folder(spark, "trainings"), A.read(spark, d, "nation")
    scores = nation.select(F.col("n_name").alias("model_name"), *[F.round(F.col("n_nationkey") / 100, 6).alias(c) for c in learning.METRICS])
    per = A.read(spark, d, "customer").where("c_nationkey % 2 = 0").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    importances = per.groupBy(F.col("n_name").alias("model_name"), F.col("c_mktsegment").alias("feature")).agg(F.count(F.lit(1)).cast("double").alias("importance"))
    segments = scores.withColumn("segment", F.lit("H1"))
    rows = catalog.training_rows("train-1", scores, importances, segments, segments)
    for _ in range(2):
        catalog.store_training(spark, path, rows)
    back = catalog.training_runs(spark, path).read().withColumn("m", F.from_json("feature_importances", "map<string, double>"))
    return back.select("model_name", "roc_auc", "run_id", F.explode_outer("m").alias("feature", "importance"))


@query("SELECT DISTINCT conv_id AS id, CASE WHEN conv_id % 3 = 0 THEN 'named ' || conv_id ELSE 'Nova conversa' END AS title FROM conversations")
def session_rename(spark, d):
    ids = A.read(spark, d, "conversations").select(F.col("conv_id").alias("id"), F.lit(None).cast("string").alias("title"), F.col("turn").alias("created_at"))
    sessions = catalog.create_sessions(ids.limit(0), ids)
    names = sessions.where("id % 3 = 0").select("id", F.concat(F.lit("named "), F.col("id").cast("string")).alias("title"))
    return catalog.rename_sessions(catalog.create_sessions(sessions, ids), names).select("id", "title")


_MESSAGES = "SELECT CAST(conv_id AS VARCHAR) || ':' || CAST(turn AS VARCHAR) AS id, conv_id AS session_id"


@query(f"{_MESSAGES}, CASE WHEN turn % 2 = 0 THEN 'edited' ELSE role END AS role, turn AS created_at FROM conversations WHERE conv_id % 5 <> 0")
def session_message_upsert(spark, d):
    m = A.read(spark, d, "conversations").select(F.concat_ws(":", "conv_id", "turn").alias("id"), F.col("conv_id").alias("session_id"), "role", F.col("turn").alias("created_at"))
    edits = m.where("created_at % 2 = 0").withColumns({"role": F.lit("edited"), "created_at": F.lit(1 << 40).cast("long")})
    return catalog.reset_sessions(catalog.upsert_messages(m, edits), m.where("session_id % 5 = 0").select(F.col("session_id").alias("id")).distinct()).select("id", "session_id", "role", "created_at")


@query("SELECT doc_id, doc_index FROM numbered ORDER BY doc_index LIMIT 120", **T)
def document_preview(spark, d):
    return documents.preview(_docs(spark, d), 120).select("doc_id", "doc_index")


@query("SELECT src_ord, file FROM m ORDER BY src_ord LIMIT 250", m=A.MATCH)
def events_head(spark, d):
    return rounds.head(match(spark, d), 250).select("src_ord", "file")


@query("SELECT src_ord FROM m ORDER BY md5('42' || src_ord), src_ord LIMIT 200", m=A.MATCH)
def seeded_sample(spark, d):
    return learning.seeded_sample(match(spark, d), 200, "42", "src_ord").select("src_ord")


@query("SELECT n_name AS model_name, metric, value FROM (SELECT n_name, 'a' AS metric, n_nationkey::DOUBLE AS value FROM nation WHERE n_nationkey % 3 <> 0 UNION ALL SELECT n_name, 'b', n_nationkey / 2.0 FROM nation WHERE n_nationkey % 2 = 0)")
def metrics_finite(spark, d):
    k = F.col("n_nationkey").cast("double")
    table = A.read(spark, d, "nation").select(F.col("n_name").alias("model_name"), F.when(F.col("n_nationkey") % 3 == 0, F.lit(float("nan"))).otherwise(k).alias("a"), F.when(F.col("n_nationkey") % 2 == 0, k / 2).otherwise(F.lit(float("inf"))).alias("b"))
    return learning.finite_metrics(learning.unpivot_metrics(table, ("a", "b")))


@query("SELECT (SELECT count(*) FROM documents WHERE lang = 'en') AS deleted_rows, (SELECT count(*) FROM documents WHERE lang IS DISTINCT FROM 'en') AS left_rows")
def delete_run(spark, d):
    rows, gone = retrieval.delete_run(A.read(spark, d, "documents").select(F.col("lang").alias("embedding_run_id")), "en")
    return gone.join(F.broadcast(rows.agg(F.count(F.lit(1)).alias("left_rows"))))


@query(f"SELECT count_if(NOT is_test) AS train_files, count_if(is_test) AS test_files, 0::BIGINT AS shared_files FROM ({ORACLES['group_split']})")
def split_files(spark, d):
    return learning.file_sets(learning.group_split(supervised_features(spark, d)))


@query("SELECT count_if(doc_id % 3 = 0) AS kills, count_if(doc_id % 3 = 1) AS damage, 0::BIGINT AS assets FROM documents")
def section_counts(spark, d):
    kind = F.element_at(F.array(*map(F.lit, ("kills", "damage", "meta"))), (F.col("doc_id") % 3 + 1).cast("int"))
    return reports.section_counts(A.read(spark, d, "documents").select(F.concat(F.lit("run/extracted/"), kind, F.lit("/assets.csv")).alias("object_key")), ("kills", "damage", "assets"))


@query("SELECT c_name AS feature, c_acctbal AS coefficient FROM customer ORDER BY abs(c_acctbal) DESC, c_name LIMIT 15")
def coefficient_ranking(spark, d):
    return learning.ranked_coefficients(A.read(spark, d, "customer").select(F.col("c_name").alias("feature"), F.col("c_acctbal").alias("coefficient")), 15)


# ---- manifests, and what only tests had


@query("""SELECT relative_path, kind || '/' || relative_path AS typed_relative_path, kind AS file_type, 'own/run-7/extracted/' || kind || '/' || relative_path AS object_key, size_bytes, 'run-7' AS run_id
FROM (SELECT 'demos/' || page_id || CASE page_id % 5 WHEN 0 THEN '_meta.csv' WHEN 1 THEN '_kills.csv' WHEN 2 THEN '_dmg.csv' WHEN 3 THEN '.png' ELSE '_grenades.csv' END AS relative_path, CASE page_id % 5 WHEN 0 THEN 'round_meta' WHEN 1 THEN 'kills' WHEN 2 THEN 'damage' WHEN 3 THEN 'assets' ELSE 'grenades' END AS kind, strlen(html) AS size_bytes FROM pages)""")
def upload_manifest(spark, d):
    end = F.element_at(F.array(*map(F.lit, ("_meta.csv", "_kills.csv", "_dmg.csv", ".png", "_grenades.csv"))), (F.col("page_id") % 5 + 1).cast("int"))
    members = A.read(spark, d, "pages").select(F.concat(F.lit("demos/"), F.col("page_id").cast("string"), end).alias("member"), F.encode("html", "UTF-8").alias("content"))
    folder = _folder(spark, "upload-manifest")
    reports.write_json(reports.upload_manifest(members, "own", "run-7"), folder)
    return reports.read_json(spark, folder, reports.UPLOADED).select(F.explode("files").alias("f"), "run_id").select("f.*", "run_id")


@query("""SELECT part, rows, first_doc_id, last_doc_id, skipped, rows - skipped AS read, rows - skipped AS indexed, (SELECT count(*) FROM numbered) AS total_documents_read FROM (SELECT CAST((doc_index - 1) // 100 + 1 AS INT) AS part, count(*) AS rows, arg_min(doc_id, doc_index) AS first_doc_id, arg_max(doc_id, doc_index) AS last_doc_id, count_if(doc_index <= 150) AS skipped FROM numbered GROUP BY 1)""", **T)
def embedding_manifest(spark, d):
    docs = written(_docs(spark, d), "docs")
    vectors = retrieval.embed_documents(docs, "emb-1", retrieval.hashing_embedder(16), 16, resume_from=150)
    folder = _folder(spark, "embedding-manifest")
    reports.write_json(reports.embedding_manifest(docs, vectors, PART_ROWS, 150, embedding_run_id="emb-1"), folder)
    return reports.read_json(spark, folder, reports.EMBEDDED).select(F.explode("parts").alias("p"), "summary.total_documents_read").select("p.*", "total_documents_read")


_GOLD = f"SELECT file, round_number, map, round_type, winner_side_current AS winner_side_norm, (winner_side_current = 'CT')::INT AS winner_side_code, ct::DOUBLE AS ct_eq_val, t::DOUBLE AS t_eq_val, CAST(ct - t AS DECIMAL(38,10))::DOUBLE AS eq_diff, CASE WHEN (round_number - 1) % 30 < 15 THEN 'H1' ELSE 'H2' END AS half, (round_number > 30)::INT AS overtime_flag FROM ({SILVER})"


@query(
    "SELECT * FROM (SELECT *, lead(winner_side_code) OVER own AS target_winner_side_next_code, lag(eq_diff) OVER own AS eq_diff_lag1, lag(winner_side_code, 3) OVER own AS winner_side_code_lag3, round(avg(eq_diff_before) OVER (PARTITION BY file ORDER BY round_number ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 6) AS eq_diff_rollmean3 FROM (SELECT *, lag(eq_diff) OVER (PARTITION BY file ORDER BY round_number) AS eq_diff_before FROM g) WINDOW own AS (PARTITION BY file ORDER BY round_number)) WHERE target_winner_side_next_code IS NOT NULL".replace("SELECT * FROM (", "SELECT * EXCLUDE (eq_diff_before) FROM (", 1),
    **R, g=_GOLD,
)
def context_round_frame(spark, d):
    """Rounds of the Gold table, without events, as the frame that models learn from."""
    frame = rounds.supervised(rounds.context_rounds(rounds.as_text(rounds.gold(_gold_in(spark, d)))))
    names = ["file", "round_number", "map", "round_type", "winner_side_norm", "winner_side_code", "ct_eq_val", "t_eq_val", "eq_diff", "half", "overtime_flag", "target_winner_side_next_code", "eq_diff_lag1", "winner_side_code_lag3"]
    return frame.select(*names, F.round("eq_diff_rollmean3", 6).alias("eq_diff_rollmean3"))


@query("SELECT node_id, embedding_run_id, doc_line FROM (SELECT 'r:' || (vec_id + 1) AS node_id, vec_id % 3 AS k, vec_id + 1 AS doc_line FROM embeddings) , (VALUES ('old', 0), ('redone', 1), ('other', 2)) v(embedding_run_id, k2) WHERE CASE k2 WHEN 0 THEN k = 0 WHEN 1 THEN k = 2 ELSE k = 1 END")
def runs_written_again(spark, d):
    """Three runs are written, and one of them again: its rows are replaced, no other's."""
    folder = _folder(spark, "vectors")
    rows = A.read(spark, d, "embeddings").select(F.concat(F.lit("r:"), (F.col("vec_id") + 1).cast("string")).alias("node_id"), "embedding", (F.col("vec_id") + 1).alias("doc_line"), (F.col("vec_id") % 3).alias("k"))
    of = lambda k, run: rows.where(F.col("k") == k).drop("k").withColumn("embedding_run_id", F.lit(run))
    retrieval.write_run(of(0, "old").union(of(1, "redone")).union(of(1, "other")), folder)
    retrieval.write_run(of(2, "redone"), folder)
    return spark.read.parquet(folder).select("node_id", "embedding_run_id", "doc_line")


_SIM0 = "list_cosine_similarity(CAST(embedding AS DOUBLE[]), (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 0))"


@query(f"SELECT CAST(row_number() OVER (ORDER BY s DESC, node_id) AS INT) AS rank, 'd' || vec_id AS doc_id, 'kill' AS event_type, CASE WHEN vec_id % 4 > 0 THEN 'm' || vec_id % 4 END AS map, CAST(vec_id % 30 AS INT) AS round FROM (SELECT vec_id, 'r:' || vec_id AS node_id, {_SIM0} AS s FROM embeddings WHERE vec_id % 2 = 0) ORDER BY 1 LIMIT 20")
def semantic_rows(spark, d):
    """Rows of a filtered search, with the fields that a caller sees."""
    rows = A.read(spark, d, "embeddings")
    vector = list(rows.where("vec_id = 0").select("embedding").first()[0])
    text = lambda c: c.cast("string")
    meta = F.create_map(F.lit("doc_id"), F.concat(F.lit("d"), text(F.col("vec_id"))), F.lit("event_type"), F.when(F.col("vec_id") % 2 == 0, F.lit("kill")).otherwise(F.lit("damage")), F.lit("map"), F.when(F.col("vec_id") % 4 == 0, F.lit("")).otherwise(F.concat(F.lit("m"), text(F.col("vec_id") % 4))), F.lit("round"), text(F.col("vec_id") % 30), F.lit("_node"), F.lit("x"))
    vectors = rows.select(F.concat(F.lit("r:"), text(F.col("vec_id"))).alias("node_id"), F.lit("t").alias("text"), meta.alias("metadata"), "embedding", F.when(F.col("vec_id") < 0, F.lit("another")).otherwise(F.lit("e")).alias("embedding_run_id"))
    found = retrieval.semantic_search(vectors, "any", lambda texts: [vector], "e", 20, event_type="kill")
    return found.select("rank", "doc_id", "event_type", "map", F.col("round").cast("int").alias("round"))


@query("""SELECT run_id, run_id || '|' || replace(model_name, '_', ' ') || ' modelo ' || run_id || '|' || replace(model_name, '_', ' ') || ' performance desempenho model ranking comparacao compare metrics metricas best top winner melhor mais performou melhor modelo melhor desempenho'
  || ' f1 ' || printf('%.4f', f1) || CASE WHEN roc_auc IS NULL THEN '' ELSE ' roc_auc ' || printf('%.4f', roc_auc) || ' roc auc ' || printf('%.4f', roc_auc) END || ' f1 score ' || printf('%.4f', f1) || ' eq_diff de_hill' AS search_text FROM r""", r=A.RUNS)
def search_texts(spark, d):
    runs = _runs(spark, d)
    metrics = F.map_filter(F.map_from_arrays(F.array(F.lit("f1"), F.lit("roc_auc")), F.array("f1", "roc_auc")), lambda k, v: v.isNotNull())
    return catalog.search_text(runs.select(F.concat("run_id", F.lit("|"), "model_name").alias("model_name"), metrics.alias("metrics"), F.array(F.lit("eq_diff")).alias("features"), F.array(F.lit("de_hill")).alias("segments"))).select(F.split_part("model_name", F.lit("|"), F.lit(1)).alias("run_id"), "search_text")
