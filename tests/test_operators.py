import hashlib
import json
import os
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from matchlake.functions import scalars as S
from matchlake.operators import catalog, documents, learning, retrieval
from matchlake.sources import files
from matchlake.streaming import rounds as streaming


# ---- documents

EVENTS = "src_ord long, event_type string, file string, round string, map string, source_file string, weapon string, hp_dmg string, arm_dmg string, att_pos_x string, att_pos_y string, hitbox string, nade string, att_side string, winner_side string, round_type string, ct_eq_val string, t_eq_val string, start_seconds string, end_seconds string"


def match(spark):
    n = [None] * 20
    rows = [
        (0, "damage", "d", "1", "de_mirage", "s", "ak47", "27", "10", "100", "200", "head", None, "T", *n[:6]),
        (1, "kill", "d", "1", "de_mirage", "s", "ak47", "100", "5", "100", "200", "Head", None, "T", *n[:6]),
        (2, "grenade", "d", "1", "de_nuke", "s", None, "20", None, "-1", "0", None, "smoke", "CT", *n[:6]),
        (3, "round_meta", "d", "1", "de_ancient", "s", None, None, None, None, None, None, None, None, "CT", "eco", "2500", "1200", "0", "30"),
    ]
    return spark.createDataFrame(rows, EVENTS)


def test_documents(spark):
    docs = documents.documents(match(spark), "run-9").orderBy("doc_index").collect()
    assert [d.doc_index for d in docs] == list(range(1, len(docs) + 1))
    assert [d.document_tier for d in docs] == ["weapon_map_profile"] * 2 + ["map_overview"] * 3 + ["hotspot_zone"] * 2 + ["round_type_profile", "weapon_global_profile"]
    assert all(d.doc_id == f"run-9:{d.doc_index}" and d.metadata["doc_id"] == d.doc_id and d.metadata["document_tier"] == d.document_tier for d in docs)
    assert "Taxa de headshot: 100.0% dos acertos. Hitboxes mais atingidas: head (100.0%)" in docs[0].text
    assert "x:[-500,0] y:[0,500]" in docs[6].text and "smoke: 1" in docs[6].text
    assert "CT R$2,500, T R$1,200" in docs[7].text and "100.0%" in docs[7].text
    assert "63.5 | Máximo: 100" in docs[8].text
    assert documents.prepared(match(spark), max_rows=2).count() == 2
    with pytest.raises(ValueError, match="source_file"):
        documents.prepared(match(spark).drop("source_file"))


def test_first_seen_breaks_ties(spark):
    rows = spark.createDataFrame([(3, "k", "b"), (0, "k", "c"), (1, "k", "b"), (2, "k", "c"), (5, "k", "a")], "src_ord long, key string, v string")
    got = documents.histogram(rows, ["key"], "v", 2).orderBy("place").collect()
    assert [(r.v, r.n) for r in got] == [("c", 2), ("b", 2)]


def test_parts(spark, tmp_path):
    docs = documents.documents(match(spark), "r")
    parts = {r.part: (r.rows, r.first_doc_id, r.last_doc_id) for r in documents.write_parts(docs, str(tmp_path / "p"), 4).collect()}
    assert parts == {1: (4, "r:1", "r:4"), 2: (4, "r:5", "r:8"), 3: (1, "r:9", "r:9")}
    back = files.read_documents(spark, *[str(tmp_path / "p" / f"part={k}") for k in parts])
    assert sorted(r.doc_id for r in back.collect()) == sorted(f"r:{i}" for i in range(1, 10))


# ---- embedding and search


def test_embedding_skips_nan_and_resumes(spark):
    docs = spark.createDataFrame([(f"r:{i}", t, {"event_type": "kill"}) for i, t in enumerate(["one", "bad", "three", "four"], 1)], files.DOCUMENT)

    def embed(texts):
        if "bad" in texts:
            raise RuntimeError("NaN in output")
        return [[float(len(t)), 1.0] for t in texts]

    got = {r.node_id: r for r in retrieval.embed_documents(docs, "e", embed, 2).collect()}
    assert set(got) == {"r:1", "r:3", "r:4"} and list(got["r:3"].embedding) == [5.0, 1.0]
    assert got["r:1"].metadata["embedding_run_id"] == "e" and got["r:1"].metadata["event_type"] == "kill"
    assert {r.node_id for r in retrieval.embed_documents(docs, "e", embed, 2, resume_from=2).collect()} == {"r:3", "r:4"}
    assert retrieval.embed_documents(docs, "e", embed, 2, max_documents=1).count() == 1
    with pytest.raises(Exception, match="do not have 3"):
        retrieval.embed_documents(docs, "e", embed, 3).collect()


def test_write_run_replaces_one_run(spark, tmp_path):
    path, embed = str(tmp_path / "v"), retrieval.hashing_embedder(8)
    docs = lambda n: spark.createDataFrame([(f"r:{i}", f"t {i}", {"a": "b"}) for i in range(1, n + 1)], files.DOCUMENT)
    for run, n in (("a", 3), ("b", 2), ("a", 1)):
        retrieval.write_run(retrieval.embed_documents(docs(n), run, embed, 8), path)
    assert {r["embedding_run_id"]: r["count"] for r in spark.read.parquet(path).groupBy("embedding_run_id").count().collect()} == {"a": 1, "b": 2}


def test_semantic_search(spark):
    embed = retrieval.hashing_embedder(32)
    docs = spark.createDataFrame([("r:1", "smoke on mirage", {"map": "mirage", "event_type": "x", "round": "3", "_node": "y", "document_id": "z", "doc_id": "r:1"}), ("r:2", "eco round", {"map": "nuke"})], files.DOCUMENT)
    v = retrieval.embed_documents(docs, "e", embed, 32)
    top = retrieval.semantic_search(v, "smoke on mirage", embed, "e", 5).orderBy("rank").collect()
    assert [r.doc_id for r in top] == ["r:1", "r:2"] and top[0].score == pytest.approx(1.0, abs=1e-6) and top[0]["round"] == 3
    assert set(top[0].metadata) == {"map", "event_type", "round", "doc_id", "embedding_run_id", "embed_model"}
    assert retrieval.semantic_search(v, "smoke", embed, "e", 5, map="dust").count() == 0
    for bad in (("", "e", 5), ("q", " ", 5), ("q", "e", 0)):
        with pytest.raises(ValueError):
            retrieval.check_request(*bad)
    out = retrieval.rag_query(v, "smoke", embed, lambda prompt: f"<{len(prompt) > 5}>", "e", 1)
    assert out["answer"] == "<True>" and len(out["sources"]) == 1
    kinds = [k for k, _ in retrieval.rag_stream(v, "smoke", embed, lambda p: iter(["a", "b"]), run_id="e", k=1)]
    assert kinds == ["sources", "chunk", "chunk", "done"]


def training_runs(spark):
    rows = [
        ("spring", "hist_gradient_boosting", 0.81, 0.64, 0.75, 0.47, 0.15, "trees by histogram, boosted gradients", "2031-02-03T09:00"),
        ("spring", "logistic_regression", 0.77, 0.69, 0.72, 0.52, 0.17, "a straight line through logits", "2031-02-03T08:00"),
        ("autumn", "none_yet", None, None, None, None, None, None, "2030-11-20"),
    ]
    return spark.createDataFrame(rows, "run_id string, model_name string, roc_auc double, f1 double, balanced_accuracy double, log_loss_val double, brier double, search_text string, created_at string")


def test_lexical(spark):
    runs = training_runs(spark)
    names = lambda df: [r.model_name for r in df.orderBy("rank").collect()]
    assert names(retrieval.lexical_search(runs, "melhor desempenho no roc auc"))[:2] == ["hist_gradient_boosting", "logistic_regression"]
    assert names(retrieval.lexical_search(runs, "highest f1"))[:2] == ["logistic_regression", "hist_gradient_boosting"]
    assert names(retrieval.lexical_search(runs, "regression ranking")) == ["logistic_regression"]
    assert names(retrieval.lexical_fallback(runs, "best by log loss"))[0] == "hist_gradient_boosting"
    assert names(retrieval.lexical_search(runs, "top", model_filter="logistic_regression")) == ["logistic_regression"]
    assert names(retrieval.fts(runs, "boosting tree")) == ["hist_gradient_boosting"]
    assert names(retrieval.fts(runs, '"straight line" -trees')) == ["logistic_regression"]
    assert set(names(retrieval.fts(runs, "gradient or logit"))) == {"hist_gradient_boosting", "logistic_regression"}
    assert retrieval.hybrid_search(None, runs, "logistic regression", None)["semantic"] == []
    assert retrieval.metric_asked("log loss")[0] == "log_loss_val" and retrieval.metric_asked("balanced accuracy")[0] == "balanced_accuracy"
    assert S.without_accents("Ação") == "acao"


def test_markdown(spark):
    pages = spark.createDataFrame([("a.md", "intro\n# One\ntext\n```\n# not a header\n```\n## Two\nmore"), ("b.md", None)], "path string, text string")
    got = retrieval.markdown_chunks(pages).orderBy("chunk").collect()
    assert [(r.header, r.text.split("\n")[0]) for r in got] == [(None, "intro"), ("One", "# One"), ("Two", "## Two")]


# ---- catalogue


def runs(spark, change=lambda rows: rows):
    chain = [("bronze", None), ("silver", "ore-4"), ("gold", "wash-4"), ("documents", "bar-4"), ("embeddings", "ledger-4")]
    names = dict(zip(catalog.STAGES, ("ore-4", "wash-4", "bar-4", "ledger-4", "index-4"), strict=True))
    rows = change([{"run_id": names[s], "stage": s, "status": "completed", "dataset_prefix": "p", "source_run_id": p, "created_at": i} for i, (s, p) in enumerate(chain)])
    return spark.createDataFrame(rows, "run_id string, stage string, status string, dataset_prefix string, source_run_id string, created_at int")


def test_lineage(spark):
    assert [r["stage"] for r in catalog.audit(runs(spark), "embeddings", "index-4")] == ["embeddings", "documents", "gold", "silver", "bronze"]
    assert len(catalog.audit(runs(spark), "gold", "bar-4")) == 3
    cases = {
        "run_not_found@gold:bar-4": lambda rows: [r for r in rows if r["stage"] != "gold"],
        "dataset_prefix_mismatch@bronze:ore-4": lambda rows: [r | {"dataset_prefix": "q"} if r["stage"] == "bronze" else r for r in rows],
        "cycle_detected@bronze:ore-4": lambda rows: [r | {"source_run_id": "x"} if r["stage"] == "bronze" else r for r in rows],
        "missing_source_run_id@silver:wash-4": lambda rows: [r | {"source_run_id": None} if r["stage"] == "silver" else r for r in rows],
    }
    for message, change in cases.items():
        with pytest.raises(ValueError, match=message):
            catalog.audit(runs(spark, change), "embeddings", "index-4")
    start = spark.createDataFrame([("embeddings", "index-4")], "start_stage string, start_run string")
    s = catalog.lineage_summary(catalog.lineage(runs(spark), start)).first()
    assert (s.length, s.hops, s.complete, s.status) == (5, 4, True, "ok")


def test_upsert_keeps_the_first_time(spark):
    new = spark.createDataFrame([("bar-4", "gold", "redone", "p", "wash-4", 99), ("new", "gold", "completed", "p", "wash-4", 50)], "run_id string, stage string, status string, dataset_prefix string, source_run_id string, created_at int")
    out = {(r.run_id, r.status, r.created_at) for r in catalog.upsert(runs(spark), new, ["run_id", "stage"]).where("stage = 'gold'").collect()}
    assert out == {("bar-4", "redone", 2), ("new", "completed", 50)}
    assert catalog.latest_run(runs(spark).union(new.where("run_id = 'new'")), "gold").first().run_id == "new"


def test_search_text(spark):
    rows = spark.createDataFrame([("logistic_regression", {"roc_auc": 0.5}, ["eq_diff"], ["de_mirage"])], "model_name string, metrics map<string,double>, features array<string>, segments array<string>")
    text = catalog.search_text(rows).first().search_text
    assert text.startswith("logistic regression modelo logistic regression performance") and text.endswith("roc_auc 0.5000 roc auc 0.5000 eq_diff de_mirage")


# ---- learning


def test_metrics_of_one_class_and_perfect_order(spark):
    rows = spark.createDataFrame([("a", 1, 0.9), ("a", 0, 0.1), ("a", 1, 0.8), ("b", 1, 0.2), ("b", 1, 0.7)], "seg string, y int, p double")
    got = {r.segment: r for r in learning.segment_metrics(rows, "seg").collect()}
    assert got["a"].roc_auc == 1.0 and got["a"].f1 == 1.0 and got["b"].roc_auc is None and got["b"].balanced_accuracy == 0.5
    assert learning.segment_metrics(rows, "seg", min_rows=3).count() == 1
    assert learning.segment_metrics(rows, "seg", min_rows=9).columns[0] == "segment"


def test_split_and_models(spark):
    from matchlake.operators import rounds
    from tests.test_rounds import events

    in_turn = {f"m{i}": ("CT" if i % 2 else "TC") * 3 for i in range(8)}
    frame = rounds.supervised(rounds.event_rounds(events(spark, in_turn)))
    split = learning.group_split(frame).select("file", "is_test").distinct().collect()
    assert sum(r.is_test for r in split) == 2 and len(split) == 8
    out = learning.train_and_evaluate(frame, learning.MODELS[:2], min_rows=1)
    got = {r.model_name: r for r in out["metrics"].collect()}
    assert got["baseline_repeat_current"].roc_auc == 0.0 and got["logistic_regression"].roc_auc == 1.0
    assert out["by_half"].count() >= 2
    with pytest.raises(ValueError, match="unknown models"):
        learning.train_and_evaluate(frame, ["other"])


# ---- sources


def test_headers():
    assert files.normal_headers([" Damage ", "Damage", "Round Number", "!!!"]) == ["damage", "damage_2", "round_number", "column"]


def test_headers_in_columns(spark):
    heads = [[" Damage ", "Damage", "Round Number", "!!!", None, "damage"], ["file", "round", "map", "winner_side", "ct_eq_val", "t_eq_val"], ["tick", "hp_dmg"], ["map", "x", "file"]]
    got = [r[0] for r in spark.createDataFrame([(h,) for h in heads], "h array<string>").select(files.normal_header_cells(F.col("h"))).collect()]
    assert got == [files.normal_headers([c or "" for c in h]) for h in heads] and got[0] == ["damage", "damage_2", "round_number", "column", "column_2", "damage_3"]
    assert [r[0] for r in spark.createDataFrame([(h,) for h in heads], "h array<string>").select(files.is_round_header(files.normal_header_cells(F.col("h")))).collect()] == [False, True, False, True]


def test_round_files_with_other_headers(spark, tmp_path):
    (tmp_path / "round_meta").mkdir()
    (tmp_path / "round_meta" / "a.csv").write_bytes("﻿file,round,map,winner_side,ct_eq_val,t_eq_val\nd,1,m,CT,1,2\n\nd,2,m,T,3\n".encode())
    (tmp_path / "round_meta" / "b.csv").write_text("File,Round Num,Map,Winner Side,CT Eq,T Eq,Round Type\ne,1,m,T,5,6,eco,extra\n")
    (tmp_path / "round_meta" / "c.csv").write_text("x,y\n1,2\n")
    (tmp_path / "kills.csv").write_text("file,round,tick\n")
    rows, read, skipped = files.read_round_files(spark, str(tmp_path))
    got = sorted((r.file, r.t_eq_val or r.t_eq or "") for r in rows.collect())
    assert got == [("d", ""), ("d", "2"), ("e", "6")]
    assert (read, skipped) == (2, 1)
    with pytest.raises(FileNotFoundError):
        files.list_files(spark, str(tmp_path / "none"))
    with pytest.raises(ValueError, match="No round_meta"):
        files.read_round_files(spark, str(tmp_path / "round_meta" / "c.csv"))


def test_many_files_in_one_scan(spark, tmp_path):
    for k in range(120):
        names = ["File", "map", f"Extra {k % 3}", "source_file"] if k % 2 else ["map", "FILE", "Map"]
        (tmp_path / f"{k:03d}.csv").write_text(",".join(names) + "\n" + "".join(f"{k}-{j},\"two\nlines, \"\"quoted\"\"\",x{j}\n" for j in range(3)))
    (tmp_path / "empty.csv").write_text("")
    found = files.read_files(spark, [str(tmp_path)])
    assert found.files.count() == 120 and set(found.rows.columns) == {"file", "map", "extra_0", "extra_1", "extra_2", "map_2", "source_file", "_source_file", "src_ord"}
    rows = found.rows.orderBy("src_ord").collect()
    assert [r["_source_file"] for r in rows] == [f"{k:03d}.csv" for k in range(120) for _ in range(3)]
    body = 'two\nlines, "quoted"'
    for i, r in enumerate(rows):
        k, j = divmod(i, 3)
        want = {"file": f"{k}-{j}", "map": body, f"extra_{k % 3}": f"x{j}"} if k % 2 else {"map": f"{k}-{j}", "file": body, "map_2": f"x{j}"}
        assert {c: v for c, v in r.asDict().items() if v is not None and c not in ("_source_file", "src_ord")} == want
    scans = found.rows._jdf.queryExecution().executedPlan().toString().count("FileScan")
    assert scans <= 2


def test_too_many_columns_are_an_error(spark, tmp_path):
    (tmp_path / "w.csv").write_text(",".join(f"c{k}" for k in range(files.MOST_COLUMNS + 1)) + "\n1\n")
    with pytest.raises(Exception, match="more than 256 columns"):
        files.read_files(spark, [str(tmp_path / "w.csv")])


def test_types_of_text(spark):
    rows = spark.createDataFrame([("1", "1.5", "true", "2024-01-02", "x", "", "7", None), (" 2 ", "3", "FALSE", "2024-02-29", "1", " ", "", None), (None, "", None, None, None, None, "9223372036854775808", None)], "a string, b string, c string, d string, e string, f string, g string, h string")
    out = files.typed(rows)
    assert dict(out.dtypes) == {"a": "bigint", "b": "double", "c": "boolean", "d": "date", "e": "string", "f": "string", "g": "double", "h": "string"}
    assert [r.a for r in out.collect()] == [1, 2, None] and files.typed(rows.limit(0)).dtypes == rows.dtypes


def test_one_file_in_order(spark, tmp_path):
    rows = spark.range(500).select((F.col("id") * 7919 % 500).alias("k"), F.concat(F.lit('a "q", '), F.col("id").cast("string")).alias("text, quoted"))
    files.write_ordered_csv(rows, str(tmp_path / "one.csv"), ["k"], 7)
    lines = (tmp_path / "one.csv").read_text().splitlines()
    assert lines[0] == 'k,"text, quoted"' and [int(x.split(",")[0]) for x in lines[1:]] == list(range(500)) and set(os.listdir(tmp_path)) <= {"one.csv", ".one.csv.crc"}
    files.write_ordered_csv(rows, str(tmp_path / "again.csv"), ["k"], 1)
    assert (tmp_path / "again.csv").read_bytes() == (tmp_path / "one.csv").read_bytes()
    files.write_ordered_csv(rows.limit(0), str(tmp_path / "one.csv"), ["k"])
    assert (tmp_path / "one.csv").read_text().splitlines() == lines[:1]


def test_bad_lines_are_named_by_part_and_line(spark, tmp_path):
    good = '{"doc_id": "r:%d", "text": "t", "metadata": {"a": "b"}}\n'
    (tmp_path / "one.jsonl").write_text("".join(good % k for k in range(2000)))
    (tmp_path / "two.jsonl").write_text("".join(good % k if k != 1500 else "\n{broken\n[1]\n" for k in range(2000)))
    paths = [str(tmp_path / f"{n}.jsonl") for n in ("one", "two")]
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "8000")  # many splits a file
        assert sorted((r.part, r.line) for r in files.document_errors(spark, *paths).collect()) == [("two.jsonl", 1502), ("two.jsonl", 1503)]
        with pytest.raises(Exception, match=r"two.jsonl:150[23]"):
            files.read_documents(spark, *paths).collect()
        assert files.read_documents(spark, paths[0]).select("doc_id").distinct().count() == 2000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_archive(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        for n in ("cup_meta_demos.part9.csv", "cup_master_kills_demos.part9.csv", "cup_master_dmg_demos.part9.csv", "maps/hill.png", "notes.txt"):
            z.writestr(n, "a,b\n")
    got = {r.member: (r.file_type, r.typed_path, r.size) for r in files.typed_manifest(files.unzip(spark, str(tmp_path / "*.zip"))).collect()}
    assert got == {
        "cup_meta_demos.part9.csv": ("round_meta", "round_meta/cup_meta_demos.part9.csv", 4), "cup_master_kills_demos.part9.csv": ("kills", "kills/cup_master_kills_demos.part9.csv", 4),
        "cup_master_dmg_demos.part9.csv": ("damage", "damage/cup_master_dmg_demos.part9.csv", 4), "maps/hill.png": ("assets", "assets/maps/hill.png", 4),
    }


def test_manifest_and_documents(spark, tmp_path):
    part = {"object_key": "k", "rows": 2, "first_doc_id": "r:1", "last_doc_id": "r:2"}
    (tmp_path / "m.json").write_text(json.dumps({"parts": [part]}))
    assert files.read_manifest(spark, str(tmp_path / "m.json")).first().last_line == 2
    (tmp_path / "bad.json").write_text(json.dumps({"parts": [part | {"last_doc_id": "r:0"}]}))
    with pytest.raises(Exception, match="bad manifest part 0"):
        files.read_manifest(spark, str(tmp_path / "bad.json")).collect()
    (tmp_path / "d.jsonl").write_text('{"doc_id": "r:1", "text": "t", "metadata": {"event_type": "kill", "document_tier": "x"}}\n\n{"doc_id": "r:2", "text": " ", "metadata": {}}\n')
    got = {r.doc_id: r.reason for r in files.checked_documents(files.read_documents(spark, str(tmp_path / "d.jsonl"))).collect()}
    assert got == {"r:1": None, "r:2": "missing_text"}
    (tmp_path / "m.md").write_text("# Title\ntext")
    assert files.read_markdown(spark, str(tmp_path / "*.md")).first().stem == "m"


def test_progress_finds_gaps(spark):
    ids = lambda *n: spark.createDataFrame([(f"r:{i}",) for i in n], "node_id string")
    assert retrieval.progress(ids(1, 2, 3), "r").first().contiguous and not retrieval.progress(ids(1, 3), "r").first().contiguous
    assert retrieval.progress(ids(1), "other").first().rows == 0


def test_streamed_rounds(spark, tmp_path):
    schema = "src_ord long, file string, round string, map string, winner_side string, ct_eq_val string, t_eq_val string"
    source, table = str(tmp_path / "in"), str(tmp_path / "out")
    for k, winner in ((1, "CT"), (2, "T")):
        spark.createDataFrame([(k, "d", "1", "m", winner, "1", "2"), (k, "d", "x", "m", winner, "1", "2")], schema).write.mode("append").parquet(source)
        streaming.upsert_rounds(spark.readStream.schema(schema).parquet(source), table, str(tmp_path / "cp")).awaitTermination()
    assert [(r.round_number, r.winner_side_current) for r in streaming.rounds_table(spark, table).read().collect()] == [(1, "T")]


def test_paths_and_ids(spark):
    assert S.join_path("/a/", "", "b/") == "a/b"
    rows = spark.createDataFrame([("r:x:12",), ("12",), ("r:a",)], "c string")
    assert [r[0] for r in rows.select(S.doc_line(F.col("c"))).collect()] == [12, None, None]


# ---- sums and means over ranges


def test_metrics_of_ranges_equal_those_of_one_sort(spark):
    rng = np.random.default_rng(8)
    p = np.concatenate([rng.random(400), np.repeat(0.25, 150), 0.5 + rng.random(200) / 1e6, [0.0, 1.0]])
    y = (rng.random(len(p)) < p).astype(int)
    rows = spark.createDataFrame([(float(a), int(b), "g" if i % 3 else None) for i, (a, b) in enumerate(zip(p, y, strict=True))], "p double, y int, seg string")
    auc = lambda at: float(np.mean([(1.0 if a > b else 0.5 if a == b else 0.0) for a in p[at][y[at] == 1] for b in p[at][y[at] == 0]]))
    assert abs(learning.metrics(rows).first().roc_auc - auc(np.arange(len(p)))) < 1e-9
    got = {r.seg: r.roc_auc for r in learning.metrics(rows, by=["seg"]).collect()}
    at = np.arange(len(p)) % 3 != 0
    assert abs(got["g"] - auc(at)) < 1e-9 and abs(got[None] - auc(~at)) < 1e-9
    points = {r.threshold: (r.fpr, r.tpr) for r in learning.roc_points(rows).collect()}
    assert set(points) == set(p.tolist())
    for t, (fpr, tpr) in points.items():
        assert abs(fpr - ((p >= t) & (y == 0)).sum() / (y == 0).sum()) < 1e-9 and abs(tpr - ((p >= t) & (y == 1)).sum() / (y == 1).sum()) < 1e-9


def test_split_takes_the_share_of_many_files(spark):
    split = learning.group_split(spark.range(9_001).select(F.concat(F.lit("f"), "id").alias("file")), 0.3)
    tested = {r.file for r in split.where("is_test").collect()}
    order = sorted((hashlib.md5(f"42f{i}".encode()).hexdigest(), f"f{i}") for i in range(9_001))
    assert split.count() == 9_001 and tested == {f for _, f in order[:2_701]}


def test_means_across_files_of_few_rows(spark):
    from matchlake.operators import rounds

    rng = np.random.default_rng(6)
    rows = [(f"m{i:03}", n, "CT", 1, float(rng.integers(0, 9))) for i in range(60) for n in range(1, 1 + int(rng.integers(1, 5)))]
    df = spark.createDataFrame(rows, "file string, round_number int, winner_side_norm string, winner_side_code int, eq_diff double")
    got = {(r.file, r.round_number): r.eq_diff_rollmean3 for r in rounds.supervised(df, cross_file=True).collect()}
    lag = [rows[i - 1][4] if i and rows[i - 1][0] == r[0] else None for i, r in enumerate(rows)]
    for i, r in enumerate(rows):
        if i + 1 < len(rows) and rows[i + 1][0] == r[0]:
            seen = [x for x in lag[max(0, i - 2) : i + 1] if x is not None]
            assert got.pop((r[0], r[1])) == (pytest.approx(sum(seen) / len(seen)) if seen else None)
    assert not got


def test_batch_search_in_blocks(spark):
    from matchlake.operators import retrieval

    rng = np.random.default_rng(3)
    x = rng.normal(size=(90, 4))
    x[40:60] = x[40]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(90, None), (91, [0.0] * 4), (92, [1.0]), (93, [1.0, None, 2.0, 3.0])], "vec_id long, embedding array<double>")
    asked = df.where("vec_id % 7 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    got = {}
    for r in retrieval.top_k_batch(df, asked, 5, 4, block=16).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id))
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    for q in range(0, 90, 7):
        assert [v for _, v in sorted(got.pop(q))] == np.lexsort((np.arange(90), -np.round(unit @ unit[q], 6)))[:5].tolist()
    assert not got
    assert retrieval.top_k_batch(df.limit(0), asked, 5, 4).count() == 0
