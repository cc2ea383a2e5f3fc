"""Embedding runs, exact cosine search, lexical search over training runs, and both side by side."""

from __future__ import annotations

import hashlib
import logging
import math
import re
import time
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions.scalars import without_accents
from . import fulltext

LOG = logging.getLogger(__name__)
BATCH = 256
TOP_K = 5
DEFAULT_RUN = "pipeline-docs"
EMBEDDED = "node_id string, text string, metadata map<string,string>, embedding array<float>, embedding_run_id string, doc_line long"
FILTER_KEYS = ("event_type", "map", "file", "round", "document_tier", "weapon")
# Words that a query's tokens leave out; phrases and words that ask for the best model; metrics by name.
STOP_WORDS = "a an as best better compare comparacao comparar comparison de do dos e em foi maior mais melhor modelo model o os para performou performance qual que resultado top".split()
BEST_PHRASES = ("mais performou", "melhor desempenho", "melhor modelo", "best model", "best performer", "highest roc auc", "highest f1")
BEST_WORDS = frozenset("best better desempenho melhor performou performance ranking top".split())


# ---- embedding runs


def hashing_embedder(dim: int = 64) -> Callable[[list[str]], list[list[float]]]:
    """A stand-in for a language model: signed hashed words, normalised. The same text always gives the same vector."""

    def embed(texts: list[str]) -> list[list[float]]:
        out = []
        for x in texts:
            v = [0.0] * dim
            for w in without_accents(x).split():
                h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
                v[h % dim] += 1.0 if h >> 63 else -1.0
            n = math.sqrt(sum(c * c for c in v)) or 1.0
            out.append([c / n for c in v])
        return out

    return embed


def _embed_or_skip(embed, texts: list[str]) -> list[list[float] | None]:
    """Halves a batch that fails with NaN until the text at fault is alone, and skips it; other errors stay errors."""
    try:
        got = embed(texts)
        if all(all(math.isfinite(c) for c in v) for v in got):
            return list(got)
        bad: Exception = ValueError("NaN in an embedding")
    except Exception as e:  # noqa: BLE001
        if "nan" not in str(e).lower():
            raise
        bad = e
    if len(texts) == 1:
        return [None]
    if not texts:
        raise bad
    half = len(texts) // 2
    return _embed_or_skip(embed, texts[:half]) + _embed_or_skip(embed, texts[half:])


def check_dimension(vectors: DataFrame, dim: int, column: str = "embedding") -> DataFrame:
    """One row: how many vectors there are, and how many have another length."""
    return vectors.agg(F.count(F.lit(1)).alias("vectors"), F.count_if(F.size(column) != dim).alias("wrong"))


def run_metadata(metadata: Column, doc_id: Column, run_id: str, model: str, source_run_id: str | None = None, prefix: str | None = None) -> Column:
    """A document's metadata with the run's own in place of what it had: its id, the embedding run, the run that made the
    documents, the prefix of the data and the model. A run that is not told keeps what the document says."""
    own = {"doc_id": doc_id, "embedding_run_id": F.lit(run_id), "embed_model": F.lit(model), "document_source_run_id": F.lit(source_run_id), "dataset_prefix": F.lit(prefix)}
    own = {k: v for k, v in own.items() if not (k == "document_source_run_id" and source_run_id is None) and not (k == "dataset_prefix" and prefix is None)}
    return F.map_concat(F.map_filter(metadata, lambda k, v: ~k.isin(*own)), F.create_map(*[x for k, v in own.items() for x in (F.lit(k), v)]))


def delete_run(vectors: DataFrame, run_id: str) -> tuple[DataFrame, DataFrame]:
    """What is left without a run, and one row with the number of rows that it had."""
    return vectors.where(F.coalesce(F.col("embedding_run_id") != run_id, F.lit(True))), vectors.agg(F.count_if(F.col("embedding_run_id") == run_id).alias("deleted_rows"))


def after_line(docs: DataFrame, resume_from: int, id_column: str = "doc_id") -> DataFrame:
    """The documents with a line number (doc_line) beyond those that are done."""
    return docs.withColumn("doc_line", S.doc_line(F.col(id_column))).where(F.col("doc_line") > resume_from)


def embed_documents(docs: DataFrame, run_id: str, embed: Callable[[list[str]], list[list[float]]], dim: int, model: str = "hashing", batch: int = BATCH, resume_from: int = 0, max_documents: int | None = None, source_run_id: str | None = None, prefix: str | None = None) -> DataFrame:
    """doc_id, text, metadata -> vectors of run `run_id`, a batch at a time in the tasks; documents up to `resume_from` are
    passed over before anything is embedded. `embed` is called in the tasks: a `models.Model` is made once a worker."""
    rows = after_line(docs, resume_from)
    if max_documents is not None:
        rows = rows.orderBy("doc_line").limit(max_documents)
    rows = rows.withColumn("metadata", run_metadata(F.col("metadata"), F.col("doc_id"), run_id, model, source_run_id, prefix))

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for i in range(0, len(frame), batch):
                part = frame.iloc[i : i + batch]
                vectors = _embed_or_skip(embed, part["text"].tolist())
                part = part.assign(embedding=vectors)
                part = part[[v is not None for v in vectors]]
                if len(part) and any(len(v) != dim for v in part["embedding"]):
                    raise ValueError(f"the model's vectors do not have {dim} components")
                yield part.assign(embedding_run_id=run_id).rename(columns={"doc_id": "node_id"})[["node_id", "text", "metadata", "embedding", "embedding_run_id", "doc_line"]]

    return rows.select("doc_id", "text", "metadata", "doc_line").mapInPandas(work, EMBEDDED)


def write_run(vectors: DataFrame, folder: str) -> None:
    """Replaces the partitions of the runs that `vectors` has, and no other."""
    vectors.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("embedding_run_id").parquet(folder)


def progress(vectors: DataFrame, run_id: str, id_column: str = "node_id") -> DataFrame:
    """rows, documents, first and last line of a run, and whether they are contiguous from 1."""
    second = F.split_part(F.col(id_column), F.lit(":"), F.lit(2)).try_cast("long")
    one = vectors.where(F.col(id_column).startswith(f"{run_id}:")).agg(F.count(F.lit(1)).alias("rows"), F.count_distinct(id_column).alias("documents"), F.min(second).alias("first_line"), F.max(second).alias("last_line"))
    return one.withColumn("contiguous", (F.col("rows") == 0) | ((F.col("first_line") == 1) & (F.col("documents") == F.col("rows")) & (F.col("last_line") == F.col("rows"))))


def sanitized(metadata: Column) -> Column:
    """Without private keys, and without other ids where there is a doc_id."""
    has = F.coalesce(metadata["doc_id"], F.lit("")) != ""
    return F.map_filter(metadata, lambda k, v: ~k.startswith("_") & ~(has & k.isin("document_id", "ref_doc_id")))


# ---- semantic search


def cosine(vector: Column, query: list[float]) -> Column:
    """Null for vectors of no length, and for those with a component that is null or not finite."""
    q = [float(x) for x in query]
    lit = F.array(*map(F.lit, q))
    norm = math.sqrt(sum(x * x for x in q))
    dot = F.aggregate(F.zip_with(vector, lit, lambda a, b: a.cast("double") * b), F.lit(0.0), lambda a, b: a + b)
    own = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda a, b: a + b.cast("double") * b.cast("double")))
    score = dot / (own * F.lit(norm))
    return F.when((own > 0) & F.lit(norm > 0) & ~F.isnan(score) & (own < float("inf")), score)


def check_request(query: str, run_id: str, top_k: int) -> None:
    if not query or not query.strip():
        raise ValueError("query must not be blank")
    if not run_id or not run_id.strip():
        raise ValueError("embedding_run_id must not be blank")
    if top_k <= 0:
        raise ValueError("top_k must be positive")


def search_filter(run_id: str, **wanted) -> Column:
    """The run, which is a partition, and any of FILTER_KEYS."""
    out = F.col("embedding_run_id") == run_id
    for k, v in wanted.items():
        if k not in FILTER_KEYS:
            raise ValueError(f"unknown filter {k}")
        if v is not None:
            out = out & (F.col("metadata")[k] == str(v))
    return out


def top_k(rows: DataFrame, score: Column, k: int, tie: str, descending: bool = True) -> DataFrame:
    """The best k rows with score and rank; no shuffle but of k rows a task."""
    best = rows.withColumn("score", score).where("score IS NOT NULL").orderBy(F.col("score").desc() if descending else F.col("score"), tie).limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.col("score").desc() if descending else F.col("score"), tie)))


def top_k_batch(vectors: DataFrame, queries: DataFrame, k: int, dim: int, digits: int = 6, block: int = 8192) -> DataFrame:
    """vec_id, embedding and query_id, query -> query_id, rank, vec_id, score: for each query its k rows of the greatest cosine,
    rounded to `digits`, ties to the smaller id. Exact.

    Queries and vectors are cut into blocks of about `block` rows; each pair of blocks gives the k best of the vectors' block, and a query's are
    merged. Rows of another dimension, with a component that is null or not finite, or of no length take no part."""
    spare = lambda df, i, v: df.select(F.col(i).cast("long").alias(i), F.transform(v, lambda x: x.cast("double")).alias("v")).where((F.size("v") == dim) & ~F.exists("v", lambda x: x.isNull()) & ~F.exists("v", lambda x: F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("v", lambda x: x != 0))
    number = F.monotonically_increasing_id()
    held, asked = spare(vectors, "vec_id", "embedding"), spare(queries, "query_id", "query")
    n, m = (max(1, math.ceil(df.count() / block)) for df in (held, asked))
    every = lambda x: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(x - 1).cast("long")))
    held = held.withColumn("b", F.pmod(number, F.lit(n))).withColumn("g", every(m))
    asked = asked.withColumn("g", F.pmod(number, F.lit(m))).withColumn("b", every(n))

    def matrix(column) -> np.ndarray:
        return np.asarray(column.combine_chunks().flatten(), dtype=np.float64).reshape(-1, dim)

    def meet(some: pa.Table, others: pa.Table) -> pa.Table:
        q, x = matrix(some.column("v")), matrix(others.column("v"))
        ids = others.column("vec_id").to_numpy()
        q, x = q / np.linalg.norm(q, axis=1, keepdims=True), x / np.linalg.norm(x, axis=1, keepdims=True)
        out = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]
        for one, row in zip(some.column("query_id").to_numpy(), q, strict=True):
            score = np.round(x @ row, digits)
            least = np.partition(score, max(0, len(score) - k))[max(0, len(score) - k)] if len(score) else 0.0
            at = np.flatnonzero(score >= least)
            best = at[np.lexsort((ids[at], -score[at]))[:k]]
            out.append((np.full(len(best), one), ids[best], score[best]))
        return pa.table([np.concatenate(c) for c in zip(*out, strict=True)], names=["query_id", "vec_id", "score"])

    found = asked.groupBy("b", "g").cogroup(held.groupBy("b", "g")).applyInArrow(meet, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def semantic_search(vectors: DataFrame, query: str, embed, run_id: str = DEFAULT_RUN, k: int = TOP_K, digits: int | None = None, **wanted) -> DataFrame:
    """The k nearest of a run, ties by node_id; with `digits`, scores are rounded to so many before they are compared."""
    check_request(query, run_id, k)
    score = cosine(F.col("embedding"), embed([query])[0])
    found = top_k(vectors.where(search_filter(run_id, **wanted)), score if digits is None else F.round(score, digits), k, "node_id")
    meta = sanitized(F.col("metadata"))
    field = lambda c: F.nullif(meta[c], F.lit(""))
    return found.select("rank", "score", F.coalesce(field("doc_id"), F.col("node_id")).alias("doc_id"), "text", field("event_type").alias("event_type"), field("map").alias("map"), field("file").alias("file"), S.round_value(meta["round"]).alias("round"), field("source_file").alias("source_file"), meta.alias("metadata"))


# ---- lexical search


def normal_query(query: str) -> str:
    return re.sub(r"[^a-z0-9]+", " ", without_accents(query)).strip()


def query_tokens(query: str) -> list[str]:
    return sorted(set(normal_query(query).split()) - set(STOP_WORDS))


def asks_for_best(query: str) -> bool:
    q = normal_query(query)
    return any(p in q for p in BEST_PHRASES) or bool(BEST_WORDS & set(q.split()))


def metric_asked(query: str) -> tuple[str, bool]:
    """(column, whether higher is better)"""
    q = normal_query(query)
    words = set(q.split())
    if "brier" in words:
        return "brier", False
    if {"log", "loss"} <= words:
        return "log_loss_val", False
    if {"balanced", "accuracy"} <= words:
        return "balanced_accuracy", True
    return ("f1" if "f1" in words else "roc_auc"), True


def lexical_fallback(runs: DataFrame, query: str, k: int = TOP_K, model_filter: str | None = None) -> DataFrame:
    """Ranks the newest max(10 k, 20) runs by the metric that is asked for, or else by the query's words that they have."""
    tokens = F.array(*map(F.lit, query_tokens(query))) if query_tokens(query) else F.array().cast("array<string>")
    rows = runs if model_filter is None else runs.where(F.col("model_name") == model_filter)
    rows = rows.orderBy(F.col("created_at").desc(), "model_name").limit(max(10 * k, 20))
    shared = lambda c: F.size(F.array_intersect(S.token_set(c), tokens))
    rows = rows.withColumn("model_overlap", shared(F.col("model_name"))).withColumn("text_overlap", shared(F.concat_ws(" ", "model_name", F.coalesce("search_text", F.lit("None")))))
    rows = rows.withColumn("_named", F.max("model_overlap").over(Window.partitionBy())).where((F.col("_named") == 0) | (F.col("model_overlap") > 0)).drop("_named")  # at most max(10 k, 20) rows
    overlap = (F.col("model_overlap") + F.col("text_overlap")).cast("double")
    if asks_for_best(query):
        name, higher = metric_asked(query)
        value = F.when(F.isnan(F.col(name).cast("double")), None).otherwise(F.col(name).cast("double"))
        primary = value if higher else -value
        rows = rows.withColumn("score", F.when(value.isNull(), overlap).otherwise(value if higher else 1 / (1 + value)))
        order = [primary.desc_nulls_last(), overlap.desc(), F.col("model_name").desc()]
    else:
        rows = rows.where("text_overlap > 0").withColumn("score", F.col("text_overlap").cast("double"))
        order = [F.col("text_overlap").desc(), F.col("model_overlap").desc(), F.col("created_at").cast("string").desc(), F.col("model_name").desc()]
    return decoded(rows.withColumn("rank", F.row_number().over(Window.orderBy(*order))).where(F.col("rank") <= k))


def decoded(found: DataFrame) -> DataFrame:
    """Rows of a search over training runs with their JSON decoded: importances as a map of numbers, segments as a map of maps
    of metrics. What is no such JSON is null."""
    kinds = {"feature_importances": "map<string,double>", "map_segment_metrics": "map<string,map<string,double>>", "half_segment_metrics": "map<string,map<string,double>>"}
    texts = dict(found.dtypes)
    return found.withColumns({c: F.try_variant_get(F.try_parse_json(c), "$", k) for c, k in kinds.items() if texts.get(c) == "string"})


#: What tells training runs apart.
RUN_KEY = ["run_id", "model_name"]


def fts(runs: DataFrame, query: str, k: int = TOP_K, model_filter: str | None = None, index: DataFrame | None = None) -> DataFrame:
    """The k runs that a web-style query (words joined by and, "or", -not, "phrases") ranks highest; ties: the newest, then
    by model. `index` has the runs' postings (`fulltext.postings` by RUN_KEY); without it they are made."""
    rows = runs if model_filter is None else runs.where(F.col("model_name") == model_filter)
    posted = fulltext.postings(rows, RUN_KEY) if index is None else index
    return decoded(fulltext.search(posted, rows, query, RUN_KEY, k, [F.col("created_at").desc(), F.col("model_name"), F.col("run_id")]))


def lexical_search(runs: DataFrame, query: str, k: int = TOP_K, model_filter: str | None = None) -> DataFrame:
    found = fts(runs, query, k, model_filter)
    return lexical_fallback(runs, query, k, model_filter).drop("model_overlap", "text_overlap") if found.isEmpty() else found


def hybrid_search(vectors: DataFrame | None, runs: DataFrame | None, query: str, embed, run_id: str = DEFAULT_RUN, k: int = TOP_K, model_filter: str | None = None, lexical_k: int | None = None, digits: int | None = None) -> dict:
    """Both searches by themselves: {"semantic": rows, "lexical": rows, "retrieval_ms": time}; one that fails is an empty list.
    Each has k rows, the lexical one `lexical_k` if that is given."""
    began, out = time.time(), {}
    for name, run in (("semantic", lambda: semantic_search(vectors, query, embed, run_id, k, digits)), ("lexical", lambda: lexical_search(runs, query, k if lexical_k is None else lexical_k, model_filter))):
        try:
            out[name] = [r.asDict(recursive=True) for r in run().orderBy("rank").collect()]  # k rows
        except Exception:  # noqa: BLE001  the other branch answers
            LOG.exception("%s search failed", name)
            out[name] = []
    return out | {"retrieval_ms": (time.time() - began) * 1000}


def rag_context(found: DataFrame) -> DataFrame:
    """One row: the passages of a search in rank order, numbered, and their ids."""
    rows = F.array_sort(F.collect_list(F.struct("rank", "doc_id", "text")))  # k rows
    return found.agg(rows.alias("x")).select(F.concat_ws("\n\n", F.transform("x", lambda r: F.concat(F.lit("["), r["rank"].cast("string"), F.lit("] "), r["text"]))).alias("context"), F.transform("x", lambda r: r["doc_id"]).alias("sources"))


def rag_query(vectors: DataFrame, query: str, embed, answer: Callable[[str], str], run_id: str = DEFAULT_RUN, k: int = 10, **wanted) -> dict:
    """Retrieves, builds the prompt and asks the model that is passed in."""
    found = semantic_search(vectors, query, embed, run_id, k, **wanted)
    sources = [r.asDict() for r in found.select("rank", "score", "doc_id", "text", "event_type", "map").orderBy("rank").collect()]
    context = "\n\n".join(f"[{s['rank']}] {s['text']}" for s in sources)
    return {"sources": sources, "answer": answer(f"{context}\n\n{query}")}


def rag_stream(vectors: DataFrame, query: str, embed, chunks: Callable[[str], Iterator[str]], **kwargs) -> Iterator[tuple[str, object]]:
    """("sources", list), ("chunk", text) ..., ("done", None)"""
    got: list[str] = []
    result = rag_query(vectors, query, embed, lambda prompt: got.append(prompt) or "", **kwargs)
    yield "sources", result["sources"]
    for part in chunks(got[0]):
        yield "chunk", part
    yield "done", None


def markdown_chunks(pages: DataFrame) -> DataFrame:
    """path, text -> path, chunk, header, text: one row for each header and what is under it; fences hide headers."""

    def split(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for path, text in zip(frame["path"], frame["text"], strict=True):
                part, header, fenced, n = [], None, False, 0
                for line in [*(text or "").split("\n"), None]:
                    fenced ^= line is not None and line.lstrip().startswith("```")
                    if line is None or (not fenced and re.match(r"#{1,6}\s", line)):
                        if "\n".join(part).strip():
                            rows.append((path, n, header, "\n".join(part).strip()))
                            n += 1
                        if line is not None:
                            part, header = [], line.lstrip("#").strip()
                    if line is not None:
                        part.append(line)
            yield pd.DataFrame(rows, columns=["path", "chunk", "header", "text"])

    return pages.select("path", "text").mapInPandas(split, "path string, chunk int, header string, text string")
