"""Operator 4: bottom-k sketches of word shingles as document fingerprints.

A sketch is the K least of a set's 48-bit shingle hashes. The sketch of a union is the K least of the sketches, so parts
are sketched where they are and merged. Of two sketches, the K least hashes of both together are a sample of the union:
the share that both have estimates the resemblance |A & B| / |A | B|, and with the distinct counts the containment
|A & B| / |A|. Sketches of sets with fewer than K shingles are the sets, and their estimates exact.

As text, a sketch is its hashes in base 64, six bytes each, ascending.

Edge cases: null, empty and blank texts have the empty sketch, which is like itself (1) and unlike any other (0);
repeated rows have equal sketches; rows of equal ids are neighbours in the order of their texts; a null id comes last;
one row alone is its own next document; an empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text

K = 256
WORDS = 5
_SHIFT = np.uint64(16)
_SPACE = float(1 << 48)


def sketch(shingles: np.ndarray, k: int = K) -> np.ndarray:
    """The k least 48-bit hashes of an ascending array of distinct 64-bit ones."""
    least = shingles[: 2 * k] >> _SHIFT
    least = least[np.concatenate(([True], least[1:] != least[:-1]))] if len(least) else least
    return least[:k]


def merge(sketches: Iterable[np.ndarray], k: int = K) -> np.ndarray:
    parts = list(sketches)
    return np.unique(np.concatenate(parts))[:k] if parts else np.zeros(0, np.uint64)


def distinct(a: np.ndarray, k: int = K) -> float:
    """Estimated number of distinct shingles."""
    return float(len(a)) if len(a) < k else (k - 1) / ((int(a[k - 1]) + 1) / _SPACE)


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = np.concatenate((a, b))
    both.sort()
    first = np.concatenate(([True], both[1:] != both[:-1]))
    limit = both[first][:k]
    twice = both[1:][~first[1:]]
    return float(np.searchsorted(twice, limit[-1], side="right")) / len(limit)


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated share of a's shingles that b has; 1 for an empty a."""
    if not len(a):
        return 1.0
    if len(a) < k and len(b) < k:
        return float(len(np.intersect1d(a, b, assume_unique=True))) / len(a)
    return min(1.0, resemblance(a, b, k) * distinct(merge((a, b), k), k) / distinct(a, k))


def to_text(a: np.ndarray) -> str:
    return base64.b64encode(np.ascontiguousarray(a.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 2:]).tobytes()).decode()


def from_text(s: str | None) -> np.ndarray:
    raw = np.frombuffer(base64.b64decode(s or ""), dtype=np.uint8).reshape(-1, 6)
    wide = np.zeros((len(raw), 8), dtype=np.uint8)
    wide[:, 2:] = raw
    return wide.view(">u8").ravel().astype(np.uint64)


def _sketches(column: pa.Array) -> list[np.ndarray]:
    return [sketch(s) for s in text.shingle_sets(column, WORDS)]


def fingerprint(column: str | Column) -> Column:
    """Column of texts -> column of fingerprints."""

    @F.pandas_udf("string")
    def make(s: pd.Series) -> pd.Series:
        return pd.Series([to_text(x) for x in _sketches(pa.array(s, pa.string(), from_pandas=True))])

    return make(column)


def _estimate(f):
    def column(a: str | Column, b: str | Column) -> Column:
        @F.pandas_udf("double")
        def make(x: pd.Series, y: pd.Series) -> pd.Series:
            return pd.Series([f(from_text(p), from_text(q)) for p, q in zip(x, y, strict=True)], dtype=float)

        return make(a, b)

    return column


resemblance_of = _estimate(resemblance)
containment_of = _estimate(containment)


def distinct_of(a: str | Column) -> Column:
    @F.pandas_udf("double")
    def make(x: pd.Series) -> pd.Series:
        return pd.Series([distinct(from_text(p)) for p in x], dtype=float)

    return make(a)


def merge_fingerprints(df: DataFrame, key: str, column: str = "fingerprint") -> DataFrame:
    """(key, fingerprint) rows -> one merged fingerprint a key. A task merges what it has before anything is shuffled,
    and a key's parts meet in two steps, so a group never holds more than one sketch for each of its parts."""
    kind = df.schema[key].dataType.simpleString()

    def partial(batches):
        for batch in batches:
            groups: dict = {}
            for k, s in zip(batch.column(key).to_pylist(), batch.column(column).to_pylist(), strict=True):
                a = from_text(s)
                groups[k] = merge((groups[k], a)) if k in groups else a
            yield pa.RecordBatch.from_arrays([pa.array(list(groups), batch.schema.field(key).type), pa.array([to_text(a) for a in groups.values()])], [key, column])

    def group(table: pa.Table) -> pa.Table:
        merged = to_text(merge(from_text(s) for s in table.column(column).to_pylist()))
        return pa.table({key: table.column(key).slice(0, 1), column: pa.array([merged])})

    schema = f"{key} {kind}, {column} string"
    parts = df.select(key, column).mapInArrow(partial, schema).withColumn("_part", F.pmod(F.spark_partition_id(), F.lit(64)))
    return parts.groupBy(key, "_part").applyInArrow(group, schema).groupBy(key).applyInArrow(group, schema)


def with_next(docs: DataFrame, parts: int) -> DataFrame:
    """doc_id, text -> partitions in descending order of doc_id, each ending in the document that comes next (`halo`).

    The ids' quantiles cut the order into parts; the first document of each part is also dealt to the part before it,
    and the first of all to the last part. Texts are shuffled once.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    key = F.coalesce("doc_id", F.lit(-(1 << 63)))
    docs = docs.withColumn("key", key)
    cuts = docs.approxQuantile("doc_id", [i / parts for i in range(1, parts)], 0.2 / parts) if parts > 1 else []
    bounds = np.unique(np.array(cuts, dtype=np.int64))[::-1]

    @F.pandas_udf("int")
    def part(ids: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(-bounds.astype(np.float64), -ids.to_numpy(dtype=np.float64), side="right").astype(np.int32))

    firsts = [(r["part"], r["key"]) for r in docs.select("key", part("key").alias("part")).groupBy("part").agg(F.max("key").alias("key")).collect()]  # one a part
    firsts.sort()
    to = [(firsts[i - 1][0], k) for i, (_, k) in enumerate(firsts)] or [(0, 0)]
    where = spark.createDataFrame(to, "part int, key long")
    halo = docs.where(F.col("key").isin([k for _, k in to])).groupBy("key").agg(F.min("text").alias("text")).join(F.broadcast(where), "key").select("part", F.lit(True).alias("halo"), "key", F.lit(None).cast("long").alias("doc_id"), "text")
    rows = docs.select(part("key").alias("part"), F.lit(False).alias("halo"), "key", "doc_id", "text").union(halo)
    return rows.repartitionById(len(bounds) + 1, "part").sortWithinPartitions(F.col("halo"), F.col("key").desc(), F.col("text"))


def _rows(ids: list, texts: list[str]) -> pa.RecordBatch:
    """The results of all documents but the last, which is only the next of the one before."""
    n = len(texts) - 1
    edited = [a[: len(a) - len(a) // 2] + b[: len(a) // 2] for a, b in zip(texts[:-1], texts[1:], strict=True)]
    own, new = _sketches(pa.array(texts, pa.string())), _sketches(pa.array(edited, pa.string()))
    return pa.RecordBatch.from_arrays(
        [
            pa.array(ids[:n], pa.int64()),
            pa.array([len(a) for a in texts[:n]], pa.int64()),
            pa.array([hashlib.sha256(a.encode()).hexdigest() for a in edited], pa.string()),
            pa.array([to_text(a) for a in own[:n]], pa.string()),
            pa.array([to_text(a) for a in new], pa.string()),
            pa.array([resemblance(a, b) for a, b in zip(own[:n], new, strict=True)], pa.float64()),
            pa.array([resemblance(a, b) for a, b in zip(own[:-1], own[1:], strict=True)], pa.float64()),
            pa.array([distinct(a) for a in own[:n]], pa.float64()),
            pa.array([containment(a, b) for a, b in zip(own[:n], new, strict=True)], pa.float64()),
        ],
        ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "distinct_shingles", "contained_in_edited"],
    )


@text.tidy
def _edit(batches):
    ids, texts, size = [], [], 0
    for batch in batches:
        for i, x in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
            ids.append(i)
            texts.append(x)
            size += len(x)
            if size >= text.SLICE_BYTES and len(texts) > 1:
                yield _rows(ids, texts)
                ids, texts, size = ids[-1:], texts[-1:], len(x)
    if len(texts) > 1:
        yield _rows(ids, texts)


RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, distinct_shingles double, contained_in_edited double"


def edited_likeness(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """Each document's fingerprint, that of its text with the second half replaced by the next document's beginning,
    and how alike the fingerprints are."""
    parts = parts or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return with_next(docs, parts).select("doc_id", "text").mapInArrow(_edit, RESULT)


def op4(spark, sf_dir: str) -> DataFrame:
    return edited_likeness(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
