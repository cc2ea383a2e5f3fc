"""Operator 1: token counts as delta-maintained rollups.

A rollup is a folder of committed batches. Each batch turns a feed of changes into signed additive totals for
(source, language, tokenizer version): an insert adds its count, a delete takes its count away, a revision takes the old
count from the old group and adds the new one to the new group. Totals are the sum over committed batches, so a change
costs the size of the change and never a recount of the corpus.

Commits are idempotent. A batch is written to a folder of its own attempt and then renamed to its id; the rename fails
if the id is already there, so a batch that is sent again, or by two writers at once, counts once. `compact` folds what
is live into a generation, named by its number alone: of two compactions at once one rename succeeds, and the other has
no effect. A generation lists all batches that it or one before it folded; they are read no more and never accepted again,
whether or not their folders, or those of older generations, still exist.

This needs a store whose rename of a folder is atomic and fails if the goal is there, such as HDFS. On object stores, where a
rename is a copy, let one writer at a time commit.

Edge cases: null source or lang are groups of their own; null counts are 0; a null text has no tokens; a delete of what
was never inserted leaves a negative total (the feed is taken at its word); groups whose documents and tokens are all
zero are left out; an empty feed commits an empty batch; an empty rollup has no rows. Extra columns of a feed are ignored.
"""

from __future__ import annotations

import uuid
from collections import deque

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import text, tokens
from .shared import new_path

KEYS = ("source", "lang", "tokenizer")
SUMS = ("n_docs", "n_tokens")
SCHEMA = "source string, lang string, tokenizer string, n_docs long, n_tokens long, folded string"
GENERATION = "generation-"


def _batches(spark: SparkSession, root: str) -> dict[str, str]:
    """Committed batches: id -> path."""
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/committed")
    fs = place.getFileSystem(spark._jsc.hadoopConfiguration())
    return {x.getPath().getName(): x.getPath().toString() for x in fs.listStatus(place)} if fs.exists(place) else {}


def _commit(spark: SparkSession, root: str, batch_id: str, rows: DataFrame) -> bool:
    attempt = f"{root}/attempts/{uuid.uuid4().hex}"
    rows.write.parquet(attempt)
    hadoop = spark._jvm.org.apache.hadoop.fs
    source, goal = hadoop.Path(attempt), hadoop.Path(f"{root}/committed/{batch_id}")
    fs = goal.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(goal.getParent())
    done = not fs.exists(goal) and fs.rename(source, goal)
    if done and fs.exists(hadoop.Path(goal, source.getName())):  # a rename into a folder that came meanwhile
        fs.delete(hadoop.Path(goal, source.getName()), True)
        done = False
    fs.delete(source, True)
    return done


def signed(changes: DataFrame) -> DataFrame:
    """A feed -> one signed row for each count that it adds or takes.

    A feed has `op` ('insert', 'delete', 'revise'), source, lang, tokenizer, n_tokens (the count now; for a delete, the
    count that was), and, if it has revisions, old_source, old_lang, old_tokenizer, old_n_tokens.
    """

    def part(prefix: str, sign: int):
        return F.struct(*[F.col(prefix + k).cast("string").alias(k) for k in KEYS], F.lit(sign).cast("long").alias("n_docs"), (F.lit(sign) * F.coalesce(F.col(f"{prefix}n_tokens").cast("long"), F.lit(0))).alias("n_tokens"))

    parts = F.when(F.col("op") == "insert", F.array(part("", 1))).when(F.col("op") == "delete", F.array(part("", -1)))
    if "old_n_tokens" in changes.columns:
        parts = parts.when(F.col("op") == "revise", F.array(part("old_", -1), part("", 1)))
    return changes.select(F.explode(parts).alias("x")).select("x.*")


def apply_batch(spark: SparkSession, root: str, batch_id: str, changes: DataFrame) -> bool:
    """Commits a batch of changes; False, and no effect, if the id is committed already."""
    if batch_id.startswith(GENERATION):
        raise ValueError(f"ids that begin with {GENERATION} are those of compactions")
    done = _batches(spark, root)
    if batch_id in done or _folded(spark, done, [batch_id]):
        return False
    sums = signed(changes).groupBy(*KEYS).agg(*[F.sum(c).alias(c) for c in SUMS])
    return _commit(spark, root, batch_id, sums.withColumn("folded", F.lit(None).cast("string")))


def _newest(done: dict[str, str]) -> int:
    """The number of the last generation; 0 if nothing was compacted yet."""
    return max((int(k.removeprefix(GENERATION)) for k in done if k.startswith(GENERATION)), default=0)


def _folded(spark: SparkSession, done: dict[str, str], ids: list[str]) -> set[str]:
    """Which of `ids` the last generation has folded."""
    last = done.get(f"{GENERATION}{_newest(done)}")
    return {r["folded"] for r in spark.read.schema(SCHEMA).parquet(last).where(F.col("folded").isin(ids)).select("folded").collect()} if last and ids else set()


def _live(spark: SparkSession, done: dict[str, str]) -> dict[str, str]:
    """The last generation and the batches that it has not folded."""
    last, batches = f"{GENERATION}{_newest(done)}", [k for k in done if not k.startswith(GENERATION)]
    gone = _folded(spark, done, batches)
    return {k: done[k] for k in [*batches, last] if k in done and k not in gone}


def _sums(spark: SparkSession, live: dict[str, str]) -> DataFrame:
    rows = spark.read.schema(SCHEMA).parquet(*live.values()) if live else spark.createDataFrame([], SCHEMA)
    sums = rows.where("folded IS NULL").groupBy(*KEYS).agg(*[F.sum(c).alias(c) for c in SUMS])
    return sums.where("n_docs <> 0 OR n_tokens <> 0")


def totals(spark: SparkSession, root: str) -> DataFrame:
    """source, lang, tokenizer, n_docs, n_tokens of all committed batches."""
    return _sums(spark, _live(spark, _batches(spark, root)))


def compact(spark: SparkSession, root: str) -> bool:
    """Folds all live batches into the next generation; False, and no effect, if another compaction came first."""
    done = _batches(spark, root)
    live, newest = _live(spark, done), _newest(done)
    rows = _sums(spark, live).withColumn("folded", F.lit(None).cast("string"))
    names = spark.createDataFrame([(k,) for k in live if not k.startswith(GENERATION)], "folded string")
    if newest:
        names = names.union(spark.read.schema(SCHEMA).parquet(done[f"{GENERATION}{newest}"]).where("folded IS NOT NULL").select("folded"))
    marks = names.select(*[F.lit(None).cast(t).alias(c) for c, t in (x.split() for x in SCHEMA.split(", ")[:-1])], "folded")
    return _commit(spark, root, f"{GENERATION}{newest + 1}", rows.unionByName(marks))


def token_counts(docs: DataFrame, tokenizer: str = tokens.WORD_BPE, folder: str | None = None) -> DataFrame:
    """doc_id, text, source, lang -> doc_id, source, lang, tokenizer, n_words, n_tokens, without the texts."""
    path = tokens.path_of(tokenizer, folder)

    names = ["doc_id", "source", "lang", "n_words"]

    @text.tidy
    def count(batches):
        waiting = deque()  # batches whose texts are under way

        def texts():
            for batch in batches:
                waiting.append(batch.select(names))
                yield from (x or "" for x in batch.column("text").to_pylist())

        done = []
        for raw in tokens.encode(texts(), path):
            done.append(len(raw) // 4)
            while waiting and len(done) >= len(waiting[0]):
                rows = waiting.popleft()
                n, done = done[: len(rows)], done[len(rows) :]
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(n, pa.int64())], [*names, "n_tokens"])

    words = F.regexp_count(F.coalesce(F.col("text").cast("string"), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), words.alias("n_words"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(count, "doc_id long, source string, lang string, n_words long, n_tokens long").withColumn("tokenizer", F.lit(tokenizer))


def op1(spark, sf_dir: str) -> DataFrame:
    """The rollup of all documents after three batches: they come in counted as words by a first tokenizer version,
    are revised to the byte-pair version, and those without a token are deleted. The second batch is sent twice."""
    root = new_path(spark, "rollup")
    counted_at = new_path(spark, "rollup-counts")
    token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source", "lang")).write.parquet(counted_at)
    counted = spark.read.parquet(counted_at)
    old = {"op": F.lit("insert"), "tokenizer": F.lit("words-1"), "n_tokens": F.col("n_words")}
    new = {"op": F.lit("revise"), "old_source": F.col("source"), "old_lang": F.col("lang"), "old_tokenizer": F.lit("words-1"), "old_n_tokens": F.col("n_words")}
    apply_batch(spark, root, "load", counted.withColumns(old))
    apply_batch(spark, root, "revise", counted.withColumns(new))
    apply_batch(spark, root, "revise", counted.withColumns(new))
    apply_batch(spark, root, "drop-empty", counted.where("n_tokens = 0").withColumns({"op": F.lit("delete")}))
    return totals(spark, root)
