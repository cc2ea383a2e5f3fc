"""The stages of the corpus pipeline: (spark, docs, sf_dir) -> the documents that are kept, with the columns of `docs`.

Each applies one operator to all of `docs`. Columns beyond those of `documents` are carried along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import language as languages
from . import minhash, mixing, packing
from . import quality as good
from .shared import Tables, join_checked, same_columns, unused


def quality(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return good.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def language(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose words are of no learned language go."""
    return languages.keep_identified(docs)


def near_duplicates(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, that with the smallest id, null ids last. Rows of one id, or of
    none, are told apart by their texts: equal ones are one document, unlike ones are not. Texts without words stay, once
    for each id."""
    t = Tables(spark, "near-stage")
    pairs = minhash.clean(docs.select("doc_id", "text"), t)
    per = t.put(pairs.groupBy("doc_id").agg(F.sum("rows").alias("n"), F.bool_or("keep").alias("keep")), "ids")
    # Most ids have one row and are decided without a look at the text.
    gone = t.put(per.where("doc_id IS NOT NULL AND (n > 1 OR NOT keep)").select("doc_id"), "gone")
    again = t.put(per.where("n > 1 AND doc_id IS NOT NULL").select("doc_id"), "again")
    once = join_checked(docs.where("doc_id IS NOT NULL"), gone, ["doc_id"], "left_anti")
    nulls = not per.where("doc_id IS NULL").isEmpty()
    if again.isEmpty() and not nulls:
        return once
    rest = join_checked(docs.where("doc_id IS NOT NULL"), again, ["doc_id"], "left_semi")
    own, of, same, n = unused(docs, "_set", "_id", "_same", "_n")
    rest = minhash.with_set(rest.union(docs.where("doc_id IS NULL")) if nulls else rest, own)
    wanted = pairs.where("keep").select(F.col("doc_id").alias(of), F.col("set").alias(same), F.col("n").alias(n))
    rest = rest.join(wanted, (F.col(own) == F.col(same)) & F.col("doc_id").eqNullSafe(F.col(of)))
    blank = F.col("doc_id").isNull() & (F.col(n) == 0)
    rest = rest.where(~blank).dropDuplicates(["doc_id", own]).union(rest.where(blank))
    return once.union(rest.select(*same_columns(docs)))


def mix(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it. Rows of one id, or of none, are mixed each for itself; which of those
    that have the source and the number of words in common, too, gets whose copies follows how `docs` is laid out."""
    t = Tables(spark, "mix-stage")
    mixed = t.put(mixing.mix_sources(docs.select("doc_id", "text", "source")).select("doc_id", "source", "size", "row", "copies"), "mixed")
    again = t.put(mixed.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 OR doc_id IS NULL").select("doc_id"), "again")
    repeats = not again.isEmpty()
    copies, copy, of, size, row, salt, at = unused(docs, "_copies", "_copy", "_source", "_size", "_row", "_salt", "_at")
    one = join_checked(mixed, again, ["doc_id"], "left_anti", null_safe=True) if repeats else mixed
    rows = join_checked(docs, one.where("copies > 0").select("doc_id", F.col("copies").alias(copies)), ["doc_id"]).select(*same_columns(docs), copies)
    if repeats:
        # The rows are written with a number each. They are counted within (key, salt), and a salt's first number follows
        # from the counts of those before it, so that a hot id is numbered by many tasks.
        key = ["doc_id", of, size]
        held = join_checked(docs, again, ["doc_id"], "left_semi", null_safe=True)
        held = held.withColumns({of: F.col("source"), size: mixing.words_in(), row: F.monotonically_increasing_id()})
        held = t.put(held.withColumn(salt, F.pmod(F.xxhash64(row), F.lit(1024))), "held")
        salts = held.groupBy(*key, salt).agg(F.count(F.lit(1)).alias("n"))
        salts = t.put(salts.withColumn("first", F.sum("n").over(Window.partitionBy(*key).orderBy(salt)) - F.col("n")).drop("n"), "salts")
        place = F.row_number().over(Window.partitionBy(*key, salt).orderBy(row)) - 1
        numbered = join_checked(held.select(*key, salt, row, place.alias("place")), salts, [*key, salt], null_safe=True)
        numbered = t.put(numbered.select(*key, row, (F.col("first") + F.col("place")).alias(at)), "numbered")
        wanted = mixed.where("copies > 0").select("doc_id", F.col("source").alias(of), F.col("size").alias(size), F.col("row").alias(at), F.col("copies").alias(copies))
        drawn = t.put(join_checked(numbered, wanted, [*key, at], null_safe=True).select(row, copies), "drawn")
        rows = rows.union(join_checked(held, drawn, [row]).select(*same_columns(docs), copies))
    return rows.withColumn(copy, F.explode(F.sequence(F.lit(1).cast("long"), F.col(copies)))).select(*same_columns(docs))


def pack(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences."""
    return packing.pack(docs.select("doc_id", "text"))
