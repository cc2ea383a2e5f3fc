"""Operator 8: mixing sources to target weights by Pareto order sampling.

Each source gets a target of words, and its documents unequal shares of it: a document of a size of k binary digits is
expected in min(MOST_COPIES, c * (LEAN + k)) copies, with the one c for which a source's expected words are its target.
The whole part of that is certain. The rest, p, is drawn: documents are ranked by their random odds u / (1 - u) over
their inclusion odds p / (1 - p), and the first of that order are taken until the source's remaining words are filled (the
fixed size is one of words, as documents differ in length by orders of magnitude). CLOSINGS times the document whose
size comes nearest to the words still missing (or too many) joins the sample (or leaves it), if that brings the sum
nearer to its target.

The random number is a hash of the seed, the document's id, its size and its number among the rows that have both in
common, so reruns agree and repeated rows are drawn one by one. A source, or one id, may hold any share of the rows: the
cut in a source's order comes from word counts of intervals of the rank, added up before anything is sorted, and only
documents of the interval that holds the cut are ordered one by one; rows of one id are counted, and numbered by chunks.

Edge cases: null or empty texts have size 0 and take nothing; a null source is a source of its own, the last; repeated
rows, and rows of a null id, are mixed each for itself; an empty table gives an empty mix; a null id hashes as the empty
text. Other columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import Tables, join_checked, text_or_empty

WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
MOST_COPIES = 2.0
SEED = "mix-1"
#: Rows that an interval of the rank has on average, and the most intervals of a source.
BIN_ROWS = 512
MOST_BINS = 1 << 20
CLOSINGS = 3
#: Expected copies are in proportion to this and the binary digits of a document's size: a long document is worth repeating
#: more than a short one, and the lean bounds by how much.
LEAN = 8
#: Rows of one id, source and size are numbered in chunks of so many.
CHUNK = 10_000
WORD = r"[^\x20\x09-\x0D]+"


def words_in(name: str = "text"):
    return F.regexp_count(text_or_empty(name), F.lit(WORD)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST_COPIES) -> DataFrame:
    """(source, source_size) with a row a source -> weight and target added.

    Targets are in proportion to the weights until a source stops at `most` times its size; its excess goes to the
    others. That is one level L with target = min(most * size, L * weight): sources in the order of most * size / weight
    stop as long as the level that the rest would have is at or above theirs. The first that does not stop sees L; for
    those after it the level is lower, so L is the greatest of the sources that do not stop.
    """
    place = Window.orderBy(F.col("source").asc_nulls_last())
    every = Window.partitionBy()
    before = Window.orderBy("ratio", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    kinds = F.array(*map(F.lit, weights))
    out = (
        sizes.withColumn("weight", F.element_at(kinds, ((F.row_number().over(place) - 1) % len(weights) + 1).cast("int")))
        .withColumn("ratio", F.lit(most) * F.col("source_size") / F.col("weight"))
        .withColumn("left", F.lit(share) * F.sum("source_size").over(every) - F.coalesce(F.sum(F.lit(most) * F.col("source_size")).over(before), F.lit(0.0)))
        .withColumn("level", F.col("left") / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
    )
    free = F.max(F.when(F.col("ratio") > F.col("level"), F.col("level"))).over(every)
    return out.withColumn("target", F.when(F.col("ratio") > F.col("level"), F.least(F.col("ratio"), free) * F.col("weight")).otherwise(F.lit(most) * F.col("source_size"))).select("source", "source_size", "weight", "target")


def class_rates(classes: DataFrame, most: float = MOST_COPIES) -> DataFrame:
    """(source, digits, words, target) with a row for each number of digits -> (source, digits, rate): expected copies.

    c has the form of the level of `source_targets`: classes stop at `most` copies in the order of their weights, the
    heaviest first, as long as the c that the rest would have takes them there. Sums are of whole numbers, so exact.
    """
    before = Window.partitionBy("source").orderBy(F.col("digits").desc()).rowsBetween(Window.unboundedPreceding, -1)
    rest = Window.partitionBy("source").orderBy(F.col("digits").desc()).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    weight = F.col("digits") + F.lit(LEAN)
    c = (F.col("target") - F.lit(most) * F.coalesce(F.sum("words").over(before), F.lit(0))) / F.sum(weight * F.col("words")).over(rest)
    out = classes.withColumn("c", c).withColumn("stops", F.col("c") * weight >= F.lit(most))
    free = F.max(F.when(~F.col("stops"), F.col("c"))).over(Window.partitionBy("source"))
    return out.select("source", "digits", F.when(F.col("stops"), F.lit(most)).otherwise(F.least(free * weight, F.lit(most))).alias("rate"))


def _numbered(counted: DataFrame) -> DataFrame:
    """(doc_id, source, size, n), a written table -> n rows of each with `row` from 0; equal rows are counted, not gathered."""
    once = counted.where("n = 1").select("doc_id", "source", "size", F.lit(0).cast("long").alias("row"))
    chunks = counted.where("n > 1").withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / F.lit(CHUNK)))))
    # Chunks go to tasks by themselves, so that a hot id is written out by many.
    chunks = chunks.repartition("doc_id", "source", "size", "chunk").withColumn("row", F.explode(F.sequence(F.col("chunk") * CHUNK, F.least(F.col("n"), (F.col("chunk") + 1) * CHUNK) - 1)))
    return once.union(chunks.select("doc_id", "source", "size", "row"))


def _rates(counted: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """(source, digits) -> rate, and of the source: source_size, target, goal (words that are not certain), bins."""
    classes = counted.groupBy("source", F.length(F.bin("size")).alias("digits")).agg(F.sum(F.col("size") * F.col("n")).alias("words"), F.sum("n").alias("n"))  # 64 rows a source at most
    targets = source_targets(classes.groupBy("source").agg(F.sum("words").alias("source_size")), weights, share, most)
    named = targets.select(F.col("source").alias("_source"), "source_size", "target")
    classes = classes.join(named, F.col("source").eqNullSafe(F.col("_source"))).select("source", "digits", "words", "n", "source_size", "target")
    rated = class_rates(classes.where("words > 0"), most).select(F.col("source").alias("_source"), F.col("digits").alias("_digits"), "rate")
    rated = classes.join(rated, F.col("source").eqNullSafe(F.col("_source")) & (F.col("digits") == F.col("_digits")), "left").withColumn("rate", F.coalesce("rate", F.lit(0.0)))
    own = Window.partitionBy("source")
    goal = F.col("target") - F.sum(F.floor("rate") * F.col("words")).over(own)
    bins = F.least(F.lit(MOST_BINS), F.floor(F.sum("n").over(own) / F.lit(BIN_ROWS)) + 1)
    return rated.select("source", "digits", "rate", "source_size", "target", goal.alias("goal"), bins.alias("bins"))


def mix_sources(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST_COPIES, seed: str = SEED) -> DataFrame:
    """doc_id (integer), text, source -> doc_id, row, size, source, source_size, target, copies, taken (= copies * size).
    Rows of one doc_id, source and size are told apart by `row`, from 0."""
    t = Tables(docs.sparkSession, "mix")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), words_in().alias("size"))
    counted = t.put(texts.groupBy("doc_id", "source", "size").agg(F.count(F.lit(1)).alias("n")), "counted")
    rates = t.put(_rates(counted, weights, share, most), "rates")
    named = F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("size").cast("string"), F.col("row").cast("string"))
    number = F.conv(F.substring(F.md5(named), 1, 13), 16, 10).cast("long")
    odds = (F.col("u") / (1 - F.col("u"))) / (F.col("p") / (1 - F.col("p")))
    rows = join_checked(_numbered(counted).withColumn("digits", F.length(F.bin("size"))), rates, ["source", "digits"], null_safe=True)
    rows = (
        rows.withColumn("u", (number + F.lit(0.5)) / F.lit(float(1 << 52)))
        .withColumn("certain", F.floor("rate"))
        .withColumn("p", F.col("rate") - F.col("certain"))
        # x / (1 + x) keeps the order of the quotient of odds and lies between 0 and 1
        .withColumn("rank", F.when(F.col("p") > 0, odds / (1 + odds)))
        .withColumn("bin", F.floor(F.col("rank") * F.col("bins")))
    )
    rows = t.put(rows.select("doc_id", "row", "source", "size", "source_size", "target", "goal", "certain", "rank", "bin"), "ranked")
    t.drop("counted")
    drawable = rows.where("rank IS NOT NULL")
    through = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    words = drawable.groupBy("source", "bin").agg(F.sum("size").alias("words"), F.max("goal").alias("goal")).withColumn("upto", F.sum("words").over(through)).where("upto > goal")
    cut = t.put(words.groupBy("source").agg(F.min("bin").alias("cut"), F.min_by(F.col("upto") - F.col("words"), "bin").alias("before")), "cut")
    # Documents of the interval with the cut, one by one. A source without a cut takes all that may be drawn.
    own = Window.partitionBy("source").orderBy("rank", "doc_id", "size", "row").rowsBetween(Window.unboundedPreceding, 0)
    order = F.struct("rank", "doc_id", "size", "row")
    near = join_checked(drawable, cut, ["source"], null_safe=True).where("bin = cut").withColumn("upto", F.col("before") + F.sum("size").over(own))
    inside = F.col("upto") <= F.col("goal")
    state = near.groupBy("source").agg(F.max("cut").alias("cut"), F.max(F.when(inside, order)).alias("last"), (F.max("goal") - F.coalesce(F.max(F.when(inside, F.col("upto"))), F.max("before"))).alias("gap"))
    state = t.put(state.withColumn("swaps", F.array().cast("array<struct<off:double,rank:double,doc_id:long,size:long,row:long>>")), "filled")
    first = F.col("rank").isNotNull() & (F.col("cut").isNull() | (F.col("bin") < F.col("cut")) | ((F.col("bin") == F.col("cut")) & F.coalesce(order <= F.col("last"), F.lit(False))))
    moved = F.exists("swaps", lambda x: (F.col("rank") == x["rank"]) & F.col("doc_id").eqNullSafe(x["doc_id"]) & (F.col("size") == x["size"]) & (F.col("row") == x["row"]))
    drawn = first != F.coalesce(moved, F.lit(False))  # a document moves once at most: moving back would widen the gap again
    off = F.abs(F.col("size") - F.abs("gap"))
    for k in range(CLOSINGS):
        fits = (off < F.abs("gap")) & (drawn == (F.col("gap") < 0))
        swap = join_checked(drawable, state, ["source"], null_safe=True).where(fits).groupBy(F.col("source").alias("_source")).agg(F.min(F.struct(off.alias("off"), "rank", "doc_id", "size", "row")).alias("swap"))
        step = F.coalesce(F.when(F.col("gap") < 0, -F.col("swap.size")).otherwise(F.col("swap.size")), F.lit(0))
        after = state.join(swap, F.col("source").eqNullSafe(F.col("_source")), "left")
        state = t.put(after.select("source", "cut", "last", (F.col("gap") - step).alias("gap"), F.when(F.col("swap").isNull(), F.col("swaps")).otherwise(F.concat("swaps", F.array("swap"))).alias("swaps")), f"closed{k}")
    copies = (F.col("certain") + F.when(drawn, 1).otherwise(0)).cast("long")
    rows = join_checked(rows, state, ["source"], "left", null_safe=True)
    return rows.select("doc_id", "row", "size", "source", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def op8(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return mix_sources(docs).select("doc_id", "size", "source_size", "target", "taken", "copies")


_OP8_SQL = rf"""
WITH docs AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
n AS (SELECT *, row_number() OVER (PARTITION BY doc_id, source, size) - 1 AS row, length(bin(size)) AS digits FROM docs),
v AS (
  SELECT *, (('0x' || substr(md5('{SEED}:' || coalesce(doc_id::VARCHAR, '') || ':' || size || ':' || row), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS u
  FROM n),
src AS (SELECT source, sum(size)::BIGINT AS source_size FROM docs GROUP BY source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS weight FROM src),
r AS (SELECT *, 2.0::DOUBLE * source_size / weight AS ratio FROM w),
l AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(2.0::DOUBLE * source_size) OVER before, 0))
            / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0)) AS level
  FROM r WINDOW before AS (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (
  SELECT source, source_size,
         CASE WHEN ratio > level THEN least(ratio, max(CASE WHEN ratio > level THEN level END) OVER ()) * weight ELSE 2.0::DOUBLE * source_size END AS target
  FROM l),
k AS (SELECT source, digits, sum(size)::BIGINT AS words FROM v WHERE size > 0 GROUP BY source, digits),
kc AS (
  SELECT k.source, digits, words, digits + {LEAN} AS h,
         (target - 2.0::DOUBLE * coalesce(sum(words) OVER before, 0)::BIGINT) / (sum((digits + {LEAN}) * words) OVER rest)::BIGINT AS c
  FROM k JOIN t ON k.source IS NOT DISTINCT FROM t.source
  WINDOW before AS (PARTITION BY k.source ORDER BY digits DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
         rest AS (PARTITION BY k.source ORDER BY digits DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
kr AS (
  SELECT source, digits, words,
         CASE WHEN c * h >= 2.0::DOUBLE THEN 2.0::DOUBLE ELSE least(max(CASE WHEN c * h < 2.0::DOUBLE THEN c END) OVER (PARTITION BY source) * h, 2.0::DOUBLE) END AS rate
  FROM kc),
sure AS (SELECT source, sum(floor(rate)::BIGINT * words)::BIGINT AS words FROM kr GROUP BY source),
d AS (
  SELECT v.*, source_size, target, target - coalesce(sure.words, 0) AS goal, coalesce(rate, 0) AS rate
  FROM v JOIN t ON v.source IS NOT DISTINCT FROM t.source LEFT JOIN sure ON v.source IS NOT DISTINCT FROM sure.source
  LEFT JOIN kr ON v.source IS NOT DISTINCT FROM kr.source AND v.digits = kr.digits),
e AS (SELECT *, floor(rate) AS certain, rate - floor(rate) AS p FROM d),
o AS (SELECT *, CASE WHEN p > 0 THEN (u / (1 - u)) / (p / (1 - p)) END AS odds FROM e),
f AS (SELECT *, odds / (1 + odds) AS rank FROM o),
g AS (
  SELECT *, CASE WHEN p > 0 THEN sum(CASE WHEN p > 0 THEN size END) OVER (PARTITION BY source ORDER BY rank, doc_id, size, row ROWS UNBOUNDED PRECEDING) END AS upto FROM f),
h AS (SELECT *, coalesce(p > 0 AND upto <= goal, false) AS drawn,
             CASE WHEN coalesce(max(upto) OVER (PARTITION BY source), 0) > goal
                  THEN goal - coalesce(max(CASE WHEN p > 0 AND upto <= goal THEN upto END) OVER (PARTITION BY source), 0) ELSE 0 END AS gap FROM g)
"""

# One closing step: the sample of step k - 1 with the best document of each source joining or leaving.
_OP8_SWAP = """,
o{k} AS (
  SELECT *, CASE WHEN p > 0 AND abs(size - abs(gap)) < abs(gap) AND drawn = (gap < 0)
                 THEN row(abs(size - abs(gap)), rank, doc_id, size, row) END AS offer FROM {before}),
m{k} AS (SELECT source AS s, min(offer) AS swap FROM o{k} WHERE offer IS NOT NULL GROUP BY source),
h{k} AS (
  SELECT doc_id, row, source, size, source_size, target, certain, p, rank,
         drawn <> coalesce(rank = swap[2] AND doc_id IS NOT DISTINCT FROM swap[3] AND size = swap[4] AND row = swap[5], false) AS drawn,
         gap - coalesce(CASE WHEN gap < 0 THEN -swap[4] ELSE swap[4] END, 0) AS gap
  FROM o{k} LEFT JOIN m{k} ON source IS NOT DISTINCT FROM s)"""

OP8_SQL = (
    _OP8_SQL
    + "".join(_OP8_SWAP.format(k=k, before=f"h{k - 1}" if k else "h") for k in range(CLOSINGS))
    + f"""
SELECT doc_id, size, source_size, target, (certain + drawn::INT)::BIGINT * size AS taken, (certain + drawn::INT)::BIGINT AS copies
FROM h{CLOSINGS - 1}
"""
)
