"""Operator 5: near-duplicates by a join of inverted lists of signature coordinates.

Two documents are linked if the Jaccard similarity of their sets of 5-word shingles is at least 0.75. A document's
signature is the minimum of its shingles under COORDINATES hash functions. It is posted under each (coordinate, value)
pair, and pairs of documents that collide at MATCHES coordinates or more are compared on their whole shingle sets.

- Documents with equal sets are one from the start: a set goes on once, under a key of its own, whatever the ids of its rows.
- Skips: a value that one document alone has cannot collide and is dropped; a document with fewer than MATCHES values
  left is done.
- Prefix: values are ordered by how many documents have them. Two documents with MATCHES collisions collide at least
  once in the first COORDINATES - MATCHES + 1 values of each, so only those are joined; the longest lists (shared
  passages, license lines) are never scanned and only count when signatures are compared.
- A link's coordinates each agree with probability 0.75 or more, so it has fewer than MATCHES = 10 of 32 collisions
  with a probability of at most 3.5e-8; fewer matches or more coordinates lower it (`missed` tells by how much).
- `exact=True` loses no link: the lists are then those of the shingles themselves. Sets of n and m shingles with a
  similarity of t share at least t * max(n, m) of them, so each has one of the shared in its first n - ceil(t * n) + 1
  by rarity, and no number of collisions is asked for. These lists take about a quarter of all shingles instead of 23
  values a document.

Lists can be long where thousands of near copies meet. They are not expanded into all pairs: a few rounds compare each
document with the best few, by collisions, of the documents that lead its lists and are not yet known to be of its
component, and components grow by the links found. What remains are pairs of different components. A document with
more than a quarter of shingles that no other document of the lists has cannot be linked, and a pair's overlap is
at most what either shares with anyone, and what their bit maps allow; all pairs that these bounds, their sizes and
their collisions leave are compared (members of a list's largest component only with those outside it), so that no link is lost to a cap.

Edge cases: null, empty and blank texts have no shingles and stand alone; documents with a null id keep a null component
and name none, but their sets are searched as all others; rows of one id are of one component, whatever their texts, and
so are the documents that any of them is linked with; an empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import text
from .components import components
from .shared import Tables, join_checked, unused

WORDS = 5
SIMILAR = (75, 100)
COORDINATES = 32
MATCHES = 10
#: Rounds in which a document meets the best leaders of its lists, and how many of them.
ROUNDS = 3
BEST = 3
#: Bits of a set's map; must be a power of two.
BITS = 4096

_FACTORS = np.random.Generator(np.random.PCG64(5)).integers(0, 1 << 64, COORDINATES, dtype=np.uint64) | np.uint64(1)


def signature(shingles: np.ndarray) -> np.ndarray:
    """The least value of each hash function over a set, as int32; zeros for the empty set."""
    least = np.full(COORDINATES, np.iinfo(np.uint32).max, dtype=np.uint64)
    for i in range(0, len(shingles), 2048):
        np.minimum(least, ((shingles[i : i + 2048, None] * _FACTORS) >> np.uint64(32)).min(axis=0), out=least)
    return least.astype(np.uint32).view(np.int32)


def missed(matches: int = MATCHES, coordinates: int = COORDINATES, similar: float = SIMILAR[0] / SIMILAR[1]) -> float:
    """The probability that a pair of this similarity collides at fewer coordinates than it must."""
    return sum(math.comb(coordinates, k) * similar**k * (1 - similar) ** (coordinates - k) for k in range(matches))


@text.tidy
def _sign(batches):
    for batch in batches:
        ids, n, keys, signs = batch.column("id"), [], [], []
        for s in text.shingle_sets(batch.column("text"), WORDS):
            n.append(len(s))
            keys.append(hashlib.blake2b(s.tobytes(), digest_size=16).hexdigest())
            signs.append(signature(s))
        flat = np.concatenate(signs) if signs else np.zeros(0, np.int32)
        values = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, COORDINATES, dtype=np.int32)), pa.array(flat))
        yield pa.RecordBatch.from_arrays([ids, pa.array(n, pa.int64()), pa.array(keys, pa.string()), values], ["id", "n", "set", "signature"])


def _bits(shingles: np.ndarray) -> np.ndarray:
    """A bit for each shingle, by its first bits."""
    seen = np.zeros(BITS, dtype=bool)
    seen[shingles >> np.uint64(64 - BITS.bit_length() + 1)] = True
    return np.packbits(seen, bitorder="little").view("<i8")


@text.tidy
def _sets(batches):
    for batch in batches:
        sets = [s.tobytes() for s in text.shingle_sets(batch.column("text"), WORDS)]
        keys = pa.array([hashlib.blake2b(s, digest_size=16).hexdigest() for s in sets], pa.string())
        bits = [_bits(np.frombuffer(s, np.uint64)) for s in sets]
        flat = np.concatenate(bits) if bits else np.zeros(0, np.int64)
        maps = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, BITS // 64, dtype=np.int32)), pa.array(flat))
        yield pa.RecordBatch.from_arrays([batch.column("id"), keys, pa.array(sets, pa.binary()), maps], ["id", "set", "shingles", "bits"])


@text.tidy
def _compare(batches):
    for batch in batches:
        out = []
        for a, b in zip(batch.column("sa"), batch.column("sb"), strict=True):
            x, y = np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint64)
            small, large = (x, y) if len(x) <= len(y) else (y, x)
            at = np.searchsorted(large, small)
            both = int((large[np.minimum(at, len(large) - 1)] == small).sum())
            out.append(SIMILAR[1] * both >= SIMILAR[0] * (len(x) + len(y) - both))
        yield pa.RecordBatch.from_arrays([batch.column("u"), batch.column("v"), pa.array(out, pa.bool_())], ["u", "v", "same"])


def _prefixes(t: Tables, reps: DataFrame) -> DataFrame:
    """(id, n, signature) -> (token, id, n): the lists to scan."""
    tokens = reps.select("id", "n", F.posexplode("signature").alias("at", "value")).select("id", "n", (F.col("at").cast("long") * (1 << 32) + F.col("value")).alias("token"))
    # Counts are written before the join, here and below, so that a long list's rows can be split where they meet it.
    shared = t.put(tokens.groupBy("token").agg(F.count(F.lit(1)).alias("df")).where("df > 1"), "shared")
    own = Window.partitionBy("id")
    ranked = join_checked(tokens, shared, ["token"]).withColumn("place", F.row_number().over(own.orderBy("df", "token"))).withColumn("m", F.count(F.lit(1)).over(own))
    return t.put(ranked.where(F.col("place") <= F.col("m") - (MATCHES - 1)).select("token", "id", "n"), "lists")


def _shingle_prefixes(t: Tables, reps: DataFrame, sets: DataFrame) -> DataFrame:
    """(id, n), (id, shingles) -> (token, id, n): the lists of the rarest shingles of each set, of which any two similar
    sets share one. Shingles that one set alone has are the rarest; they take places but have no list."""
    tokens = sets.mapInArrow(_own_shingles, "id long, shingle long").withColumnRenamed("shingle", "token")
    shared = t.put(tokens.groupBy("token").agg(F.count(F.lit(1)).alias("df")).where("df > 1"), "shared")
    own = Window.partitionBy("id")
    ranked = join_checked(tokens, shared, ["token"]).withColumn("place", F.row_number().over(own.orderBy("df", "token"))).withColumn("m", F.count(F.lit(1)).over(own))
    first = F.floor((SIMILAR[1] - SIMILAR[0]) * F.col("n") / SIMILAR[1]) + 1  # n - ceil(t * n) + 1
    return t.put(ranked.join(reps.select("id", "n"), "id").where(F.col("place") + F.col("n") - F.col("m") <= first).select("token", "id", "n"), "lists")


def _confirmed(t: Tables, pairs: DataFrame, sets: DataFrame, key: str) -> DataFrame:
    """Pairs (u, v), a written table, whose whole sets are similar enough. Few pairs go to the sets, not the sets to
    the pairs."""
    a = sets.select(F.col("id").alias("u"), F.col("shingles").alias("sa"))
    b = sets.select(F.col("id").alias("v"), F.col("shingles").alias("sb"))
    rows = join_checked(b, pairs, ["v"]).join(a, "u")
    return t.put(rows.select("u", "v", "sa", "sb").mapInArrow(_compare, "u long, v long, same boolean").where("same").select("u", "v"), key)


def _collisions(pairs: DataFrame, signs: DataFrame, matches: int) -> DataFrame:
    """Pairs with at least `matches` equal coordinates, and their number."""
    a = signs.select(F.col("id").alias("u"), F.col("signature").alias("xa"))
    b = signs.select(F.col("id").alias("v"), F.col("signature").alias("xb"))
    equal = F.size(F.filter(F.zip_with("xa", "xb", lambda x, y: x == y), lambda x: x))
    return pairs.join(b, "v").join(a, "u").withColumn("collisions", equal).where(F.col("collisions") >= matches).select("u", "v", "collisions")


@text.tidy
def _own_shingles(batches):
    for batch in batches:
        for i in range(0, len(batch), 256):
            part = batch.slice(i, 256)
            sets = [np.frombuffer(x.as_buffer(), np.int64) for x in part.column("shingles")]
            ids = np.repeat(np.asarray(part.column("id")), [len(x) for x in sets])
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(np.concatenate(sets))], ["id", "shingle"])


def _facts(t: Tables, signs: DataFrame, sets: DataFrame, lists: DataFrame) -> DataFrame:
    """(id, n, signature, tokens, common) of the documents that may be linked: `common` is how many of a document's
    shingles any other document of the lists has."""
    single = sets.mapInArrow(_own_shingles, "id long, shingle long").groupBy("shingle").agg(F.count(F.lit(1)).alias("df"), F.min("id").alias("id")).where("df = 1")
    alone = single.groupBy("id").agg(F.count(F.lit(1)).alias("alone"))
    tokens = lists.groupBy("id").agg(F.collect_list("token").alias("tokens"))  # a prefix: never more than the document's own shingles
    facts = signs.join(alone, "id", "left").join(tokens, "id").withColumn("common", F.col("n") - F.coalesce("alone", F.lit(0)))
    return t.put(facts.where(F.lit(SIMILAR[1]) * F.col("common") >= F.lit(SIMILAR[0]) * F.col("n")).select("id", "n", "signature", "tokens", "common"), "facts")


def _remaining(own: DataFrame, facts: DataFrame, sets: DataFrame, matches: int) -> DataFrame:
    """All pairs of open lists that can still be links, each once. A bit that one has and the other has not stands for
    at least one shingle that they do not share."""
    maps = join_checked(sets.select("id", "bits"), own.select("id").distinct(), ["id"], "left_semi")
    rows = own.join(facts.select("id", "signature", "tokens").join(maps, "id"), "id")
    names = {"token": "tk", "id": "v", "n": "nb", "label": "lb", "tokens": "tb", "signature": "sb", "common": "cb", "bits": "bb"}
    outside = rows.where("label <> largest").select(*[F.col(a).alias(b) for a, b in names.items()])
    once = (F.col("label") != F.col("lb")) & ((F.col("label") == F.col("largest")) | (F.col("id") < F.col("v")))
    collide = F.size(F.filter(F.zip_with("signature", "sb", lambda x, y: x == y), lambda x: x)) >= matches
    first = F.array_min(F.array_intersect("tokens", "tb")) == F.col("token")
    apart = F.aggregate(F.zip_with("bits", "bb", lambda x, y: F.bit_count(x.bitwiseAND(F.bitwise_not(y)))), F.lit(0), lambda x, y: x + y)
    back = F.aggregate(F.zip_with("bits", "bb", lambda x, y: F.bit_count(y.bitwiseAND(F.bitwise_not(x)))), F.lit(0), lambda x, y: x + y)
    overlap = F.lit(SIMILAR[0] + SIMILAR[1]) * F.least(F.col("n") - apart, F.col("nb") - back) >= F.lit(SIMILAR[0]) * (F.col("n") + F.col("nb"))
    pairs = rows.join(outside, (F.col("token") == F.col("tk")) & once & _possible() & first & collide & overlap)
    return pairs.select(F.least("id", "v").alias("u"), F.greatest("id", "v").alias("v")).distinct()


def _possible():
    """Sizes and shared shingles of two documents allow a link."""
    size = F.lit(SIMILAR[1]) * F.least("n", "nb") >= F.lit(SIMILAR[0]) * F.greatest("n", "nb")
    return size & (F.lit(SIMILAR[0] + SIMILAR[1]) * F.least("common", "cb") >= F.lit(SIMILAR[0]) * (F.col("n") + F.col("nb")))


def groups(docs: DataFrame, t: Tables, exact: bool = False) -> tuple[DataFrame, DataFrame]:
    """doc_id (integer), text -> written tables (id, n, set, signature) of all rows and (set, rep, group) of all sets that
    have shingles: its smallest id, null if its rows have none, and its component by links of sets alone."""
    matches = 0 if exact else MATCHES
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    signed = t.put(texts.mapInArrow(_sign, "id long, n long, set string, signature array<int>"), "signed")
    usable = signed.where("n > 0")
    # Equal sets are one document. Below, `id` is the key of a set: ids may have many sets, or be null.
    first = t.put(usable.groupBy("set").agg(F.min("id").alias("rep"), F.first("n").alias("n"), F.first("signature").alias("signature")).withColumn("id", F.monotonically_increasing_id()), "first")
    reps = first.select("id", "n", "set", "signature")
    if exact:  # any set may be linked until its shingles are counted
        lists, signs, chosen = None, reps, first.select("id", "set", "rep")
    else:
        lists = _prefixes(t, reps)
        members = lists.select("id").distinct()
        signs = t.put(reps.join(members, "id", "left_semi").select("id", "n", "set", "signature"), "signs")
        chosen = t.put(first.join(members, "id", "left_semi").select("id", "set", "rep"), "chosen")
    # The texts of the chosen sets, by an id that has each; those without an id are looked through as a whole.
    holders = join_checked(texts, chosen.where("rep IS NOT NULL").select(F.col("rep").alias("id")), ["id"], "left_semi")
    if not chosen.where("rep IS NULL").isEmpty():
        holders = holders.union(texts.where("id IS NULL"))
    sets = holders.mapInArrow(_sets, "id long, set string, shingles binary, bits array<long>").withColumnRenamed("id", "held")
    sets = sets.join(chosen.withColumnRenamed("set", "_set"), (F.col("set") == F.col("_set")) & F.col("held").eqNullSafe(F.col("rep")))
    sets = t.put(sets.select("id", "shingles", "bits").dropDuplicates(["id"]), "sets")
    lists = _shingle_prefixes(t, reps, sets) if lists is None else lists
    facts = _facts(t, signs, sets, lists)
    sets = t.put(join_checked(sets, facts.select("id"), ["id"], "left_semi"), "linkable-sets")
    lists = t.put(lists.join(facts.select("id", "common"), "id"), "linkable")
    t.drop("sets", "signs", "lists", "chosen", "shared")
    labels = links = None
    for k in range(ROUNDS + 1):
        own = lists.withColumn("label", F.col("id")) if labels is None else lists.join(labels, "id", "left").withColumn("label", F.coalesce("label", "id"))
        # Lists whose documents are all of one component are done.
        per = own.groupBy("token", "label").agg(F.count(F.lit(1)).alias("c"))
        mixed = per.groupBy("token").agg(F.max(F.struct("c", "label")).alias("x"), F.count(F.lit(1)).alias("kinds")).where("kinds > 1").select("token", F.col("x.label").alias("largest"))
        own = t.put(join_checked(own, t.put(mixed, f"mixed{k}"), ["token"]), f"open{k}")
        if own.isEmpty():
            break
        if k < ROUNDS:
            # The document of a list that comes first in this round's random order, for all of other components.
            order = F.xxhash64(F.lit(k), "id")
            lead = own.groupBy("token").agg(F.min(F.struct(order.alias("o"), "id", "n", "label", "common")).alias("x")).select("token", F.col("x.id").alias("v"), F.col("x.n").alias("nb"), F.col("x.label").alias("lb"), F.col("x.common").alias("cb"))
            pairs = join_checked(own, t.put(lead, f"lead{k}"), ["token"]).where(F.col("label") != F.col("lb")).where(_possible()).select(F.col("id").alias("u"), "v").distinct()
            best = Window.partitionBy("u").orderBy(F.col("collisions").desc(), "v")
            pairs = _collisions(pairs, facts, matches).withColumn("place", F.row_number().over(best)).where(F.col("place") <= BEST)
        else:
            pairs = _remaining(own, facts, sets, matches)
        found = _confirmed(t, t.put(pairs.select("u", "v"), f"pairs{k}"), sets, f"found{k}")
        links = found if links is None else links.union(found)
        labels = t.put(components(links, "near-links").select("id", F.col("component").alias("label")), f"labels{k}")
        t.drop(f"pairs{k}", f"open{k}", f"mixed{k}", f"lead{k}", f"labels{k - 1}")
    if labels is None:
        labels = reps.select("id", F.col("id").alias("label")).limit(0)
    t.drop("linkable-sets")
    out = t.put(first.join(labels, "id", "left").select("set", "rep", F.coalesce("label", "id").alias("group")), "groups")
    t.drop("first")
    return signed, out


def near_duplicates(docs: DataFrame, exact: bool = False) -> DataFrame:
    """doc_id (integer), text -> doc_id, n_shingles, component_id, kept. `exact` finds candidates by shingles."""
    t = Tables(docs.sparkSession, "near")
    signed, sets = groups(docs, t, exact)
    # Ids that have several sets link the groups of these sets.
    usable = signed.where("n > 0 AND id IS NOT NULL")
    several = t.put(usable.groupBy("id").agg(F.min("set").alias("x"), F.max("set").alias("y")).where("x <> y").select("id"), "several")
    if not several.isEmpty():
        held = t.put(join_checked(usable.select("id", "set"), several, ["id"], "left_semi").join(sets, "set").select("id", "group").distinct(), "held")
        least = held.groupBy("id").agg(F.min("group").alias("u"))
        stars = held.join(least, "id").select("u", F.col("group").alias("v")).where("u <> v")
        joined = components(stars, "id-links").select(F.col("id").alias("group"), "component")
        sets = sets.join(joined, "group", "left").select("set", "rep", F.coalesce("component", "group").alias("group"))
    named = t.put(sets.groupBy("group").agg(F.min("rep").alias("component_id")), "named")  # written, so that hot groups can be split
    of_set = sets.join(named, "group").select("set", "component_id")
    rows = signed.join(of_set, "set", "left").select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.when((F.col("n") > 0) & F.col("id").isNotNull(), F.col("component_id")).otherwise(F.col("id")).alias("component_id"))
    return rows.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def clean(docs: DataFrame, t: Tables) -> DataFrame:
    """doc_id (integer), text -> a written table (doc_id, set, n, rows, keep): each id and set once, the number of its rows
    and whether it stays. Of each group of sets that the links make, the one of the smallest id, null ids last, and the
    first digest stays. Rows of one id whose texts are unlike are different documents. Without shingles, all stay."""
    signed, sets = groups(docs, t)
    order = F.struct(F.col("rep").isNull().alias("none"), "rep", "set")
    best = sets.groupBy("group").agg(F.min(order).alias("x")).select(F.col("x.set").alias("set"), F.col("x.rep").alias("rep"), F.lit(True).alias("best"))
    pairs = signed.groupBy("id", "set").agg(F.max("n").alias("n"), F.count(F.lit(1)).alias("rows"))
    marked = pairs.join(best, "set", "left").select(F.col("id").alias("doc_id"), "set", "n", "rows", ((F.col("n") == 0) | (F.coalesce("best", F.lit(False)) & F.col("id").eqNullSafe(F.col("rep")))).alias("keep"))
    return t.put(marked, "clean")


def with_set(docs: DataFrame, name: str) -> DataFrame:
    """`docs` with the digest of each text's set in a column `name`."""
    (whole,) = unused(docs, "_text")

    @text.tidy
    def digests(batches):
        for batch in batches:
            keys = [hashlib.blake2b(s.tobytes(), digest_size=16).hexdigest() for s in text.shingle_sets(batch.column(whole), WORDS)]
            kept = [c for c in batch.schema.names if c != whole]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.array(keys, pa.string())], [*kept, name])

    schema = docs.withColumn(name, F.lit("")).schema
    return docs.withColumn(whole, F.col("text").cast("string")).mapInArrow(digests, schema)


def op5(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
