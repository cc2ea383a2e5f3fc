"""Operator 9: best-fit packing of tokenised documents, after Martello and Toth's dominance reduction.

Documents are cut into pieces of at most CAPACITY tokens. How pieces go together depends on their lengths alone, so the
plan is made from the histogram of lengths, which has at most CAPACITY rows whatever the corpus:

1. Reduction. A set of pieces that dominates every other set with the same first piece is fixed for good: a piece with
   which nothing fits; a piece and the longest that fits, if they fill the sequence or if no two others fit there.
   Fixed pieces leave the instance, which may let the rules apply again.
2. Best fit, longest first, of what remains: each length goes to the sequences with the least room that holds it.

The plan says for each length which places its 1st, 2nd, ... piece gets, as ranges of ranks. Pieces are ranked within
(length, one of SALTS hash values), and the ranges are met by a join on the length, so a length that a third of all
pieces have is still dealt to many tasks, and no piece passes through the driver.

Edge cases: a null or empty text is the one id END; repeated rows are packed each; a null doc_id is kept; an empty
table packs to an empty table. Other columns are ignored.
"""

from __future__ import annotations

import bisect
import zlib
from collections import defaultdict, deque

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import text, tokens
from .shared import Tables

CAPACITY = 2048
END = 0
SALTS = 256
#: Rows of a batch that goes back to Spark.
ROWS = 10_000


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])


def _pieces(path: str, capacity: int):
    size, end = 4 * capacity, END.to_bytes(4, "little")

    @text.tidy
    def cut(batches):
        ids = deque()

        def texts():
            for batch in batches:
                for doc, x in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                    ids.append(doc)
                    yield x or ""

        rows = []
        for raw in tokens.encode(texts(), path):
            doc, raw = ids.popleft(), raw + end
            for k in range(0, len(raw), size):
                part = raw[k : k + size]
                rows.append((doc, k // size, k // 4, len(part) // 4, zlib.crc32(part)))
            if len(rows) >= ROWS:
                yield _batch(rows)
                rows = []
        if rows:
            yield _batch(rows)

    return cut


def reduce_instance(count: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """Takes dominating sets out of the histogram: (lengths of the set, how often)."""
    fixed = []

    def fix(lengths: tuple[int, ...], times: int) -> None:
        fixed.append((lengths, times))
        for x in lengths:
            count[x] -= times
            if not count[x]:
                del count[x]

    for x in sorted(count, reverse=True):  # pairs that fill a sequence
        y = capacity - x
        if x == y and count.get(x, 0) > 1:
            fix((x, x), count[x] // 2)
        elif x > y and count.get(x) and count.get(y):
            fix((x, y), min(count[x], count[y]))
    while count:
        lengths = sorted(count)
        shortest = lengths[0]
        second = shortest if count[shortest] > 1 else lengths[1] if len(lengths) > 1 else capacity
        before = len(fixed)
        for x in reversed(lengths):
            room = capacity - x
            if x not in count:
                continue
            if shortest > room or (x == shortest and count[x] == 1 and len(count) == 1):
                fix((x,), count[x])
            elif shortest + second > room:  # one more at most: the longest that fits
                left = sorted(count)
                y = left[bisect.bisect_right(left, room) - 1]
                if y == x:
                    if count[x] > 1:
                        fix((x, x), count[x] // 2)
                elif y < x:
                    fix((x, y), min(count[x], count[y]))
            else:
                break  # shorter ones leave more room
            if len(fixed) > before:
                break
        if len(fixed) == before:
            break
    return fixed


def best_fit(count: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """Best fit, longest first, on a histogram: (lengths in a sequence, how many such sequences)."""
    open_: dict[int, list[tuple[tuple[int, ...], int]]] = defaultdict(list)  # by room left
    rooms: list[int] = []

    def put(room: int, kind: tuple[int, ...], times: int) -> None:
        if times:
            if not open_[room]:
                bisect.insort(rooms, room)
            open_[room].append((kind, times))

    for x in sorted(count, reverse=True):
        n = count[x]
        while n:
            at = bisect.bisect_left(rooms, x)
            if at < len(rooms):
                room = rooms[at]
                kind, times = open_[room].pop()
                if not open_[room]:
                    rooms.pop(at)
            else:
                room, kind, times = capacity, (), n
            each = room // x
            full = min(times, n // each)
            put(room - each * x, kind + (x,) * each, full)
            n -= full * each
            left = times - full
            if left and n:  # one more takes what is left of this length
                put(room - n * x, kind + (x,) * n, 1)
                n, left = 0, left - 1
            if kind:
                put(room, kind, left)
    return [x for kinds in open_.values() for x in kinds]


def plan(count: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Histogram -> (length, first rank, rank after the last, sequence of the first rank, offset) ranges."""
    count = {k: n for k, n in count.items() if n}
    kinds = reduce_instance(count, capacity) + best_fit(count, capacity)
    ranges, rank, sequence = [], defaultdict(int), 0
    for lengths, times in kinds:
        offset = 0
        for x in lengths:
            ranges.append((x, rank[x], rank[x] + times, sequence, offset))
            rank[x] += times
            offset += x
        sequence += times
    return ranges


def pack(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str = tokens.WORD_BPE, folder: str | None = None) -> DataFrame:
    """doc_id (integer), text -> doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    spark = docs.sparkSession
    t = Tables(spark, "pack")
    cut = _pieces(tokens.path_of(vocabulary, folder), capacity)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # Rows of one id, however many, have salts of their own; they are written, so that ranks stay what they are.
    salt = F.pmod(F.xxhash64("doc_id", "piece", F.monotonically_increasing_id()), F.lit(SALTS)).cast("int")
    pieces = t.put(texts.mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long").withColumn("salt", salt), "pieces")
    per = t.put(pieces.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n")), "counts")
    histogram = {r["length"]: r["n"] for r in per.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # CAPACITY rows at most
    ranges = t.put(spark.createDataFrame(plan(histogram, capacity), "at long, first long, beyond long, sequence long, offset long"), "ranges")
    before = per.select("length", "salt", (F.sum("n").over(Window.partitionBy("length").orderBy("salt")) - F.col("n")).alias("before"))
    ranked = pieces.withColumn("place", F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "start", "ids_crc32")) - 1)
    ranked = ranked.join(before, ["length", "salt"]).withColumn("rank", F.col("before") + F.col("place"))
    few = ranges.count() <= 200_000  # a few for each length; not a matter of the corpus
    met = ranked.join(F.broadcast(ranges) if few else ranges, (F.col("length") == F.col("at")) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("beyond")))
    return met.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("sequence") + F.col("rank") - F.col("first")).alias("sequence_id"), "offset")


def op9(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
