"""Operator 12: long strings that occur more than once, found with suffix arrays made by two-stage sorting, and removed.

A start is a place where a string of LENGTH bytes begins within a text. Two starts of equal strings have the same least
hash of the GRAM-byte substrings within (the minimiser), so starts are gathered by it, in runs of neighbouring starts that
share one: a region, its starts and the bytes that their strings cover.

1. Each text gives its regions, without bytes. Minimisers that occur once in the corpus can repeat nothing: they go.
2. Regions with equal bytes become one with a weight, so thousands of copies weigh no more than one.
3. The bytes of what is left are fetched from the texts, and regions of one minimiser meet in a task.
4. `order` sorts their suffixes in two stages: those smaller than their successors are sorted directly, by LENGTH bytes;
   the others are induced by scanning the buckets of first bytes in order. Neighbours' common prefixes are computed, and a
   start is repeated if it has LENGTH bytes in common with a neighbour or stands in a region of weight two or more.
5. Repeated starts go back to their texts; every byte that a string from such a start covers is removed.

A minimiser with more than HOT different regions (a passage that very many unlike texts share) would fill a task. Its
starts are first counted by two 64-bit hashes of their whole strings, in an aggregation that splits; those of a string
that occurs once go, and the rest are repeated. This is exact but for collisions of 128 bits, as is the weighing of equal regions.

Edge cases: null and empty texts have no bytes and the digest of none; texts under LENGTH bytes lose nothing; repeated rows
repeat each other; a null doc_id is kept; an empty table gives an empty result. A text of any length is cut into pieces that
overlap by LENGTH - 1 bytes. Other columns are ignored. Kept bytes may be no valid UTF-8: a removed run may begin within a
character, so they are given as bytes (`kept`).
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text
from .shared import Tables, join_checked, text_or_empty

LENGTH = 400
GRAM = 160
#: Starts of a region at most (longer ones come only where a minimiser repeats within LENGTH bytes).
STARTS = 512
HOT = 500
#: Bytes of regions that a task sorts at once; a minimiser's regions stay together.
CHUNK_BYTES = 1 << 20
U64 = np.uint64
_TABLES = np.random.Generator(np.random.PCG64(20250713)).integers(0, 1 << 64, (2, 256), dtype=U64)
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


# ---- suffix sorting


def order(t: np.ndarray, wanted: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """The places `wanted` (a mask) of `t` in the order of their suffixes, by their first `length` bytes at least.

    `t` is a text of bytes 1 to 255 with 0 after each part, and `length` zeros at its end. Suffixes smaller than their
    successors are sorted directly. Any other follows a smaller one, so it is found in its place when the bucket of that
    one's first byte is scanned; buckets are scanned ascending, and each has those found before those sorted.
    """
    n = len(t) - length
    step = t[1 : n + 1].astype(np.int16) - t[:n]
    places = np.arange(n)
    differs = np.minimum.accumulate(np.where(step != 0, places, n - 1)[::-1])[::-1]
    rises = step[differs] > 0
    ends = t[:n] == 0
    stop = np.minimum.accumulate(np.where(rises | ends, places, n - 1)[::-1])[::-1]
    # what is induced needs its successor, and so on up to one that is sorted
    needed = np.zeros(n + 1, np.int32)
    last = np.flatnonzero(wanted[:n] & ~np.concatenate((wanted[1:n], [False])))
    np.add.at(needed, last, 1)
    np.add.at(needed, stop[last] + 1, -1)
    needed = (np.cumsum(needed)[:n] > 0) | wanted[:n]
    plain = t.tobytes().decode("latin-1")  # compares as bytes do, and faster
    direct = np.flatnonzero(needed & rises & ~ends).tolist()
    direct.sort(key=lambda i: plain[i : i + length])
    direct = np.array(direct, dtype=np.int64)
    cuts = np.searchsorted(t[direct], np.arange(257))
    queues: list[list[np.ndarray]] = [[] for _ in range(256)]
    out = [np.flatnonzero(needed & ends)]

    def scan(block: np.ndarray, byte: int) -> np.ndarray:
        """Puts the suffixes before those of the block into the buckets of their first bytes; returns those of this one."""
        before = block[block > 0] - 1
        before = before[needed[before] & ~rises[before] & (t[before] >= max(byte, 1))]
        first = t[before]
        at = np.argsort(first, kind="stable")
        before, first = before[at], first[at]
        heads = np.flatnonzero(np.concatenate(([True], first[1:] != first[:-1]))) if len(first) else []
        same = before[:0]
        for i, part in zip(heads, np.split(before, heads[1:]) if len(first) else [], strict=True):
            if first[i] == byte:
                same = part
            else:
                queues[first[i]].append(part)
        return same

    scan(out[0], 0)
    for byte in range(1, 256):
        layer = np.concatenate(queues[byte]) if queues[byte] else direct[:0]
        queues[byte] = []
        while len(layer):
            out.append(layer)
            layer = scan(layer, byte)
        block = direct[cuts[byte] : cuts[byte + 1]]
        if len(block):
            out.append(block)
            scan(block, byte)
    found = np.concatenate(out)
    return found[wanted[found]]


def common_prefixes(t: np.ndarray, a: np.ndarray, b: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Bytes that the suffixes of `t` at the places a and b have in common, pair by pair, up to `length`."""
    padded = np.concatenate((t, np.zeros(length + 8, np.uint8)))
    words = np.ndarray((len(padded) - 7,), dtype="<u8", buffer=padded, strides=(1,))  # from every byte on
    out, open_ = np.full(len(a), length, np.int64), np.arange(len(a))
    for k in range(0, length, 8):
        if not len(open_):
            break
        differ = words[a[open_] + k] ^ words[b[open_] + k]
        off = differ != 0
        low = differ[off] & (~differ[off] + U64(1))
        out[open_[off]] = np.minimum(k + np.log2(low.astype(np.float64)).astype(np.int64) // 8, length)
        open_ = open_[~off]
    return out


def repeated(regions: list[bytes], starts: list[int], weights: list[int], length: int = LENGTH) -> list[np.ndarray]:
    """For each region (its bytes, without 255) a mask of its starts whose strings occur at another start of any region."""
    size = np.array([len(r) + 1 for r in regions])
    first = np.concatenate(([0], np.cumsum(size)))
    t = np.frombuffer(b"\0".join([*regions, bytes(length)]), np.uint8).copy()
    t += 1
    t[first[1:] - 1] = 0
    t[first[-1] :] = 0
    edge = np.zeros(len(t) + 1, np.int32)
    np.add.at(edge, first[:-1], 1)
    np.add.at(edge, first[:-1] + np.array(starts), -1)
    wanted = np.cumsum(edge)[:-1] > 0
    found = order(t, wanted, length)
    same = common_prefixes(t, found[:-1], found[1:], length) >= length
    twice = np.zeros(len(t), bool)
    twice[found[:-1][same]] = True
    twice[found[1:][same]] = True
    return [twice[i : i + n] | (w > 1) for i, n, w in zip(first[:-1].tolist(), starts, weights, strict=True)]


# ---- regions


def _sums(data: np.ndarray, which: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = (np.full(len(data) + 1, b, dtype=U64) for b in (_BASES[which] | 1, pow(_BASES[which] | 1, -1, 1 << 64)))
    up[0] = down[0] = 1
    np.multiply.accumulate(up, out=up)
    np.multiply.accumulate(down, out=down)
    sums = np.zeros(len(data) + 1, dtype=U64)
    np.cumsum(_TABLES[which][data] * up[:-1], out=sums[1:])
    return sums, down


def _sliding(f: np.ufunc, x: np.ndarray, width: int, pad: int) -> np.ndarray:
    """f over each `width` neighbours: of the ends of blocks from the right, and of their beginnings from the left."""
    n, blocks = len(x), -(-len(x) // width)
    padded = np.full(blocks * width, pad, dtype=x.dtype)
    padded[:n] = x
    rows = padded.reshape(blocks, width).T.copy()  # a block a column: its rows are done in vectors
    left = f.accumulate(rows, axis=0).T.ravel()
    right = f.accumulate(rows[::-1], axis=0)[::-1].T.ravel()
    return f(right[: n - width + 1], left[width - 1 : n])


def regions_of(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Texts' bytes -> place of each region, its number of starts, minimiser, hash of its bytes, and how many places the
    minimiser has in it, 2 standing for more."""
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return none, none, none, none, none
    width, top = length - gram + 1, (1 << 64) - 1
    sums, down = _sums(data, 0)
    grams = text.mix((sums[gram:] - sums[:-gram]) * down[: len(data) - gram + 1]) | U64(1)
    least = _sliding(np.minimum, grams, width, top)
    sizes = np.diff(offsets)
    long = sizes >= length
    inside = np.zeros(len(least) + 1, np.int32)
    inside[offsets[:-1][long]] += 1
    inside[offsets[:-1][long] + sizes[long] - length + 1] -= 1
    least[np.cumsum(inside)[:-1] == 0] = 0
    heads = np.concatenate(([0], np.flatnonzero(least[1:] != least[:-1]) + 1))
    tails = np.concatenate((heads[1:], [len(least)]))
    kept = least[heads] != 0
    heads, tails = heads[kept], tails[kept]
    pieces = -(-(tails - heads) // STARTS)
    begin = np.repeat(heads, pieces) + STARTS * (np.arange(int(pieces.sum())) - np.repeat(np.cumsum(pieces) - pieces, pieces))
    count = np.minimum(np.repeat(tails, pieces) - begin, STARTS)
    key = least[begin]
    # minimisers that stand twice within reach of one region
    pad = np.zeros(width - 1, U64)
    at = np.flatnonzero(grams == _sliding(np.maximum, np.concatenate((pad, least, pad)), width, 0))
    by = np.lexsort((at, grams[at]))
    at = at[by]
    near = (grams[at[1:]] == grams[at[:-1]]) & (np.diff(at) <= width)
    twice = np.isin(key, np.unique(grams[at[1:]][near]))
    end = begin + count + length - 1
    body = text.mix((sums[end] - sums[begin]) * down[begin] + count.astype(U64))
    return begin, count, key.view(np.int64), body.view(np.int64), 1 + twice.astype(np.int64)


def _pieces(data: np.ndarray, offsets: np.ndarray, length: int):
    """(first text, offsets, bytes, place of the bytes in the text) of slices; a text of more than a slice comes in pieces."""
    for i, j in text.slices(offsets):
        a, b = int(offsets[i]), int(offsets[j])
        if b - a <= 2 * text.SLICE_BYTES:
            yield i, offsets[i : j + 1] - a, data[a:b], 0
        else:  # one text
            for k in range(a, b - length + 1, text.SLICE_BYTES):
                part = data[k : min(b, k + text.SLICE_BYTES + length - 1)]
                yield i, np.array([0, len(part)]), part, k - a


_REGION = "key long, doc long, digest long, start long, starts int, body long, places long"


def _cut(length: int, gram: int):
    @text.tidy
    def work(batches):
        for batch in batches:
            doc, digest = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("doc", "digest"))
            for i, offsets, part, place in _pieces(*text.as_bytes(batch.column("text")), length):
                begin, count, key, body, places = regions_of(part, offsets, length, gram)
                if len(begin):
                    own = np.searchsorted(offsets, begin, side="right") - 1
                    columns = (key, doc[i + own], digest[i + own], begin - offsets[own] + place, count.astype(np.int32), body, places)
                    yield pa.RecordBatch.from_arrays(list(map(pa.array, columns)), ["key", "doc", "digest", "start", "starts", "body", "places"])

    return work


_FETCHED = pa.schema([("key", pa.int64()), ("body", pa.int64()), ("starts", pa.int32()), ("weight", pa.int64()), ("bytes", pa.binary()), ("at", pa.int32()), ("one", pa.int64()), ("two", pa.int64())])
_FETCHED_DDL = "key long, body long, starts int, weight long, bytes binary, at int, one long, two long"


def _fetch(length: int):
    """Regions' bytes; of regions of hot minimisers, a row for each start with two hashes of its string."""

    def hot_rows(r: dict, raw: bytes) -> pa.RecordBatch:
        n, data = r["starts"], np.frombuffer(raw, np.uint8)
        hashes = []
        for which in (0, 1):
            sums, down = _sums(data, which)
            hashes.append(text.mix((sums[length : length + n] - sums[:n]) * down[:n]).view(np.int64))
        columns = [np.full(n, r["key"]), np.full(n, r["body"]), np.full(n, n, np.int32), np.full(n, r["weight"]), None, np.arange(n, dtype=np.int32), *hashes]
        return pa.RecordBatch.from_arrays([pa.nulls(n, f.type) if c is None else pa.array(c, f.type) for c, f in zip(columns, _FETCHED, strict=True)], schema=_FETCHED)

    @text.tidy
    def work(batches):
        rows, size, before = [], 0, None
        for batch in batches:
            for i in range(batch.num_rows):
                ref = (batch.column("doc")[i].as_py(), batch.column("digest")[i].as_py())
                if ref == before:  # the same text again
                    continue
                before, data = ref, batch.column("text")[i].as_py().encode()
                for r in batch.column("regions")[i].as_py():
                    raw = data[r["start"] : r["start"] + r["starts"] + length - 1]
                    if r["hot"]:
                        yield hot_rows(r, raw)
                        continue
                    rows.append({"key": r["key"], "body": r["body"], "starts": r["starts"], "weight": r["weight"], "bytes": raw})
                    size += len(raw)
                    if size >= CHUNK_BYTES:
                        yield pa.RecordBatch.from_pylist(rows, _FETCHED)
                        rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, _FETCHED)

    return work


def _sort(length: int):
    schema = pa.schema([("key", pa.int64()), ("body", pa.int64()), ("starts", pa.int32()), ("runs", pa.list_(pa.int32()))])

    def chunk(rows: list[tuple]) -> pa.RecordBatch:
        out = []
        for (key, body, n, _, _), mask in zip(rows, repeated([r[4] for r in rows], [r[2] for r in rows], [r[3] for r in rows], length), strict=True):
            if mask.any():
                edges = np.flatnonzero(np.diff(np.concatenate(([False], mask, [False])).astype(np.int8)))
                out.append({"key": key, "body": body, "starts": n, "runs": edges.tolist()})
        return pa.RecordBatch.from_pylist(out, schema)

    @text.tidy
    def work(batches):
        rows, size = [], 0
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("key", "body", "starts", "weight", "bytes")), strict=True):
                if size >= CHUNK_BYTES and row[0] != rows[-1][0]:
                    yield chunk(rows)
                    rows, size = [], 0
                rows.append(row)
                size += len(row[4])
        if rows:
            yield chunk(rows)

    return work


def _remove(length: int):
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.binary())])

    @text.tidy
    def work(batches):
        for batch in batches:
            out = []
            for doc, x, found in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "found")), strict=True):
                data, spans = x.encode(), []
                for a, b in sorted((f["start"] + f["runs"][k], f["start"] + f["runs"][k + 1] + length - 1) for f in found or () for k in range(0, len(f["runs"]), 2)):
                    if spans and a <= spans[-1][1]:
                        spans[-1][1] = max(b, spans[-1][1])
                    else:
                        spans.append([a, b])
                kept = b"".join(data[i:j] for i, j in zip([0, *(b for _, b in spans)], [*(a for a, _ in spans), len(data)], strict=True))
                out.append({"doc_id": doc, "n_bytes": len(data), "n_removed": len(data) - len(kept), "n_spans": len(spans), "kept_sha256": hashlib.sha256(kept).hexdigest(), "kept": kept})
            yield pa.RecordBatch.from_pylist(out, schema)

    return work


def _repeated_of_hot(starts: DataFrame, t: Tables) -> DataFrame:
    """Of the starts of hot minimisers' regions, those whose string occurs more than once. The repeated strings are written
    first: joined with a written table, the starts of one very common string are split among tasks."""
    twice = t.put(starts.groupBy("one", "two").agg(F.sum("weight").alias("n")).where("n > 1").select("one", "two"), "twice")
    return join_checked(starts, twice, ["one", "two"])


def remove_repeated(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """doc_id (integer), text -> doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (the bytes that stay)."""
    t = Tables(docs.sparkSession, "repeats")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    docs = docs.withColumns({"doc": F.coalesce("doc_id", F.lit(-(1 << 63))), "digest": F.xxhash64("text")})
    regions = t.put(docs.where(F.octet_length("text") >= length).select("doc", "digest", "text").mapInArrow(_cut(length, gram), _REGION), "regions")
    again = regions.groupBy("key").agg(F.sum("places").alias("n")).where("n > 1").select("key")
    found = t.put(regions.join(again, "key"), "found")
    t.drop("regions")
    # one of each set of regions with equal bytes, and how many there are
    distinct = t.put(found.groupBy("key", "body", "starts").agg(F.count(F.lit(1)).alias("weight"), F.min(F.struct("doc", "digest", "start")).alias("of")), "distinct")
    crowded = t.put(distinct.groupBy("key").count().where(F.col("count") > hot).select("key", F.lit(True).alias("hot")), "crowded")
    asked = join_checked(distinct, crowded, ["key"], "left").select("of.doc", "of.digest", F.struct(F.col("of.start").alias("start"), "key", "body", "starts", "weight", F.coalesce("hot", F.lit(False)).alias("hot")).alias("r"))
    lists = asked.groupBy("doc", "digest").agg(F.collect_list("r").alias("regions"))
    fetched = t.put(docs.select("doc", "digest", "text").join(lists, ["doc", "digest"]).mapInArrow(_fetch(length), _FETCHED_DDL), "fetched")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_ = fetched.where("bytes IS NOT NULL").select("key", "body", "starts", "weight", "bytes").repartition(parts, "key").sortWithinPartitions("key").mapInArrow(_sort(length), "key long, body long, starts int, runs array<int>")
    starts = fetched.where("bytes IS NULL").select("key", "body", "starts", "weight", "at", "one", "two")
    of_hot = _repeated_of_hot(starts, t).groupBy("key", "body", "starts").agg(F.flatten(F.collect_list(F.array("at", F.col("at") + 1))).alias("runs"))
    runs = t.put(sorted_.union(of_hot), "runs")
    spans = found.join(runs, ["key", "body", "starts"]).groupBy("doc", "digest").agg(F.collect_set(F.struct("start", "runs")).alias("found"))
    return docs.join(spans, ["doc", "digest"], "left").select("doc_id", "text", "found").mapInArrow(_remove(length), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def op12(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return remove_repeated(docs).drop("kept")
