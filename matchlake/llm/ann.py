"""Operator 6: approximate nearest neighbours by learned partitions.

On a bounded sample of vectors, the neighbour graph is cut into parts of equal size with few edges between them,
and a small network learns to tell a vector's part from its coordinates. Every vector of the table is filed under its
most probable part; a query looks into its most probable parts, as many as held-out queries of the sample needed for a
recall of TARGET there, and the vectors found are ranked by their exact distances.

The number of parts grows with the square root of the number of vectors (`parts_for`), so a query compares with a share of the
table that shrinks as the table grows. A router tells PARTS_A_ROUTER parts at most; where more are needed, each part is cut
anew in the same way, by a router of its own that a task learns from SAMPLE vectors of the part. That gives at most
PARTS_A_ROUTER ** 2 parts, whose routers (about 50 kB each, one a part of the first level) travel to every executor.

Parts are cut into blocks of about BLOCK vectors (a part that holds a third of all vectors has many), and the queries of
a part into groups of about BLOCK, so a task's memory has a bound; each pair of block and group gives the K best of the block, and a
query's are merged at the end. All vectors are filed, and no block is cut short. A query whose parts hold fewer than K others
goes through all other parts as well.

Edge cases: vectors that are null, zero, of another length than most, or hold a null or a component that is not finite take no
part, as candidate or as query; neither do null ids. Equal distances go to the smaller id; rows of one id are candidates
each, and an id that is repeated among the queries asks once, by its least vector. With fewer than K other vectors all are
returned; an empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import io
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import Tables, bounded_sample

K = 10
QUERY_EVERY = 100
SAMPLE = 4096
#: Parts that one router tells: SAMPLE vectors give 32 for each.
PARTS_A_ROUTER = 128
GRAPH_DEGREE = 10
HIDDEN = 64
EPOCHS = 30
TARGET = 0.97
BLOCK = 20_000


def neighbours(x: np.ndarray, k: int) -> np.ndarray:
    """The k nearest others of each row, by blocks."""
    out = np.zeros((len(x), min(k, len(x) - 1)), dtype=np.int64)
    norms = (x * x).sum(axis=1)
    for i in range(0, len(x), 512):
        d = norms[None] - 2 * x[i : i + 512] @ x.T
        d[np.arange(len(d)), np.arange(i, i + len(d))] = np.inf
        out[i : i + 512] = np.argpartition(d, out.shape[1] - 1, axis=1)[:, : out.shape[1]] if out.shape[1] else out[i : i + 512]
    return out


def balanced_parts(x: np.ndarray, graph: np.ndarray, parts: int, passes: int = 12) -> np.ndarray:
    """Parts of sizes that differ by one at most: halved along principal axes, then pairs of nodes swap parts as long as
    that lowers the number of edges between parts."""
    part = np.zeros(len(x), dtype=np.int64)

    def halve(rows: np.ndarray, first: int, n: int) -> None:
        if n == 1:
            part[rows] = first
            return
        centred = x[rows] - x[rows].mean(axis=0)
        axis = np.linalg.eigh(centred.T @ centred)[1][:, -1]
        order = rows[np.argsort(centred @ axis, kind="stable")]
        cut = len(rows) * (n // 2) // n
        halve(order[:cut], first, n // 2)
        halve(order[cut:], first + n // 2, n - n // 2)

    halve(np.arange(len(x)), 0, parts)
    source, goal = np.repeat(np.arange(len(x)), graph.shape[1]), graph.ravel()
    for _ in range(passes):
        near = np.zeros((len(x), parts))
        np.add.at(near, (source, part[goal]), 1)
        np.add.at(near, (goal, part[source]), 1)
        own = near[np.arange(len(x)), part]
        swapped = 0
        for a in range(parts):
            for b in range(a + 1, parts):
                ia, ib = np.flatnonzero(part == a), np.flatnonzero(part == b)
                ga, gb = near[ia, b] - own[ia], near[ib, a] - own[ib]
                ia, ib = ia[np.argsort(-ga, kind="stable")], ib[np.argsort(-gb, kind="stable")]
                n = min(len(ia), len(ib))
                gain = np.sort(ga)[::-1][:n] + np.sort(gb)[::-1][:n]
                n = min(int((gain > 2).sum()), max(1, len(ia) // 8))
                if n and gain[0] > 2:
                    part[ia[:n]], part[ib[:n]] = b, a
                    own[ia[:n]], own[ib[:n]] = near[ia[:n], b], near[ib[:n], a]
                    swapped += n
        if not swapped:
            break
    return part


class Router:
    """A network of one hidden layer: vectors -> probabilities of parts."""

    def __init__(self, weights: tuple):
        self.weights = weights

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        mean, scale, w1, b1, w2, b2 = self.weights
        z = np.maximum(0, (x - mean) / scale @ w1 + b1) @ w2 + b2
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)


def train_router(x: np.ndarray, part: np.ndarray, graph: np.ndarray, parts: int, hidden: int = HIDDEN, epochs: int = EPOCHS, seed: int = 3) -> Router:
    """Learns where a vector and its neighbours lie: the goal is the share of each part among them."""
    rng = np.random.Generator(np.random.PCG64(seed))
    goal = np.zeros((len(x), parts))
    goal[np.arange(len(x)), part] = 1
    np.add.at(goal, (np.repeat(np.arange(len(x)), graph.shape[1]), part[graph.ravel()]), 1 / max(1, graph.shape[1]))
    goal /= goal.sum(axis=1, keepdims=True)
    mean, scale = x.mean(axis=0), x.std() + 1e-12
    z = (x - mean) / scale
    w = [rng.normal(size=(x.shape[1], hidden)) * np.sqrt(2 / x.shape[1]), np.zeros(hidden), rng.normal(size=(hidden, parts)) * np.sqrt(1 / hidden), np.zeros(parts)]
    m, v, t = [np.zeros_like(a) for a in w], [np.zeros_like(a) for a in w], 0
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for i in range(0, len(x), 128):
            own = order[i : i + 128]
            h = np.maximum(0, z[own] @ w[0] + w[1])
            p = h @ w[2] + w[3]
            p = np.exp(p - p.max(axis=1, keepdims=True))
            d = (p / p.sum(axis=1, keepdims=True) - goal[own]) / len(own)
            back = (d @ w[2].T) * (h > 0)
            t += 1
            for j, g in enumerate((z[own].T @ back, back.sum(axis=0), h.T @ d, d.sum(axis=0))):
                m[j], v[j] = 0.9 * m[j] + 0.1 * g, 0.999 * v[j] + 0.001 * g * g
                w[j] = w[j] - 0.003 * (m[j] / (1 - 0.9**t)) / (np.sqrt(v[j] / (1 - 0.999**t)) + 1e-8)
    return Router((mean, scale, *w))


class Index:
    """A trained router, and how many parts a query looks into."""

    def __init__(self, router: Router, parts: int, probes: int, width: int):
        self.router, self.parts, self.probes, self.width = router, parts, probes, width


def parts_for(rows: int) -> int:
    """Parts of about 4 * sqrt(rows) vectors."""
    return max(1, round(math.sqrt(rows) / 4))


def train_index(x: np.ndarray, parts: int, target: float = TARGET) -> Index:
    width = x.shape[1] if x.ndim == 2 else 0
    parts = max(1, min(parts, len(x) // 32))
    if parts == 1:
        return Index(Router(()), 1, 1, width)
    held = np.arange(len(x)) % 8 == 0
    learn = x[~held]
    graph = neighbours(learn, GRAPH_DEGREE)
    router = train_router(learn, balanced_parts(learn, graph, parts), graph, parts)
    # Held-out queries against the whole sample: at which place of a query's order is the part of each true neighbour?
    chance = router.probabilities(x)
    filed = chance.argmax(axis=1)
    place = np.argsort(np.argsort(-chance[held], axis=1, kind="stable"), axis=1)
    true = neighbours(x, K)[held]
    need = np.take_along_axis(place, filed[true], axis=1)
    probes = next(p for p in range(1, parts + 1) if (need < p).mean() >= target or p == parts)
    return Index(router, parts, probes, width)


def _usable(vectors: DataFrame) -> DataFrame:
    v = F.transform("embedding", lambda x: x.cast("double"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where("vec_id IS NOT NULL AND v IS NOT NULL")
    return rows.where(~bad & F.exists("v", lambda x: x != 0))


def _matrix(column, width: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.asarray(column.flatten(), dtype=np.float64).reshape(-1, width)


def _packed(index: Index) -> bytes:
    out = io.BytesIO()
    np.savez(out, np.array([index.parts, index.probes, index.width]), *[np.asarray(w, dtype=np.float32) for w in index.router.weights])
    return out.getvalue()


def _unpacked(data: bytes) -> Index:
    with np.load(io.BytesIO(data)) as f:
        facts, *weights = [f[k] for k in f.files]
    return Index(Router(tuple(w.astype(np.float64) for w in weights)), *map(int, facts))


def _order(index: Index, x: np.ndarray) -> np.ndarray:
    """The parts that each vector looks into, the most probable first."""
    if index.parts == 1:
        return np.zeros((len(x), 1), dtype=np.int64)
    return np.argsort(-index.router.probabilities(x), axis=1, kind="stable")[:, : index.probes]


def _lists(values: list[np.ndarray]) -> pa.ListArray:
    ends = np.concatenate([[0], np.cumsum([len(v) for v in values])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(values).astype(np.int32) if values else [], pa.int32()))


_FILED = "vec_id long, v array<double>, asks boolean, parts array<int>"


def _file(rows: DataFrame, index: Index, width: int) -> DataFrame:
    """Rows with `parts`: that in which a vector is filed, followed by the others that it looks into if it asks."""

    def route(batches):
        for batch in batches:
            order, asks = _order(index, _matrix(batch.column("v"), width)), batch.column("asks").to_pylist()
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("vec_id", "v", "asks")), _lists([o if a else o[:1] for o, a in zip(order, asks, strict=True)])], ["vec_id", "v", "asks", "parts"])

    return rows.mapInArrow(route, _FILED)


def _file_below(t: Tables, filed: DataFrame, below: int, width: int, sample: int, target: float) -> DataFrame:
    """Each part cut into up to `below` parts by a router of its own; part p has the numbers from p * below on."""
    own = filed.select(F.col("parts")[0].alias("part"), "vec_id", "v")
    sizes = own.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    h, top = F.pmod(F.xxhash64("vec_id", "v"), F.lit(1 << 30)), Window.partitionBy("part").orderBy("_h", "vec_id", "v")
    near = own.join(F.broadcast(sizes), "part").withColumn("_h", h).where(F.col("_h") < F.lit(1.2 * sample * (1 << 30)) / F.col("n"))
    drawn = near.withColumn("_rn", F.row_number().over(top)).where(F.col("_rn") <= sample).select("part", "v")

    def learn(key, rows):
        x = _matrix(rows.column("v"), width)
        return pa.table({"part": pa.array([key[0].as_py()], pa.int32()), "model": pa.array([_packed(train_index(x, below, target))], pa.binary())})

    learned = t.put(drawn.groupBy("part").applyInArrow(learn, "part int, model binary"), "routers")
    models = t.spark.sparkContext.broadcast({r["part"]: bytes(r["model"]) for r in learned.collect()})  # at most PARTS_A_ROUTER rows

    def route(batches):
        indexes = {p: _unpacked(m) for p, m in models.value.items()}
        for batch in batches:
            x, looks = _matrix(batch.column("v"), width), batch.column("parts")
            flat, row = looks.flatten().to_numpy(), np.repeat(np.arange(len(x)), np.diff(looks.offsets.to_numpy()))
            asks, out = batch.column("asks").to_pylist(), [[] for _ in range(len(x))]
            found = {}
            for p in np.unique(flat):
                if p in indexes:
                    at = np.flatnonzero(flat == p)
                    found.update(zip(at.tolist(), _order(indexes[p], x[row[at]]) + p * below, strict=True))
            for k, i in enumerate(row):
                if k in found:
                    out[i].append(found[k])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("vec_id", "v", "asks")), _lists([np.concatenate(o) if a else o[0][:1] for o, a in zip(out, asks, strict=True)])], ["vec_id", "v", "asks", "parts"])

    return t.put(filed.mapInArrow(route, _FILED), "filed-below")


def _nearest(asked: DataFrame, held: DataFrame, k: int, block: int, width: int) -> DataFrame:
    """query_id, v, part and part, vec_id, v -> each query's k nearest in its parts: query_id, vec_id, score."""
    parts = lambda df, name: df.groupBy("part").agg(F.ceil(F.count(F.lit(1)) / F.lit(block)).cast("int").alias(name))
    sizes = F.broadcast(parts(held, "blocks").join(parts(asked, "groups"), "part"))  # a row a part
    # Each block meets each group of queries of its part. Rows are numbered, so repeated ids do not share a block.
    number = F.monotonically_increasing_id()
    held = held.withColumn("_n", number).join(sizes, "part").withColumn("block", F.pmod("_n", "blocks")).withColumn("group", F.explode(F.sequence(F.lit(0).cast("long"), F.col("groups").cast("long") - 1)))
    asked = asked.withColumn("_n", number).join(sizes, "part").withColumn("group", F.pmod("_n", "groups")).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks").cast("long") - 1)))
    key = ("part", "block", "group")

    def meet(queries: pa.Table, candidates: pa.Table) -> pa.Table:
        q, x = _matrix(queries.column("v"), width), _matrix(candidates.column("v"), width)
        qid, xid = queries.column("query_id").to_numpy(), candidates.column("vec_id").to_numpy()
        out = ([], [], [])
        norms = (x * x).sum(axis=1)
        for i in range(0, len(q) if len(x) else 0, 64):
            near = norms[None] - 2 * q[i : i + 64] @ x.T
            near[xid[None] == qid[i : i + 64, None]] = np.inf
            last = np.partition(near, min(k, len(x)) - 1, axis=1)[:, min(k, len(x)) - 1]
            for row, limit, me, own in zip(near, last, qid[i : i + 64], q[i : i + 64], strict=True):
                # All that may be among the k best, ties and rounding included; then exact distances.
                at = np.flatnonzero((row <= limit + 1e-9 * (1 + abs(limit) + own @ own)) & (xid != me))
                d = np.sqrt(((x[at] - own) ** 2).sum(axis=1))
                best = np.lexsort((xid[at], d))[:k]
                out[0].append(np.full(len(best), me))
                out[1].append(xid[at][best])
                out[2].append(d[best])
        cells = [np.concatenate(c) if c else [] for c in out]
        return pa.table({"query_id": pa.array(cells[0], pa.int64()), "vec_id": pa.array(cells[1], pa.int64()), "score": pa.array(cells[2], pa.float64())})

    held, asked = held.select(*key, "vec_id", "v"), asked.select(*key, "query_id", "v")
    return asked.groupBy(*key).cogroup(held.groupBy(*key)).applyInArrow(meet, "query_id long, vec_id long, score double")


def search(vectors: DataFrame, k: int = K, every: int = QUERY_EVERY, sample: int = SAMPLE, parts: int | None = None, block: int = BLOCK, parts_a_router: int = PARTS_A_ROUTER, target: float = TARGET) -> DataFrame:
    """vec_id, embedding -> query_id, rank, vec_id, score, for the rows whose vec_id is divisible by `every`.

    `parts`: None for `parts_for` of the number of vectors."""
    spark = vectors.sparkSession
    t = Tables(spark, "ann")
    rows = _usable(vectors)
    widths = rows.groupBy(F.size("v").alias("w")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), F.col("w").desc()).limit(1).collect()
    width, total = (widths[0]["w"], widths[0]["n"]) if widths else (1, 0)
    rows = rows.where(F.size("v") == width).withColumn("asks", F.pmod("vec_id", F.lit(every)) == 0)
    wanted = parts or parts_for(total)
    first = min(wanted, parts_a_router)
    below = min(-(-wanted // first), parts_a_router)
    drawn = bounded_sample(rows, "vec_id", sample).collect()
    index = train_index(np.array([r["v"] for r in drawn], dtype=np.float64).reshape(len(drawn), width), first, target)
    filed = t.put(_file(rows, index, width), "filed")
    if below > 1:
        filed = _file_below(t, filed, below, width, sample, target)
    held = filed.select(F.col("parts")[0].alias("part"), "vec_id", "v")
    queries = t.put(filed.where("asks").groupBy(F.col("vec_id").alias("query_id")).agg(F.min(F.struct("v", "parts")).alias("q")).select("query_id", "q.v", "q.parts"), "queries")
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    best = lambda found: found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
    found = t.put(best(_nearest(queries.withColumn("part", F.explode("parts")).drop("parts"), held, k, block, width)), "found")
    # Queries whose parts hold too few others go through the rest of the parts.
    few = queries.join(found.where(F.col("rank") == k), "query_id", "left_anti")
    rest = t.put(few.withColumn("part", F.explode(F.array_except(F.sequence(F.lit(0), F.lit(first * below - 1)), "parts"))).drop("parts"), "rest")
    if rest.isEmpty():
        return found
    return best(found.drop("rank").unionByName(_nearest(rest, held, k, block, width)))


def op6(spark, sf_dir: str) -> DataFrame:
    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))
