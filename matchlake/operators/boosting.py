"""Gradient-boosted trees on histograms, for a binary target.

Features are binned once, by quantiles, into a written table of one byte a cell, a row for each block of rows. A level of a
tree is one sum of gradients, hessians and counts over (node, feature, bin), whose size depends on the model and not on the
rows; the best split of each node is read from it, and leaves take a Newton step. Of two nodes that were one, the smaller is
summed and the other is what is left of both. Of the splits down to the greatest depth, those are kept that a growth by
greatest gain would take up to the greatest number of leaves.

Rows lie in partitions of at most PARTITION_ROWS, and of several partitions in as many as there are cores, as long as each
has LEAST_ROWS. Of several partitions each level is a Spark job without a shuffle: tasks sum their rows, and the driver adds
the sums, or, of more than ADDED partitions, an aggregation does. Sums of one partition are complete where they are made, so
a table of one partition (12 MB of bins at 48 features) takes its rounds within its task. Both ways use the same functions
and give the same trees, up to the order in which floating numbers are added.

A tree's margins are cached with its first level; every KEPT_TREES trees they are written.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import new_folder, remove

BINS = 255
PARTITION_ROWS, LEAST_ROWS = 250_000, 20_000
#: Partitions whose sums the driver adds itself.
ADDED = 32
KEPT_TREES = 10
#: A column with more categories than this is no category; its distinct values would be gathered.
CATEGORIES = 1_000


@dataclass
class Features:
    """What makes a row's bins: the edges of numeric columns (a value up to the k-th edge has bin k or less) and the values
    of categorical ones, each of which is a feature of its own."""

    numeric: list[str]
    edges: list[np.ndarray]
    categorical: list[str]
    values: list[list[str]]

    @classmethod
    def fit(cls, rows: DataFrame, numeric: list[str], categorical: list[str], bins: int = BINS) -> Features:
        """One aggregate over the rows. Up to `bins` quantiles of each column, to a ten-thousandth of the rows."""
        if not numeric + categorical:
            raise ValueError("no features")
        shares = [k / bins for k in range(1, bins)]
        asked = [F.percentile_approx(F.col(c).cast("double"), shares, 10_000).alias(f"n{i}") for i, c in enumerate(numeric)]
        found = rows.agg(*asked, *[F.collect_set(F.col(c)).alias(f"c{i}") for i, c in enumerate(categorical)]).first()
        edges = [np.unique(np.array(found[f"n{i}"] or [], dtype=np.float64)) for i in range(len(numeric))]
        values = [sorted(found[f"c{i}"]) for i in range(len(categorical))]
        if over := [c for c, v in zip(categorical, values, strict=True) if len(v) > CATEGORIES]:
            raise ValueError(f"more than {CATEGORIES} categories: {over}")
        return cls(numeric, edges, categorical, values)

    @property
    def names(self) -> list[str]:
        return [*self.numeric, *(f"{c}={v}" for c, vs in zip(self.categorical, self.values, strict=True) for v in vs)]

    def bins(self, columns: dict[str, np.ndarray]) -> np.ndarray:
        """Rows x features, one byte each; a value that is missing has the last bin, one that is no known category none."""
        out = [np.searchsorted(e, columns[c].astype(np.float64), side="left") for c, e in zip(self.numeric, self.edges, strict=True)]
        out += [columns[c] == v for c, vs in zip(self.categorical, self.values, strict=True) for v in vs]
        return np.stack(out, axis=1).astype(np.uint8)


@dataclass
class Tree:
    """Nodes in the order in which they were made; a leaf has feature -1. Rows of at most `bin` go left, to `left`; others
    to the node after it."""

    feature: np.ndarray
    bin: np.ndarray
    left: np.ndarray
    value: np.ndarray

    def leaves(self, bins: np.ndarray) -> np.ndarray:
        """Each row's leaf."""
        node, rows = np.zeros(len(bins), np.int64), np.arange(len(bins))
        while len(rows):
            at = node[rows]
            inner = self.feature[at] >= 0
            rows, at = rows[inner], at[inner]
            node[rows] = self.left[at] + (bins[rows, self.feature[at]] > self.bin[at])
        return node


@dataclass
class Settings:
    rounds: int = 350
    depth: int = 6
    leaves: int = 31
    rate: float = 0.05
    min_rows: int = 20
    min_hessian: float = 1e-3


@dataclass
class _Growth:
    """A tree as it grows, level by level: its splits with their gains, and the nodes that may be split next."""

    feature: list[int] = field(default_factory=lambda: [-1])
    bin: list[int] = field(default_factory=lambda: [0])
    left: list[int] = field(default_factory=lambda: [0])
    gain: list[float] = field(default_factory=lambda: [0.0])
    sums: list[tuple[float, float]] = field(default_factory=lambda: [(0.0, 0.0)])
    open: list[int] = field(default_factory=lambda: [0])
    #: Of each pair of open nodes, which were one: its place in the level before, and the place of the smaller of the two.
    pairs: list[tuple[int, int]] = field(default_factory=list)

    def routing(self) -> Tree:
        return Tree(np.array(self.feature), np.array(self.bin), np.array(self.left), np.zeros(len(self.feature)))

    def split(self, histogram: np.ndarray, s: Settings) -> None:
        """Sums of the open nodes, (node, feature, bin, [gradient, hessian, rows]) -> their best splits, if any gains."""
        upto = histogram.cumsum(axis=2)
        whole = upto[:, :1, -1:, :]
        rest = whole - upto
        (g, h, n), (gr, hr, nr) = np.moveaxis(upto, 3, 0), np.moveaxis(rest, 3, 0)
        fits = (n >= s.min_rows) & (nr >= s.min_rows) & (h >= s.min_hessian) & (hr >= s.min_hessian)
        with np.errstate(divide="ignore", invalid="ignore"):
            gains = np.where(fits, g * g / h + gr * gr / hr, -np.inf) - (whole[..., 0] ** 2 / np.maximum(whole[..., 1], 1e-300))
        flat = gains.reshape(len(gains), -1)
        best = flat.argmax(axis=1)
        todo, self.open, self.pairs = self.open, [], []
        for i, node in enumerate(todo):
            if node == 0:
                self.sums[0] = tuple(whole[i, 0, 0, :2])
            f, b = divmod(int(best[i]), histogram.shape[2])
            if not flat[i, best[i]] > 1e-12:
                continue
            self.feature[node], self.bin[node], self.left[node], self.gain[node] = f, b, len(self.feature), float(flat[i, best[i]])
            self.pairs.append((i, int(rest[i, f, b, 2] < upto[i, f, b, 2])))
            for part in (upto[i, f, b], rest[i, f, b]):
                self.open.append(len(self.feature))
                for x, v in ((self.feature, -1), (self.bin, 0), (self.left, 0), (self.gain, 0.0), (self.sums, (part[0], part[1]))):
                    x.append(v)

    def tree(self, s: Settings) -> Tree:
        """The tree that growth by greatest gain makes of the splits, with its leaves' values."""
        kept, waiting, count = set(), [], 1
        if self.feature[0] >= 0:
            heapq.heappush(waiting, (-self.gain[0], 0))
        while waiting and count < s.leaves:
            node = heapq.heappop(waiting)[1]
            kept.add(node)
            count += 1
            for child in (self.left[node], self.left[node] + 1):
                if self.feature[child] >= 0:
                    heapq.heappush(waiting, (-self.gain[child], child))
        feature = np.array([f if k in kept else -1 for k, f in enumerate(self.feature)])
        value = np.array([-s.rate * g / h if h > 0 else 0.0 for g, h in self.sums])
        return Tree(feature, np.array(self.bin), np.array(self.left), value)


def gradients(y: np.ndarray, margin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    p = 1 / (1 + np.exp(-margin))
    return p - y, p * (1 - p)


def histogram(bins: np.ndarray, node: np.ndarray, open_: list[int], g: np.ndarray, h: np.ndarray, width: int) -> np.ndarray:
    """Sums of rows over (open node, feature, bin): gradients, hessians, rows. One feature at a time: its sums stay in the
    processor's cache, and `bins` is best laid out by features."""
    place = np.full(max(int(node.max(initial=0)), max(open_)) + 1, -1)
    place[open_] = np.arange(len(open_))
    first = place[node] * width
    rows = np.flatnonzero(first >= 0)
    whole = len(rows) == len(node)
    first, g, h = (first, g, h) if whole else (first[rows], g[rows], h[rows])
    out = np.empty((len(open_), bins.shape[1], width, 3))
    for f in range(bins.shape[1]):
        at = first + (bins[:, f] if whole else bins[rows, f])
        for k, w in enumerate((g, h, None)):
            out[:, f, :, k] = np.bincount(at, w, len(open_) * width).reshape(len(open_), width)
    return out


def margins(bins: np.ndarray, trees: list[Tree]) -> np.ndarray:
    out = np.zeros(len(bins))
    for t in trees:
        out += t.value[t.leaves(bins)]
    return out


def grow(sums, s: Settings) -> Tree:
    """A tree; `sums(routing, nodes)` gives the histogram of nodes of a level."""
    g = _Growth()
    level = None
    for _ in range(s.depth):
        if not g.open:
            break
        if level is None:
            level = sums(g.routing(), g.open)
        else:
            one = sums(g.routing(), [g.open[2 * k + small] for k, (_, small) in enumerate(g.pairs)])
            other = level[[i for i, _ in g.pairs]] - one
            other[other[..., 2] == 0] = 0.0  # nothing is left of no rows, not the error of a difference
            left = np.array([small == 0 for _, small in g.pairs])[:, None, None, None]
            level = np.stack([np.where(left, one, other), np.where(left, other, one)], axis=1).reshape(-1, *one.shape[1:])
        g.split(level, s)
    return g.tree(s)


# ---- tables


#: A block of rows: bins by features (one byte each), targets and margins (eight).
_BINNED = "bins binary, y binary, margin binary"


def _block(bins: np.ndarray, y: np.ndarray, margin: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in (np.ascontiguousarray(bins.T).tobytes(), y.tobytes(), margin.tobytes())], ["bins", "y", "margin"])


def _rows(batches: Iterator[pa.RecordBatch], features: int) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """All blocks of a partition as one, if there is any."""
    parts = [(np.frombuffer(x, np.uint8).reshape(features, -1), np.frombuffer(y), np.frombuffer(m)) for b in batches for x, y, m in zip(*(c.to_pylist() for c in b.columns), strict=True)]
    if not parts:
        return None
    bins, y, margin = zip(*parts, strict=True)
    return np.concatenate(bins, axis=1).T, np.concatenate(y), np.concatenate(margin)


def _into_bins(features: Features, target: str, base: float):
    columns = [*features.numeric, *features.categorical]

    def work(batches):
        for b in batches:
            if b.num_rows:
                cells = features.bins({c: b.column(c).to_numpy(zero_copy_only=False) for c in columns})
                yield _block(cells, b.column(target).cast(pa.float64()).to_numpy(zero_copy_only=False), np.full(b.num_rows, base))

    return work


def _rounds_in_task(n_features: int, width: int, s: Settings):
    """All rounds over one partition."""

    def work(batches):
        found = _rows(batches, n_features)
        if found is None:
            return
        bins, y, margin = found
        for k in range(s.rounds):
            g, h = gradients(y, margin)
            tree = grow(lambda t, open_, g=g, h=h: histogram(bins, t.leaves(bins), open_, g, h, width), s)
            margin = margin + tree.value[tree.leaves(bins)]
            yield pa.RecordBatch.from_arrays([pa.array([k]), *(pa.array([x.tolist()]) for x in (tree.feature, tree.bin, tree.left, tree.value))], ["round", "feature", "bin", "left", "value"])

    return work


def _level_in_tasks(n_features: int, width: int, routing: Tree, open_: list[int]):
    """The sums of a task's rows, those that are not nothing: slot, gradient, hessian, rows."""

    def work(batches):
        found = _rows(batches, n_features)
        if found is not None:
            bins, y, margin = found
            flat = histogram(bins, routing.leaves(bins), open_, *gradients(y, margin), width).reshape(-1, 3)
            slot = np.flatnonzero(flat[:, 2])
            yield pa.RecordBatch.from_arrays([pa.array(slot), *(pa.array(flat[slot, k]) for k in range(3))], ["slot", "g", "h", "n"])

    return work


def _moved_margins(n_features: int, tree: Tree):
    def work(batches):
        found = _rows(batches, n_features)
        if found is not None:
            bins, y, margin = found
            yield _block(bins, y, margin + tree.value[tree.leaves(bins)])

    return work


@dataclass
class Boosted:
    features: Features
    base: float
    trees: list[Tree]

    def probability(self) -> Column:
        """The probability of 1, for rows that have the features' columns."""
        model, columns = self, [*self.features.numeric, *self.features.categorical]

        @F.pandas_udf("double")
        def said(frame: pd.DataFrame) -> pd.Series:
            bins = model.features.bins({c: frame[c].to_numpy() for c in columns})
            return pd.Series(1 / (1 + np.exp(-(model.base + margins(bins, model.trees)))))

        return said(F.struct(*[F.col(c) for c in columns]))


def fit(rows: DataFrame, target: str, numeric: list[str], categorical: list[str], settings: Settings = Settings(), partition_rows: int = PARTITION_ROWS) -> Boosted:
    """Rows with numeric columns that are not null, categorical ones and a target of 0 and 1 -> the model."""
    spark = rows.sparkSession
    features = Features.fit(rows, numeric, categorical)
    count, mean = rows.agg(F.count(F.lit(1)), F.avg(F.col(target).cast("double"))).first()
    if not count:
        raise ValueError("no rows to learn from")
    mean = min(max(mean, 1e-15), 1 - 1e-15)
    base, n, width = float(np.log(mean / (1 - mean))), len(features.names), max(2, *(len(e) + 1 for e in features.edges), 2)
    parts = -(-count // partition_rows)
    if parts > 1:
        parts = max(parts, min(spark.sparkContext.defaultParallelism, count // LEAST_ROWS))
    spread = rows.select(*numeric, *categorical, target)
    spread = spread.coalesce(1) if parts == 1 else spread.repartition(parts)
    made: list[str] = []

    def put(df: DataFrame, name: str) -> DataFrame:
        made.append(new_folder(spark, "intermediate", name))
        df.write.parquet(made[-1])
        return spark.read.schema(_BINNED).parquet(made[-1])

    table = put(spread.mapInArrow(_into_bins(features, target, base), _BINNED), "binned")
    cached: list[DataFrame] = []
    try:
        if parts == 1:
            schema = "round long, feature array<long>, bin array<long>, left array<long>, value array<double>"
            found = sorted(table.coalesce(1).mapInArrow(_rounds_in_task(n, width, settings), schema).collect())  # a few hundred trees
            trees = [Tree(*map(np.array, r[1:])) for r in found]
            return Boosted(features, base, trees)
        trees: list[Tree] = []
        for k in range(settings.rounds):

            def level(routing: Tree, open_: list[int], table=table) -> np.ndarray:
                sums = table.mapInArrow(_level_in_tasks(n, width, routing, open_), "slot long, g double, h double, n double")
                if parts > ADDED:
                    sums = sums.groupBy("slot").agg(*[F.sum(c).alias(c) for c in "ghn"])
                got = sums.toArrow()  # at most a row for each open node, feature and bin, of at most ADDED partitions
                slot, *added = (got.column(c).to_numpy() for c in ("slot", "g", "h", "n"))
                return np.stack([np.bincount(slot, w, len(open_) * n * width) for w in added], axis=1).reshape(len(open_), n, width, 3)

            trees.append(grow(level, settings))
            for old in cached[:-1]:  # the margins that the tree was made of are in the last
                old.unpersist()
            cached = cached[-1:]
            if k + 1 == settings.rounds:
                break
            table = table.mapInArrow(_moved_margins(n, trees[-1]), _BINNED)
            if (k + 1) % KEPT_TREES:
                cached.append(table.persist())
            else:
                table = put(table, "margins")
                remove(spark, made.pop(-2))
        return Boosted(features, base, trees)
    finally:
        for old in cached:
            old.unpersist()
        remove(spark, *made)
