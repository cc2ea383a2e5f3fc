"""Operator 2: a quality classifier with hierarchical empirical Bayes over hosts and paths.

A logistic model of the text's form gives each document evidence: the log-odds of being good. The rates of hosts, and of
paths within hosts, are learned by grouped aggregation of the documents' probabilities:

    global rate m  ->  host rate = (K m + sum) / (K + n)  ->  path rate = (k host rate + sum) / (k + n)

K and k are the prior's weights in documents, from how much more hosts differ (and paths within hosts) than chance
makes them, so sparse sites shrink towards the level above. A document's posterior log-odds are its evidence plus
the log-odds of its path's rate over those of the global rate, with the document's own probability left out of its site's sums.

Documents have no address, so `source` stands for the host and `lang`, the only level below it in the table, for the path.

The model is fitted on at most TRAIN_ROWS labelled documents, those with the least hashes of their ids; everything else covers
all rows. Sites are sums of partial sums, so a host may hold any share of the documents.

Edge cases: null and empty texts have no evidence and the lowest quality: probability 0, rejected; they count in no site. Null
hosts and paths are sites of their own. Null labels are left out; an id with several labels counts with each; without labels
of both kinds the evidence is 0 and all documents with a word are kept. Repeated rows are scored each. An empty table
gives an empty result. Other columns pass through `keep_good` and are ignored by `score_quality`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text
from .shared import Tables, bounded_sample, join_checked, same_columns, unused

TRAIN_ROWS = 20_000
#: Posterior probability below which a document is rejected.
KEEP_FROM = 0.5
FEATURES = ("words", "word_length", "upper", "symbols", "digits", "pipes", "marks", "distinct", "runs", "line_words", "short", "loud", "wide")
_CLASSES = np.zeros((5, 256), dtype=np.float64)  # upper, symbol, digit, pipe, sentence mark
_CLASSES[0, 65:91] = 1
_CLASSES[1, [ord(c) for c in "#$%&*+/<=>@[\\]^_`{|}~!"]] = 1
_CLASSES[2, 48:58] = 1
_CLASSES[3, ord("|")] = 1
_CLASSES[4, [ord(c) for c in ".,;:?"]] = 1


def _sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums between bounds, 0 where there is nothing between them."""
    total = np.concatenate(([0.0], np.cumsum(values, dtype=np.float64)))
    return total[bounds[1:]] - total[bounds[:-1]]


def _features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of FEATURES for each text; every row of a text without words is zero."""
    starts, ends, counts = text.word_spans(data, offsets)
    n = np.diff(counts).astype(np.float64)
    size = np.maximum(1, np.diff(offsets)).astype(np.float64)
    some = np.maximum(1, n)
    length = (ends - starts).astype(np.float64)
    hashes = text.span_hashes(data, starts, ends)
    kinds = [_sums(c[data], offsets) / size for c in _CLASSES]
    same = np.zeros(len(hashes))
    same[1:] = hashes[1:] == hashes[:-1]
    # The share of words whose last letter is a capital or which end in marks that prose does not use.
    last, first = data[np.maximum(ends - 1, 0)], data[starts] if len(starts) else data[:0]
    loud = (_CLASSES[1][last] > 0) | ((last >= 65) & (last < 91) & (length > 2))
    distinct = np.array([len(np.unique(hashes[a:b])) for a, b in zip(counts[:-1], counts[1:], strict=True)], dtype=np.float64)
    lines = _sums(data == 10, offsets) + 1
    wide = _sums(data >= 128, offsets) / size
    rows = np.stack(
        [np.log1p(n), _sums(length, counts) / some / 10, kinds[0], kinds[1], kinds[2], kinds[3], kinds[4], distinct / some ** 0.9, _sums(same, counts) / some, np.log1p(n / lines), _sums(length <= 3, counts) / some, _sums(loud, counts) / some, wide], axis=1
    )
    return rows * (n > 0)[:, None]


def features(column: pa.Array) -> np.ndarray:
    data, offsets = text.as_bytes(column)
    parts = [_features(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]) for i, j in text.slices(offsets)]
    return np.concatenate(parts) if parts else np.zeros((0, len(FEATURES)))


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, steps: int = 30) -> np.ndarray:
    """Logistic regression by Newton's method on standardised features and their squares; weights for _expand(x)."""
    if len(set(y.tolist())) < 2:
        return np.zeros(0)
    wide = np.concatenate((x, x * x), axis=1)
    mean, scale = wide.mean(axis=0), wide.std(axis=0) + 1e-9
    z = np.concatenate((np.ones((len(x), 1)), (wide - mean) / scale), axis=1)
    w = np.zeros(z.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        h = (z * (p * (1 - p))[:, None]).T @ z + ridge * len(x) * np.eye(len(w))
        step = np.linalg.solve(h, z.T @ (y - p) - ridge * len(x) * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return np.concatenate(([w[0] - (w[1:] * mean / scale).sum()], w[1:] / scale))


def log_odds(x: np.ndarray, weights: np.ndarray) -> np.ndarray:
    return np.clip(weights[0] + np.concatenate((x, x * x), axis=1) @ weights[1:], -20, 20) if len(weights) else np.zeros(len(x))


def _logit(c: Column) -> Column:
    c = F.greatest(F.least(c, F.lit(1 - 1e-6)), F.lit(1e-6))
    return F.log(c / (1 - c))


def _strength(groups, n, squares, scatter) -> float:
    """The weight of a prior in documents, by moments: 1 / r - 1 for an intraclass correlation of r. `groups` are those
    that are free, `squares` the sum of squared sizes over their total, `scatter` the sum of squares over a unit's variance."""
    groups = max(groups or 0, 0)
    free = (n or 0) - (squares or 0) - groups
    r = ((scatter or 0) - groups) / free if free > 0 else 0
    return min(max(1 / r - 1, 1.0), 1e6) if r > 0 else 1e6


class QualityModel:
    """The fitted evidence model and site rates; made by `fit_quality`."""

    def __init__(self, weights: np.ndarray, scored: DataFrame, sites: DataFrame, rate: float, host_weight: float, path_weight: float):
        """scored: id, host, path, evidence of each document, written; sites: the sums of each host and path, written."""
        self.weights, self.scored, self.sites = weights, scored, sites
        self.rate, self.host_weight, self.path_weight = rate, host_weight, path_weight

    def posterior(self, docs: DataFrame, host: str, path: str, evidence: str) -> tuple[DataFrame, Column, Column]:
        """`docs` joined with its sites, and the columns of the site's rate and of the posterior probability."""
        own_host, own_path, hs, hn, ps, pn = unused(docs, "_host", "_path", "_host_sum", "_host_n", "_path_sum", "_path_n")
        sites = self.sites.select(*[F.col(a).alias(b) for a, b in (("host", own_host), ("path", own_path), ("host_sum", hs), ("host_n", hn), ("path_sum", ps), ("path_n", pn))])
        rows = docs.withColumns({own_host: F.col(f"`{host}`").cast("string"), own_path: F.col(f"`{path}`").cast("string")})
        rows = join_checked(rows, sites, [own_host, own_path], "left", null_safe=True)
        own = 1 / (1 + F.exp(-F.col(evidence)))
        rate = (F.lit(self.host_weight * self.rate) + F.col(hs) - own) / (F.lit(self.host_weight) + F.col(hn) - 1)
        rate = F.coalesce((F.lit(self.path_weight) * rate + F.col(ps) - own) / (F.lit(self.path_weight) + F.col(pn) - 1), F.lit(self.rate))
        return rows, rate, F.coalesce(1 / (1 + F.exp(-(F.col(evidence) + _logit(rate) - _logit(F.lit(self.rate))))), F.lit(0.0))


@text.tidy
def _described(batches):
    for batch in batches:
        x = features(batch.column("text"))
        cells = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * len(FEATURES)), pa.array(x.ravel()))
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("host"), batch.column("path"), cells], ["id", "host", "path", "x"])


def _evidence(x: np.ndarray, weights: np.ndarray) -> pa.Array:
    """Log-odds of rows of FEATURES; null without a word."""
    return pa.array(np.where(x[:, 0] > 0, log_odds(x, weights), np.nan), from_pandas=True)


def fit_quality(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", train_rows: int = TRAIN_ROWS) -> QualityModel:
    """docs: doc_id, text, `host`, `path`; labels: doc_id, quality (0 or 1). Texts are read once: their features are
    written and all else is made from these."""
    t = Tables(docs.sparkSession, "quality")
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.col(f"`{host}`").cast("string").alias("host"), F.col(f"`{path}`").cast("string").alias("path"), F.col("text").cast("string").alias("text"))
    described = t.put(rows.mapInArrow(_described, "id long, host string, path string, x array<double>"), "described")
    marks = labels.where("quality IN (0, 1) AND doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("id"), F.col("quality").cast("int").alias("y"))
    # Documents that a stage before has dropped don't count, so the sample is drawn after the join.
    sample = bounded_sample(t.put(marks.join(described.where("x[0] > 0").select("id", "x"), "id"), "labelled"), "id", train_rows).collect()
    x, y = np.array([r["x"] for r in sample]).reshape(len(sample), len(FEATURES)), np.array([r["y"] for r in sample], dtype=np.float64)
    weights = fit(x, y)

    @text.tidy
    def evidence(batches):
        for batch in batches:
            x = np.asarray(batch.column("x").flatten(), dtype=np.float64).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("host"), batch.column("path"), _evidence(x, weights)], ["id", "host", "path", "evidence"])

    scored = t.put(described.mapInArrow(evidence, "id long, host string, path string, evidence double"), "scored")
    t.drop("described", "labelled")
    q = 1 / (1 + F.exp(-F.col("evidence")))
    paths = t.put(scored.where("evidence IS NOT NULL").groupBy("host", "path").agg(F.sum(q).alias("path_sum"), F.count(F.lit(1)).alias("path_n")), "paths")
    hosts = t.put(paths.groupBy("host").agg(F.sum("path_sum").alias("host_sum"), F.sum("path_n").alias("host_n")), "hosts")
    whole = hosts.agg(F.sum("host_sum").alias("s"), F.sum("host_n").alias("n")).first()
    rate = (whole["s"] / whole["n"]) if whole["n"] else 0.5
    spread = max(rate * (1 - rate), 1e-9)
    h = hosts.agg(F.count(F.lit(1)).alias("g"), F.sum("host_n").alias("n"), F.sum(F.pow("host_n", F.lit(2))).alias("q"), F.sum(F.col("host_n") * F.pow(F.col("host_sum") / F.col("host_n") - F.lit(rate), F.lit(2)) / F.lit(spread)).alias("s")).first()
    host_weight = _strength((h["g"] or 0) - 1, h["n"], (h["q"] or 0) / max(h["n"] or 0, 1), h["s"])
    sites = t.put(join_checked(paths, hosts, ["host"], null_safe=True), "sites")
    mu = (F.lit(host_weight * rate) + F.col("host_sum")) / (F.lit(host_weight) + F.col("host_n"))
    within = sites.groupBy("host").agg(F.count(F.lit(1)).alias("g"), F.sum("path_n").alias("n"), F.sum(F.pow("path_n", F.lit(2))).alias("q"), F.sum(F.col("path_n") * F.pow(F.col("path_sum") / F.col("path_n") - F.col("host_sum") / F.col("host_n"), F.lit(2)) / F.greatest(mu * (1 - mu), F.lit(1e-9))).alias("s"))
    p = within.agg(F.sum(F.col("g") - 1).alias("g"), F.sum("n").alias("n"), F.sum(F.col("q") / F.col("n")).alias("q"), F.sum("s").alias("s")).first()
    return QualityModel(weights, scored, sites, rate, host_weight, _strength(p["g"], p["n"], p["q"], p["s"]))


def score_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, text, source, lang -> doc_id, source, lang, evidence, site_rate, quality, keep."""
    model = fit_quality(docs.select("doc_id", "text", "source", "lang"), labels)
    rows, rate, quality = model.posterior(model.scored, "host", "path", "evidence")
    keep = F.col("evidence").isNotNull() & (F.col("quality") >= KEEP_FROM)
    rows = rows.select(F.col("id").alias("doc_id"), F.col("host").alias("source"), F.col("path").alias("lang"), "evidence", rate.alias("site_rate"), quality.alias("quality"))
    return rows.withColumn("keep", keep)


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are not rejected, with their columns. Texts are scored where they are a second time, which costs
    less than to shuffle them to their scores; called nondeterministic, so that no filter makes the planner score them again."""
    model = fit_quality(docs, labels)
    weights = model.weights

    @F.arrow_udf("double")
    def evidence(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        try:
            for column in columns:
                yield _evidence(features(column), weights)
        finally:
            text.release()

    (own,) = unused(docs, "_evidence")
    rows, _, quality = model.posterior(docs.withColumn(own, evidence.asNondeterministic()(F.col("text").cast("string"))), "source", "lang", own)
    return rows.where(F.col(own).isNotNull() & (quality >= KEEP_FROM)).select(*same_columns(docs))


def op2(spark, sf_dir: str) -> DataFrame:
    return score_quality(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
