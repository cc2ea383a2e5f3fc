"""Splits, preparation, models, metrics and their report tables for next-round prediction."""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..session import written
from . import boosting
from .rounds import consistency, feature_columns

METRICS = ("roc_auc", "f1", "balanced_accuracy", "log_loss", "brier")
MODELS = ("baseline_repeat_current", "logistic_regression", "hist_gradient_boosting")
TARGET = "target_winner_side_next_code"
#: Values are dealt out within so many buckets of rows, and within more where these would have more rows than DEALT_ROWS.
DEALT_BUCKETS, DEALT_ROWS = 32, 50_000
#: Probabilities of a feature and repeat that are ranked at once, about.
RANKED_ROWS = 100_000


def _before(rows: DataFrame, by: list[str], bucket: Column, order: list[Column], *counted: str, down: bool = False) -> DataFrame:
    """`rows` with before_<c>, the total of each column c of `counted` over the rows of a group that come earlier by
    `order`, and all_<c>, the group's. Rows are summed within buckets, which `order` must not interleave, and the totals of
    earlier buckets are added: no task takes a whole group, only its buckets' totals."""
    rows = rows.withColumn("_b", bucket)
    first = Window.partitionBy(*by).orderBy(F.col("_b").desc() if down else F.col("_b")).rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy(*by, "_b").agg(*[F.sum(c).alias(c) for c in counted])
    totals = sums.select(
        *[F.col(c).alias(f"_k{i}") for i, c in enumerate([*by, "_b"])],
        *[F.coalesce(F.sum(c).over(first), F.lit(0)).alias(f"_first_{c}") for c in counted],
        *[F.sum(c).over(Window.partitionBy(*by)).alias(f"all_{c}") for c in counted],
    )
    own = Window.partitionBy(*by, "_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({f"_own_{c}": F.coalesce(F.sum(c).over(own), F.lit(0)) for c in counted})
    test = [F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate([*by, "_b"])]
    out = rows.join(totals, test).withColumns({f"before_{c}": F.col(f"_first_{c}") + F.col(f"_own_{c}") for c in counted})
    return out.select(*[c for c in rows.columns if c != "_b" and not c.startswith("_own_")], *[f"{m}_{c}" for c in counted for m in ("before", "all")])


def _bucket(p: str) -> Column:
    """4,096 equal ranges of a probability; NaN, which is sorted as the greatest, comes with the greatest."""
    return F.when(F.isnan(p), F.lit((1 << 63) - 1)).otherwise(F.floor(F.col(p) * 4096))


def group_split(frame: DataFrame, share: float = 0.2, seed: str = "42", group: str = "file") -> DataFrame:
    """`frame` with is_test: whole files, the first ceil(share * files) in the order of a seeded hash."""
    files = frame.select(group).distinct().withColumns({"_h": F.md5(F.concat(F.lit(seed), F.col(group))), "_one": F.lit(1)})
    marked = _before(files, [], F.substring("_h", 1, 3), [F.col("_h"), F.col(group)], "_one")
    return frame.join(marked.select(group, (F.col("before__one") < F.ceil(F.col("all__one") * share)).alias("is_test")), group)


def baseline(side: Column) -> Column:
    """The current winner wins again."""
    return F.when(side == "CT", 1.0).when(side == "T", 0.0).otherwise(0.5)


def metrics(rows: DataFrame, y: str = "y", p: str = "p", by: list[str] | None = None, min_rows: int = 0) -> DataFrame:
    """ROC-AUC by average ranks, F1, balanced accuracy, log-loss and Brier score, for each group of `by`.

    Rows are counted by (group, probability, class) first, so ranks are sums over distinct probabilities, range by range.
    An AUC of one class is null.
    """
    by = by or []
    rows = rows.select(*by, F.col(y).cast("int").alias("y"), S.clip_probability(F.col(p).cast("double")).alias("p")).groupBy(*by, "p").agg(F.sum(F.col("y")).alias("pos"), F.count(F.lit(1)).alias("n"))
    # one row a distinct probability: rank of its middle
    rows = _before(rows, by, _bucket("p"), [F.col("p")], "n").withColumn("rank", F.col("before_n") + (F.col("n") + 1) / 2)
    pos, neg, said = F.sum("pos"), F.sum(F.col("n") - F.col("pos")), F.col("p") >= 0.5
    tp, fp = F.sum(F.when(said, F.col("pos")).otherwise(0)), F.sum(F.when(said, F.col("n") - F.col("pos")).otherwise(0))
    fn, tn = pos - tp, neg - fp
    div = lambda a, b: F.when(b != 0, a / b)
    out = rows.groupBy(*by).agg(
        F.sum("n").cast("long").alias("rows"),
        div(F.sum(F.col("rank") * F.col("pos")) - pos * (pos + 1) / 2, pos * neg).alias("roc_auc"),
        F.coalesce(div(2 * tp, 2 * tp + fp + fn), F.lit(0.0)).alias("f1"),
        ((F.coalesce(div(tp, pos), div(tn, neg)) + F.coalesce(div(tn, neg), div(tp, pos))) / 2).alias("balanced_accuracy"),
        (-F.sum(F.col("pos") * F.log("p") + (F.col("n") - F.col("pos")) * F.log(1 - F.col("p"))) / F.sum("n")).alias("log_loss"),
        (F.sum(F.col("pos") * F.pow(1 - F.col("p"), F.lit(2)) + (F.col("n") - F.col("pos")) * F.pow("p", F.lit(2))) / F.sum("n")).alias("brier"),
    )
    return out.where(F.col("rows") >= min_rows)


def segment_metrics(rows: DataFrame, segment: str, y: str = "y", p: str = "p", min_rows: int = 1) -> DataFrame:
    named = rows.select(F.col(segment).cast("string").alias("segment"), F.col(y).alias("y"), F.col(p).alias("p"))
    return metrics(named, by=["segment"], min_rows=min_rows).orderBy(F.col("rows").desc(), "segment")


def confusion_matrix(rows: DataFrame, y: str = "y", p: str = "p") -> DataFrame:
    return rows.groupBy(F.col(y).cast("int").alias("actual"), (F.col(p) >= 0.5).cast("int").alias("predicted")).agg(F.count(F.lit(1)).alias("n"))


def roc_points(rows: DataFrame, y: str = "y", p: str = "p") -> DataFrame:
    """threshold, fpr, tpr at each distinct probability."""
    per = rows.groupBy(F.col(p).alias("threshold")).agg(F.sum(F.col(y).cast("long")).alias("pos"), F.count(F.lit(1)).alias("n"))
    per = per.withColumn("neg", F.col("n") - F.col("pos"))
    out = _before(per, [], _bucket("threshold"), [F.col("threshold").desc()], "pos", "neg", down=True)
    share = lambda c: F.try_divide(F.col(f"before_{c}") + F.col(c), f"all_{c}")
    return out.select("threshold", share("neg").alias("fpr"), share("pos").alias("tpr"))


def file_sets(split: DataFrame, group: str = "file") -> DataFrame:
    """One row: groups in training and in test rows, and in both, which a split by groups must not have."""
    sides = split.groupBy(group).agg(F.bool_or(~F.col("is_test")).alias("a"), F.bool_or("is_test").alias("b"))
    return sides.agg(F.count_if("a").alias("train_files"), F.count_if("b").alias("test_files"), F.count_if(F.col("a") & F.col("b")).alias("shared_files"))


def ranked_coefficients(table: DataFrame, keep: int | None = None) -> DataFrame:
    """feature, coefficient -> those of the greatest magnitude first."""
    out = table.orderBy(F.abs("coefficient").desc(), "feature")
    return out if keep is None else out.limit(keep)


def coefficients(trained: Trained) -> DataFrame:
    """feature, coefficient of a logistic regression, the greatest first. One row a feature."""
    model = trained.model.stages[-1]
    hot = trained.model.stages[0]
    names = list(trained.preparation.numeric)
    for c, labels in zip(trained.preparation.categorical, hot.labelsArray, strict=True):
        names += [f"{c}={x}" for x in [*labels, "other"]]
    return ranked_coefficients(SparkSession.active().createDataFrame([(n, float(x)) for n, x in zip(names, model.coefficients, strict=False)], "feature string, coefficient double"))


def finite_metrics(long: DataFrame) -> DataFrame:
    """model_name, metric, value rows that a tracker takes: no null, NaN or infinite value."""
    v = F.col("value")
    return long.where(v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))


def seeded_sample(rows: DataFrame, n: int, seed: str, key: str) -> DataFrame:
    """`n` rows, those with the least hashes of seed and key: the same on every run, and a top-k without a full sort."""
    return rows.orderBy(F.md5(F.concat(F.lit(seed), F.col(key).cast("string"))), key).limit(n)


def correlations(rows: DataFrame, columns: list[str]) -> DataFrame:
    """a, b, corr of all pairs of numeric columns, over rows where both are there; one pass over the rows."""
    pairs = list(itertools.combinations(columns, 2))
    v = lambda c: F.col(c).cast("double")
    one = rows.agg(*[F.corr(v(a), v(b)).alias(f"r{i}") for i, (a, b) in enumerate(pairs)])
    return one.select(F.inline(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"r{i}").alias("corr")) for i, (a, b) in enumerate(pairs)])))


def described(rows: DataFrame, columns: list[str]) -> DataFrame:
    """name, count, mean, std, min, p25, p50, p75, max of numeric columns; one pass over the rows. Quartiles are
    interpolated between distinct values, of which a column of measurements has few."""
    facts = {"count": F.count, "mean": F.avg, "std": F.stddev_samp, "min": F.min, "p25": lambda c: F.percentile(c, F.lit(0.25)), "p50": lambda c: F.percentile(c, F.lit(0.5)), "p75": lambda c: F.percentile(c, F.lit(0.75)), "max": F.max}
    one = rows.agg(*[f(F.col(c).cast("double")).alias(f"{k}{i}") for i, c in enumerate(columns) for k, f in facts.items()])
    return one.select(F.inline(F.array(*[F.struct(F.lit(c).alias("name"), *[F.col(f"{k}{i}").alias(k) for k in facts]) for i, c in enumerate(columns)])))


def unpivot_metrics(table: DataFrame, names=METRICS) -> DataFrame:
    return table.unpivot(["model_name"], list(names), "metric", "value")


def ranked_models(table: DataFrame) -> DataFrame:
    auc = F.when(~F.isnan("roc_auc"), F.col("roc_auc"))
    return table.orderBy(auc.desc_nulls_last(), "model_name")


def best_model(table: DataFrame) -> DataFrame:
    return ranked_models(table.where("roc_auc IS NOT NULL")).select("model_name", "roc_auc").limit(1)


class Preparation:
    """Medians, means, deviations and most frequent values of training rows, and the columns that they make."""

    def __init__(self, numeric: list[str], categorical: list[str], facts: dict):
        self.numeric, self.categorical, self.facts = numeric, categorical, facts

    @classmethod
    def fit(cls, rows: DataFrame, numeric: list[str], categorical: list[str]) -> Preparation:
        """One aggregate over the rows; of equally frequent values the least is taken."""
        asked = []
        for i, c in enumerate(numeric):
            v = F.col(c).cast("double")
            asked += [f(v).alias(f"{k}{i}") for k, f in (("n", F.count), ("mean", F.avg), ("var", F.var_pop))] + [F.percentile(v, F.lit(0.5)).alias(f"median{i}")]
        found = rows.agg(F.count(F.lit(1)).alias("rows"), *asked, *[F.mode(F.col(c), True).alias(f"mode{i}") for i, c in enumerate(categorical)]).first()
        facts: dict = {"median": {}, "mode": {c: "unknown" if found[f"mode{i}"] is None else found[f"mode{i}"] for i, c in enumerate(categorical)}}
        for i, c in enumerate(numeric):  # mean and deviation of the values once the median stands for those that are missing
            n, mean, var, median = (found[f"{k}{i}"] or 0.0 for k in ("n", "mean", "var", "median"))
            gone, rows_ = found["rows"] - n, max(found["rows"], 1)
            facts["median"][c] = median
            facts[f"{c}_mean"] = m = (n * mean + gone * median) / rows_
            facts[f"{c}_std"] = math.sqrt((n * (var + (mean - m) ** 2) + gone * (median - m) ** 2) / rows_)
        return cls(numeric, categorical, facts)

    def apply(self, rows: DataFrame) -> DataFrame:
        out = {}
        for c in self.numeric:
            v = F.coalesce(F.col(c).cast("double"), F.lit(float(self.facts["median"][c])))
            std = self.facts[f"{c}_std"] or 1.0
            out[f"x_{c}"] = (v - F.lit(float(self.facts[f"{c}_mean"] or 0.0))) / F.lit(float(std))
        for c in self.categorical:
            out[f"c_{c}"] = F.coalesce(F.col(c).cast("string"), F.lit(self.facts["mode"][c]))
        return rows.withColumns(out)


def _pipeline(numeric, categorical, model) -> Pipeline:
    index = StringIndexer(inputCols=[f"c_{c}" for c in categorical], outputCols=[f"i_{c}" for c in categorical], handleInvalid="keep")
    hot = OneHotEncoder(inputCols=[f"i_{c}" for c in categorical], outputCols=[f"h_{c}" for c in categorical], dropLast=False)
    return Pipeline(stages=[index, hot, VectorAssembler(inputCols=[f"x_{c}" for c in numeric] + [f"h_{c}" for c in categorical], outputCol="features"), model])


class Trained:
    def __init__(self, name: str, preparation: Preparation, model):
        self.name, self.preparation, self.model = name, preparation, model

    def predict(self, rows: DataFrame) -> DataFrame:
        """`rows` with the probability `p` that CT wins next."""
        made = self.preparation.apply(rows)
        if isinstance(self.model, boosting.Boosted):
            return made.withColumn("p", self.model.probability()).select(*rows.columns, "p")
        return self.model.transform(made).withColumn("p", vector_to_array("probability")[1]).select(*rows.columns, "p")

    def in_task(self) -> tuple[Callable, list[slice], Callable]:
        """`predict` for prepared rows within a task: what makes cells of a table (a row for each thing that the model adds
        up or compares), the cells of each feature, and what makes probabilities of cells."""
        numeric, categorical = ([f"{k}_{c}" for c in names] for k, names in (("x", self.preparation.numeric), ("c", self.preparation.categorical)))
        if isinstance(self.model, boosting.Boosted):
            features, trees, base = self.model.features, self.model.trees, self.model.base
            ends = np.cumsum([1] * len(numeric) + [len(v) for v in features.values]).tolist()
            owned = [slice(a, b) for a, b in zip([0, *ends], ends, strict=False)]
            cells = lambda t: np.ascontiguousarray(features.bins({c: t.column(c).to_numpy() for c in [*numeric, *categorical]}).T)
            return cells, owned, lambda x: 1 / (1 + np.exp(-(base + boosting.margins(x.T, trees))))
        weights, intercept = self.model.stages[-1].coefficients.toArray(), float(self.model.stages[-1].intercept)
        labels = [list(x) for x in self.model.stages[0].labelsArray]
        firsts = np.cumsum([len(numeric)] + [len(x) + 1 for x in labels])

        def shares(t: pa.Table) -> np.ndarray:
            out = [t.column(c).to_numpy() * w for c, w in zip(numeric, weights, strict=False)]
            for c, known, first in zip(categorical, labels, firsts, strict=False):
                at = pc.fill_null(pc.index_in(t.column(c), value_set=pa.array(known, pa.string())), len(known))
                out.append(weights[first + at.to_numpy()])
            return np.stack(out)

        def said(x: np.ndarray) -> np.ndarray:
            margin = np.zeros(x.shape[1])
            for share in x:  # one after the other: equal rows have equal margins
                margin += share
            with np.errstate(over="ignore"):
                return 1 - 1 / (1 + np.exp(margin + intercept))

        return shares, [slice(i, i + 1) for i in range(len(numeric) + len(categorical))], said


def train(rows: DataFrame, name: str, iterations: int = 350) -> Trained:
    """One of MODELS[1:]. Classes are weighted to balance in the logistic regression. `rows` are read several times: give a
    written table."""
    numeric, categorical = feature_columns(rows)
    if name not in MODELS[1:]:
        raise ValueError(f"unknown model {name}")
    prep = Preparation.fit(rows, numeric, categorical)
    data = prep.apply(rows)
    if name == "hist_gradient_boosting":
        return Trained(name, prep, boosting.fit(data, TARGET, [f"x_{c}" for c in numeric], [f"c_{c}" for c in categorical], boosting.Settings(rounds=iterations)))
    per = {r[TARGET]: r["count"] for r in rows.groupBy(TARGET).count().collect()}
    n = sum(per.values())
    weights = F.create_map(*[F.lit(x) for k, c in per.items() for x in (k, n / (len(per) * c))])
    data = data.withColumn("_w", weights[F.col(TARGET)]).withColumn("label", F.col(TARGET).cast("double"))
    model = LogisticRegression(maxIter=2000, regParam=1.0 / max(n, 1), elasticNetParam=0.0, standardization=False, weightCol="_w")
    return Trained(name, prep, _pipeline(numeric, categorical, model).fit(data))


def written_split(frame: DataFrame, share: float = 0.2, seed: str = "42") -> DataFrame:
    """The split frame, computed once and written in partitions of a size that learning is done over."""
    frame = written(frame, "frame")
    parts = -(-frame.count() // boosting.PARTITION_ROWS) or 1
    split = group_split(frame, share, seed)
    return written(split.coalesce(1) if parts == 1 else split.repartition(parts), "split")


_COUNTED = pa.schema([("f", pa.int32()), ("r", pa.int32()), ("part", pa.int32()), *((f"{k}{c}", pa.binary()) for c in (0, 1) for k in "pn")])
_COUNTED_DDL = "f int, r int, part int, p0 binary, n0 binary, p1 binary, n1 binary"
_PAIRS_DDL = "f int, r int, part int, neg long, pos long, twice long"


def _dealt(model: tuple[Callable, list[slice], Callable], repeats: int, edges: np.ndarray):
    """Rows of whole buckets, in order -> for each feature and repeat, and once for values as they are (feature -1), the
    distinct probabilities of each class and how many rows have them, cut at the edges."""
    cells_of, owned, said = model

    def counted(f: int, r: int, p: np.ndarray, y: np.ndarray) -> list[dict]:
        p = np.fmax(np.fmin(p, 1 - S.PROBABILITY_MARGIN), S.PROBABILITY_MARGIN)  # as Spark, takes NaN for the greatest
        rows = [{"f": f, "r": r, "part": k} for k in range(len(edges) + 1)]
        for c in (0, 1):
            values, n = np.unique(p[y == c], return_counts=True)
            cuts = np.searchsorted(values, edges)
            for row, v, m in zip(rows, np.split(values, cuts), np.split(n.astype(np.uint32), cuts), strict=True):
                row |= {f"p{c}": v.tobytes(), f"n{c}": m.tobytes()}
        return rows

    def bucket(t: pa.Table):
        y, cells = t.column("y").to_numpy(), cells_of(t)
        orders = [np.argsort(t.column(f"o{r}").to_numpy(), kind="stable") for r in range(repeats)]
        yield pa.RecordBatch.from_pylist(counted(-1, 0, said(cells), y), _COUNTED)
        for f, own in enumerate(owned):
            kept, rows = cells[own].copy(), []
            for r, order in enumerate(orders):
                cells[own] = kept[:, order]
                rows += counted(f, r, said(cells), y)
            cells[own] = kept
            yield pa.RecordBatch.from_pylist(rows, _COUNTED)

    def work(batches):
        held: list[pa.RecordBatch] = []
        for b in batches:
            ends = [0, *(np.flatnonzero(np.diff(b.column("_b").to_numpy())) + 1).tolist(), b.num_rows]
            for part in (b.slice(i, j - i) for i, j in itertools.pairwise(ends) if j > i):
                if held and held[0].column("_b")[0] != part.column("_b")[0]:
                    yield from bucket(pa.Table.from_batches(held).combine_chunks())
                    held = []
                held.append(part)
        if held:
            yield from bucket(pa.Table.from_batches(held).combine_chunks())

    return work


def _pairs(key: tuple, t: pa.Table) -> pa.Table:
    """Blocks of one feature, repeat and range -> rows of each class, and twice the pairs in which the row of class 1 has
    the greater probability; an equal one counts once."""
    (v0, n0), (v1, n1) = (
        (np.frombuffer(b"".join(t.column(f"p{c}").to_pylist())), np.frombuffer(b"".join(t.column(f"n{c}").to_pylist()), np.uint32).astype(np.int64)) for c in (0, 1)
    )
    order = np.argsort(v0)
    v0, below = v0[order], np.concatenate(([0], np.cumsum(n0[order])))
    order = np.argsort(v1)  # searched in order, which is faster
    v1, n1 = v1[order], n1[order]
    twice = int((n1 * (below[np.searchsorted(v0, v1, "left")] + below[np.searchsorted(v0, v1, "right")])).sum())
    f, r, part = (k.as_py() for k in key)
    return pa.Table.from_arrays([pa.array([f], pa.int32()), pa.array([r], pa.int32()), pa.array([part], pa.int32()), pa.array([int(below[-1])]), pa.array([int(n1.sum())]), pa.array([twice])], ["f", "r", "part", "neg", "pos", "twice"])


def permutation_importance(trained: Trained, rows: DataFrame, repeats: int = 10, seed: int = 42) -> DataFrame:
    """feature, importance: the mean fall of ROC-AUC when a column's values are dealt out anew.

    Values are dealt out within salted buckets. A task has a bucket's rows once, prepared, and makes all features' and
    repeats' probabilities of them; what it gives are sorted blocks of numbers. A task that ranks has one feature, repeat
    and range of probabilities, of about RANKED_ROWS rows, so no sort takes one task."""
    features = trained.preparation.numeric + trained.preparation.categorical
    count = rows.count()
    buckets, ranges = max(DEALT_BUCKETS, -(-count // DEALT_ROWS)), -(-count // RANKED_ROWS)
    edges = trained.predict(rows).agg(F.percentile_approx(S.clip_probability(F.col("p")), [k / ranges for k in range(1, ranges)], 10_000)).first()[0] if ranges > 1 else []
    order = F.xxhash64("file", "round_number")
    made = trained.preparation.apply(rows).select(
        F.pmod(order, F.lit(buckets)).alias("_b"), order.alias("_h"), "file", "round_number", F.coalesce(F.col(TARGET).cast("int"), F.lit(0)).alias("y"),
        *[f"x_{c}" for c in trained.preparation.numeric], *[f"c_{c}" for c in trained.preparation.categorical],
        *[F.xxhash64(F.lit(seed + r), "file", "round_number").alias(f"o{r}") for r in range(repeats)],
    )
    made = made.repartition(buckets, "_b").sortWithinPartitions("_b", "_h", "file", "round_number").drop("_h", "file", "round_number")
    blocks = made.mapInArrow(_dealt(trained.in_task(), repeats, np.unique(np.array(edges or [], dtype=np.float64))), _COUNTED_DDL)
    pairs = blocks.groupBy("f", "r", "part").applyInArrow(_pairs, _PAIRS_DDL)
    lower = Window.partitionBy("f", "r").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    pairs = pairs.withColumn("twice", F.col("twice") + 2 * F.col("pos") * F.coalesce(F.sum("neg").over(lower), F.lit(0)))
    aucs = pairs.groupBy("f", "r").agg(F.try_divide(F.sum("twice").cast("double"), 2.0 * F.sum("pos") * F.sum("neg")).alias("auc"))
    found: dict[int, list[float]] = {}
    for x in aucs.where("auc IS NOT NULL").collect():  # one row a feature and repeat
        found.setdefault(x["f"], []).append(x["auc"])
    falls = {f: [found[-1][0] - x for x in xs] for f, xs in found.items()}
    out = [(c, math.fsum(falls[f]) / len(falls[f]) if f in falls else math.nan) for f, c in enumerate(features)]
    return rows.sparkSession.createDataFrame(out, "feature string, importance double").orderBy(F.col("importance").desc())


def train_and_evaluate(frame: DataFrame, models=MODELS, share: float = 0.2, seed: str = "42", iterations: int = 350, min_rows: int = 20) -> dict[str, DataFrame]:
    """Checks, split, models and the tables of their metrics: overall, by map and by half."""
    unknown = set(models) - set(MODELS)
    if unknown:
        raise ValueError(f"unknown models: {sorted(unknown)}")
    split = written_split(frame, share, seed)
    checks = consistency(split).first()
    if checks["duplicate_round_keys"] or not checks["target_shift_is_valid"] or not checks["lag1_is_past_only"]:
        raise ValueError(f"inconsistent supervised frame: {checks.asDict()}")
    fit, test = split.where("NOT is_test"), split.where("is_test")
    said = None
    for name in models:
        p = test.withColumn("p", baseline(F.col("winner_side_norm"))) if name == MODELS[0] else train(fit, name, iterations).predict(test)
        p = p.select(F.lit(name).alias("model_name"), "map", "half", F.col(TARGET).alias("y"), "p")
        said = p if said is None else said.union(p)
    return {
        "predictions": said,
        "metrics": ranked_models(metrics(said, by=["model_name"])),
        **{f"by_{s}": metrics(said.withColumn("segment", F.col(s)), by=["model_name", "segment"], min_rows=min_rows) for s in ("map", "half")},
    }
