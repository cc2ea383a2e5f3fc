"""What the operators share: tables in the cluster's shared folder and joins of a checked size."""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Used only where spark.checkpoint.dir is unset, as in tests on one machine.
LOCAL_FOLDER = "/tmp/checkpoints/matchlake"
#: Lists of paths that `scratch` deletes, the innermost last.
_SCRATCH: list[list[str]] = []
#: A side of a join is broadcast up to so many rows, after they were counted; beyond, it is shuffled.
BROADCAST_ROWS = 50_000


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors and the driver see, with one subfolder for each application."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    base = base or LOCAL_FOLDER
    return f"{base.rstrip('/')}/tables/{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    if _SCRATCH:
        _SCRATCH[-1].append(path)
    return path


def remove(spark: SparkSession, *paths: str) -> None:
    """Deletes paths in whatever store they are; paths that are gone are passed over."""
    for path in paths:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes, at the end, every table that operators wrote inside; results must have been written elsewhere by then."""
    _SCRATCH.append([])
    try:
        yield
    finally:
        remove(spark, *_SCRATCH.pop())


class Tables:
    """Intermediate tables of one operator call, written as Parquet: they cut the lineage and outlive executors."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.name, self.paths = spark, name, {}

    def put(self, df: DataFrame, key: str) -> DataFrame:
        path = new_path(self.spark, f"{self.name}-{key}")
        df.write.parquet(path)
        self.paths[key] = path
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *keys: str) -> None:
        """Deletes tables that no later result reads."""
        remove(self.spark, *(self.paths.pop(k) for k in keys if k in self.paths))


def join_checked(large: DataFrame, small: DataFrame, on: list[str], how: str = "inner", null_safe: bool = False, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Joins by columns of equal names. `small` must be cheap to count (a written table): it is broadcast if it has
    at most `rows` rows of a few numbers each, and else shuffled, where adaptive execution splits hot keys."""
    few = small.limit(rows + 1).count() <= rows
    right = F.broadcast(small) if few else small
    renamed = right.select(*[F.col(c).alias(f"_r_{c}" if c in on else c) for c in small.columns])
    test = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"_r_{c}")) if null_safe else F.col(c) == F.col(f"_r_{c}") for c in on))
    return large.join(renamed, test, how).drop(*[f"_r_{c}" for c in on])  # semi and anti joins have none of these


def bounded_sample(df: DataFrame, key: str, rows: int) -> DataFrame:
    """About `rows` rows, and no more, those with the least hashes of `key`. A threshold on the hash comes first, so that
    what tasks send for the last cut is in all little more than what is kept, whatever the number of tasks."""
    parts = 1 << 30
    total = df.count()
    near = df if total <= rows else df.where(F.pmod(F.xxhash64(key), F.lit(parts)) < F.lit(int(parts * 1.1 * rows / total) + 1))
    return near.orderBy(F.pmod(F.xxhash64(key), F.lit(parts)), key).limit(rows)


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores before it as it takes to be no column of `df`."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        out.append(name)
    return out


def same_columns(df: DataFrame) -> list[Column]:
    """The columns of `df`, for a select from something that has them and more."""
    return [F.col(f"`{c}`") for c in df.columns]


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))
