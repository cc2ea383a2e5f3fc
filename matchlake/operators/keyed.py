"""A keyed table in hash buckets, of which a batch rewrites those that it touches.

Below the table's folder, `data/<version>/keyed_bucket=<b>/` has files and `manifest/<n>.json` says which version each bucket is
read from, with the table's schema and the last batch of each stream. A merge reads the buckets that its rows fall into,
writes their new contents under a new version, and commits by creating the next manifest, which fails if another writer
created it: the merge is then done again on what that one wrote. Until the manifest is there, readers see the old table, and
what a crash left is in no manifest; `vacuum` deletes it.

A bucket is dealt to as many tasks as it needs by the hash of the key, so a batch or a bucket of any size is written in
parallel; merges shuffle the touched buckets by key, once. Rows of one key stay together: their number is bounded by what
`merge` keeps of them.

Edge cases: null keys are keys; an empty batch commits nothing but its number; a merge may leave a bucket empty; columns
that the table lacks are dropped, those that the batch lacks are null.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..session import remove

BUCKETS = 64
RETRIES = 5
#: The folders of a version are named by it.
PART = "keyed_bucket"
#: A lock without a manifest is taken away once it is so old.
STALE_SECONDS = 600


class Conflict(Exception):
    """Another writer committed first."""


@dataclass
class Manifest:
    number: int
    schema: str
    buckets: dict[int, list[str]] = field(default_factory=dict)
    batches: dict[str, int] = field(default_factory=dict)


class KeyedTable:
    def __init__(self, spark: SparkSession, path: str, schema: str | StructType, keys: list[str], buckets: int = BUCKETS):
        """`buckets` holds for a new table; one that is there keeps its own."""
        self.spark, self.path, self.keys = spark, path.rstrip("/"), keys
        self.schema = spark.createDataFrame([], schema).schema
        self.buckets = buckets

    # ---- files

    def _place(self, *parts: str):
        place = self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.path, *parts]))
        return place, place.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _numbers(self) -> list[int]:
        place, fs = self._place("manifest")
        if not fs.exists(place):
            return []
        names = (s.getPath().getName() for s in fs.listStatus(place))
        return sorted(int(n.removesuffix(".json")) for n in names if n.removesuffix(".json").isdigit() and n.endswith(".json"))

    def manifest(self) -> Manifest:
        numbers = self._numbers()
        if not numbers:
            return Manifest(0, self.schema.json())
        text = self.spark.read.text(f"{self.path}/manifest/{numbers[-1]:020d}.json", wholetext=True).first()[0]
        said = json.loads(text)
        self.buckets = said["n_buckets"]
        return Manifest(numbers[-1], said["schema"], {int(b): d for b, d in said["buckets"].items()}, said["batches"])

    def _commit(self, m: Manifest) -> None:
        """Creates the manifest's file; a store's rename of a whole file makes it appear at once or not at all."""
        body = {"schema": m.schema, "n_buckets": self.buckets, "buckets": m.buckets, "batches": m.batches}
        fresh, fs = self._place("manifest", f".{uuid.uuid4().hex}")
        out = fs.create(fresh, False)
        out.write(bytearray(json.dumps(body).encode()))
        out.close()
        goal, _ = self._place("manifest", f"{m.number:020d}.json")
        lock, _ = self._place("manifest", f"{m.number:020d}.lock")
        try:
            fs.create(lock, False).close()  # only one writer can
        except Py4JJavaError as e:
            fs.delete(fresh, False)
            if not fs.exists(goal) and fs.exists(lock) and time.time() - fs.getFileStatus(lock).getModificationTime() / 1000 > STALE_SECONDS:
                fs.delete(lock, False)  # its writer ended before it committed
            raise Conflict(m.number) from e
        fs.rename(fresh, goal)

    # ---- reading

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*[F.col(f"`{k}`").cast("string") for k in self.keys]), F.lit(self.buckets)).cast("int")

    def _read(self, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.path}/{f}" for f in folders])

    def read(self) -> DataFrame:
        return self._read([f for fs in self.manifest().buckets.values() for f in fs])

    def lookup(self, **key) -> DataFrame:
        """Rows of one key, from the files of its bucket."""
        m = self.manifest()
        kinds = {f.name: f.dataType for f in self.schema}
        one = self.spark.createDataFrame([tuple(key[k] for k in self.keys)], StructType([self.schema[k] for k in self.keys]))
        rows = self._read(m.buckets.get(one.select(self.bucket()).first()[0], []))
        for k in self.keys:
            rows = rows.where(F.col(f"`{k}`").eqNullSafe(F.lit(key[k]).cast(kinds[k])))
        return rows

    # ---- writing

    def merge(self, rows: DataFrame, merge: Callable[[DataFrame, DataFrame], DataFrame], batch: tuple[str, int] | None = None) -> list[int]:
        """Replaces the contents of the buckets that `rows` (old and new may share keys) fall into by `merge(old, new)`.
        With `batch` (stream, number), a number that was committed before changes nothing. Returns the rewritten buckets."""
        names = {c.lower() for c in rows.columns}
        new = rows.select(*[(F.col(f"`{f.name}`") if f.name.lower() in names else F.lit(None)).cast(f.dataType).alias(f.name) for f in self.schema])
        for _ in range(RETRIES):
            try:
                return self._merge(new, merge, batch)
            except Conflict:
                time.sleep(0.2)
        raise Conflict(f"{self.path}: {RETRIES} other writers came first")

    def _merge(self, new: DataFrame, merge, batch) -> list[int]:
        m = self.manifest()
        if batch and m.batches.get(batch[0], -1) >= batch[1]:
            return []
        version = f"data/{uuid.uuid4().hex}"
        staged = f"{self.path}/{version}-rows"
        try:
            # what the batch has, once: its source may be slow, or a stream's
            new.withColumn("_bucket", self.bucket()).write.parquet(staged)
            came = self.spark.read.parquet(staged)
            touched = sorted(r[0] for r in came.select("_bucket").distinct().collect())  # at most `buckets`
            if touched:
                old = self._read([f for b in touched for f in m.buckets.get(b, [])])
                out = merge(old, came.drop("_bucket")).select(*[F.col(f"`{c}`") for c in self.schema.names]).withColumn("_bucket", self.bucket())
                out.withColumnRenamed("_bucket", PART).repartition(PART, F.pmod(F.xxhash64(*[F.col(f"`{k}`").cast("string") for k in self.keys]), F.lit(8))).write.partitionBy(PART).parquet(f"{self.path}/{version}")
            made = self._made(version)
            for b in touched:
                m.buckets.pop(b, None)
                if b in made:
                    m.buckets[b] = [made[b]]
            m.number += 1
            m.schema = self.schema.json()
            if batch:
                m.batches[batch[0]] = batch[1]
            self._commit(m)
            return touched
        except (Conflict, PySparkException):
            remove(self.spark, f"{self.path}/{version}")
            raise
        finally:
            remove(self.spark, staged)

    def _made(self, version: str) -> dict[int, str]:
        place, fs = self._place(version)
        if not fs.exists(place):
            return {}
        names = [s.getPath().getName() for s in fs.listStatus(place) if s.isDirectory()]
        return {int(n.removeprefix(f"{PART}=")): f"{version}/{n}" for n in names if n.startswith(f"{PART}=")}

    def upsert(self, rows: DataFrame, keep: str = "created_at", order: str | None = None, batch: tuple[str, int] | None = None) -> list[int]:
        """Rows take the place of those of the same key; the first `keep` of a key stays."""
        from .catalog import upsert

        return self.merge(rows, lambda old, new: upsert(old, new, self.keys, keep, order), batch)

    def delete(self, keys: DataFrame) -> list[int]:
        """Without the rows of `keys`."""
        test = lambda a, b: [a[k].eqNullSafe(b[k]) for k in self.keys]
        return self.merge(keys, lambda old, new: old.join(new, test(old, new), "left_anti"))

    def vacuum(self, keep: int = 1) -> list[str]:
        """Deletes all manifests but the last `keep` and the data that these do not name; no merge may run meanwhile."""
        numbers = self._numbers()
        used: set[str] = set()
        for n in numbers[-keep:]:
            said = json.loads(self.spark.read.text(f"{self.path}/manifest/{n:020d}.json", wholetext=True).first()[0])
            used |= {f for fs in said["buckets"].values() for f in fs}
        gone = [f"manifest/{n:020d}.{e}" for n in numbers[:-keep] for e in ("json", "lock")]
        place, fs = self._place("data")
        for version in [s.getPath().getName() for s in fs.listStatus(place)] if fs.exists(place) else []:
            inside = {f"data/{version}/{s.getPath().getName()}" for s in fs.listStatus(self._place("data", version)[0])}
            gone += sorted(x for x in inside - used if f"{PART}=" in x) if inside & used else [f"data/{version}"]
        remove(self.spark, *[f"{self.path}/{x}" for x in gone])
        return gone
