"""Keyed tables: what a batch rewrites, what a crash leaves, and who wins."""

import os

import pytest
from pyspark.sql import functions as F

from matchlake.operators import keyed

SCHEMA = "k long, s string, v int, created_at int"


def table(spark, path, **more):
    return keyed.KeyedTable(spark, str(path), SCHEMA, ["k", "s"], **more)


def rows(spark, *r):
    return spark.createDataFrame(list(r), SCHEMA)


def held(t):
    return sorted(tuple(r) for r in t.read().collect())


def files(t):
    return {b: sorted(os.listdir(f"{t.path}/{d}")) for b, ds in t.manifest().buckets.items() for d in ds}


def test_a_batch_rewrites_the_buckets_it_touches(spark, tmp_path):
    t = table(spark, tmp_path, buckets=16)
    assert t.read().count() == 0
    t.upsert(spark.range(500).select(F.col("id").alias("k"), F.lit("a").alias("s"), F.lit(1).alias("v"), F.lit(5).alias("created_at")))
    before = files(t)
    touched = t.upsert(rows(spark, (7, "a", 2, 9), (9, "a", 3, 9)))
    after = files(t)
    assert len(before) == 16 and 1 <= len(touched) <= 2
    assert {b for b in before if before[b] != after[b]} == set(touched)
    got = {r.k: (r.v, r.created_at) for r in t.read().collect()}
    assert len(got) == 500 and got[7] == (2, 5) and got[9] == (3, 5) and got[8] == (1, 5)
    assert [tuple(r) for r in t.lookup(k=7, s="a").collect()] == [(7, "a", 2, 5)] and t.lookup(k=7, s="b").count() == 0
    t.vacuum()
    assert len(got) == t.read().count() and sum(len(v) for v in files(t).values()) * 2 >= sum(len(f) for _, _, f in os.walk(f"{tmp_path}/data"))


def test_odd_batches(spark, tmp_path):
    t = table(spark, tmp_path, buckets=4)
    assert t.upsert(rows(spark)) == [] and t.read().count() == 0
    t.upsert(rows(spark, (None, None, 1, 1), (1, None, 2, 1)).withColumn("bucket", F.lit("another")))
    t.upsert(spark.createDataFrame([(None, None, 9)], "k long, s string, v int").withColumn("created_at", F.lit(4)))
    assert set(held_nulls(t)) == {(None, None, 9, 1), (1, None, 2, 1)}
    t.delete(rows(spark, (None, None, 0, 0)))
    assert held_nulls(t) == [(1, None, 2, 1)]
    t.delete(rows(spark, (1, None, 0, 0)))
    assert t.read().count() == 0 and t.manifest().buckets == {}


def held_nulls(t):
    return [tuple(r) for r in t.read().collect()]


def test_a_crash_before_the_commit_leaves_the_old_table(spark, tmp_path, monkeypatch):
    t = table(spark, tmp_path, buckets=4)
    t.upsert(rows(spark, (1, "a", 1, 1)))

    def stop(self, m):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(keyed.KeyedTable, "_commit", stop)
        with pytest.raises(KeyboardInterrupt):
            t.upsert(rows(spark, (1, "a", 2, 2), (5, "b", 1, 1)))
    assert held(t) == [(1, "a", 1, 1)]
    left = len(os.listdir(f"{tmp_path}/data"))
    t.vacuum()
    assert held(t) == [(1, "a", 1, 1)] and len(os.listdir(f"{tmp_path}/data")) < left
    t.upsert(rows(spark, (1, "a", 2, 2)))
    assert held(t) == [(1, "a", 2, 1)]


def test_a_batch_sent_again_changes_nothing(spark, tmp_path):
    t = table(spark, tmp_path, buckets=4)
    add = lambda old, new: old.unionByName(new)
    for number in (0, 0, 1, 0, 1):
        t.merge(rows(spark, (1, "a", number, 1)), add, ("stream", number))
    assert held(t) == [(1, "a", 0, 1), (1, "a", 1, 1)]
    t.merge(rows(spark, (2, "a", 7, 1)), add, ("other", 0))
    assert t.read().count() == 3


def test_a_writer_that_comes_second_merges_again(spark, tmp_path, monkeypatch):
    one, two = table(spark, tmp_path, buckets=1), table(spark, tmp_path, buckets=1)
    one.upsert(rows(spark, (1, "a", 1, 1)))
    commit, late = keyed.KeyedTable._commit, []

    def first_lose(self, m):
        if self is one and not late:
            late.append(1)
            two.upsert(rows(spark, (2, "a", 2, 2)))
        commit(self, m)

    monkeypatch.setattr(keyed.KeyedTable, "_commit", first_lose)
    one.upsert(rows(spark, (3, "a", 3, 3)))
    assert [r[0] for r in held(one)] == [1, 2, 3]


def test_a_lock_left_behind_is_taken_away(spark, tmp_path, monkeypatch):
    t = table(spark, tmp_path, buckets=1)
    t.upsert(rows(spark, (1, "a", 1, 1)))
    open(f"{tmp_path}/manifest/{2:020d}.lock", "w").close()
    with pytest.raises(keyed.Conflict):
        t.upsert(rows(spark, (2, "a", 1, 1)))
    monkeypatch.setattr(keyed, "STALE_SECONDS", -1)
    t.upsert(rows(spark, (2, "a", 1, 1)))
    assert len(held(t)) == 2
