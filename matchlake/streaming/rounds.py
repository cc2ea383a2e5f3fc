"""Rounds as they arrive: raw rows of a stream are validated and the newest of each key goes to a keyed table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import rounds
from ..operators.keyed import KeyedTable

KEYS = ["file", "round_number"]
ROUNDS = "src_ord long, file string, round_number int, map string, round_type string, winner_side_current string, ct_eq_val decimal(38,10), t_eq_val decimal(38,10)"


def rounds_table(spark: SparkSession, path: str) -> KeyedTable:
    return KeyedTable(spark, path, ROUNDS, KEYS)


def upsert_rounds(raw: DataFrame, path: str, checkpoint: str, available_now: bool = True, stream: str = "rounds") -> StreamingQuery:
    """Keeps the table at `path` at the last valid row of each (file, round_number). A batch rewrites the buckets that it
    touches; one that is sent again under its number changes nothing."""

    def merge(batch: DataFrame, number: int) -> None:
        valid = rounds.silver_checked(batch).where("reason IS NULL").drop("reason")
        newest = lambda old, new: rounds.keep_last(old.unionByName(new), KEYS, [F.col("src_ord").desc()])
        rounds_table(batch.sparkSession, path).merge(rounds.keep_last(valid, KEYS, [F.col("src_ord").desc()]), newest, (stream, number))

    writer = raw.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
