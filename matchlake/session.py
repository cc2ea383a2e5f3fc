"""The session that the library expects: UTC, adaptive execution, ANSI SQL left on; and its shared folder."""

import uuid

from pyspark.sql import DataFrame, SparkSession

#: Where tables are written if spark.checkpoint.dir is unset, as in tests on one machine.
LOCAL_FOLDER = "/tmp/checkpoints/matchlake"


def session(name: str = "matchlake", **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.sql.mapKeyDedupPolicy", "LAST_WIN")
    for k, v in conf.items():
        builder = builder.config(k.replace("_", "."), v)
    return builder.getOrCreate()


def new_folder(spark: SparkSession, kind: str, name: str) -> str:
    """A new path in the folder that the driver and all executors share."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return f"{(base or LOCAL_FOLDER).rstrip('/')}/{kind}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"


def remove(spark: SparkSession, *paths: str) -> None:
    """Deletes paths in whatever store they are; paths that are gone are passed over."""
    for path in paths:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """`df` as a Parquet table in the shared folder: computed once, read by any number of plans, outlives executors."""
    path = new_folder(df.sparkSession, "intermediate", name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
