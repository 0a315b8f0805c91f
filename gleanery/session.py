"""Session settings and the shared folder jobs may write intermediate tables to."""

from __future__ import annotations

import tempfile
import uuid

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROCKSDB_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def as_column(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def build_session(app_name: str = "gleanery", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the jobs are tuned for; any of them can be overridden."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.streaming.stateStore.providerClass": ROCKSDB_PROVIDER,
        **{k.replace("__", "."): v for k, v in conf.items()},
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir`` or by the context; executors have to share it, so none is made up."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    raise ValueError("spark.checkpoint.dir names no folder for intermediate tables")


def name_local_folder(spark: SparkSession) -> None:
    """Where nothing names the shared folder and driver and executors are one process: a folder of its own."""
    unset = not spark.conf.get("spark.checkpoint.dir", None) and not spark.sparkContext.getCheckpointDir()
    if unset and spark.sparkContext.master.startswith("local") and "cluster" not in spark.sparkContext.master:
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="gleanery-"))


def checkpointed(df: DataFrame) -> DataFrame:
    """Materialise ``df`` reliably, keeping its partitions.

    Needed where a value depends on how rows were placed (chunk numbers): a recomputed partition could place
    rows differently, a stored one cannot, and the stored files survive lost executors.
    """
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)


def stored_table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to a new table in the shared folder and read it back; only the columns a later job needs are read again."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/gleanery/{name}-{uuid.uuid4().hex}"


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ship_with_tasks() -> None:
    """Send this package's own functions along with the tasks that use them.

    For sessions that were started without the package on the executors' Python path.
    """
    import gleanery

    cloudpickle.register_pickle_by_value(gleanery)
