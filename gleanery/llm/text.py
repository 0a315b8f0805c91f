"""Words and intermediate tables shared by the operators."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.session import scratch_path

# A word is a run of anything but ASCII white space: what bytes.split() gives in Python.
SPACE = r"[\x20\x09-\x0D]"
SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def word_count(text: Column) -> Column:
    """Words of a text as a long; null and empty texts have none."""
    pieces = F.size(F.split(text, f"{SPACE}+"))
    # A split leaves an empty piece before leading and after trailing space.
    outer = text.rlike(f"^{SPACE}").cast("long") + text.rlike(rf"{SPACE}\z").cast("long")
    return F.when(text.rlike(r"[^\x20\x09-\x0D]"), pieces - outer).otherwise(0).cast("long")


@contextmanager
def shuffles_go(spark: SparkSession) -> Iterator[None]:
    """What is shuffled for a job goes as soon as it ends, not when the driver next collects its garbage."""
    before = spark.conf.get(SHUFFLES_GO, None)
    spark.conf.set(SHUFFLES_GO, "true")
    try:
        yield
    finally:
        spark.conf.unset(SHUFFLES_GO) if before is None else spark.conf.set(SHUFFLES_GO, before)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: later stages neither recompute it nor lose it with an executor."""
    path = scratch_path(df.sparkSession, name)
    with shuffles_go(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop(*tables: DataFrame) -> None:
    """Delete the files of what ``stored`` gave, once all that is made of it is stored."""
    for df in tables:
        files, context = df.inputFiles(), df.sparkSession.sparkContext
        if files:
            path = context._jvm.org.apache.hadoop.fs.Path(context._jvm.java.net.URI(files[0])).getParent()
            if path.getParent().getName() != "gleanery":
                raise ValueError(f"{path} is no stored table")
            path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
