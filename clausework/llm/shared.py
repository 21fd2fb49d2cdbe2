"""Shared-folder tables: where an operator cuts its lineage or keeps intermediate rows.

Every path lies below the folder that the cluster names in ``spark.checkpoint.dir``, which the
driver and all executors see, so a lost executor costs nothing but the tasks it was running.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """The shared folder of this session; one of our own only where none is set and all runs in one process (tests)."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="clausework-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


#: Rows of an Arrow batch. A task holds some batches on the JVM, outside its heap, and in Python; Spark's 10 000 rows of text are tens of MB each.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Lower this session's bound on the rows of an Arrow batch to BATCH_ROWS; a lower one stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, BATCH_ROWS)


def new_folder(spark: SparkSession, label: str) -> str:
    return f"{shared_root(spark)}/clausework/{label}-{uuid.uuid4().hex}"


#: Spark's setting to remove an execution's shuffle files as it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def cleaned(spark: SparkSession) -> Iterator[None]:
    """What is executed inside leaves no shuffle files, which Spark else keeps until the driver happens to collect its garbage. The session's own setting is put back."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again with its own schema."""
    spark = df.sparkSession
    path = new_folder(spark, label)
    with cleaned(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._clausework_path = path
    return out


def drop(*tables: DataFrame) -> None:
    """Remove tables made by ``written`` that nothing reads any more."""
    for df in tables:
        path = getattr(df, "_clausework_path", None)
        if path:
            spark = df.sparkSession
            target = spark._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def fresh(name: str, columns: list[str]) -> str:
    """``name``, lengthened until no column has it."""
    while name.lower() in {c.lower() for c in columns}:
        name += "_"
    return name
