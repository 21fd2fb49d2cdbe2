"""Intermediate tables in the folder that the driver and all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame


#: Rows of a partition that ``dealt`` makes; a tenth is worth a task of its own while cores are free.
PART_ROWS = 200_000


def dealt(df: DataFrame, *keys: str, rows: int | None = None, part: int | None = None) -> DataFrame:
    """``df`` dealt by ``keys`` (else in turn) into partitions of about ``part`` rows (else PART_ROWS), however large it is.

    A number given to ``repartition`` holds: Spark neither merges such partitions by their compressed size nor
    deals them again for what is grouped by these keys.  ``rows`` says how many there are about; else they are counted.
    """
    n, part = df.count() if rows is None else rows, part or PART_ROWS
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(max(-(-n // part), min(cores, -(-n * 10 // part)), 1), *keys)


def kept(df: DataFrame, label: str) -> DataFrame:
    """``df`` written as Parquet below ``spark.checkpoint.dir`` and read again: what follows starts from these rows.

    Without that setting a folder of this machine serves where all runs in one process.
    """
    spark = df.sparkSession
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="clausework-")
        spark.conf.set("spark.checkpoint.dir", root)
    path = f"{root.rstrip('/')}/clausework/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
