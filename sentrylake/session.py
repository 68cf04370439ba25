"""What a job needs of its session: the folder that executors share, tables written there, and this package's code on executors."""

from __future__ import annotations

import contextlib
import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder where all executors can write: under spark.checkpoint.dir; a local one only where that is unset."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = tempfile.mkdtemp(prefix="sentrylake-")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """df written as Parquet in the shared folder and read again, so that it is worked out once and outlives any executor; by: a column that parts the files."""
    folder = shared_folder(df.sparkSession, name)
    out = df.write.option("compression", "zstd")
    (out.partitionBy(by) if by else out).parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


@contextlib.contextmanager
def batches_of(spark: SparkSession, rows: int):
    """Rows that Python gets at once in what runs meanwhile, at most."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, min(rows, int(before)) if int(before) > 0 else rows)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def ship(spark: SparkSession) -> None:
    """Send this package's code to the executors, once for each application: they may not have it."""
    sc = spark.sparkContext
    if getattr(sc, "_sentrylake_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="sentrylake-"), "sentrylake_code.zip")
    with zipfile.ZipFile(path, "w") as z:
        for base, _, names in os.walk(root):
            for n in names:
                if n.endswith(".py"):
                    full = os.path.join(base, n)
                    z.write(full, os.path.join(os.path.basename(root), os.path.relpath(full, root)))
    sc.addPyFile(path)
    sc._sentrylake_shipped = True
