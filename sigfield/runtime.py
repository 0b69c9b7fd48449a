"""Session helpers: where shared files go, and how the package reaches the executors."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh path below the folder that driver and executors share.

    The folder is the session's ``spark.checkpoint.dir``. Where that is unset and Spark runs in this one
    process (tests) a temporary folder is set as the checkpoint folder first; a cluster without one is an
    error, since its machines share no temporary folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        found = spark.sparkContext.getCheckpointDir()
        if found is None:
            if not re.fullmatch(r"local(\[[0-9*,]+\])?", spark.sparkContext.master):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="sigfield-"))
            found = spark.sparkContext.getCheckpointDir()
        base = found
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet below the shared folder and read it back: lineage ends here, and a
    lost executor costs nothing that was already computed."""
    spark = df.sparkSession
    path = shared_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` dealt by keys to all cores. Spark would join partitions of few bytes to one task, though steps upon runs make many
    rows of few bytes."""
    spark = df.sparkSession
    n = min(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    return df.repartition(max(1, n), *keys)


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per application, so that functions of its modules
    can be unpickled wherever their Python workers start."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    target = os.path.join(tempfile.mkdtemp(prefix="sigfield-py-"), "sigfield.zip")
    with zipfile.ZipFile(target, "w") as z:
        for folder, _, names in os.walk(root):
            for n in sorted(names):
                if n.endswith(".py"):
                    path = os.path.join(folder, n)
                    z.write(path, os.path.relpath(path, os.path.dirname(root)))
    spark.sparkContext.addPyFile(target)
    _SHIPPED.add(app)
