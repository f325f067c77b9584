"""Session helpers: tables by name, and a folder all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir.

    Where that setting is absent a folder of our own is made and set, but only if driver and executors are one process
    (tests, one machine); on a cluster that would be another disk on every machine, so it is refused.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    found = spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="solstrata-"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session may be gone; the folder is then the cluster's to clear
        pass


#: Folders of this session's intermediate tables, in the order they were made.
_made: list[tuple[SparkSession, str]] = []


def work_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted when Python ends or by release()."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


def release() -> None:
    """Delete all intermediate tables made so far; results that were not written yet can no longer be read."""
    while _made:
        _delete(*_made.pop())


atexit.register(release)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df once as a table in the shared folder and read it back.

    It cuts the lineage and survives the loss of executors. The table is deleted when Python ends, or by release().
    """
    spark = df.sparkSession
    path = work_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ship_package(spark: SparkSession) -> None:
    """Give this package to the executors' Python, once a session."""
    import os
    import zipfile

    sc = spark.sparkContext
    if getattr(sc, "_solstrata_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    name = os.path.join(tempfile.mkdtemp(prefix="solstrata-zip-"), "solstrata.zip")
    with zipfile.ZipFile(name, "w", zipfile.ZIP_DEFLATED) as out:
        for folder, _, files in os.walk(root):
            for f in files:
                if f.endswith(".py"):
                    path = os.path.join(folder, f)
                    out.write(path, os.path.join("solstrata", os.path.relpath(path, root)))
    sc.addPyFile(name)
    sc._solstrata_shipped = True
