"""Scans of files as they arrive: each micro-batch is scanned, findings are appended, and files already seen are left out.

Files are known by path and content hash. State is a watermark-free key set in Spark's state store, so it is spread over
executors and survives their loss through the query's checkpoint.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from solstrata.operators import detectors
from solstrata.operators.findings import fingerprints
from solstrata.operators.structure import Corpus


def stream_sources(spark: SparkSession, folder: str, suffix: str = ".sol") -> DataFrame:
    """Streaming (path, source, file_hash) of files put into a folder."""
    df = spark.readStream.format("text").option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", f"*{suffix}").schema("value string").load(folder)
    return df.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("source"), F.sha2("value", 256).alias("file_hash"))


def scan_stream(sources: DataFrame, out: str, checkpoint: str, names: list[str] | None = None, each: Callable[[DataFrame], DataFrame] = lambda df: df, once: bool = True) -> StreamingQuery:
    """Scan every new (path, content); findings go to the Parquet folder `out`. `once` takes what is there and stops."""
    fresh = sources.dropDuplicates(["path", "file_hash"])

    def scan(batch: DataFrame, batch_id: int) -> None:
        found = each(fingerprints(detectors.scan(Corpus(batch.select("path", "source")), names)))
        # one folder per batch, replaced as a whole, so a batch that is run again leaves no second copy
        found.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    writer = fresh.writeStream.foreachBatch(scan).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
