"""Findings of files as they arrive: a file stream whose batches are classified, scored and appended by scan."""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.risk import flag_harvestable, score
from ..policy import Policy


def arriving(spark: SparkSession, folder: str, schema: str, kind: str = "parquet", files_a_batch: int = 1000) -> DataFrame:
    """Rows of the files that appear in a folder, a bounded number of files a batch."""
    return spark.readStream.format(kind).schema(schema).option("maxFilesPerTrigger", files_a_batch).load(folder)


def store(findings: DataFrame, policy: Policy, out: str, checkpoint: str, now: bool = True) -> StreamingQuery:
    """Scores each micro-batch and writes it as partition ``scan_id = scan-<batch>``. A batch that runs again after a
    failure overwrites its own partition, so every finding is stored once."""

    def write(batch: DataFrame, number: int) -> None:
        scored = flag_harvestable(score(batch, policy), policy)
        scored.write.mode("overwrite").parquet(f"{out}/scan_id=scan-{number}")

    stream = findings.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (stream.trigger(availableNow=True) if now else stream).start()


def stored(spark: SparkSession, out: str, scan_id: str | None = None) -> DataFrame:
    found = spark.read.parquet(out)
    return found if scan_id is None else found.where(F.col("scan_id") == scan_id)


def windowed(events: DataFrame, late: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """Findings a window of event time and severity; late rows beyond the watermark are left out."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "severity").agg(F.count("*").alias("findings"))


