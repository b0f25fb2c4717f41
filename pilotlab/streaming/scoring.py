"""Scoring of incoming requests as a stream whose batches are written exactly once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans.segment_model import SegmentModel, read_requests, split_requests


def request_stream(spark: SparkSession, folder: str, files_per_trigger: int = 1_000) -> DataFrame:
    """One JSON request per line of the text files that arrive in ``folder``."""
    return spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(folder)


def batch_writer(model: SegmentModel, output: str, body: str = "value") -> Callable[[DataFrame, int], None]:
    """Writes one batch of requests: results to ``output/scored/batch=<id>``, rejects to ``output/rejected/batch=<id>``.

    The batch is read and parsed once for both. Its folders are replaced, so a batch that is run again
    after a failure, with the same id and the same requests, leaves the same rows as one run.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        read = read_requests(batch, body, model.required).persist()
        try:
            good, bad = split_requests(read, batch.columns)
            for rows, name in ((model.score(good), "scored"), (bad, "rejected")):
                rows.write.mode("overwrite").parquet(f"{output}/{name}/batch={batch_id}")
        finally:
            read.unpersist()

    return write


def start_scoring(requests: DataFrame, model: SegmentModel, output: str, checkpoints: str, body: str = "value") -> StreamingQuery:
    """Scores what is available and stops. One query reads the source once and writes results and rejects."""
    return (
        requests.writeStream.foreachBatch(batch_writer(model, output, body))
        .option("checkpointLocation", checkpoints).trigger(availableNow=True).start()
    )


def scored(spark: SparkSession, output: str, name: str = "scored") -> DataFrame:
    """All results (or ``rejected`` requests) written so far."""
    return spark.read.parquet(f"{output}/{name}").withColumn("batch", F.col("batch").cast("bigint"))
