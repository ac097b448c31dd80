"""Screening of a stream of documents.

Chunking and layer 1 keep no state, so they run on a stream as they are; verdicts of a document are
aggregated inside the micro-batch that brought it, and written by ``foreachBatch``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from sievewright.plans.pipeline import ScreeningPipeline


def screen_stream(documents: DataFrame, pipeline: ScreeningPipeline, output: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Write document verdicts and findings of every micro-batch under ``output``.

    A batch that is run again after a failure overwrites its own folder, so results are exactly once.
    """

    def batch(documents: DataFrame, number: int) -> None:
        found = pipeline.analyze(documents)
        found.documents.write.mode("overwrite").parquet(f"{output}/documents/batch={number}")
        found.findings.write.mode("overwrite").parquet(f"{output}/findings/batch={number}")

    return documents.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def decide_stream(chunks: DataFrame, pipeline: ScreeningPipeline) -> DataFrame:
    """Layer-1 decisions of a streaming chunks table, as a streaming table."""
    return pipeline.layer1.decide(chunks)
