"""Ingestion as a stream: files in micro-batches, each upserted; a run may stop and start again at any point."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.sinks import current, upsert


def ingest(spark: SparkSession, source: str, schema, target: str, checkpoint: str, key: str = "id", order: str = "indexed_at", files_per_batch: int = 64) -> DataFrame | None:
    """All files of ``source`` that were not yet ingested, into ``target``; returns the table.

    The checkpoint remembers the files; a batch that is run again after a failure upserts the same rows again, which
    changes nothing.
    """
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)

    def batch(df: DataFrame, _: int) -> None:
        if not df.isEmpty():
            upsert(spark, target, df, key, order)

    q = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return current(spark, target)


def deduplicated(stream: DataFrame, key: str, time: str, delay: str = "1 day") -> DataFrame:
    """The stream without repeats of a key that arrive within ``delay``; the state is bounded by the watermark."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])
