"""Streams: alerts reviewed as they arrive, the audit trail as it grows, counts by minute."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener
from pyspark.sql.streaming.query import StreamingQuery


def files(spark: SparkSession, path: str, schema: str, fmt: str = "json", per_trigger: int | None = None) -> DataFrame:
    """A stream of the files that land in a folder; malformed JSON lines are left out."""
    reader = spark.readStream.schema(schema).format(fmt)
    if per_trigger:
        reader = reader.option("maxFilesPerTrigger", per_trigger)
    return (reader.option("mode", "DROPMALFORMED") if fmt == "json" else reader).load(path)


def review(alerts: DataFrame, pipeline: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """Run ``pipeline``, the same as for a batch, on every micro-batch and append its result. A batch that is run again writes under its number, so results come once."""

    def each(batch: DataFrame, number: int) -> None:
        pipeline(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return alerts.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def per_minute(events: DataFrame, ts: str, kind: str, late: str = "10 minutes") -> DataFrame:
    """(minute, kind, n): an extension of our own: events by minute, with a watermark for late ones."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, "1 minute").alias("w"), kind).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("minute"), kind, "n")


class Progress(StreamingQueryListener):
    """Tells ``callback`` of starts, batches and ends as (kind, facts); what the callback raises is kept in ``errors`` and never stops the stream."""

    def __init__(self, callback: Callable[[str, dict], None]):
        self._callback, self.errors = callback, []

    def _tell(self, kind: str, **facts) -> None:
        try:
            self._callback(kind, facts)
        except Exception as e:
            self.errors.append(e)

    def onQueryStarted(self, event) -> None:  # noqa: N802
        self._tell("started", id=str(event.id), name=event.name)

    def onQueryProgress(self, event) -> None:  # noqa: N802
        self._tell("batch", batch=event.progress.batchId, rows=event.progress.numInputRows)

    def onQueryIdle(self, event) -> None:  # noqa: N802
        self._tell("idle", id=str(event.id))

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        self._tell("ended", id=str(event.id), error=event.exception)
