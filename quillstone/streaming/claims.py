"""Claims that arrive as a stream: the store kept up to date batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import text as T
from ..sources.store import Store


def upsert_stream(claims: DataFrame, store: Store, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Writes a stream of claims (id, text, verdict, confidence, ics, now) into the store, a batch at a time. Replaying a batch after a
    failure gives the same rows, as they are replaced by id."""
    writer = claims.writeStream.foreachBatch(lambda batch, _: store.put_claims(batch)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def volatility_counts(claims: DataFrame, time: str = "ts", window: str = "1 hour", late: str = "1 day") -> DataFrame:
    """(window, volatility, n) of a stream or table of claims (ts, text), with a watermark for late rows."""
    return claims.withWatermark(time, late).groupBy(F.window(time, window), T.volatility(F.col("text")).alias("volatility")).agg(F.count("*").alias("n"))
