"""The pipeline's steps on streams: select, filter and stream-static joins work unchanged; these add event time."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from millrace.functions.text import qcol


def window_group(df: DataFrame, at: str, width: str, aggregates: Sequence[Column], keys: Sequence[str] = (), slide: str | None = None, late: str | None = None) -> DataFrame:
    """Aggregates over tumbling (or, with ``slide``, overlapping) windows of event time ``at``.

    ``late`` is how long rows may be late on a stream before their window is closed and its state
    dropped; on a batch it changes nothing.  Rows with a null time fall in no window.
    """
    if late is not None and df.isStreaming:
        df = df.withWatermark(at, late)
    span = F.window(qcol(at), width, slide) if slide else F.window(qcol(at), width)
    out = df.groupBy(span.alias("_w"), *[qcol(k) for k in keys]).agg(*aggregates)
    return out.select(F.col("_w.start").alias("window_start"), F.col("_w.end").alias("window_end"), *[c for c in out.columns if c != "_w"])


def session_group(df: DataFrame, at: str, gap: str, aggregates: Sequence[Column], keys: Sequence[str], late: str | None = None) -> DataFrame:
    """Aggregates over sessions: rows of one key that follow each other within ``gap``."""
    if late is not None and df.isStreaming:
        df = df.withWatermark(at, late)
    out = df.groupBy(F.session_window(qcol(at), gap).alias("_w"), *[qcol(k) for k in keys]).agg(*aggregates)
    return out.select(F.col("_w.start").alias("session_start"), F.col("_w.end").alias("session_end"), *[c for c in out.columns if c != "_w"])


def run_once(df: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Processes what a stream holds now, batch by batch through ``write``, and stops; resumes from ``checkpoint``."""
    query = df.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
