"""Structured Streaming: match arriving log lines against a template pool.

The pool is a static (batch) DataFrame; each micro-batch is masked, matched
with the same anchor join as the batch matcher (a stream-static join inside
``foreachBatch``), and lines without a template are counted per pattern so new
events can be mined later.  Exactly-once output comes from the sink's batch
id (``foreachBatch`` writes are keyed by ``batch_id``).
"""

from __future__ import annotations

from typing import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweave.operators import mining
from logweave.operators.pool import match_templates


def match_micro_batch(batch: DataFrame, pool: DataFrame, masks: Sequence[str]) -> DataFrame:
    """Template per line of one micro-batch (null when no pool template fits)."""
    lines = batch.select("dataset", "line_id", "content")
    matched = match_templates(lines, pool)
    masked = mining.masked_tokens(matched, masks)
    return masked.select("dataset", "line_id", "content", "template_id", "template_regex", "pattern")


def start_matcher(stream: DataFrame, pool: DataFrame, masks: Sequence[str],
                  sink: Callable[[DataFrame, int], None], checkpoint: str,
                  trigger: dict | None = None):
    """Start a streaming query that calls ``sink(result, batch_id)`` per micro-batch.

    ``checkpoint`` must be a shared folder (the query's progress and state).
    """
    def each(batch: DataFrame, batch_id: int) -> None:
        sink(match_micro_batch(batch, pool, masks), batch_id)

    w = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    if trigger:
        w = w.trigger(**trigger)
    return w.start()


def unmatched_pattern_counts(stream: DataFrame, masks: Sequence[str], watermark: str | None = None,
                             ts_col: str | None = None, window: str = "10 minutes") -> DataFrame:
    """Streaming counts of masked patterns per time window (for lines that a
    later batch job mines into new templates)."""
    m = mining.masked_tokens(stream, masks)
    if ts_col:
        if watermark:
            m = m.withWatermark(ts_col, watermark)
        return m.groupBy("dataset", F.window(ts_col, window), "pattern").agg(F.count(F.lit(1)).alias("n"))
    return m.groupBy("dataset", "pattern").agg(F.count(F.lit(1)).alias("n"))
