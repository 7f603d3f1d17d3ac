"""Fairness monitoring over a stream of decisions.

The same group-count aggregation as the batch operators (``fairness.group_counts``),
keyed by an event-time window.  The query runs in complete mode: its state is one row of counts
per (window, attribute, group), every micro-batch summarises all windows as of then, and the
latest batch holds the answer.  So no window waits for a later event to be final, the last one is
never missing, and every row counts in whatever order the files come.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.common import stack_columns
from ..operators import fairness as fa


def windowed_group_counts(stream: DataFrame, ts: str, y: str, pred: str, sensitive: Sequence[str],
                          window: str = "1 day", watermark: str | None = None) -> DataFrame:
    """Per (window, feature, group) confusion counts of a decision stream.

    A watermark only matters to a caller that appends finished windows: rows later than it are lost.
    """
    timed = stream.withWatermark(ts, watermark) if watermark else stream
    long = (timed.select(F.window(ts, window).alias("window"), F.col(y).cast("int").alias("_y"),
                          F.col(pred).cast("int").alias("_p"), F.inline(stack_columns(list(sensitive), "string", "feature", "grp")))
                  .where(F.col("grp").isNotNull()))
    return long.groupBy("window", "feature", "grp").agg(
        F.count("*").alias("n"),
        F.count_if((F.col("_y") == 1) & (F.col("_p") == 1)).alias("tp"),
        F.count_if((F.col("_y") == 0) & (F.col("_p") == 1)).alias("fp"),
        F.count_if((F.col("_y") == 0) & (F.col("_p") == 0)).alias("tn"),
        F.count_if((F.col("_y") == 1) & (F.col("_p") == 0)).alias("fn"),
        F.sum("_p").alias("n_pred_pos"), F.count("_p").alias("n_pred"))


def window_summaries(counts: DataFrame) -> DataFrame:
    """Fairness summary per (window, feature) from finalised window counts (batch frame)."""
    c = counts.withColumn("window_start", F.col("window.start")).drop("window")
    return fa.bias_report(fa.fairness_summary(c, by=["window_start"]), by=["window_start"])


def start_monitor(stream: DataFrame, ts: str, y: str, pred: str, sensitive: Sequence[str],
                  sink: Callable[[DataFrame, int], None], checkpoint: str, window: str = "1 day",
                  watermark: str | None = None, trigger: dict | None = None):
    """Start the streaming query; ``sink(summary_df, epoch_id)`` receives after each batch the summaries
    of all windows so far, so the latest epoch replaces the earlier ones (and a batch repeated after
    a failure its own).  ``checkpoint`` must be a shared, fault-tolerant path on a cluster."""
    counts = windowed_group_counts(stream, ts, y, pred, sensitive, window, watermark)

    def each(batch: DataFrame, epoch: int) -> None:
        sink(window_summaries(batch), epoch)

    w = counts.writeStream.outputMode("complete").option("checkpointLocation", checkpoint).foreachBatch(each)
    if trigger:
        w = w.trigger(**trigger)
    return w.start()
