"""Source/sink round trips and the streaming monitor, as registered queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F


from ..session import ensure_checkpoint_dir, table
from ..sources import io
from ..streaming import monitor
from . import fixtures as fx
from . import q_fairness
from .catalog import register


def _scratch(spark, name: str) -> str:
    """A fresh folder under the session's checkpoint directory (shared storage on a cluster)."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@register("csv_round_trip", sql=f"""WITH src AS ({fx.GAPS_SQL})
SELECT count(*) AS rows, count(value) AS value_non_null, count(event_type) AS type_non_null,
       CAST(min(ts) AS TIMESTAMP) AS first_ts, CAST(max(ts) AS TIMESTAMP) AS last_ts,
       ROUND(sum(value), 6) AS value_sum FROM src""")
def csv_round_trip(spark, sf_dir):
    """Write the gap fixture as CSV under a run id, read it back with inferred types."""
    path = _scratch(spark, "csv")
    io.write_table(fx.gaps(spark, sf_dir), path, fmt="csv", run_id="r1")
    back = io.read_table(spark, f"{path}/run_id=r1", fmt="csv")
    return back.agg(F.count("*").alias("rows"), F.count("value").alias("value_non_null"),
                    F.count("event_type").alias("type_non_null"),
                    F.min(F.col("ts").cast("timestamp_ntz")).alias("first_ts"), F.max(F.col("ts").cast("timestamp_ntz")).alias("last_ts"), F.sum(F.col("value").cast("double")).alias("value_sum"))


@register("report_sink")
def report_sink(spark, sf_dir):
    """Write the privacy report of the documents/part audit as text and read it back as lines."""
    from ..operators import privacy as pv
    from ..operators import report as rp
    pii = pv.scan_pii(table(spark, sf_dir, "documents"))
    kan = pv.k_anonymity(table(spark, sf_dir, "part"), ["p_brand", "p_type", "p_size"])
    comp = pv.compliance_report(fx.numeric(spark, sf_dir), "GDPR")
    text = rp.lines_to_text(rp.privacy_report_lines(pii, kan, comp, pv.compliance_recommendations(comp)))
    path = _scratch(spark, "report")
    io.write_report(text, path)
    return spark.read.text(path).select(F.col("value").alias("line"))


@register("list_datasets")
def list_datasets(spark, sf_dir):
    """Parquet files of the input folder with their sizes (file contents never read)."""
    return io.list_datasets(spark, sf_dir, glob="*.parquet").select("name", "size")


_MONITOR_LONG = """d AS (
  SELECT make_timestamp(CAST(floor(epoch_us(CAST(o_orderdate AS TIMESTAMP)) / 2592000000000) AS BIGINT) * 2592000000000) AS window_start,
         c_mktsegment AS s1, o_orderpriority AS s2, CAST(o_orderstatus = 'F' AS INTEGER) AS y, CAST(o_totalprice > 250000 AS INTEGER) AS p
  FROM orders JOIN customer ON o_custkey = c_custkey),
lg AS (SELECT window_start, y, p, 's1' AS feature, s1 AS grp FROM d UNION ALL SELECT window_start, y, p, 's2', s2 FROM d)"""


def _by_window(cte: str) -> str:
    """The per-feature fairness SQL, per window and feature."""
    return cte.replace("SELECT feature,", "SELECT window_start, feature,").replace("GROUP BY feature", "GROUP BY window_start, feature")


@register("stream_fairness_monitor", sql=f"""
WITH {_MONITOR_LONG}, {_by_window(q_fairness._COUNTS)}, {q_fairness._ZERO}, {_by_window(q_fairness._SUMMARY)}
SELECT window_start, feature, ROUND(dp, 6) AS demographic_parity, ROUND(eo, 6) AS equalized_odds, {q_fairness._SEV} AS severity FROM s""")
def stream_fairness_monitor(spark, sf_dir):
    """Streaming: monthly fairness of order decisions from a file stream of orders.

    Orders are read as a stream (all files available now, one a batch), joined to the static
    customer dimension and aggregated per (30-day window, attribute, group); every batch writes the
    summaries of all windows so far, and those of the last batch are the answer.
    """
    orders_schema = table(spark, sf_dir, "orders").schema
    stream = (spark.readStream.schema(orders_schema).option("pathGlobFilter", "orders.parquet")
                   .option("maxFilesPerTrigger", 1).parquet(sf_dir))
    cust = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    dec = stream.join(cust, stream.o_custkey == cust.c_custkey).select(
        F.col("o_orderdate").cast("timestamp").alias("ts"), F.col("c_mktsegment").alias("s1"),
        F.col("o_orderpriority").alias("s2"), (F.col("o_orderstatus") == "F").cast("int").alias("y"),
        (F.col("o_totalprice") > 250000).cast("int").alias("p"))
    out = _scratch(spark, "monitor-out")

    def sink(batch, epoch):
        batch.write.mode("overwrite").parquet(f"{out}/epoch={epoch}")  # a repeated batch replaces its own

    q = monitor.start_monitor(dec, "ts", "y", "p", ["s1", "s2"], sink, _scratch(spark, "monitor-ckpt"),
                              window="30 days", trigger={"availableNow": True})
    q.awaitTermination()
    found = spark.read.parquet(out)
    found = found.where(F.col("epoch") == found.agg(F.max("epoch")).first()[0]).drop("epoch")
    return found.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))



