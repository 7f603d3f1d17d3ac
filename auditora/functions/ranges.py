"""Deterministic range chunks for order-dependent and rank-based operators.

A chunk id must be a function of the data, not of the physical partition a row landed
in: a plan may evaluate a range exchange twice, and a re-sampled range partitioner can
draw different bounds.  Chunks here are buckets of an order key between approximate
quantile splits; the splits are computed once (one small aggregate, ``n`` values per
column on the driver) and applied with ``Bucketizer`` (JVM binary search per row).
Equal keys always share a chunk and chunk ids are monotone in the key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import named

INF = float("inf")


def key_as_double(dt: T.DataType, col: Column) -> Column | None:
    """Monotone (non-decreasing) mapping of an order key to double, or None if unsupported."""
    if isinstance(dt, (T.TimestampType, T.TimestampNTZType)):
        return F.unix_micros(col.cast("timestamp")).cast("double")
    if isinstance(dt, T.DateType):
        return F.unix_date(col).cast("double")
    if isinstance(dt, (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)):
        return col.cast("double")
    return None


def quantile_splits(df: DataFrame, exprs: dict[str, Column], n: int, accuracy: int | None = None) -> dict[str, list[float]]:
    """Strictly increasing Bucketizer splits (with +-inf ends) per named double expression.

    The sketch resolves ten positions to each range, however many ranges are asked for.
    """
    accuracy = accuracy or max(10_000, 10 * n)
    probs = [i / n for i in range(1, n)]
    if not probs:  # Bucketizer needs one inner split; any value keeps chunks monotone
        return {k: [-INF, 0.0, INF] for k in exprs}
    row = df.agg(*[F.percentile_approx(e, probs, accuracy).alias(k) for k, e in exprs.items()]).first()
    out = {}
    for k in exprs:
        vals = sorted({float(v) for v in (row[k] or []) if v is not None}) or [0.0]
        out[k] = [-INF, *vals, INF]
    return out


def with_buckets(df: DataFrame, exprs: dict[str, Column], splits: dict[str, list[float]],
                 out: dict[str, str]) -> DataFrame:
    """Add bucket columns ``out[k]`` for the double expressions ``exprs[k]``.

    NULL keys go to bucket -1 (NULLs sort first in ascending order).
    """
    tmp = {k: f"__kd_{i}" for i, k in enumerate(exprs)}
    staged = df.withColumns({tmp[k]: e for k, e in exprs.items()})
    bz = Bucketizer(splitsArray=[splits[k] for k in exprs], inputCols=[tmp[k] for k in exprs],
                    outputCols=[f"__b_{i}" for i in range(len(exprs))], handleInvalid="keep")
    b = bz.transform(staged)
    cols = {}
    for i, k in enumerate(exprs):
        cols[out[k]] = F.when(F.col(tmp[k]).isNull(), F.lit(-1)).otherwise(F.col(f"__b_{i}").cast("int"))
    return b.withColumns(cols).drop(*tmp.values(), *[f"__b_{i}" for i in range(len(exprs))])


def key_bounds(df: DataFrame, keys: Sequence[str], n: int) -> DataFrame:
    """One row with ``bounds``: least key of each of at most ``n`` ranges of the rows by all ``keys`` (any types, NULLs first).

    The ranges come from Spark's range exchange of the key columns alone; only their least keys are kept, once, so
    a later run of the plan cannot draw others.
    """
    rows = df.select(*[named(k).alias(f"k{i}") for i, k in enumerate(keys)])
    cols = [f"k{i}" for i in range(len(keys))]
    ranged = rows.repartitionByRange(n, *[F.asc_nulls_first(c) for c in cols])
    least = ranged.groupBy(F.spark_partition_id().alias("p")).agg(F.min(F.struct(*cols)).alias("m"))
    return least.agg(F.sort_array(F.collect_set("m")).alias("bounds")).checkpoint(eager=True)


def range_chunks(df: DataFrame, keys: Sequence[str], n: int, out: str = "_chunk") -> DataFrame:
    """Adds ``out``, the number of the range a row's keys fall into; monotone in the order of all keys, NULLs first."""
    bounds = key_bounds(df, keys, n)
    key = F.struct(*[named(k).alias(f"k{i}") for i, k in enumerate(keys)])
    steps = F.sequence(F.lit(1), F.lit(max(1, n).bit_length() + 1))
    held = df.withColumns({"_key": key, "_bounds": bounds.select("bounds").scalar()})

    def halve(s: Column, _: Column) -> Column:  # bounds below lo are at most the key, those from hi on are greater
        mid = F.floor((s["lo"] + s["hi"]) / 2).cast("int")
        open_, up = s["lo"] < s["hi"], F.get(F.col("_bounds"), mid) <= F.col("_key")
        return F.struct(F.when(open_ & up, mid + 1).otherwise(s["lo"]).alias("lo"), F.when(open_ & ~up, mid).otherwise(s["hi"]).alias("hi"))

    start = F.struct(F.lit(0).alias("lo"), F.size("_bounds").alias("hi"))
    return held.withColumn(out, F.aggregate(steps, start, halve)["lo"] - 1).drop("_key", "_bounds")


def order_chunks(df: DataFrame, order: Sequence[str], n: int, out: str = "_chunk") -> DataFrame:
    """Cuts rows into about ``n`` ranges of their order: quantiles of a single number or time, else ranges of all keys."""
    e = key_as_double(df.schema[order[0]].dataType, named(order[0])) if len(order) == 1 else None
    if e is None:
        return range_chunks(df, order, n, out)
    splits = quantile_splits(df, {order[0]: e}, n)
    return with_buckets(df, {order[0]: e}, splits, {order[0]: out})


# Rows one window partition should hold at most (ranked / filled inside one task).
ROWS_PER_CHUNK = 2_000_000


def default_chunks(df: DataFrame, rows_per_chunk: int = ROWS_PER_CHUNK) -> int:
    """Chunk count for order/rank work: at least the shuffle partitions, and enough that a
    chunk holds about ``rows_per_chunk`` rows (one row-count job)."""
    base = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    n = df.count()
    return max(base, -(-n // rows_per_chunk))


def per_column_buckets(df: DataFrame, cols: Sequence[str], n: int, prefix: str = "_b_") -> DataFrame:
    """Bucket several numeric columns at once (one splits aggregate, one Bucketizer)."""
    exprs = {c: F.col(c).cast("double") for c in cols}
    splits = quantile_splits(df, exprs, n)
    return with_buckets(df, exprs, splits, {c: f"{prefix}{c}" for c in cols})


def hash_rank(df: DataFrame, part: Sequence[str], keys: Sequence[str], seed: int, buckets: int | None = None,
              out: str = "_hrank", total: str = "_hn") -> DataFrame:
    """0-based rank of each row inside ``part`` in the order of a seeded hash of ``keys``
    (a deterministic random order), plus the partition size.

    Rows are dealt into hash buckets; per (part, bucket) counts give offsets (a table of
    parts x buckets rows) and a window ranks rows inside one bucket, so a huge partition
    is never ranked by a single task.
    """
    if buckets is None:
        buckets = max(64, -(-df.count() // ROWS_PER_CHUNK))
    h = F.xxhash64(*[F.col(k) for k in keys], F.lit(seed))
    base = df.withColumn("_hh", h).withColumn("_hb", F.pmod(F.col("_hh"), F.lit(buckets)))
    per = base.groupBy(*part, "_hb").agg(F.count("*").alias("_hc"))
    wb = Window.partitionBy(*part).orderBy("_hb")
    offs = per.select(*part, "_hb",
                      F.coalesce(F.sum("_hc").over(wb.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_ho"),
                      F.sum("_hc").over(Window.partitionBy(*part)).alias(total))
    # offsets: parts x buckets rows; broadcast only when there is no partition key and the
    # bucket count is small, else a shuffle join on (part, bucket)
    keys_ = [*part, "_hb"]
    offs = offs.select(*[F.col(c).alias(f"_o_{c}") for c in keys_], "_ho", total)
    same = [F.col(c).eqNullSafe(F.col(f"_o_{c}")) for c in keys_]  # NULL is a part like any other
    j = base.join(F.broadcast(offs) if not part and buckets <= 100_000 else offs, same).drop(*[f"_o_{c}" for c in keys_])
    wr = Window.partitionBy(*part, "_hb").orderBy("_hh", *keys)
    return j.withColumn(out, F.col("_ho") + F.row_number().over(wr) - 1).drop("_hh", "_hb", "_ho")
