"""Sources and sinks (S1-S6): tables in, audit results out, through Spark's own readers
and writers (any Hadoop file system path: local, HDFS, S3A, ABFS, GCS)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# FIXED VALUES: strings pandas' CSV reader treats as missing by default (subset used here).
DEFAULT_NULL_TOKENS = ("", "NA", "N/A", "NaN", "nan", "null", "NULL", "None", "#N/A", "n/a", "-NaN", "-nan")


def normalize_missing(df: DataFrame, null_tokens: Sequence[str] = DEFAULT_NULL_TOKENS) -> DataFrame:
    """NaN -> NULL for floating columns and missing-value tokens -> NULL for strings."""
    out = []
    tokens = list(null_tokens)
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            out.append(F.when(F.isnan(c), F.lit(None)).otherwise(c).cast(f.dataType).alias(f.name))
        elif isinstance(f.dataType, T.StringType) and tokens:
            out.append(F.when(F.trim(c).isin(tokens), F.lit(None)).otherwise(c).alias(f.name))
        else:
            out.append(c)
    return df.select(*out)


def read_table(spark: SparkSession, path: str, fmt: str = "csv", schema: T.StructType | str | None = None,
               null_tokens: Sequence[str] | None = DEFAULT_NULL_TOKENS, infer_schema: bool = True,
               options: dict | None = None) -> DataFrame:
    """Read a table (csv with header, parquet, json, orc) from any supported path.

    CSV: an explicit ``schema`` avoids the inference pass over the data; with inference,
    missing-value tokens are mapped to NULL *before* typing (columns are read as strings,
    cleaned, then typed by one probing aggregate).  Other formats: NaN -> NULL only.
    """
    opts = dict(options or {})
    reader = spark.read.options(**opts)
    if fmt == "csv":
        reader = reader.option("header", True)
        if schema is not None:
            df = reader.schema(schema).csv(path)
            return normalize_missing(df, null_tokens or ())
        raw = reader.option("inferSchema", False).csv(path)
        clean = normalize_missing(raw, null_tokens or ())
        if not infer_schema:
            return clean
        return _infer_types(clean)
    if schema is not None:
        reader = reader.schema(schema)
    df = reader.format(fmt).load(path)
    return normalize_missing(df, ())


INTEGER_FORM = r"^[+-]?[0-9]{1,19}$"
NUMBER_FORM = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
BOOLEAN_FORM = r"^(?i)(true|false)$"
DATE_FORM = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"
TIME_FORM = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[ T][0-9]{2}:[0-9]{2}(:[0-9]{2}(\.[0-9]+)?)?(Z|[+-][0-9]{2}:[0-9]{2})?$"


def _infer_types(df: DataFrame) -> DataFrame:
    """Type string columns where every non-NULL value has the written form of the type.

    In order: int, bigint, double, boolean, date, timestamp; else string.  One aggregate finds the
    widest form per column.  A number must be written as one (``12D`` and ``34F`` stay strings).
    """
    probes = []
    for i, c in enumerate(df.columns):
        col = F.trim(F.col(f"`{c}`"))
        form = (F.when(col.rlike(INTEGER_FORM) & col.try_cast("int").isNotNull(), 1)
                .when(col.rlike(INTEGER_FORM) & col.try_cast("long").isNotNull(), 2)
                .when(col.rlike(NUMBER_FORM), 3)
                .when(col.rlike(BOOLEAN_FORM), 4)
                .when(col.rlike(DATE_FORM) & col.try_cast("date").isNotNull(), 8)
                .when(col.rlike(TIME_FORM) & col.try_cast("timestamp").isNotNull(), 16).otherwise(32))
        # numbers widen among themselves, dates to timestamps; any other mixture is a string
        bits = F.when(form <= 3, F.lit(0)).otherwise(form)
        probes += [F.max(F.when(col.isNotNull() & (form <= 3), form)).alias(f"n{i}"),
                   F.bit_or(F.when(col.isNotNull(), bits)).alias(f"b{i}")]
    r = df.agg(*probes).first()
    out = []
    for i, c in enumerate(df.columns):
        col, number, other = F.col(f"`{c}`"), r[f"n{i}"], r[f"b{i}"] or 0
        kind = None
        if number is not None and other == 0:
            kind = {1: "int", 2: "long", 3: "double"}[number]
        elif number is None:
            kind = {4: "boolean", 8: "date", 16: "timestamp", 24: "timestamp"}.get(other)
        out.append(F.trim(col).cast(kind).alias(c) if kind else col)
    return df.select(*out)


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite",
                run_id: str | None = None, partition_by: Sequence[str] = ()) -> None:
    """Write a table (csv with header, no index; parquet; json).  ``run_id`` adds a
    ``run_id`` column and partitions by it, the distributed form of a timestamped upload."""
    out = df if run_id is None else df.withColumn("run_id", F.lit(run_id))
    parts = list(partition_by) + (["run_id"] if run_id is not None else [])
    w = out.write.mode(mode)
    if parts:
        w = w.partitionBy(*parts)
    if fmt == "csv":
        # microseconds are kept: the default text form of a timestamp ends at milliseconds
        w.option("header", True).option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").option(
            "timestampNTZFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").csv(path)
    else:
        w.format(fmt).save(path)


def list_datasets(spark: SparkSession, path: str, glob: str = "*.csv", recursive: bool = False) -> DataFrame:
    """Stored files under ``path`` matching ``glob``: name, size and modification time.

    Uses the binaryFile source with only metadata columns selected, so file contents are
    never read (column pruning)."""
    r = spark.read.format("binaryFile").option("pathGlobFilter", glob)
    if recursive:
        r = r.option("recursiveFileLookup", True)
    df = r.load(path)
    return df.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("size"),
                     F.col("modificationTime").alias("last_modified"), "path")


def write_report(report: DataFrame, path: str, fmt: str = "text", mode: str = "overwrite") -> None:
    """Write a report (one string column) as text, or any findings table as json."""
    if fmt == "text":
        report.coalesce(1).write.mode(mode).text(path)  # a report is one document (bounded size)
    else:
        report.write.mode(mode).format(fmt).save(path)
