"""Column-expression helpers shared by the operators (all JVM-side, codegen friendly)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERIC_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


def named(name: str) -> Column:
    """Column by its exact name (dots and backticks in the name are no syntax)."""
    return F.col("`" + name.replace("`", "``") + "`")


def is_numeric(dt: T.DataType) -> bool:
    return isinstance(dt, NUMERIC_TYPES)


def is_string(dt: T.DataType) -> bool:
    return isinstance(dt, (T.StringType, T.VarcharType, T.CharType))



def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if is_string(f.dataType)]


def dtype_name(dt: T.DataType) -> str:
    return dt.simpleString()


def safe_div(num: Column, den: Column, default: float | None = 0.0) -> Column:
    """num/den as double; ``default`` when the denominator is 0 or NULL (ANSI-safe)."""
    den_d = den.cast("double")
    out = F.when(den_d.isNull() | (den_d == 0), F.lit(default).cast("double")).otherwise(
        num.cast("double") / F.nullif(den_d, F.lit(0.0))
    )
    return out



def stack_columns(cols: Sequence[str], value_type: str = "string", name_col: str = "feature",
                  value_col: str = "value") -> Column:
    """Array of (name, value) structs; ``F.inline`` of it unpivots many columns in one pass."""
    return F.array(*[
        F.struct(F.lit(c).alias(name_col), named(c).cast(value_type).alias(value_col)) for c in cols
    ])


def unpivot(df: DataFrame, cols: Sequence[str], keep: Sequence[str] = (), value_type: str = "string",
            name_col: str = "feature", value_col: str = "value") -> DataFrame:
    """Long form (keep..., feature, value): a narrow (no-shuffle) Generate over each row."""
    return df.select(*keep, F.inline(stack_columns(cols, value_type, name_col, value_col)))


def round_doubles(df: DataFrame, places: int = 6) -> DataFrame:
    """Round every floating column (used only at the comparison boundary of the query catalog)."""
    out = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            out.append(F.round(F.col(f.name).cast("double"), places).alias(f.name))
        else:
            out.append(F.col(f.name))
    return df.select(*out)


def bounded_broadcast(df: DataFrame, max_rows: int) -> DataFrame:
    """Broadcast hint only after proving the side has at most ``max_rows`` rows.

    The check is a ``limit(max_rows + 1).count()`` (stops early); beyond the bound the
    frame is returned unhinted and the planner / AQE choose a shuffle join.
    """
    n = df.limit(max_rows + 1).count()
    return F.broadcast(df) if n <= max_rows else df


# Largest side a known-size broadcast may have (rows); beyond it joins are left to the planner.
BROADCAST_ROWS = 1_000_000


def broadcast_if(df: DataFrame, known_rows: int, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast hint when the side's row count is known (from its construction: chunks x
    columns, classes, leaves) and within ``max_rows``; otherwise no hint."""
    return F.broadcast(df) if known_rows <= max_rows else df



# Aggregates per HashAggregate: keeps generated code under the JVM method-size limit.
AGG_CHUNK = 64


def long_aggregate(df: DataFrame, named: dict[str, Column], value_type: str = "long",
                   chunk: int = AGG_CHUNK) -> DataFrame:
    """Evaluate many global aggregates as (name, value) rows, ``chunk`` per aggregate
    (each chunk scans only the columns it needs), all in one job."""
    items = list(named.items())
    parts = []
    for start in range(0, len(items), chunk):
        part = items[start:start + chunk]
        wide = df.agg(*[e.alias(f"a{i}") for i, (_, e) in enumerate(part)])
        parts.append(wide.select(F.inline(F.array(*[
            F.struct(F.lit(n).alias("name"), F.col(f"a{i}").cast(value_type).alias("value"))
            for i, (n, _) in enumerate(part)]))))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def materialize(df: DataFrame) -> DataFrame:
    """Compute a small, repeatedly used result once.

    Checkpoints into the session's checkpoint directory (shared storage on a cluster, so it
    survives executor loss); without one, falls back to an eager ``persist``.  Meant for
    tables of schema size (one row per column / group / cell), not for row data.
    """
    if df.sparkSession.sparkContext.getCheckpointDir():
        return df.checkpoint(eager=True)
    out = df.persist()
    out.count()
    return out
