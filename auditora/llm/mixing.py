"""Mixing sources to target weights by Poisson replication (DataFrame expressions only).

Each source gets a mean repetition rate ``epochs * rows * weight share / rows of the source``;
a document's copy count is the inverse Poisson distribution at a uniform number hashed
from the seed and its key, so the draw needs no shuffle, no state, and gives the same copies
when a lost partition is computed again.  Copies are dealt to partitions by a hash of
(seed, key, copy) and sorted by it: a global shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.common import bounded_broadcast
from .common import default_parallelism, let, named, unused

# A rate above this is drawn as the sum of several Poisson numbers of at most this mean.
PART_MEAN = 64.0
# Largest rate table (rows = sources) that is broadcast; larger ones join on salted keys.
BROADCAST_SOURCES = 50_000
SALTS = 32
HASH_BITS = 48
TINY = 2.2250738585072014e-308  # least normal double


def hash_unit(*parts: Column | str) -> Column:
    """Uniform number in [0, 1) from the first 48 bits of the md5 of the joined parts."""
    joined = F.concat_ws(":", *[F.lit(p) if isinstance(p, str) else p for p in parts])
    return F.conv(F.substring(F.md5(joined), 1, HASH_BITS // 4), 16, 10).cast("bigint") / F.lit(float(1 << HASH_BITS))


def source_rates(docs: DataFrame, source: str, targets: DataFrame | None, epochs: float, temperature: float) -> DataFrame:
    """(src, n_rows, weight, rate, parts, cdf): one row per source, NULL being a source of its own.

    Without ``targets`` the weight of a source is rows ** temperature.  ``cdf`` is the cumulative
    Poisson distribution of mean rate / parts, long enough that no 48-bit number lies beyond it.
    """
    sizes = docs.groupBy(named(source).alias("src")).agg(F.count(F.lit(1)).alias("n_rows")).checkpoint(eager=True)  # read several times
    if targets is None:
        weighted = sizes.withColumn("weight", F.pow(F.col("n_rows").cast("double"), F.lit(float(temperature))))
    else:
        t = targets.select(named(targets.columns[0]).alias("t_src"), named(targets.columns[1]).cast("double").alias("w"))
        t = t.groupBy("t_src").agg(F.max("w").alias("w"))
        if not t.filter("w < 0 OR isnan(w) OR w = double('inf')").isEmpty():
            raise ValueError("target weights must be finite numbers from 0 on")
        weighted = sizes.join(t, F.col("src").eqNullSafe(F.col("t_src")), "left").select(
            "src", "n_rows", F.greatest(F.coalesce(F.col("w"), F.lit(0.0)), F.lit(0.0)).alias("weight"))
    # weights count by their ratios: relative to the largest, summed as decimals, so in any order alike
    weighted = weighted.withColumn("weight", F.col("weight") / F.greatest(weighted.agg(F.max("weight").alias("m")).select("m").scalar(), F.lit(TINY)))
    total = weighted.agg(F.sum(F.col("n_rows")).cast("double").alias("all_rows"),
                         F.sum(F.col("weight").cast("decimal(38,18)")).cast("double").alias("all_weight"))
    all_rows, all_weight = (total.select(c).scalar() for c in ("all_rows", "all_weight"))
    rate = F.when(all_weight > 0, F.lit(float(epochs)) * all_rows * F.col("weight") / all_weight / F.col("n_rows")).otherwise(F.lit(0.0))
    rated = weighted.select("src", "n_rows", "weight", rate.alias("rate"))
    rated = rated.withColumn("parts", F.greatest(F.lit(1), F.ceil(F.col("rate") / PART_MEAN)).cast("int"))
    mean = F.col("rate") / F.col("parts")
    steps = F.sequence(F.lit(1), (F.ceil(mean + 12 * F.sqrt(mean)) + 30).cast("int"))
    start = F.array(F.struct(F.exp(-mean).alias("p"), F.exp(-mean).alias("c")))

    def step(acc: Column, k: Column) -> Column:
        return let(F.element_at(acc, -1), lambda last: let(
            last["p"] * mean / k, lambda p: F.concat(acc, F.array(F.struct(p.alias("p"), (last["c"] + p).alias("c"))))))

    return rated.withColumn("cdf", F.transform(F.aggregate(steps, start, step), lambda s: s["c"]))


def poisson_count(cdf: Column, parts: Column, key: Column, seed: str) -> Column:
    """Sum over the parts of the number of cumulative probabilities at or below the part's hash."""
    def one(j: Column) -> Column:
        return let(hash_unit(seed, "n", j.cast("string"), key), lambda u: F.size(F.filter(cdf, lambda c: c <= u)))
    return F.aggregate(F.sequence(F.lit(1), parts), F.lit(0), lambda acc, j: acc + one(j))


def mix_sources(docs: DataFrame, targets: DataFrame | None = None, source: str = "source", key: str = "doc_id",
                text: str = "text", epochs: float = 1.0, temperature: float = 0.5, seed: str = "mix-1",
                copy_col: str | None = None, partitions: int | None = None) -> DataFrame:
    """Documents repeated so that sources appear in their target weights, in a globally shuffled order.

    ``targets`` is (source, weight); sources it lacks have weight 0.  All columns of ``docs`` are
    kept; ``copy_col`` adds the copy number from 1.  Defined cases: a NULL source is a source; a NULL
    key draws by the md5 of its text; rows of equal key (and equal NULL keys with equal text) draw
    the same count, and each is repeated; an empty table gives an empty table; no weight at all
    gives no rows; weights count by their ratios only, and negative, infinite or NaN ones are refused.
    """
    part_key = F.coalesce(named(key).cast("string"), F.concat(F.lit("~"), F.md5(F.coalesce(named(text).cast("string"), F.lit("")))))
    k, n, s = unused(docs, "_mix_key"), unused(docs, "_mix_copy"), unused(docs, "_mix_salt")
    keyed = docs.withColumn(k, part_key)
    rates = source_rates(docs, source, targets, epochs, temperature).select("src", "parts", "cdf")
    rates = rates.select(*[F.col(c).alias(unused(docs, "_mix_" + c)) for c in rates.columns])
    r_src, r_parts, r_cdf = rates.columns
    hinted = bounded_broadcast(rates, BROADCAST_SOURCES)
    on = named(source).eqNullSafe(F.col(r_src))
    if hinted is rates:  # too many sources to broadcast: spread each source over salted keys
        keyed = keyed.withColumn(s, F.pmod(F.xxhash64(F.col(k)), F.lit(SALTS)).cast("int"))
        other = unused(rates, "_mix_rsalt")
        hinted = rates.withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        on = on & (F.col(s) == F.col(other))
    counted = keyed.join(hinted, on).withColumn(n, poisson_count(F.col(r_cdf), F.col(r_parts), F.col(k), seed))
    copies = counted.filter(F.col(n) > 0).withColumn(n, F.explode(F.sequence(F.lit(1), F.col(n))))
    order = unused(docs, "_mix_order")
    dealt = copies.withColumn(order, F.xxhash64(F.md5(F.concat_ws(":", F.lit(seed), F.lit("o"), F.col(k), F.col(n).cast("string")))))
    count = partitions or default_parallelism(docs)
    keep = [named(c) for c in docs.columns] + ([F.col(n).alias(copy_col)] if copy_col else [])
    return dealt.repartition(count, F.col(order)).sortWithinPartitions(order, k).select(*keep)
