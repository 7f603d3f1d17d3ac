"""k-nearest neighbours without all-pairs joins.

``knn_graph`` is the search for large tables.  Rows are dealt into cells of bounded size by the signs
of random projections, several times with other directions (a forest of random-projection cells); a
cell that is still too large is cut at quantiles of one more projection, then by a hash (copies of
one vector).  Each cell is searched in one vectorised block, the neighbours of all cells are ranked by
exact distance, and in refinement rounds the rows that name a common neighbour are tried with
one another.  Work is rows x cells x cell size: it grows in proportion to the table.  A group that fits one
cell is searched whole, so small groups are exact.

``exact_knn`` is the exact way.  For any unit vector u, |u.x - u.y| <= ||x - y||, so every true
neighbour of x within its k-th neighbour distance d_k lies in the band |p(y) - p(x)| <= d_k of the
projection p = u.x.  d_k is bounded by the distances that ``knn_graph`` found; a join on projection
buckets inside the band does the rest.  Work per row grows with the density of points in its band, which
is what any exact method must inspect.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.common import bounded_broadcast
from ..functions.ranges import quantile_splits, with_buckets

CELL_ROWS = 256
TREES = 8
REFINE = 1
SLAB = 1 << 21  # doubles held at a time in a cell's search
GROUP_BROADCAST = 100_000
CUTS = 64  # quantile cuts of an oversized cell
CELL_KEYS = ["_g", "_tree", "_code", "_cut", "_salt"]


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def sq_dist(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda acc, x: acc + x)


def principal_direction(df: DataFrame, vec: str) -> list[float]:
    """Unit first principal direction of an array<double> column (d x d covariance on Spark ML)."""
    v = df.select(array_to_vector(F.col(vec)).alias("_v"))
    pc = PCA(k=1, inputCol="_v", outputCol="_p").fit(v).pc.toArray()[:, 0]
    norm = math.sqrt(float((pc * pc).sum())) or 1.0
    return [float(x) / norm for x in pc]


def _nearest_in_cell(ids: pa.Array, x: np.ndarray, k: int) -> pa.Table:
    """(_id, _nid, dist): up to k nearest other rows of every row of one cell (repeated ids once)."""
    order = pc.sort_indices(ids).to_numpy()
    ids, x = ids.take(pa.array(order)), x[order]  # ties go to the smaller id
    n, d = x.shape
    k = min(k, n - 1)
    if k < 1:
        return pa.table({"_id": ids.slice(0, 0), "_nid": ids.slice(0, 0), "dist": pa.array([], pa.float64())})
    step = max(1, SLAB // max(1, n * d))
    best, near = np.empty((n, k)), np.empty((n, k), np.int64)
    for lo in range(0, n, step):
        dist = ((x[lo:lo + step, None, :] - x[None, :, :]) ** 2).sum(-1)
        dist[np.arange(len(dist)), np.arange(lo, lo + len(dist))] = np.inf  # not its own neighbour
        near[lo:lo + step] = np.argsort(dist, axis=1, kind="stable")[:, :k]
        best[lo:lo + step] = np.take_along_axis(dist, near[lo:lo + step], 1)
    return pa.table({"_id": ids.take(pa.array(np.repeat(np.arange(n), k))), "_nid": ids.take(pa.array(near.ravel())), "dist": np.sqrt(best.ravel())})


def _search_cells(cells: DataFrame, keys: list[str], k: int, id_type: str) -> DataFrame:
    """(_id, _nid, dist) of all cells; ``cells`` holds the keys, _id and _x."""
    def search(table: pa.Table) -> pa.Table:
        ids, x = table["_id"].combine_chunks(), table["_x"].combine_chunks()
        if not len(ids):
            return _nearest_in_cell(ids, np.zeros((0, 1)), k)
        return _nearest_in_cell(ids, x.flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1), k)

    return cells.select(*keys, "_id", "_x").groupBy(*keys).applyInArrow(
        lambda table: search(table), f"_id {id_type}, _nid {id_type}, dist double")


def _top(found: DataFrame, k: int) -> DataFrame:
    """The k nearest distinct neighbours of every row, with ranks; ties by neighbour id."""
    once = found.groupBy("_id", "_nid").agg(F.min("dist").alias("dist"))
    rank = F.row_number().over(Window.partitionBy("_id").orderBy("dist", "_nid"))
    return once.withColumn("rank", rank).where(F.col("rank") <= k)


def projection_cells(base: DataFrame, cell_rows: int, trees: int, seed: int) -> tuple[DataFrame, bool]:
    """((_g, _tree, _code, _cut, _salt, _id, _x), whether any group was parted): every row once in each tree of its group,
    cells of about ``cell_rows`` rows.

    A group of n rows takes ceil(log2(n / cell_rows)) signs of its centred projections; a group of one cell
    is in one tree only.  Cells over twice the size are cut at quantiles of a further projection, and what a
    quantile cannot part (equal vectors) by a hash of the id.
    """
    sizes = base.groupBy("_g").agg(F.count(F.lit(1)).alias("_n"))
    shape = base.select(F.max(F.size("_x")).alias("d")).first(), sizes.agg(F.max("_n").alias("n")).first()
    dim = shape[0]["d"] or 1
    if (shape[1]["n"] or 0) <= cell_rows:
        return base.select("_g", *[F.lit(0).alias(c) for c in CELL_KEYS[1:]], "_id", "_x"), False
    means = base.select("_g", F.posexplode("_x").alias("_at", "_v")).groupBy("_g", "_at").agg(F.avg("_v").alias("_m"))
    means = means.groupBy("_g").agg(F.sort_array(F.collect_list(F.struct("_at", "_m"))).alias("_mean"))
    bits = F.greatest(F.lit(0), F.ceil(F.log2(F.col("_n") / F.lit(float(cell_rows))))).cast("int")
    groups = sizes.join(means, "_g").select("_g", F.transform("_mean", lambda m: m["_m"]).alias("_mean"), bits.alias("_bits")).checkpoint(eager=True)
    most = groups.agg(F.max("_bits")).first()[0] or 0
    rows = base.join(bounded_broadcast(groups, GROUP_BROADCAST), "_g")
    directions = np.random.default_rng(seed).standard_normal((trees, most + 1, dim))

    def project(x: pa.Array, mean: pa.Array, n_bits: pa.Array) -> pa.Array:
        centred = x.flatten().to_numpy(zero_copy_only=False).reshape(len(x), -1) - mean.flatten().to_numpy(zero_copy_only=False).reshape(len(x), -1)
        take = n_bits.to_numpy()[:, None] > np.arange(most)
        trees_, codes, last = [], [], []
        for t in range(trees):
            p = centred @ directions[t].T
            codes.append(((p[:, :most] > 0) & take) @ (1 << np.arange(most, dtype=np.int64)))
            last.append(p[:, most])
            trees_.append(np.full(len(x), t, np.int32))
        flat = [np.stack(c, 1).ravel() for c in (trees_, codes, last)]
        items = pa.StructArray.from_arrays([pa.array(f) for f in flat], names=["_tree", "_code", "_p"])
        return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * trees), items)

    coded = F.arrow_udf(project, "array<struct<_tree:int,_code:bigint,_p:double>>")("_x", "_mean", "_bits")
    dealt = rows.select("_g", "_id", "_x", "_bits", F.inline(coded)).where((F.col("_tree") == 0) | (F.col("_bits") > 0))
    keys = ["_g", "_tree", "_code"]
    over = dealt.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 2 * cell_rows)
    marks = [i / CUTS for i in range(1, CUTS)]
    big = bounded_broadcast(over.checkpoint(eager=True), 1_000_000)
    cuts = dealt.join(big, keys).groupBy(*keys).agg(F.max("_n").alias("_n"), F.percentile_approx("_p", marks, 1000).alias("_q"))
    parts = F.least(F.lit(CUTS), F.ceil(F.col("_n") / cell_rows)).cast("int")
    chosen = F.transform(F.sequence(F.lit(1), parts - 1), lambda i: F.element_at("_q", F.floor(i * CUTS / parts).cast("int")))
    cuts = bounded_broadcast(cuts.select(*keys, chosen.alias("_q")).checkpoint(eager=True), 1_000_000)
    cut = dealt.join(cuts, keys, "left").withColumn("_cut", F.when(F.col("_q").isNull(), 0).otherwise(F.size(F.filter("_q", lambda q: q < F.col("_p")))))
    keys = [*keys, "_cut"]
    still = cut.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 2 * cell_rows).select(
        *keys, F.ceil(F.col("_n") / cell_rows).alias("_salts"))
    salted = cut.join(bounded_broadcast(still.checkpoint(eager=True), 1_000_000), keys, "left")
    salt = F.when(F.col("_salts").isNull(), 0).otherwise(F.pmod(F.xxhash64("_id", F.lit(seed)), F.col("_salts")))
    return salted.select(*keys, salt.cast("bigint").alias("_salt"), "_id", "_x"), True


def _base(df: DataFrame, id_col: str, vec: str, group: str | None) -> DataFrame:
    g = F.col(group) if group else F.lit(0)
    rows = df.select(F.col(id_col).alias("_id"), g.alias("_g"), F.transform(F.col(vec), lambda x: x.cast("double")).alias("_x"))
    return rows.where(F.col("_x").isNotNull() & F.col("_g").isNotNull())


def knn_graph(df: DataFrame, id_col: str, vec: str, k: int, group: str | None = None, cell_rows: int = CELL_ROWS,
              trees: int = TREES, refine: int = REFINE, seed: int = 7) -> DataFrame:
    """(id, nbr_id, dist, rank): k near other rows of each row (same ``group`` if given), ties by neighbour id.

    Distances are exact; a true neighbour may be missed if no tree puts the pair into one cell and no
    refinement meets it (groups up to ``cell_rows`` rows miss none).  Rows without a vector or group have no neighbours.
    """
    base = _base(df, id_col, vec, group).checkpoint(eager=True)  # read by several passes
    id_type = base.schema["_id"].dataType.simpleString()
    wide = max(k, 10) if refine else k  # refinement needs some neighbours to start from
    cells, parted = projection_cells(base, cell_rows, trees, seed)
    found = _top(_search_cells(cells, CELL_KEYS, wide, id_type), wide).checkpoint(eager=True)
    for turn in range(refine if parted else 0):
        edges = found.select("_id", "_nid").unionByName(found.select(F.col("_nid").alias("_id"), F.col("_id").alias("_nid"))).distinct()
        lists = edges.groupBy(F.col("_nid").alias("_hub")).agg(F.count(F.lit(1)).alias("_n"))
        # the rows around a hub, in blocks of bounded size
        blocks = F.pmod(F.xxhash64("_id", F.lit(turn)), F.ceil(F.col("_n") / F.lit(4 * wide))).alias("_block")
        around = edges.select(F.col("_nid").alias("_hub"), "_id").join(lists, "_hub").select("_hub", blocks, "_id").join(base.select("_id", "_x"), "_id")
        more = _search_cells(around, ["_hub", "_block"], wide, id_type)
        found = _top(found.select("_id", "_nid", "dist").unionByName(more), wide).checkpoint(eager=True)
    return found.where(F.col("rank") <= k).select(F.col("_id").alias(id_col), F.col("_nid").alias("nbr_id"), "dist", "rank")


def exact_knn(df: DataFrame, id_col: str, vec: str, k: int, group: str | None = None) -> DataFrame:
    """(id, nbr_id, dist, rank) for the k nearest other rows of each row (same ``group`` if
    given); ties broken by neighbour id.  ``vec`` is an array<double>/array<float> column."""
    base = _base(df, id_col, vec, group).checkpoint(eager=True)
    u = F.array(*[F.lit(x) for x in principal_direction(base.withColumnRenamed("_x", "v"), "v")])
    # projected rows feed several passes (bounds, spread, band join)
    proj = base.withColumn("_p", _dot(F.col("_x"), u)).checkpoint(eager=True)
    near = knn_graph(base, "_id", "_x", k, group="_g", refine=0).groupBy("_id").agg(F.max("dist").alias("_dk"), F.count(F.lit(1)).alias("_nc"))
    # a row with fewer than k others in its cells has a group of at most k rows: its band is the group
    pb = proj.join(near, "_id", "left").withColumn("_dk", F.when(F.col("_nc") >= k, F.col("_dk")).otherwise(F.lit(float("inf"))))
    spread = pb.agg(F.min("_p").alias("lo"), F.max("_p").alias("hi"),
                    F.percentile_approx(F.when(F.col("_dk") < float("inf"), F.col("_dk")), 0.5, 1000).alias("med")).first()
    lo, hi = float(spread["lo"] or 0.0), float(spread["hi"] or 0.0)
    width = float(spread["med"] or 0.0) or max((hi - lo) / 1000.0, 1e-9)
    nbk = int(math.floor((hi - lo) / width)) + 1
    bucket = lambda p: F.floor((p - F.lit(lo)) / F.lit(width)).cast("long")
    if spread["lo"] is None:
        return near.select(F.col("_id").alias(id_col), F.col("_id").alias("nbr_id"), F.col("_dk").alias("dist"), F.lit(0).alias("rank"))
    # small slack so floating rounding in the projection never drops a boundary neighbour
    pb = pb.withColumn("_band", F.least(F.col("_dk"), F.lit(hi - lo + 1.0)) * (1 + 1e-9) + 1e-12)
    dk = F.col("_band")
    q = pb.select("_id", "_g", "_p", "_x", "_dk", "_band",
                  F.explode(F.sequence(F.greatest(bucket(F.col("_p") - dk), F.lit(0).cast("long")),
                                       F.least(bucket(F.col("_p") + dk), F.lit(nbk).cast("long")))).alias("_b"))
    t = proj.select(F.col("_id").alias("_nid"), "_g", F.col("_p").alias("_np"), F.col("_x").alias("_nx"),
                    bucket(F.col("_p")).alias("_b"))
    j = q.join(t, ["_g", "_b"]).where((F.col("_nid") != F.col("_id")) & (F.abs(F.col("_np") - F.col("_p")) <= F.col("_band")))
    j = j.withColumn("dist", F.sqrt(sq_dist(F.col("_x"), F.col("_nx")))).where(
        F.col("dist") <= F.col("_dk") * (1 + 1e-9) + 1e-12)
    r = Window.partitionBy("_id").orderBy("dist", "_nid")
    out = j.select("_id", "_nid", "dist", F.row_number().over(r).alias("rank")).where(F.col("rank") <= k)
    return out.select(F.col("_id").alias(id_col), F.col("_nid").alias("nbr_id"), "dist", "rank")


def _bucket_range(a: Column, b: Column, nbk: int) -> Column:
    lo = F.greatest(a, F.lit(0).cast("long"))
    hi = F.least(b, F.lit(nbk).cast("long"))
    return F.sequence(lo, F.greatest(lo, hi))


def bipartite_knn(queries: DataFrame, points: DataFrame, k: int, chunk_rows: int = 50000) -> DataFrame:
    """Exact k nearest points for every query, within groups.

    Inputs carry ``_qid``/``_pid``, ``_g`` (group), ``_x`` (array<double>), ``_s2`` (a squared
    scale, constant per group: distance = sqrt(_s2 * |x - y|^2)) and ``_p`` - the scaled
    projection sqrt(_s2) * u.x on a unit vector u that is the same for every row of a group.
    Returns (_qid, _g, _pid, dist, rank).  Same bound as ``exact_knn``: a per-query radius
    from the 2k points nearest in projection order (found by insertion rank, an
    equi-join), then an equi-join on projection buckets limited to that band.
    """
    # both sides feed several passes (count, splits, ranks, bounds, band join): cut their
    # lineage once (reliable checkpoint) rather than re-deriving them from the source each time
    q = queries.select("_qid", "_g", "_x", "_p", "_s2").checkpoint(eager=True)
    pts = points.select("_pid", "_g", "_x", "_p").checkpoint(eager=True)
    n = pts.count()
    nchunks = max(1, n // chunk_rows)
    splits = quantile_splits(pts, {"_p": F.col("_p")}, nchunks)
    pts = with_buckets(pts, {"_p": F.col("_p")}, splits, {"_p": "_c"})
    q = with_buckets(q, {"_p": F.col("_p")}, splits, {"_p": "_c"})
    # insertion rank of each query among the points of its (group, chunk)
    both = (pts.select("_g", "_c", "_p", F.col("_pid").cast("string").alias("_key"), F.lit(1).alias("_isp"))
               .unionByName(q.select("_g", "_c", "_p", F.col("_qid").cast("string").alias("_key"), F.lit(0).alias("_isp"))))
    w = Window.partitionBy("_g", "_c").orderBy("_p", F.desc("_isp"), "_key").rowsBetween(Window.unboundedPreceding, 0)
    ranked = both.withColumn("_r", F.sum("_isp").over(w))
    prank = ranked.where(F.col("_isp") == 1).select("_g", "_c", F.col("_key").alias("_pkey"), "_r")
    qrank = ranked.where(F.col("_isp") == 0).select("_g", "_c", F.col("_key").alias("_qkey"), "_r")
    kk = 2 * k
    qc = qrank.select("_g", "_c", "_qkey", F.explode(F.sequence(F.col("_r") - kk + 1, F.col("_r") + kk)).alias("_r"))
    cand_ids = qc.join(prank, ["_g", "_c", "_r"]).select("_g", "_qkey", "_pkey")
    qx = q.select(F.col("_qid").cast("string").alias("_qkey"), "_qid", "_g", F.col("_x").alias("_qx"), F.col("_p").alias("_qp"),
                  "_s2")
    px = pts.select(F.col("_pid").cast("string").alias("_pkey"), "_pid", "_g", "_x", "_p")
    cand = cand_ids.join(qx, ["_g", "_qkey"]).join(px, ["_g", "_pkey"])
    cand = cand.withColumn("_d", F.sqrt(F.col("_s2") * sq_dist(F.col("_qx"), F.col("_x"))))
    rk = Window.partitionBy("_g", "_qid").orderBy("_d", "_pid")
    bound = (cand.withColumn("_k", F.row_number().over(rk)).where(F.col("_k") <= k)
                 .groupBy("_g", "_qid").agg(F.max("_d").alias("_dk"), F.count("*").alias("_nc")))
    qb = q.join(bound, ["_g", "_qid"], "left").withColumn(
        "_dk", F.when(F.col("_nc") >= k, F.col("_dk")).otherwise(F.lit(float("inf"))))
    spread = pts.agg(F.min("_p").alias("lo"), F.max("_p").alias("hi")).first()
    if spread["lo"] is None:
        return queries.sparkSession.createDataFrame([], "_qid string, _g string, _pid string, dist double, rank int")
    med = qb.agg(F.percentile_approx(F.when(F.col("_dk") < float("inf"), F.col("_dk")), 0.5, 1000)).first()[0]
    lo, hi = float(spread["lo"]), float(spread["hi"])
    width = float(med or 0.0) or max((hi - lo) / 1000.0, 1e-9)
    nbk = int(math.floor((hi - lo) / width)) + 1
    bucket = lambda p: F.floor((p - F.lit(lo)) / F.lit(width)).cast("long")
    band = F.least(F.col("_dk"), F.lit(hi - lo + 1.0) + F.abs(F.col("_p") - F.lit(lo))) * (1 + 1e-9) + 1e-12
    qb = qb.withColumn("_band", band)
    qe = qb.select("_qid", "_g", F.col("_x").alias("_qx"), F.col("_p").alias("_qp"), "_dk", "_band", "_s2",
                   F.explode(_bucket_range(bucket(F.col("_p") - F.col("_band")), bucket(F.col("_p") + F.col("_band")),
                                           nbk)).alias("_b"))
    pe = pts.select("_pid", "_g", "_x", "_p", bucket(F.col("_p")).alias("_b"))
    j = qe.join(pe, ["_g", "_b"]).where(F.abs(F.col("_p") - F.col("_qp")) <= F.col("_band"))
    j = j.withColumn("dist", F.sqrt(F.col("_s2") * sq_dist(F.col("_qx"), F.col("_x")))).where(
        F.col("dist") <= F.col("_dk") * (1 + 1e-9) + 1e-12)
    r = Window.partitionBy("_g", "_qid").orderBy("dist", "_pid")
    return j.select("_qid", "_g", "_pid", "dist", F.row_number().over(r).alias("rank")).where(F.col("rank") <= k)
