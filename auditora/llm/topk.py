"""Exact top-k inner products by a Voronoi nearest-neighbour join.

Inner products become distances with one more coordinate: data x -> (x, sqrt(M^2 - |x|^2)), query
q -> (q, 0), M the largest data norm; then |q - x|^2 = |q|^2 + M^2 - 2 q.x, so the highest products
are the least distances.  Data is assigned to the nearest of a bounded set of pivots; every cell is
summed up by its size, its least and largest distance to the pivot and its k + 1 least distances.
From the summaries each query has a bound on its k-th distance, and a data row goes to a group of queries
only if the triangle inequality leaves one of them in reach.  Groups of queries and blocks of
rows are of bounded size, so a cell with a third of all rows is many tasks; each task solves its
block exactly, and the partial answers are merged per query.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import named

MAX_PIVOTS = 256  # bound of the pivot table, which every task holds
QUERIES_PER_GROUP = 2048
ROWS_PER_BLOCK = 8192
OWN_ROWS = 64  # rows of one id that the distances kept of a cell allow for; more of them prune less
SLAB = 128  # queries scored at once in a task
BOUND_CELLS = 1 << 21  # numbers of a table of bounds held at a time
EXACT = float(1 << 53)
SLACK = 1e-7  # relative slack of the distance bounds, far above their rounding


def integer_vectors(rows: DataFrame, key: str, vector: str, scale: int, repeated: bool = False) -> DataFrame:
    """(id, v): floor(scale * x) of every usable vector; of a repeated id all rows, or the least vector only."""
    x = F.transform(named(vector), lambda c: F.floor(F.lit(float(scale)) * c.cast("double")))
    fine = F.forall(named(vector), lambda c: c.isNotNull() & ~F.isnan(c.cast("double"))
                    & (F.abs(c.cast("double")) < F.lit(float("inf"))))
    good = rows.filter(named(key).isNotNull() & named(vector).isNotNull() & F.coalesce(fine, F.lit(False)))
    vectors = good.select(named(key).cast("bigint").alias("id"), x.alias("v"))
    return vectors.repartition("id", "v") if repeated else vectors.groupBy("id").agg(F.min("v").alias("v"))


def _matrix(column, dim: int) -> np.ndarray:
    """List column -> rows x dim doubles, shorter vectors padded with zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    offsets = column.offsets.to_numpy()
    flat = column.values.to_numpy(zero_copy_only=False)
    n = np.diff(offsets)
    out = np.zeros((len(n), dim))
    at = np.arange(int(offsets[-1] - offsets[0]))
    row = np.repeat(np.arange(len(n)), n)
    out[row, at - np.repeat(np.concatenate(([0], np.cumsum(n)))[:-1], n)] = flat[offsets[0]:offsets[-1]]
    return out


class Geometry:
    """Pivots in the lifted space and distances to them."""

    def __init__(self, pivots: np.ndarray, top: float):
        self.top = top  # largest squared data norm
        self.pivots = self.lift(pivots)
        self.between = np.sqrt(np.maximum(self.squares(self.pivots), 0))

    def lift(self, x: np.ndarray) -> np.ndarray:
        return np.hstack([x, np.sqrt(np.maximum(self.top - (x * x).sum(axis=1), 0))[:, None]])

    def squares(self, x: np.ndarray) -> np.ndarray:
        p = self.pivots
        return (x * x).sum(axis=1)[:, None] + (p * p).sum(axis=1)[None] - 2 * x @ p.T

    def distances(self, x: np.ndarray, data: bool) -> np.ndarray:
        y = self.lift(x) if data else np.hstack([x, np.zeros((len(x), 1))])
        return np.sqrt(np.maximum(self.squares(y), 0))


def _assigner(geometry, dim: int, data: bool):
    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = geometry.value
        for b in batches:
            if not b.num_rows:
                continue
            x = _matrix(b.column(1), dim)
            d = g.distances(x, data)
            cell = d.argmin(axis=1)
            packed = pa.array([r.tobytes() for r in x.astype("<f8")], pa.binary())
            yield pa.record_batch([b.column(0), pa.array(cell.astype(np.int32)), pa.array(d[np.arange(len(x)), cell]), packed],
                                  names=["id", "cell", "dist", "v"])
    return assign


def _summariser(keep: int):
    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells: dict[int, list] = {}
        for b in batches:
            cell, dist = b.column(0).to_numpy(), b.column(1).to_numpy()
            for c in np.unique(cell):
                d = dist[cell == c]
                n, far, near = cells.get(int(c), (0, 0.0, np.zeros(0)))
                near = np.sort(np.concatenate((near, np.partition(d, min(keep, len(d)) - 1)[:keep])))[:keep]
                cells[int(c)] = (n + len(d), max(far, float(d.max())), near)
        yield pa.record_batch([pa.array(list(cells), pa.int32()), pa.array([v[0] for v in cells.values()], pa.int64()),
                               pa.array([v[1] for v in cells.values()], pa.float64()),
                               pa.array([v[2].tolist() for v in cells.values()], pa.list_(pa.float64()))],
                              names=["cell", "n", "far", "near"])
    return summarise


def _vectors(packed) -> np.ndarray:
    return np.frombuffer(b"".join(packed), "<f8").reshape(len(packed), -1) if len(packed) else np.zeros((0, 0))


def _bounds(geometry, summary: pd.DataFrame, k: int, own: int):
    """Adds to each query its k-th distance bound and, per data cell, the least distance to the
    pivot a row needs to matter (or none)."""
    cells, far = summary["cell"].to_numpy(), summary["far"].to_numpy()
    counts = [len(x) for x in summary["near"]]
    near = np.concatenate([np.asarray(x) for x in summary["near"]])
    owner = np.repeat(np.arange(len(cells)), counts)

    step = max(1, BOUND_CELLS // max(1, len(owner)))

    def reach(g: Geometry, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A few rows at a time: the table of bounds is rows x kept distances."""
        done = [some(g, x[lo:lo + step]) for lo in range(0, max(1, len(x)), step)]
        return np.concatenate([h for h, _ in done]), np.concatenate([n for _, n in done])

    def some(g: Geometry, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        d = g.distances(x, False)
        upper = d[:, cells][:, owner] + near[None]
        # of the nearest up to ``own`` rows may be of the query's own id
        want = k + own - 1
        theta = np.partition(upper, want, axis=1)[:, want] if upper.shape[1] > want else np.full(len(x), np.inf)
        theta = theta * (1 + SLACK) + SLACK
        need = d[:, cells] - theta[:, None] - SLACK * (1 + d[:, cells])
        home = d.argmin(axis=1)
        # rows of another cell lie beyond the plane between the two pivots
        gap = g.between[home][:, cells]
        plane = np.where(gap > 0, (d[:, cells] ** 2 - d[np.arange(len(x)), home][:, None] ** 2) / np.where(gap > 0, 2 * gap, 1), 0)
        out_of_reach = (need > far[None]) | (plane > theta[:, None] * (1 + SLACK) + SLACK)
        return home, np.where(out_of_reach, np.inf, need)
    return cells, reach


def _solve(k: int, exact: bool):
    def solve(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0, np.int64)})
        right = right.sort_values("id")
        x, ids = _vectors(right["v"].to_list()), right["id"].to_numpy()
        q, qids = _vectors(left["v"].to_list()), left["id"].to_numpy()
        if not exact:
            x, q = x.astype(np.int64), q.astype(np.int64)
        out = []
        for lo in range(0, len(q), SLAB):
            s = (q[lo:lo + SLAB] @ x.T).astype(np.int64)
            own = qids[lo:lo + SLAB][:, None] == ids[None]
            s[own] = np.iinfo(np.int64).min
            take = min(k, s.shape[1])
            # the take-th best score, then every row above it and the first of the ties, in id order
            kth = np.partition(s, s.shape[1] - take, axis=1)[:, s.shape[1] - take]
            above = s > kth[:, None]
            ties = s == kth[:, None]
            ties &= np.cumsum(ties, axis=1) <= (take - above.sum(axis=1))[:, None]
            r, c = np.nonzero((above | ties) & ~own)
            out.append(np.stack([qids[lo + r], ids[c], s[r, c]], axis=1))
        got = np.concatenate(out)
        return pd.DataFrame({"query_id": got[:, 0], "vec_id": got[:, 1], "score": got[:, 2]})
    return solve


def top_products(rows: DataFrame, queries: Column, key: str = "vec_id", vector: str = "embedding", k: int = 20,
                 scale: int = 64, max_pivots: int = MAX_PIVOTS, queries_per_group: int = QUERIES_PER_GROUP,
                 rows_per_block: int = ROWS_PER_BLOCK, repeated: bool = False) -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest inner products of every query, ties to smaller ids.

    ``queries`` is a condition on the integer column ``id``.  Candidates are all rows but those of the query's id.
    Defined cases: rows with a NULL id, a NULL vector or a NULL or non-finite component take no part;
    shorter vectors count as padded with zeros; of a repeated id the least vector counts, or with
    ``repeated`` every row, as candidate and as query (its products are ranked together); fewer than
    k candidates give them all; no usable rows or no queries give no rows.  Products are exact
    while they stay below 2^63 (below 2^53 in floating point, else in 64-bit integers).
    """
    spark = rows.sparkSession
    base = integer_vectors(rows, key, vector, scale, repeated).checkpoint(eager=True)
    norm = F.aggregate("v", F.lit(0.0), lambda a, c: a + c.cast("double") * c.cast("double"))
    stats = base.agg(F.count(F.lit(1)).alias("n"), F.max(norm).alias("top"), F.max(F.size("v")).alias("dim")).first()
    n, top, dim = stats["n"], stats["top"] or 0.0, max(1, stats["dim"] or 1)
    schema = "query_id bigint, rank int, vec_id bigint, score bigint"
    if not n:
        return spark.createDataFrame([], schema)
    wanted = min(max_pivots, max(1, int(round(n ** 0.5))))
    picks = base.orderBy(F.xxhash64("id"), "id").limit(wanted).collect()
    pivots = np.zeros((len(picks), dim))
    for i, r in enumerate(picks):
        pivots[i, :len(r["v"])] = r["v"]
    same = base.groupBy("id").count().agg(F.max("count")).first()[0] if repeated else 1
    near = k + min(same, OWN_ROWS)  # distances kept of a cell
    geometry = spark.sparkContext.broadcast(Geometry(np.unique(pivots, axis=0), top))
    kind = "id bigint, cell int, dist double, v binary"
    data = base.mapInArrow(_assigner(geometry, dim, True), kind)
    asked = base.filter(queries).mapInArrow(_assigner(geometry, dim, False), kind)
    partial = data.select("cell", "dist").mapInArrow(_summariser(near), "cell int, n bigint, far double, near array<double>")
    summary = partial.groupBy("cell").agg(F.sum("n").alias("n"), F.max("far").alias("far"),
                                          F.slice(F.sort_array(F.flatten(F.collect_list("near"))), 1, near).alias("near"))
    summary = summary.orderBy("cell").toPandas()  # at most max_pivots rows
    per_cell = {r["cell"]: r["n"] for r in asked.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not per_cell:
        return spark.createDataFrame([], schema)
    group_of = _grouped(per_cell, geometry.value, queries_per_group)
    cells, reach = _bounds(geometry, summary, k, same)
    blocks = max(1, -(-n // rows_per_block))

    def place(batches):  # query -> its group; cells with many queries are several groups
        for b in batches:
            ids = b.column(0).to_numpy()
            g = np.array([group_of[c][0] + (i % group_of[c][1]) for c, i in zip(b.column(1).to_pylist(), ids.tolist())], np.int32)
            yield pa.record_batch([b.column(0), pa.array(g), b.column(3)], names=["id", "grp", "v"])

    placed = asked.mapInArrow(place, "id bigint, grp int, v binary")

    def least(batches):  # per group and data cell: the least distance to the pivot that matters
        best: dict[int, np.ndarray] = {}
        for b in batches:
            g = b.column(1).to_numpy()
            _, need = reach(geometry.value, _vectors(b.column(2).to_pylist()))
            for one in np.unique(g):
                low = need[g == one].min(axis=0)
                best[int(one)] = np.minimum(best[int(one)], low) if int(one) in best else low
        for one, low in best.items():
            hit = np.flatnonzero(low < np.inf)
            yield pa.record_batch([pa.array(np.full(len(hit), one, np.int32)), pa.array(cells[hit].astype(np.int32)),
                                   pa.array(low[hit])], names=["grp", "cell", "need"])

    needs = placed.mapInArrow(least, "grp int, cell int, need double").groupBy("grp", "cell").agg(F.min("need").alias("need"))
    # a row goes to each group that has a query in reach of it
    sent = data.join(needs, "cell").filter(F.col("dist") >= F.col("need"))
    sent = sent.select("grp", F.pmod(F.xxhash64("id", "v"), F.lit(blocks)).cast("int").alias("blk"), "id", "v")
    spread = placed.withColumn("blk", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).select("grp", "blk", "id", "v")
    exact = top < EXACT
    found = spread.groupBy("grp", "blk").cogroup(sent.groupBy("grp", "blk")).applyInPandas(
        _solve(k, exact), "query_id bigint, vec_id bigint, score bigint")
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select(
        "query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _grouped(per_cell: dict[int, int], g: Geometry, most: int) -> dict[int, tuple[int, int]]:
    """cell -> (first group, number of groups): near cells share a group, crowded cells have several."""
    out, group, held = {}, 0, 0
    left, at = dict(per_cell), min(per_cell)
    while left:
        size = left.pop(at)
        if size >= most:
            parts = -(-size // most)
            group += 1 if held else 0
            out[at] = (group, parts)
            group, held = group + parts, 0
        else:
            if held + size > most:
                group, held = group + 1, 0
            out[at] = (group, 1)
            held += size
        if left:
            rest = np.array(list(left))
            at = int(rest[g.between[at][rest].argmin()])
    return out
