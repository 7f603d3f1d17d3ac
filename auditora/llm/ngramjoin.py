"""N-gram Jaccard self-join by prefixes under several global token orders.

Two sets of Jaccard similarity t or more share a token among the first n - ceil(t n) + 1 of each,
under any order of all tokens.  Three orders are used: each puts tokens that are common in the
corpus last (a sketch of fixed size, counted over all documents) and breaks ties by a hash of
its own.  Candidates come from an equi-join on the first order's prefixes, must share a prefix token
under the second and the third order as well, and only then are their whole sets fetched and compared.

What is wanted is the components, so links inside one component need no test: documents of
equal sets are one node; of every shared token first one hub, the document of the commonest tokens,
is tested against the others, in crowded tokens then several hubs, and at last all pairs of nodes that
are still in different components.  No pair that could join two components goes untested.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.common import bounded_broadcast
from .common import named, scratch_folder, settled, unused
from .components import components
from .textnum import buffers, mix, small_batches, word_hashes

SKETCH_BITS = 22
LEVEL_BLOCK = 14  # bits of a block of the sketch that is packed into one row
LOCAL_MIN = 2  # a token is reported to the sketch if this many texts of a batch group hold it
FLUSH = 3_000_000
SHARED = 4  # prefix tokens two linked sets must share (prefixes are longer by one less)
HOT_LEVEL = 12  # tokens of this level (about 4096 texts) or more may be crowded
HUBS = 8
HUB_ROUNDS = 1
CROWDED = 16  # pairs per row of the shared tokens from which another hub round pays
FETCH_BROADCAST = 1_000_000
BLOCK_ROWS = 500  # rows of one token that meet its others in one task


def shingle_sets(column, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct 64-bit shingle hashes of every text, set size per text)."""
    words, counts, _ = word_hashes(*buffers(column))
    starts = np.concatenate(([0], np.cumsum(counts)))
    n_full = np.maximum(counts - width + 1, 0)
    out_at = np.concatenate(([0], np.cumsum(np.where(counts == 0, 0, np.maximum(n_full, 1)))))
    out = np.empty(int(out_at[-1]), np.uint64)
    if len(words) >= width:
        m = len(words) - width + 1
        acc = np.zeros(m, np.uint64)
        for j in range(width):
            acc = (acc ^ words[j:j + m]) * np.uint64(0x9E3779B97F4A7C15 + 2 * j) + np.uint64(j + 1)
            acc ^= acc >> np.uint64(29)
        acc = mix(acc, 11)
    sizes = np.zeros(len(counts), np.int64)
    for i, c in enumerate(counts):
        lo, hi = out_at[i], out_at[i + 1]
        if c == 0:
            continue
        if c >= width:
            out[lo:hi] = acc[starts[i]:starts[i] + c - width + 1]
            out[lo:hi].sort()
        else:  # the whole short sequence is one shingle
            h = np.uint64(c)
            for w in words[starts[i]:starts[i] + c]:
                h = mix(np.array([h ^ w]), 12)[0]
            out[lo] = h
    keep = np.ones(len(out), bool)
    keep[1:] = out[1:] != out[:-1]
    firsts = out_at[:-1][out_at[:-1] < len(out)]
    keep[firsts] = True
    total = np.concatenate(([0], np.cumsum(keep)))
    sizes = total[out_at[1:]] - total[out_at[:-1]]
    return out[keep], sizes


def prefix_length(n: np.ndarray | int, percent: int):
    """Size of the prefix two sets of at least ``percent`` / 100 similarity must share a token of."""
    return n - (percent * n + 99) // 100 + 1


def slots(h: np.ndarray) -> np.ndarray:
    return (mix(h, 31) & np.uint64((1 << SKETCH_BITS) - 1)).astype(np.int64)


def _counter(width: int):
    """mapInArrow: texts -> (slot, texts) of tokens that several texts of a batch group hold."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def report(held):
            tokens, n = np.unique(np.concatenate(held), return_counts=True)
            s, c = slots(tokens[n >= LOCAL_MIN]), n[n >= LOCAL_MIN]
            u, at = np.unique(s, return_inverse=True)
            return pa.record_batch([pa.array(u.astype(np.int32)), pa.array(np.bincount(at, c, len(u)).astype(np.int64))], names=["slot", "n"])
        held, size = [], 0
        for b in small_batches(batches, 0):
            tokens, _ = shingle_sets(b.column(0), width)
            held.append(tokens)
            size += len(tokens)
            if size >= FLUSH:
                yield report(held)
                held, size = [], 0
        if size:
            yield report(held)
    return count


def commonness(texts: DataFrame, width: int) -> np.ndarray:
    """Level (binary logarithm of the count) of every slot of the sketch: 4 MB whatever the corpus."""
    counted = texts.mapInArrow(_counter(width), "slot int, n bigint").groupBy("slot").agg(F.sum("n").alias("n"))
    levels = counted.select(F.shiftright("slot", LEVEL_BLOCK).alias("block"), F.col("slot").bitwiseAND(F.lit((1 << LEVEL_BLOCK) - 1)).alias("at"),
                            F.least(F.lit(60), F.floor(F.log2(F.col("n") + 1))).cast("int").alias("level"))

    def pack(pdf):
        row = np.zeros(1 << LEVEL_BLOCK, np.uint8)
        row[pdf["at"].to_numpy()] = pdf["level"].to_numpy()
        return pdf[["block"]].iloc[:1].assign(levels=[row.tobytes()])

    out = np.zeros(1 << SKETCH_BITS, np.uint8)
    for r in levels.groupBy("block").applyInPandas(pack, "block int, levels binary").collect():
        out[r["block"] << LEVEL_BLOCK:(r["block"] + 1) << LEVEL_BLOCK] = np.frombuffer(r["levels"], np.uint8)
    return out


def _halves(tokens: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit fingerprints of every set: wrapped sums of differently mixed tokens."""
    out = []
    for salt in (41, 42):
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(tokens, salt), dtype=np.uint64)))
        out.append(mix(sums[at[1:]] - sums[at[:-1]], salt + 2))
    return out[0], out[1]


def node_ids(tokens: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """64-bit name of every set (equal for equal sets)."""
    at = np.concatenate(([0], np.cumsum(sizes)))
    a, b = _halves(tokens, at)
    return mix(a ^ (b * np.uint64(0x9E3779B97F4A7C15)) ^ sizes.astype(np.uint64), 45).view(np.int64)


SIGNATURE = "key {key}, th bigint, n bigint, node bigint, info bigint, cool array<bigint>, hot array<bigint>"


def order_keys(tokens: np.ndarray, levels: np.ndarray, order: int) -> np.ndarray:
    """Sort keys of a global order: rarer levels first, then the order's own hash."""
    return (levels[slots(tokens)].astype(np.uint64) << np.uint64(57)) | (mix(tokens, 51 + order) >> np.uint64(7))


def _signer(held, width: int, percent: int):
    """mapInArrow: (key, text hash, text) -> signature rows; a set seen before in the task has no prefix.

    ``cool`` and ``hot`` are the prefix under the first order, extended by ``SHARED`` - 1 tokens, split at
    the level from which a token's documents may not fit one task; ``info`` is size and mean level.
    """
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in small_batches(batches, 2):
            tokens, sizes = shingle_sets(batch.column(2), width)
            at = np.concatenate(([0], np.cumsum(sizes)))
            nodes = node_ids(tokens, sizes)
            level = held.value[slots(tokens)]
            keys = order_keys(tokens, held.value, 0)
            summed = np.concatenate(([0], np.cumsum(level.astype(np.int64))))
            typ = np.minimum((summed[at[1:]] - summed[at[:-1]]) * 64 // np.maximum(sizes, 1), 65535)
            chosen = []
            for i, n in enumerate(sizes.tolist()):
                node, lo = int(nodes[i]), int(at[i])
                if n == 0 or node in seen:
                    chosen.append(np.zeros(0, np.int64))
                    continue
                seen.add(node)
                p = prefix_length(n, percent) + SHARED - 1
                chosen.append(lo + (np.argpartition(keys[lo:lo + n], p - 1)[:p] if p < n else np.arange(n)))
            owner = np.repeat(np.arange(len(sizes)), [len(c) for c in chosen])
            flat = np.concatenate(chosen) if chosen else np.zeros(0, np.int64)
            crowded = level[flat] >= HOT_LEVEL

            def listed(pick):
                cuts = np.concatenate(([0], np.cumsum(np.bincount(owner[pick], minlength=len(sizes))))).astype(np.int32)
                return pa.ListArray.from_arrays(pa.array(cuts), pa.array(tokens[flat[pick]].view(np.int64)))

            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(sizes.astype(np.int64)), pa.array(nodes, mask=sizes == 0),
                                   pa.array((sizes.astype(np.int64) << 16) | typ), listed(~crowded), listed(crowded)],
                                  names=["key", "th", "n", "node", "info", "cool", "hot"])
    return sign


def _set_maker(held, width: int, percent: int):
    """mapInArrow: texts -> (node, whole set, its prefixes under the second and the third order)."""
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 0):
            tokens, sizes = shingle_sets(batch.column(0), width)
            at = np.concatenate(([0], np.cumsum(sizes)))
            cols = [[tokens[x:y].tobytes() for x, y in zip(at[:-1], at[1:])], [], []]
            for order in (1, 2):
                keys = order_keys(tokens, held.value, order)
                for x, y in zip(at[:-1], at[1:]):
                    k = prefix_length(int(y - x), percent)
                    part = tokens[x:y] if k >= y - x else tokens[x:y][np.argpartition(keys[x:y], k - 1)[:k]]
                    cols[order].append(part.tobytes())
            yield pa.record_batch([pa.array(node_ids(tokens, sizes)), *[pa.array(c, pa.binary()) for c in cols]],
                                  names=["node", "tokens", "second", "third"])
    return make


def common_tokens(p: np.ndarray, q: np.ndarray) -> int:
    both = np.concatenate((p, q))
    both.sort(kind="stable")
    return int((both[1:] == both[:-1]).sum())


def _meeting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow: pairs with their prefixes -> the pairs that share a token under both orders."""
    for batch in batches:
        ok = [all(common_tokens(np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64)) for p, q in ((x2, y2), (x3, y3)))
              for x2, y2, x3, y3 in zip(*[batch.column(c).to_pylist() for c in range(2, 6)])]
        yield pa.record_batch([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))


def _verifier(percent: int):
    """mapInArrow: pairs with their whole sets -> the pairs that are similar enough."""
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                shared = common_tokens(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64))
                ok.append(100 * shared >= percent * ((len(x) + len(y)) // 8 - shared))
            yield pa.record_batch([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))
    return verify


class Join:
    """State of one self-join: signatures, shared prefix tokens and the components found so far."""

    def __init__(self, docs: DataFrame, key: str, text: str, width: int, percent: int):
        self.spark, self.width, self.percent = docs.sparkSession, width, percent
        body = F.coalesce(named(text).cast("string"), F.lit(""))
        self.levels = self.spark.sparkContext.broadcast(commonness(docs.select(body.alias("text")), width))
        self.docs = docs.select(named(key).alias("key"), F.xxhash64(body).alias("th"), body.alias("text"))
        schema = SIGNATURE.format(key=self.docs.schema["key"].dataType.simpleString())
        folder = scratch_folder(self.spark, "signatures")
        self.docs.mapInArrow(_signer(self.levels, width, percent), schema).write.parquet(folder)
        self.rows = self.spark.read.parquet(folder)

    def in_size(self, n: str, other: str):
        return F.least(F.col(n), F.col(other)) * 100 >= F.greatest(F.col(n), F.col(other)) * self.percent

    def beyond(self, n: str):
        """Tokens of a set outside its prefix."""
        return F.greatest(F.lit(0), F.floor((F.col(n) * self.percent + 99) / 100) - SHARED)

    def needed(self, n: str):
        """Least number of prefix tokens in which a set meets any similar one."""
        return F.least(F.lit(SHARED), F.floor((F.col(n) * self.percent + 99) / 100))

    def meetings(self, n: str, other: str):
        """Least number of prefix tokens in which two similar sets of these sizes meet.

        The set whose prefix ends earlier in the order has in the other set, of its prefix, only the
        tokens in which they meet; the rest of it lies beyond the prefix.
        """
        both = F.floor(((F.col(n) + F.col(other)) * self.percent + 99 + self.percent) / (100 + self.percent))
        return F.greatest(F.lit(1), both - F.greatest(self.beyond(n), self.beyond(other)))

    def shared_tokens(self) -> DataFrame:
        """(token, node, n, typ): prefix tokens that several nodes hold, a row per node.

        Nodes with fewer of them than any link needs are left out.
        One exchange by token; tokens that may be crowded are found by a partial aggregation and a join
        instead, so that no task has to hold all rows of one of them.
        """
        def long(column: str) -> DataFrame:
            return self.rows.select("node", "info", F.explode(column).alias("token"))

        same = Window.partitionBy("token")
        cool = long("cool").withColumn("x", F.min("node").over(same)).withColumn("y", F.max("node").over(same)).filter("x <> y")
        hot = long("hot")
        several = hot.groupBy("token").agg(F.min("node").alias("x"), F.max("node").alias("y")).filter("x <> y").select("token")
        found = cool.select("token", "node", "info").dropDuplicates(["token", "node"]).unionByName(
            hot.join(several, "token").select("token", "node", "info").dropDuplicates(["token", "node"]))
        found = found.checkpoint(eager=True)  # few of the exploded rows; both uses below would repeat their exchange
        n = F.shiftright("info", 16)
        met = found.groupBy("node").agg(F.count(F.lit(1)).alias("s"))
        rows = found.join(met, "node").select("token", "node", n.alias("n"), F.col("info").bitwiseAND(F.lit(65535)).cast("int").alias("typ"), "s")
        return rows.filter(F.col("s") >= self.needed("n")).drop("s").checkpoint(eager=True)

    def verified(self, pairs: DataFrame) -> DataFrame:
        """(a, b) of the candidate pairs whose whole sets are similar enough; sets are made from the texts again."""
        pairs = settled(pairs)
        wanted = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        first = self.rows.filter(F.size("cool") + F.size("hot") > 0).select("node", "th", "key")
        first = first.join(bounded_broadcast(wanted, FETCH_BROADCAST), "node", "left_semi")
        first = first.groupBy("node").agg(F.min(F.struct("th", "key")).alias("m")).select(F.col("m.th").alias("w_th"), F.col("m.key").alias("w_key"))
        texts = self.docs.join(bounded_broadcast(first, FETCH_BROADCAST), (F.col("th") == F.col("w_th")) & F.col("key").eqNullSafe(F.col("w_key")), "left_semi")
        folder = scratch_folder(self.spark, "sets")
        texts.select("text").mapInArrow(_set_maker(self.levels, self.width, self.percent),
                                        "node bigint, tokens binary, second binary, third binary").write.parquet(folder)
        sets = self.spark.read.parquet(folder)

        def with_sets(some: DataFrame, columns: tuple[str, ...]) -> DataFrame:
            for name in ("a", "b"):
                some = some.join(sets.select(F.col("node").alias(name), *[F.col(c).alias(f"{name}_{c}") for c in columns]), name)
            return some.select("a", "b", *[f"{name}_{c}" for c in columns for name in ("a", "b")])

        # short prefixes go to the pairs first; whole sets only to the pairs that all three orders leave
        near = settled(with_sets(pairs, ("second", "third")).mapInArrow(_meeting, "a bigint, b bigint"))
        return with_sets(near, ("tokens",)).mapInArrow(_verifier(self.percent), "a bigint, b bigint")

    def mixed(self, shared: DataFrame, comp: DataFrame) -> DataFrame:
        """Rows of the tokens whose nodes are of several components, with the component and the token's rows (df)."""
        labelled = shared.join(bounded_broadcast(comp, FETCH_BROADCAST), "node", "left").withColumn("comp", F.coalesce("comp", "node"))
        several = labelled.groupBy("token").agg(F.min("comp").alias("x"), F.max("comp").alias("y"), F.count(F.lit(1)).alias("df")).filter("x <> y")
        return labelled.join(several.select("token", "df"), "token").checkpoint(eager=True)

    def hub_pairs(self, rows: DataFrame, hubs: DataFrame) -> DataFrame:
        """Pairs of a token's hub and its other nodes that meet in several tokens."""
        met = rows.join(hubs, "token").filter((F.col("hub.node") != F.col("node")) & (F.col("hub.comp") != F.col("comp")))
        met = met.select(F.col("hub.node").alias("a"), F.col("hub.n").alias("an"), F.col("node").alias("b"), F.col("n").alias("bn"))
        met = met.filter(self.in_size("an", "bn")).groupBy("a", "b").agg(F.count(F.lit(1)).alias("c"))
        return met.filter("c > 1").select("a", "b")

    def components(self) -> DataFrame:
        """(node, comp) of all nodes that have links.

        The hub rounds only join components early; the last step tests every pair of nodes that are
        still apart and meet in as many prefix tokens as a link needs.
        """
        shared = self.shared_tokens()
        hub = shared.groupBy("token").agg(F.max(F.struct("typ", F.xxhash64("node").alias("h"), "node", "n", F.col("node").alias("comp"))).alias("hub"))
        comp = components(self.verified(self.hub_pairs(shared.withColumn("comp", F.col("node")), hub)))
        rest = self.mixed(shared, comp)
        for turn in range(HUB_ROUNDS):
            crowd = rest.groupBy("token").agg(F.count(F.lit(1)).alias("c")).agg(
                F.sum("c").alias("rows"), F.sum(F.col("c") * (F.col("c") - 1) / 2).alias("pairs")).first()
            if not crowd["rows"] or crowd["pairs"] <= CROWDED * crowd["rows"]:
                break
            picks = [F.min(F.struct(F.xxhash64("node", F.lit(turn), F.lit(k)).alias("h"), "node", "n", "comp")).alias(f"h{k}") for k in range(HUBS)]
            hubs = rest.groupBy("token").agg(*picks).select("token", F.explode(F.array_distinct(F.array(*[
                F.struct(F.col(f"h{k}.node").alias("node"), F.col(f"h{k}.n").alias("n"), F.col(f"h{k}.comp").alias("comp")) for k in range(HUBS)]))).alias("hub"))
            comp = components(self.verified(self.hub_pairs(rest, hubs)), comp)
            rest = self.mixed(shared, comp)
        if rest.isEmpty():
            return comp
        # under the order of these tokens by count, two sets that meet in c of them meet in one that has
        # at least c - 1 tokens of either set after it
        by_count = Window.partitionBy("node").orderBy("df", "token")
        placed = rest.withColumn("at", F.row_number().over(by_count)).withColumn("s", F.count(F.lit(1)).over(Window.partitionBy("node")))
        # a crowded token's rows are cut into blocks; each block meets all rows of the token in a task of its own
        blocks = F.ceil(F.col("df") / BLOCK_ROWS)
        other = placed.select("token", F.explode(F.sequence(F.lit(0).cast("bigint"), blocks - 1)).alias("block"),
                              *[F.col(c).alias("o_" + c) for c in ("node", "n", "comp", "at", "s")])
        placed = placed.withColumn("block", F.pmod(F.xxhash64("node"), blocks))
        c = self.meetings("n", "o_n")
        met = placed.join(other, ["token", "block"]).filter(
            (F.col("node") < F.col("o_node")) & (F.col("comp") != F.col("o_comp")) & self.in_size("n", "o_n")
            & (F.col("s") - F.col("at") + 1 >= c) & (F.col("o_s") - F.col("o_at") + 1 >= c))
        pairs = met.select(F.col("node").alias("a"), F.col("o_node").alias("b"), "n", "o_n").distinct()
        held = rest.groupBy("node").agg(F.collect_set("token").alias("tokens"))  # at most a prefix each
        pairs = pairs.join(held.select(F.col("node").alias("a"), F.col("tokens").alias("ta")), "a").join(
            held.select(F.col("node").alias("b"), F.col("tokens").alias("tb")), "b")
        pairs = pairs.filter(F.size(F.array_intersect("ta", "tb")) >= self.meetings("n", "o_n"))
        return components(self.verified(pairs.select("a", "b")), comp)


def jaccard_components(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 3, percent: int = 90) -> DataFrame:
    """(key, n_shingles, component_id) for every row: components of documents linked by set similarity.

    A set is the distinct word shingles of a text (words between ASCII white space, A-Z lower-cased); a
    text with fewer words than the width is one shingle; a text without words has no set and no link.
    Documents link when 100 * shared >= percent * united.  ``component_id`` is the smallest key
    reachable.  Defined cases: NULL text has no words; equal sets link; rows of one key and different
    text are different documents; NULL keys are not the smallest (a component of NULL keys only has a NULL
    id); an empty table gives no rows.  Sets are compared by 64-bit hashes of their shingles.
    """
    found = _placed(docs, key, text, width, percent)
    return found.select(F.col("key").alias(key), F.col("n").alias("n_shingles"), "component_id")


def _placed(docs: DataFrame, key: str, text: str, width: int, percent: int) -> DataFrame:
    """(key, th, n, comp, component_id) of every row; ``comp`` is NULL for texts without words."""
    join = Join(docs, key, text, width, percent)
    comp = join.components()
    named_sets = join.rows.filter("node IS NOT NULL").groupBy("node").agg(F.min("key").alias("least"))
    placed = named_sets.join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    least = placed.groupBy("comp").agg(F.min("least").alias("component_id"))
    of_node = placed.join(least, "comp").select("node", "comp", "component_id")
    out = join.rows.select("key", "th", "n", "node").join(of_node, "node", "left")
    return out.select("key", "th", "n", "comp", F.when(F.col("node").isNull(), F.col("key")).otherwise(
        F.col("component_id")).alias("component_id"))


def keep_one_per_component(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 3, percent: int = 90) -> DataFrame:
    """One row of ``docs`` for each component, all columns kept: the least key (NULL last), then text hash.

    Texts without words are in no component and stay.  Of rows repeating both key and text one stays.
    """
    found = _placed(docs, key, text, width, percent).checkpoint(eager=True)
    place = F.struct(F.col("key").isNull().alias("last"), "key", "th")
    heads = found.filter("comp IS NOT NULL").groupBy("comp").agg(F.min(place).alias("m")).select("m.key", "m.th")
    blank = found.filter("comp IS NULL").select("key", "th").distinct()
    again = found.filter("comp IS NOT NULL").groupBy("key", "th").agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1").select("key", "th")
    again = again.join(heads.select(F.col("key").alias("k2"), F.col("th").alias("t2")),
                       F.col("key").eqNullSafe(F.col("k2")) & (F.col("th") == F.col("t2")), "left_semi").checkpoint(eager=True)
    h = unused(docs, "_text_hash")
    hashed = docs.withColumn(h, F.xxhash64(F.coalesce(named(text).cast("string"), F.lit(""))))

    def on(side: DataFrame, how: str, rows: DataFrame = hashed) -> DataFrame:
        k, t = unused(rows, "_head_key"), unused(rows, "_head_hash")
        names = side.select(F.col("key").alias(k), F.col("th").alias(t))
        return rows.join(bounded_broadcast(names, FETCH_BROADCAST), named(key).eqNullSafe(F.col(k)) & (F.col(h) == F.col(t)), how)

    kept = on(heads.unionByName(blank), "left_semi")
    if not again.isEmpty():
        kept = on(again, "left_anti", kept).unionByName(on(again, "left_semi", kept).dropDuplicates([key, h]))
    return kept.select(*[named(c) for c in docs.columns])
