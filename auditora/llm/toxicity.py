"""Toxicity: a convolutional text classifier trained in numpy.

Words are embedded by hashing (two hashes of the word and one of its first bytes, summed), filters
of widths 1, 2 and 3 slide over the words, each filter is max-pooled over the whole text and a
logistic layer reads the pooled values.  Training starts on the driver with a bounded sample of the
labelled rows and then goes over all of them: every task carries the starting network on through its
own rows, and what the tasks changed is averaged.  Scoring is a scalar Arrow UDF, whole texts in pieces,
so memory is bounded by a batch.  Scores are calibrated, and a threshold per language is set, on all
labelled rows kept out of training, counted by language, label and ``BINS_PER_LOGIT``.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.common import bounded_broadcast
from .common import named, release_kept, scratch_folder
from .textnum import buffers, give_back, in_spans, mix, small_batches, word_hashes

TABLE = 1 << 17
DIM = 8
WIDTHS = (1, 2, 3)
FILTERS = 16  # per width
HEAD = 4  # bytes of a word's beginning that have an embedding of their own
SPAN = max(WIDTHS)
PIECE_WORDS = 1 << 16
# Bound of the sample that training starts with (documented parameter): rows per class.
SAMPLE_ROWS = 2500
SAMPLE_BYTES = 96 << 20  # words of the sample that the driver trains on
SAMPLE_FILE_ROWS = 200  # rows of the sample that one file holds: the driver reads a few files at a time
VISITS = 40_000  # row visits of the training; small samples are gone through up to MAX_EPOCHS times
BATCH = 32  # rows of a step of the training
ROUND_ROWS = 2000  # rows of a task after which a step ends, however Spark cuts its batches
WORD_DROP = 0.4
MIN_EPOCHS, MAX_EPOCHS = 8, 40
BLOCK = 1024  # table rows that tasks hand over together
BINS_PER_LOGIT = 256  # calibration rows are counted by scores of this resolution
LABEL_BROADCAST = 500_000  # labels that tasks hold; more are joined by a shuffle
MIN_POSITIVES = 20  # a language with fewer labelled positives uses the common threshold


PARTS = pa.schema([("block", pa.int32()), ("shard", pa.int32()), ("n", pa.int64()), ("change", pa.binary())])


def features(column) -> tuple[np.ndarray, np.ndarray]:
    """(three table rows per word, words per text)."""
    h, counts, heads = word_hashes(*buffers(column), head=HEAD)
    mask = np.uint64(TABLE - 1)
    idx = np.stack([mix(h, 3) & mask, mix(h, 4) & mask, mix(heads, 5) & mask], axis=1).astype(np.int32)
    return idx, counts


@dataclass
class Model:
    """Weights and calibration; ``rate`` alone is used when there was nothing to learn."""

    table: np.ndarray
    conv: np.ndarray  # SPAN x DIM x (filters of all widths)
    conv_bias: np.ndarray
    out: np.ndarray
    out_bias: float
    scale: float = 1.0
    shift: float = 0.0
    rate: float | None = None
    threshold: float = 0.5
    thresholds: dict = field(default_factory=dict)

    def padded(self, idx: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows with SPAN - 1 blank words after each text; start of each text."""
        starts = np.concatenate(([0], np.cumsum(counts + SPAN - 1)))
        rows = np.full((int(starts[-1]) + SPAN, 3), TABLE, np.int32)
        words = np.arange(len(idx)) + np.repeat(np.arange(len(counts)) * (SPAN - 1), counts)
        rows[words] = idx
        return rows, starts

    def embed(self, rows: np.ndarray) -> np.ndarray:
        t = self.table
        return t[rows[:, 0]] + t[rows[:, 1]] + t[rows[:, 2]]

    def activate(self, x: np.ndarray, n: int) -> np.ndarray:
        z = x[:n] @ self.conv[0]
        for j in range(1, SPAN):
            z += x[j:n + j] @ self.conv[j]
        z += self.conv_bias
        return np.maximum(z, 0, out=z)

    def pooled(self, idx: np.ndarray, counts: np.ndarray) -> np.ndarray:
        best = np.zeros((len(counts), self.conv.shape[2]), np.float32)
        rows, starts = self.padded(idx, counts)
        total = int(starts[-1])
        for lo in range(0, total, PIECE_WORDS):
            hi = min(total, lo + PIECE_WORDS)
            z = self.activate(self.embed(rows[lo:hi + SPAN - 1]), hi - lo)
            z[rows[lo:hi, 0] == TABLE] = 0  # windows that start on a blank belong to no text
            a, b = np.searchsorted(starts, lo, "right") - 1, np.searchsorted(starts, hi, "left")
            cuts = np.maximum(starts[a:b], lo) - lo
            np.maximum(best[a:b], np.maximum.reduceat(z, cuts, axis=0), out=best[a:b])
        return best

    def logits(self, idx: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return self.pooled(idx, counts).astype(np.float64) @ self.out + self.out_bias

    def score(self, idx: np.ndarray, counts: np.ndarray) -> np.ndarray:
        if self.rate is not None:
            return np.full(len(counts), self.rate)
        return 1 / (1 + np.exp(-np.clip(self.scale * self.logits(idx, counts) + self.shift, -40, 40)))


def mask_of_widths() -> np.ndarray:
    """1 where a filter of its width has weights: position x 1 x filter."""
    m = np.zeros((SPAN, 1, len(WIDTHS) * FILTERS), np.float32)
    for k, w in enumerate(WIDTHS):
        m[:w, :, k * FILTERS:(k + 1) * FILTERS] = 1
    return m


def fresh(rng: np.random.Generator) -> tuple[Model, dict]:
    """A network to start with and its Adagrad sums."""
    n_out, mask = len(WIDTHS) * FILTERS, mask_of_widths()
    table = np.zeros((TABLE + 1, DIM), np.float32)
    table[:TABLE] = rng.normal(0, 0.02, (TABLE, DIM))
    m = Model(table, (rng.normal(0, 0.3, (SPAN, DIM, n_out)) * mask).astype(np.float32), np.zeros(n_out, np.float32),
              rng.normal(0, 0.3, n_out), 0.0)
    return m, {"table": np.full((TABLE + 1, 1), 1e-4, np.float32), "conv": np.full_like(m.conv, 1e-3),
               "bias": np.full(n_out, 1e-3), "out": np.full(n_out, 1e-3), "b": 1e-3}


def learn(m: Model, sums: dict, idx_list: list[np.ndarray], labels: np.ndarray, weight: np.ndarray, order: np.ndarray,
          rng: np.random.Generator, batch: int = BATCH, rate: float = 0.08, drop: float = WORD_DROP) -> None:
    """One pass of Adagrad on the logistic loss over the rows in ``order``."""
    n_out, mask = len(WIDTHS) * FILTERS, mask_of_widths()
    for at in range(0, len(order), batch):
        pick = order[at:at + batch]
        # words left out at random, so that no text is known by a few words of its own
        texts = [idx_list[i][rng.random(len(idx_list[i])) >= drop] for i in pick]
        counts = np.array([len(x) for x in texts])
        rows, starts = m.padded(np.concatenate(texts), counts)
        total = int(starts[-1])
        x = m.embed(rows)
        z = m.activate(x, total)
        z[rows[:total, 0] == TABLE] = 0
        spot = np.stack([z[s:e].argmax(axis=0) + s for s, e in zip(starts[:-1], starts[1:])])
        top = z[spot, np.arange(n_out)]
        p = 1 / (1 + np.exp(-np.clip(top @ m.out + m.out_bias, -30, 30)))
        g = (p - labels[pick]) * weight[pick] / len(pick)
        d_top = (g[:, None] * m.out[None] * (top > 0)).astype(np.float32)
        d_out, d_b, d_bias = top.T @ g, g.sum(), d_top.sum(axis=0)
        d_conv = np.zeros_like(m.conv)
        for j in range(SPAN):
            near = x[spot + j]
            d_conv[j] = np.einsum("nf,nfd->df", d_top, near)
            d_x = d_top[:, :, None] * m.conv[j].T[None]
            live = (d_top != 0) & (mask[j, 0] > 0)[None]
            at_rows, grads = rows[(spot + j)[live]], d_x[live]
            for h in range(3):
                keep = at_rows[:, h] != TABLE
                u, inv = np.unique(at_rows[keep, h], return_inverse=True)
                gr = np.zeros((len(u), DIM), np.float32)
                np.add.at(gr, inv, grads[keep])
                sums["table"][u] += (gr ** 2).mean(axis=1, keepdims=True)
                m.table[u] -= rate * gr / np.sqrt(sums["table"][u])
        for name, grad in (("conv", d_conv * mask), ("bias", d_bias), ("out", d_out), ("b", d_b)):
            sums[name] = sums[name] + grad ** 2
        m.conv -= (rate * d_conv * mask / np.sqrt(sums["conv"])).astype(np.float32)
        m.conv_bias -= (rate * d_bias / np.sqrt(sums["bias"])).astype(np.float32)
        m.out = m.out - rate * d_out / np.sqrt(sums["out"])
        m.out_bias -= float(rate * d_b / np.sqrt(sums["b"]))


def train(idx_list: list[np.ndarray], labels: np.ndarray, epochs: int | None = None, seed: int = 7) -> tuple[Model, dict]:
    """The network after some passes, classes weighted alike, and its Adagrad sums; deterministic for a given order of rows."""
    epochs = epochs or min(MAX_EPOCHS, max(MIN_EPOCHS, VISITS // max(1, len(labels))))
    rng = np.random.default_rng(seed)
    m, sums = fresh(rng)
    weight = np.where(labels == 1, 0.5 / max(1, labels.sum()), 0.5 / max(1, (labels == 0).sum())) * len(labels)
    for _ in range(epochs):
        learn(m, sums, idx_list, labels, weight, rng.permutation(len(labels)), rng)
    return m, sums


def flat_layers(m: Model) -> np.ndarray:
    return np.concatenate([m.conv.ravel(), m.conv_bias, m.out, [m.out_bias]]).astype(float)


def task_changes(m: Model, sums: dict, rows: DataFrame, counts: dict[int, int], seed: int = 7) -> DataFrame:
    """(block, shard, n, change): what every task changes in ``m`` on its own rows (y, t), n of them.

    The words are made from the texts in the function that learns from them: two Python functions in a row would take
    two workers for every task, and each keeps its memory for the stages after.
    """
    spark = rows.sparkSession
    held = spark.sparkContext.broadcast((m, sums))
    class_weight = {c: 0.5 * sum(counts.values()) / max(1, counts.get(c, 0)) for c in (0, 1)}

    def own_rows(batches):
        start, sums_ = held.value
        mine = replace(start, table=start.table.copy(), conv=start.conv.copy(), conv_bias=start.conv_bias.copy(), out=start.out.copy())
        own = {k: np.array(v) for k, v in sums_.items()}
        shard, n = TaskContext.get().partitionId(), 0
        rng = np.random.default_rng([seed, shard])

        def step(some: list) -> None:
            y = np.array([r[0] for r in some])
            learn(mine, own, [r[1] for r in some], y, np.where(y == 1, class_weight[1], class_weight[0]), np.arange(len(y)), rng)

        waiting: list = []
        for batch in small_batches(batches, 1):
            idx, words = features(batch.column(1))
            waiting += zip(batch.column(0).to_pylist(), np.split(idx, np.cumsum(words)[:-1]))
            while len(waiting) >= (size := min(BATCH, ROUND_ROWS - n % ROUND_ROWS)):
                step(waiting[:size])
                del waiting[:size]
                n += size
        if waiting:
            step(waiting)
            n += len(waiting)
        if not n:
            return
        change = mine.table - start.table
        for b in range(-(-TABLE // BLOCK)):
            part = change[b * BLOCK:(b + 1) * BLOCK]
            if part.any():
                yield pa.RecordBatch.from_pydict({"block": [b], "shard": [shard], "n": [n], "change": [part.tobytes()]}, PARTS)
        yield pa.RecordBatch.from_pydict({"block": [-1], "shard": [shard], "n": [n], "change": [(flat_layers(mine) - flat_layers(start)).tobytes()]}, PARTS)

    return rows.select("y", "t").mapInArrow(own_rows, "block int, shard int, n long, change binary")


def learn_all(m: Model, sums: dict, rows: DataFrame, counts: dict[int, int], seed: int = 7) -> Model:
    """``m`` carried on through every row (y, t) once: each task goes over its own rows from ``m``, and the changes are
    averaged by rows; those of a table row over the tasks that met it.  Tasks hand the table over in blocks."""
    def averaged(block: pa.Table) -> pa.Table:
        block = block.sort_by("shard")
        layers = block["block"][0].as_py() < 0
        total = weight = 0.0
        for n, change in zip(block["n"].to_pylist(), block["change"].to_pylist()):
            change = np.frombuffer(change, float) if layers else np.frombuffer(change, np.float32).reshape(-1, DIM).astype(float)
            met = n * (np.ones(1) if layers else change.any(axis=1, keepdims=True))
            total, weight = total + n * change, weight + met
        mean = total / np.maximum(weight, 1)
        return pa.table({"block": block["block"][:1], "change": pa.array([mean.tobytes()], pa.binary())})

    changes = task_changes(m, sums, rows, counts, seed)
    out = replace(m, table=m.table.copy())
    for r in changes.groupBy("block").applyInArrow(averaged, "block int, change binary").collect():  # the size of one network
        change = np.frombuffer(r["change"], float)
        if r["block"] >= 0:
            out.table[r["block"] * BLOCK:(r["block"] + 1) * BLOCK][:] += change.reshape(-1, DIM).astype(np.float32)
            continue
        conv, bias, last, _ = np.split(change, np.cumsum([m.conv.size, m.conv_bias.size, m.out.size]))
        out.conv, out.conv_bias = m.conv + conv.reshape(m.conv.shape).astype(np.float32), m.conv_bias + bias.astype(np.float32)
        out.out, out.out_bias = m.out + last, m.out_bias + float(change[-1])
    return out


def calibrate(m: Model, logits: np.ndarray, labels: np.ndarray, weights: np.ndarray, langs: list) -> None:
    """Platt scaling with smoothed targets, then the threshold of best F1 for each language.

    ``weights`` count the rows of each logit.
    """
    pos, neg = (weights * labels).sum(), (weights * (labels == 0)).sum()
    if not pos or not neg:
        return
    target = np.where(labels == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a, b = 1.0, 0.0
    for _ in range(100):  # Newton steps on the convex loss
        p = 1 / (1 + np.exp(-np.clip(a * logits + b, -30, 30)))
        g, h = weights * (p - target), weights * np.maximum(p * (1 - p), 1e-9)
        ga, gb = (g * logits).sum() + 1e-3 * a, g.sum()
        haa, hab, hbb = (h * logits * logits).sum() + 1e-3, (h * logits).sum(), h.sum() + 1e-9
        det = haa * hbb - hab * hab
        if det <= 1e-12:
            break
        da, db = (hbb * ga - hab * gb) / det, (haa * gb - hab * ga) / det
        size = max(1.0, abs(da), abs(db))
        a, b = a - da / size, b - db / size
        if abs(da) + abs(db) < 1e-8:
            break
    m.scale, m.shift = float(max(a, 1e-3)), float(b)
    scores = 1 / (1 + np.exp(-np.clip(m.scale * logits + m.shift, -40, 40)))

    def best(sel: np.ndarray) -> float:
        s, y, w = scores[sel], labels[sel], weights[sel]
        order = np.argsort(-s, kind="stable")
        s, y, w = s[order], y[order], w[order]
        tp, fp, all_pos = np.cumsum(w * y), np.cumsum(w * (1 - y)), (w * y).sum()
        f1 = 2 * tp / (tp + fp + all_pos)
        f1[:-1][s[:-1] == s[1:]] = -1  # a threshold lies between two different scores
        k = int(np.argmax(f1))
        return float((s[k] + (s[k + 1] if k + 1 < len(s) else 0.0)) / 2)

    m.threshold = best(np.ones(len(labels), bool))
    groups = np.array([x if x is not None else "" for x in langs], object)
    for lang in sorted(set(groups) - {""}):
        sel = groups == lang
        if (weights * labels)[sel].sum() >= MIN_POSITIVES and (weights * (labels == 0))[sel].sum() >= MIN_POSITIVES:
            m.thresholds[str(lang)] = best(sel)


def _word_rows(idx: np.ndarray, counts: np.ndarray) -> pa.Array:
    cuts = np.concatenate(([0], np.cumsum(counts)))
    flat = np.ascontiguousarray(idx)
    return pa.array([flat[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:])], pa.binary())


def labelled(docs: DataFrame, labels: DataFrame, key: str, text: str, lang: str, label: str) -> DataFrame:
    """(k, fold, y, g, t) of every labelled text: rows whose crc32(key as text) mod 5 is 0 are left out, remainder 1 calibrates
    (fold 1), 2 to 4 train (fold 0).

    Labels other than 0 and 1 and NULL keys teach nothing; several labels of a key count as 1 if any is.
    """
    lab = labels.select(named(key).alias("k"), named(label).cast("int").alias("y")).filter("k IS NOT NULL AND y IN (0, 1)")
    lab = lab.groupBy("k").agg(F.max("y").alias("y"))
    rest = F.pmod(F.crc32(F.col("k").cast("string")), F.lit(5))
    lab = lab.withColumn("fold", F.when(rest == 1, 1).when(rest > 1, 0)).filter("fold IS NOT NULL")
    rows = docs.select(named(key).alias("k"), named(lang).cast("string").alias("g"), named(text).cast("string").alias("t"))
    rows = rows.filter(F.pmod(F.crc32(F.col("k").cast("string")), F.lit(5)) > 0)
    return rows.join(bounded_broadcast(lab, LABEL_BROADCAST), "k")


def word_column(text: str) -> Column:
    def words(t: pa.Array) -> pa.Array:
        release_kept()
        return _word_rows(*features(t))

    return F.arrow_udf(in_spans(words), "binary")(text)


def first_sample(rows: DataFrame, per_class: int) -> list:
    """(y, word rows) of at most 2 * per_class training rows: what the network starts with, before it goes over all.

    Whole texts in the order of a hash, as many as ``SAMPLE_BYTES`` of words hold (12 bytes a word).
    """
    spark = rows.sparkSession
    fold = rows.filter("fold = 0")
    picks = None
    for y in (0, 1):
        part = fold.filter(F.col("y") == y).select("k").distinct().orderBy(F.xxhash64("k"), "k").limit(per_class)
        picks = part if picks is None else picks.unionByName(part)
    got = fold.join(F.broadcast(picks), "k").select("y", F.xxhash64("k", "t").alias("h"), word_column("t").alias("w"))
    # repeated keys could exceed the bound: keep it whatever the documents hold
    folder = scratch_folder(spark, "sample")
    got.orderBy("h").limit(2 * per_class).write.option("maxRecordsPerFile", SAMPLE_FILE_ROWS).parquet(folder)
    kept = spark.read.parquet(folder)
    sizes = kept.select("h", F.octet_length("w").alias("n")).orderBy("h").collect()  # at most 2 * per_class numbers
    fits = np.cumsum([r["n"] for r in sizes]) <= SAMPLE_BYTES
    last = sizes[int(fits.sum()) - 1]["h"] if fits.any() else None
    held = kept.filter(F.col("h") <= F.lit(last)) if last is not None else kept.limit(0)
    # one partition of a few files at a time, so that the driver holds the words once
    found = sorted(((r["h"], r["y"], np.frombuffer(r["w"], np.int32).reshape(-1, 3)) for r in held.toLocalIterator()), key=lambda r: r[0])
    return [r[1:] for r in found]


def calibrate_all(m: Model, rows: DataFrame) -> None:
    """Calibration and thresholds from all ``rows`` (y, g, t): they are counted by language, label and logit, and the
    languages too small for a threshold of their own together."""
    spark = rows.sparkSession
    held = spark.sparkContext.broadcast(m)

    def logit(t: pa.Array) -> pa.Array:
        release_kept()
        return pa.array(held.value.logits(*features(t)), pa.float64())

    scored = rows.select("y", "g", F.arrow_udf(in_spans(logit), "double")("t").alias("s"))
    cells = scored.groupBy("g", "y", F.floor(F.col("s") * BINS_PER_LOGIT).alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.sum("s").alias("s")).checkpoint(eager=True)
    per = cells.groupBy("g").agg(*[F.sum(F.when(F.col("y") == y, F.col("n"))).alias(f"n{y}") for y in (0, 1)])
    large = [r["g"] for r in per.filter((F.col("n0") >= MIN_POSITIVES) & (F.col("n1") >= MIN_POSITIVES) & F.col("g").isNotNull()).select("g").collect()]
    group = F.when(F.col("g").isin(large), F.col("g"))
    found = cells.groupBy(group.alias("g"), "y", "bin").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).orderBy("g", "y", "bin").collect()
    n = np.array([r["n"] for r in found], float)
    calibrate(m, np.array([r["s"] for r in found]) / n, np.array([r["y"] for r in found]), n, [r["g"] for r in found])


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", label: str = "toxic",
        per_class: int = SAMPLE_ROWS, epochs: int | None = None) -> Model:
    """Model learnt from every labelled row; without both classes it scores the constant label rate."""
    rows = labelled(docs, labels, key, text, lang, label)
    counts = {(r["fold"], r["y"]): r["n"] for r in rows.groupBy("fold", "y").agg(F.count(F.lit(1)).alias("n")).collect()}
    blank = Model(np.zeros((1, 1), np.float32), np.zeros((SPAN, 1, 1), np.float32), np.zeros(1, np.float32), np.zeros(1), 0.0)
    if not counts.get((0, 0)) or not counts.get((0, 1)):
        blank.rate = sum(n for (_, y), n in counts.items() if y) / max(1, sum(counts.values()))
        return blank
    first = first_sample(rows, per_class)
    y = np.array([r[0] for r in first])
    if len(set(y)) == 2:
        m, sums = train([r[1] for r in first], y, epochs)
    else:  # words beyond the bound left no sample of both classes
        m, sums = fresh(np.random.default_rng(7))
    own, started = {y: counts[0, y] for y in (0, 1)}, len(first)
    del first
    give_back()  # the driver's Python keeps no words while the rest is learnt
    if started < sum(own.values()):
        m = learn_all(m, sums, rows.filter("fold = 0"), own)
    both = counts.get((1, 0)) and counts.get((1, 1))
    calibrate_all(m, rows.filter("fold = 1") if both else rows)
    return m


def score_column(spark, m: Model, text: Column) -> Column:
    """Score expression for a text column (NULL is an empty text); the model is broadcast (about 4 MB)."""
    held = spark.sparkContext.broadcast(m)

    def score(t: pa.Array) -> pa.Array:
        release_kept()
        return pa.array(held.value.score(*features(t)), pa.float64())

    return F.arrow_udf(in_spans(score), "double")(F.coalesce(text.cast("string"), F.lit("")))


def threshold_column(m: Model, lang: Column) -> Column:
    out = F.lit(m.threshold)
    for name, t in m.thresholds.items():
        out = F.when(lang == name, F.lit(t)).otherwise(out)
    return out


def score_toxicity(docs: DataFrame, m: Model, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """(key, held_out, score, predicted, lang_threshold, toxic) for every row.

    ``predicted`` cuts the calibrated score at 0.5, ``toxic`` at the language's threshold (the common
    one for NULL or unknown languages).  The score reads the text alone.  Defined cases: NULL and empty
    texts get the score of no words; a NULL key is not held out; repeated rows are scored alike.
    """
    rows = docs.select(named(key).alias("k"), named(lang).cast("string").alias("g"),
                       score_column(docs.sparkSession, m, named(text)).alias("s"))
    held = F.coalesce(F.pmod(F.crc32(F.col("k").cast("string")), F.lit(5)) == 0, F.lit(False))
    limit = threshold_column(m, F.col("g"))
    return rows.select(F.col("k").alias(key), held.alias("held_out"), F.col("s").alias("score"),
                       (F.col("s") >= 0.5).cast("int").alias("predicted"), limit.alias("lang_threshold"),
                       (F.col("s") >= limit).alias("toxic"))


def drop_toxic(docs: DataFrame, m: Model, text: str = "text", lang: str = "lang") -> DataFrame:
    """The rows of ``docs`` whose score is below their language's threshold, all columns kept."""
    s = score_column(docs.sparkSession, m, named(text))
    return docs.filter(s < threshold_column(m, named(lang).cast("string")))
