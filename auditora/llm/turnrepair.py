"""Conversation structure repair by a lightest-derivation agenda.

A conversation is legal if its roles' initials read (s?(ua)+)?.  Its rows are edited into a legal one:
Keep costs 0, Rerole (to user or assistant) 3, Delete 4, Insert (an empty user or assistant turn) 3; blank and
duplicate rows must go, truncated rows that stay cost 3 more.  Of all cheapest edits the one whose
initials, in order, are least in ASCII is taken.

The edits are deductions of a weighted hypergraph.  Axioms are a start state and every row's possible
edits; ``state before row`` and ``edit of the row`` give ``state after the row``, and a state with an
insertion gives another state before the same row.  Weights are (cost, audit), joined by adding costs and
joining audits in order.  The join never gets lighter than its parts and keeps their order (two audits
of one cost between the same states are never a beginning of each other, as only insertions could
follow and these cost), so Knuth's agenda applies: the lightest item popped is final.

Conversations up to ``CHUNK_ROWS`` rows are solved in one go.  Longer ones are sorted and cut into chunks by
Spark; each chunk is solved from every state to every state, neighbouring chunks are composed in a
tree, and the best path is dealt back to the chunks, so no task ever holds all rows of one.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.common import bounded_broadcast
from .common import WHITE_CHARS, default_parallelism, let, named, scratch_folder

CHUNK_ROWS = 1024
CHUNK_BYTES = 8 << 20
FAN = 16  # chunks or groups of chunks composed at a time
BIG_BROADCAST = 1_000_000

START, OPENED, ASKED, ANSWERED = range(4)  # nothing yet, after s, after u, after a
STEP = {(START, "s"): OPENED, (START, "u"): ASKED, (OPENED, "u"): ASKED, (ANSWERED, "u"): ASKED, (ASKED, "a"): ANSWERED}
FINAL = (START, ANSWERED)
ROLES = {"u": "user", "a": "assistant"}
LEGAL = {"su", "ua", "au"}
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3

ROW = "turn bigint, role string, text string, m bigint"
COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def damaged(rows: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """(conv, turn, role, text, m): rows after the damage their crc32(conv:turn) % 20 names; m rows of this kind
    stand here, 0 where the row is dropped.  NULL roles and texts are one blank, NULL keys too inside the hash."""
    c, t = named(conv), named(turn).cast("bigint")
    blank = F.lit(" ")
    key = F.concat(F.coalesce(c.cast("string"), blank), F.lit(":"), F.coalesce(t.cast("string"), blank))
    body = F.coalesce(named(text).cast("string"), blank)
    cut = rows.select(c.alias("conv"), t.alias("turn"), F.coalesce(named(role).cast("string"), blank).alias("role"), body.alias("text"),
                      F.pmod(F.crc32(key), F.lit(20)).alias("h"))
    h = F.col("h")
    return cut.select("conv", "turn", F.when(h == 4, "user").otherwise(F.col("role")).alias("role"),
                      F.when(h == 1, "").when(h == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
                      F.when(h == 0, 0).when(h == 3, 2).otherwise(1).cast("bigint").alias("m"))


def fault_of(text: str, seen_before: bool) -> str:
    """blank, duplicate, truncated or nothing."""
    solid = text.rstrip(WHITE_CHARS)
    return "blank" if not solid else "duplicate" if seen_before else "truncated" if solid[-1] not in ".!?" else ""


class Edits:
    """What may become of one row that stands m times: (weight, symbol it gives) of every edit."""

    def __init__(self, role: str, fault: str, m: int):
        again = DELETE * (m - 1), "D" * (m - 1)  # repetitions of a row that stays are duplicates
        self.options = [((DELETE + again[0], "D" + again[1]), "")]
        if fault not in ("blank", "duplicate"):
            extra = TRUNCATED if fault else 0
            if role[:1] in ("s", "u", "a"):
                self.options.append(((KEEP + extra + again[0], "K" + again[1]), role[:1]))
            self.options += [((REROLE + extra + again[0], "R" + again[1]), symbol) for symbol in "ua"]


def join(*weights: tuple[int, str]) -> tuple[int, str]:
    """Weight of a deduction: costs add up, audits stand in order."""
    return sum(w[0] for w in weights), "".join(w[1] for w in weights)


def lightest(rows: list[Edits], start: int, goals: tuple[int, ...], enough: int) -> dict[int, tuple[int, str]]:
    """Lightest (cost, audit) from the state before the first row to the ``enough`` lightest of ``goals`` after the last.

    Items are ("at", row, state) and ("edit", row, option).  The agenda holds derived weights; an item is
    final when popped, and then every deduction whose other premise is final fires.
    """
    final: dict[tuple, tuple[int, str]] = {}
    states_at: list[list[int]] = [[] for _ in range(len(rows) + 1)]
    edits_at: list[list[int]] = [[] for _ in range(len(rows) + 1)]
    agenda: list[tuple[tuple[int, str], tuple]] = [((0, ""), ("at", 0, start))]
    for i, row in enumerate(rows):
        agenda += [(weight, ("edit", i, k)) for k, (weight, _) in enumerate(row.options)]
    heapq.heapify(agenda)
    found: dict[int, tuple[int, str]] = {}

    def derive(i: int, q: int, k: int) -> None:
        symbol = rows[i].options[k][1]
        after = STEP.get((q, symbol)) if symbol else q
        if after is not None and ("at", i + 1, after) not in final:
            heapq.heappush(agenda, (join(final["at", i, q], final["edit", i, k]), ("at", i + 1, after)))

    while agenda and len(found) < enough:
        weight, item = heapq.heappop(agenda)
        if item in final:
            continue
        final[item] = weight
        kind, i, which = item
        if kind == "edit":
            edits_at[i].append(which)
            for q in states_at[i]:
                derive(i, q, which)
            continue
        states_at[i].append(which)
        if i == len(rows) and which in goals:
            found[which] = weight
        for symbol in "ua":
            after = STEP.get((which, symbol))
            if after is not None and ("at", i, after) not in final:
                heapq.heappush(agenda, (join(weight, (INSERT, "I")), ("at", i, after)))
        for k in edits_at[i]:
            derive(i, which, k)
    return found


def replay(rows: list[tuple[str, str, int]], audit: str, state: int) -> list[tuple[str, str]]:
    """The repaired (role, text) list of (role, text, m) rows under an audit, from a state on."""
    out, at, left = [], 0, rows[0][2] if rows else 0
    for edit in audit:
        if edit == "I":
            role, text = ROLES["a" if state == ASKED else "u"], ""
        else:
            role, text = rows[at][:2]
            left -= 1
            if left == 0:
                at += 1
                left = rows[at][2] if at < len(rows) else 0
            if edit == "D":
                continue
            if edit == "R":
                role = ROLES["a" if state == ASKED else "u"]
        state = STEP[state, role[0]]
        out.append((role, text))
    return out


def faults(rows: list[tuple[str, str, int]], met: list[bool]) -> tuple[list[Edits], dict[str, int]]:
    """Edits of every row and the counts of first faults; ``met`` says which rows were seen earlier."""
    edits, n = [], {"blank": 0, "duplicate": 0, "truncated": 0}
    for (role, text, m), again in zip(rows, met):
        fault = fault_of(text, again)
        edits.append(Edits(role, fault, m))
        if fault in ("blank", "duplicate"):
            n[fault] += m
        else:
            n["duplicate"] += m - 1
            n["truncated"] += bool(fault)
    return edits, n


def illegal_pairs(rows: list[tuple[str, str, int]]) -> int:
    inside = sum(m - 1 for _, _, m in rows)  # a repetition stands beside its equal
    return inside + sum(a[0][:1] + b[0][:1] not in LEGAL for a, b in zip(rows, rows[1:]))


def solve(entries: list[dict]) -> dict:
    """All results of one conversation whose rows are in order."""
    rows = [(e["role"], e["text"], e["m"]) for e in entries]
    turns = [e["turn"] for e in entries if e["turn"] is not None]
    firsts = {}
    met = [firsts.setdefault(row[:2], i) != i for i, row in enumerate(rows)]
    edits, n = faults(rows, met)
    (cost, audit), = lightest(edits, START, FINAL, 1).values()
    return {"gaps": max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, **n, "illegal": illegal_pairs(rows), "cost": cost,
            "audit": audit, "turns": [{"role": r, "text": t} for r, t in replay(rows, audit, START)]}


TURNS = "array<struct<role:string,text:string>>"
OUT = pa.struct([*[(c, pa.int64()) for c in COUNTS], ("audit", pa.string()), ("turns", pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())])))])


def _solve_column(rows: pa.Array) -> pa.Array:
    return pa.array([solve(r or []) for r in rows.to_pylist()], OUT)


class Repair:
    """``summary`` (conv, counts, cost, audit, repaired_sha256) and ``turns`` (conv, place, role, text) of a table of rows."""

    def __init__(self, rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", damage: bool = True):
        self.spark = rows.sparkSession
        if damage:
            rows = damaged(rows, conv, turn, role, text)
        else:
            rows = rows.select(named(conv).alias("conv"), named(turn).cast("bigint").alias("turn"), *[
                F.coalesce(named(c).cast("string"), F.lit(" ")).alias(a) for c, a in ((role, "role"), (text, "text"))], F.lit(1).cast("bigint").alias("m"))
        sizes = rows.groupBy("conv").agg(F.sum("m").alias("rows"), F.sum(F.octet_length("text") * F.col("m")).alias("bytes"))
        big = sizes.filter((F.col("rows") > CHUNK_ROWS) | (F.col("bytes") > CHUNK_BYTES) & (F.col("rows") > 1)).select(F.col("conv").alias("big"))
        big = big.checkpoint(eager=True)
        self.long = None
        if not big.isEmpty():
            hinted = bounded_broadcast(big, BIG_BROADCAST)
            self.long = LongRepair(rows.join(hinted, F.col("conv").eqNullSafe(F.col("big")), "left_semi").filter("m > 0"))
            rows = rows.join(hinted, F.col("conv").eqNullSafe(F.col("big")), "left_anti")
        entry = F.when(F.col("m") > 0, F.struct("turn", "role", "text", "m"))  # a struct's NULL turn sorts first
        grouped = rows.groupBy("conv").agg(F.sort_array(F.collect_list(entry)).alias("rows"))
        made = F.arrow_udf(_solve_column, ", ".join(f"{c} bigint" for c in COUNTS) + f", audit string, turns {TURNS}")
        self.short = grouped.select("conv", made("rows").alias("r")).select("conv", "r.*")

    def summary(self) -> DataFrame:
        lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n")
        out = self.short.select("conv", *COUNTS, "audit", F.sha2(lines, 256).alias("repaired_sha256"))
        return out.unionByName(self.long.summary()) if self.long else out

    def turns(self) -> DataFrame:
        out = self.short.select("conv", F.posexplode("turns").alias("place", "t")).select("conv", F.col("place").cast("bigint"), "t.role", "t.text")
        return out.unionByName(self.long.turns()) if self.long else out


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow: sorted rows get the number of their chunk (growing in the order of all rows) and their place in it."""
    chunk, place, size, last = (TaskContext.get().partitionId() << 32) - 1, 0, 0, object()
    for batch in batches:
        chunks, places = [], []
        for conv, n in zip(batch.column(0).to_pylist(), batch.column(batch.num_columns - 1).to_pylist()):
            if conv != last or place >= CHUNK_ROWS or size + n > CHUNK_BYTES:
                chunk, place, size, last = chunk + 1, 0, 0, conv
            chunks.append(chunk)
            places.append(place)
            place, size = place + 1, size + n
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(chunks, pa.int64()), pa.array(places, pa.int64())],
                                         names=[*batch.schema.names[:-1], "chunk", "place"])


def _solve_chunk(pdf: pd.DataFrame) -> pd.DataFrame:
    """One chunk: counts, first and last initial, and the lightest way from every state to every state."""
    pdf = pdf.sort_values("place")
    rows = list(zip(pdf["role"], pdf["text"], pdf["m"].astype(int)))
    edits, n = faults(rows, [not first for first in pdf["first"]])
    ways = {}
    for q in range(4):
        for to, (cost, audit) in lightest(edits, q, (START, OPENED, ASKED, ANSWERED), 4).items():
            ways[f"{q}{to}"] = [cost, audit, [len(audit)], [to]]
    return pd.DataFrame([{"chunk": pdf["chunk"].iloc[0], **n, "illegal": illegal_pairs(rows), "first": rows[0][0][:1],
                          "last": rows[-1][0][:1], "ways": json.dumps(ways)}])


def compose(ways: list[dict]) -> dict:
    """Lightest ways through neighbouring chunks; each keeps the audit length and end state of every chunk."""
    total = ways[0]
    for more in ways[1:]:
        both: dict[str, list] = {}
        for x, (c1, a1, l1, e1) in total.items():
            for to in range(4):
                second = more.get(f"{x[1]}{to}")
                if second is None:
                    continue
                way = [c1 + second[0], a1 + second[1], l1 + second[2], e1 + second[3]]
                key = f"{x[0]}{to}"
                if key not in both or way[:2] < both[key][:2]:
                    both[key] = way
        total = both
    return total


def _compose_group(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("at")
    seam = sum(a + b not in LEGAL for a, b in zip(pdf["last"].iloc[:-1], pdf["first"].iloc[1:]))
    ways = compose([json.loads(w) for w in pdf["ways"]])
    return pd.DataFrame([{"head": pdf["head"].iloc[0], "at": pdf["at"].iloc[0] // FAN, **{c: pdf[c].sum() for c in ("blank", "duplicate", "truncated")},
                          "illegal": pdf["illegal"].sum() + seam, "first": pdf["first"].iloc[0], "last": pdf["last"].iloc[-1], "ways": json.dumps(ways)}])


def _best(ways: pa.Array) -> pa.Array:
    """cost, audit and (start state, slice) of every chunk of the lightest way to a legal end."""
    out = []
    for text in ways.to_pylist():
        made = json.loads(text)
        cost, audit, lengths, ends = min(made[k] for k in ("00", "03") if k in made)
        slices, at = [], 0
        for state, n in zip([START, *ends], lengths):
            slices.append({"state": state, "slice": audit[at:at + n]})
            at += n
        out.append({"cost": cost, "audit": audit, "slices": slices})
    return pa.array(out, pa.struct([("cost", pa.int64()), ("audit", pa.string()), ("slices", pa.list_(pa.struct([("state", pa.int32()), ("slice", pa.string())])))]))


def _replay_chunk(rows: pa.Table, plan: pa.Table) -> pa.Table:
    """The repaired rows of one chunk under its slice of the audit."""
    rows, todo = rows.sort_by("place"), plan.to_pylist()[0]
    done = replay([(r["role"], r["text"], r["m"]) for r in rows.to_pylist()], todo["slice"], todo["state"])
    return pa.table({"chunk": pa.array([rows["chunk"][0].as_py()] * len(done), pa.int64()), "place": pa.array(range(len(done)), pa.int64()),
                     "role": pa.array([r for r, _ in done], pa.string()), "text": pa.array([t for _, t in done], pa.string())})


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow: sorted (head, line) -> (head, sha256 of the lines joined by newlines), one line at a time."""
    last, held = None, None

    def done():
        return pa.record_batch([pa.array([last], pa.int64()), pa.array([held.hexdigest()])], names=["head", "repaired_sha256"])

    for batch in batches:
        for head, line in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if head != last:
                if held is not None:
                    yield done()
                last, held = head, hashlib.sha256()
            else:
                held.update(b"\n")
            held.update(line.encode())
    if held is not None:
        yield done()


class LongRepair:
    """The same for conversations that one task should not hold."""

    def __init__(self, rows: DataFrame):
        self.spark = rows.sparkSession
        self.kind = rows.schema["conv"].dataType.simpleString()
        alike = rows.groupBy("conv", "turn", "role", "text").agg(F.sum("m").alias("m"))  # equal rows stand side by side
        alike = alike.withColumn("same", F.sha2("text", 256))
        met = alike.groupBy("conv", "role", "same").agg(F.min(F.struct("turn")).alias("met"))
        met = met.select(*[F.col(c).alias("m_" + c) for c in ("conv", "role", "same")], "met")
        on = F.col("conv").eqNullSafe(F.col("m_conv")) & (F.col("role") == F.col("m_role")) & (F.col("same") == F.col("m_same"))
        flagged = alike.join(met, on).select("conv", "turn", "role", "text", "m", F.col("turn").eqNullSafe(F.col("met.turn")).alias("first"),
                                             F.octet_length("text").cast("bigint").alias("size"))
        order = [F.asc_nulls_first("conv"), F.asc_nulls_first("turn"), F.asc("role"), F.asc("text")]
        schema = f"conv {self.kind}, {ROW}, first boolean, chunk bigint, place bigint"
        folder = scratch_folder(self.spark, "turns")
        flagged.repartitionByRange(default_parallelism(rows), *order).sortWithinPartitions(*order).mapInArrow(_cut, schema).write.parquet(folder)
        self.rows = self.spark.read.parquet(folder)
        counts = "blank bigint, duplicate bigint, truncated bigint, illegal bigint, first string, last string, ways string"
        solved = self.rows.groupBy("chunk").applyInPandas(_solve_chunk, f"chunk bigint, {counts}").checkpoint(eager=True)
        # a conversation is named by its first chunk from here on, so that NULL is a name like any other
        of_conv = Window.partitionBy("conv")
        self.chunks = self.rows.select("conv", "chunk").distinct().select(
            "conv", "chunk", F.min("chunk").over(of_conv).alias("head"),
            (F.row_number().over(of_conv.orderBy("chunk")) - 1).cast("bigint").alias("at")).checkpoint(eager=True)
        level = solved.join(self.chunks.select("chunk", "head", "at"), "chunk").drop("chunk")
        while not level.filter("at > 0").isEmpty():
            level = level.withColumn("up", F.floor(F.col("at") / FAN)).groupBy("head", "up").applyInPandas(
                lambda pdf: _compose_group(pdf), f"head bigint, at bigint, {counts}").checkpoint(eager=True)
        best = F.arrow_udf(_best, "cost bigint, audit string, slices array<struct<state:int,slice:string>>")
        self.found = level.withColumn("b", best("ways")).select("head", "blank", "duplicate", "truncated", "illegal", "b.*").checkpoint(eager=True)
        plan = self.found.select("head", F.posexplode("slices").alias("at", "s"))
        plan = plan.withColumn("at", F.col("at").cast("bigint")).join(self.chunks, ["head", "at"]).select("chunk", "s.*")
        self.lines = self.rows.select("chunk", "place", "role", "text", "m").groupBy("chunk").cogroup(plan.groupBy("chunk")).applyInArrow(
            lambda rows, todo: _replay_chunk(rows, todo), "chunk bigint, place bigint, role string, text string").checkpoint(eager=True)

    def summary(self) -> DataFrame:
        span = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0))
        turns = self.rows.groupBy("conv").agg(span.alias("gaps"), F.min("chunk").alias("head"))
        lines = self.lines.join(self.chunks.select("chunk", "head"), "chunk").select("head", F.concat("role", F.lit(":"), "text").alias("line"), "chunk", "place")
        lines = lines.repartition(default_parallelism(lines), "head").sortWithinPartitions("head", "chunk", "place").select("head", "line")
        digest = lines.mapInArrow(_digest, "head bigint, repaired_sha256 string")
        out = turns.join(self.found, "head").join(digest, "head", "left")
        return out.select("conv", *COUNTS, "audit", F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))

    def turns(self) -> DataFrame:
        sizes = self.lines.groupBy("chunk").agg(F.count(F.lit(1)).alias("n")).join(self.chunks, "chunk")
        before = F.coalesce(F.sum("n").over(Window.partitionBy("head").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        return self.lines.join(sizes.select("conv", "chunk", before.alias("before")), "chunk").select(
            "conv", (F.col("before") + F.col("place")).alias("place"), "role", "text")


def repair_conversations(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", damage: bool = True) -> DataFrame:
    """(conv, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of every conversation of ``rows``.

    ``damage`` first drops, empties, cuts, repeats or re-roles rows by their hash.  Rows are taken by turn, NULL
    turns first; rows of one turn by role, then text (UTF-8).  Defined cases: a NULL conversation is one; NULL roles
    and texts are one blank, so such rows are blank and go; equal rows are duplicates of the first; an empty role has no
    initial and cannot be kept; a conversation without rows after damage has zeros, an empty audit and the hash of
    the empty text; an empty table gives no rows; other columns are ignored.
    """
    return Repair(rows, conv, turn, role, text, damage).summary().withColumnRenamed("conv", conv)


def repaired_turns(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", damage: bool = False) -> DataFrame:
    """(conv, place, role, text): the repaired conversations themselves, turns numbered from 0."""
    return Repair(rows, conv, turn, role, text, damage).turns().withColumnRenamed("conv", conv)
