"""Conversation repair: plain search over all edits, long conversations in chunks, the defined cases."""

import hashlib
import random
import re
import zlib
from functools import lru_cache

import pytest

from auditora.llm import queries, turnrepair

SCHEMA = "conv_id bigint, turn bigint, role string, text string, m int, h int, chunk int, rows string, ways string"
WHITE = " \t\n\x0b\x0c\r"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, 3, "a", "b") for r in rows], SCHEMA)


def cheapest(rows):
    """(cost, audit, lines) by trying all edits row by row; rows are (role, text, fault)."""
    @lru_cache(None)
    def after(i, tail, inserted):
        """Least (cost, audit, lines) to finish from row i with the initials ``tail`` (last two) behind."""
        best = []
        state = {"": 0, "s": 1, "u": 2, "a": 3}[tail[-1:]]
        if i == len(rows) and state in (0, 3):
            best.append((0, "", ()))
        follow = {0: "su", 1: "u", 2: "a", 3: "u"}[state]
        options = []
        if inserted < 3:
            options += [(3, "I", {"u": "user", "a": "assistant"}[c], "", i, inserted + 1) for c in follow if c != "s"]
        if i < len(rows):
            role, text, fault = rows[i]
            options.append((4, "D", None, None, i + 1, 0))
            if fault not in ("blank", "duplicate"):
                extra = 3 if fault else 0
                if role[:1] and role[:1] in follow:
                    options.append((extra, "K", role, text, i + 1, 0))
                options += [(3 + extra, "R", r, text, i + 1, 0) for r in ("user", "assistant") if r[0] in follow]
        for cost, letter, role, text, nxt, ins in options:
            rest = after(nxt, tail if role is None else role[0], ins)
            if rest is not None:
                line = () if role is None else (f"{role}:{text}",)
                best.append((cost + rest[0], letter + rest[1], line + rest[2]))
        return min(best) if best else None
    return after(0, "", 0)


def plain(rows):
    """{conv: (gaps, blank, duplicate, truncated, illegal, cost, audit, sha)} of undamaged rows."""
    out = {}
    for conv in {r[0] for r in rows}:
        done = []
        for _, turn, role, text in (r for r in rows if r[0] == conv):
            key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
            role, text = " " if role is None else role, " " if text is None else text
            h = zlib.crc32(key.encode()) % 20
            text = "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text
            done += [(turn, "user" if h == 4 else role, text)] * (0 if h == 0 else 2 if h == 3 else 1)
        done.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, marked = set(), []
        for _, role, text in done:
            solid = text.rstrip(WHITE)
            fault = "blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else ""
            seen.add((role, text))
            marked.append((role, text, fault))
        turns = [t for t, _, _ in done if t is not None]
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(marked, marked[1:]))
        cost, audit, lines = cheapest(tuple(marked))
        count = [sum(f == k for _, _, f in marked) for k in ("blank", "duplicate", "truncated")]
        out[conv] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *count, illegal, cost, audit,
                     hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def made_up(seed, convs, most, roles=("system", "user", "assistant", "user", "assistant", "tool", "", None)):
    r = random.Random(seed)
    texts = ["Yes.", "No!", "and", "", None, " \t", "Why? ", "ends\n", "x.y", "Ünï."] + [f"t{i}." for i in range(12)]
    return [(c, r.choice([t, t, t, t + 1, None]), r.choice(roles), r.choice(texts)) for c in [*range(convs), None] for t in range(r.randrange(0, most))]


def result(df):
    rows = df.collect()
    assert len({r["conv_id"] for r in rows}) == len(rows)
    return {r["conv_id"]: tuple(r)[1:] for r in rows}


def test_equals_plain_search(spark):
    rows = made_up(1, 150, 8) + made_up(2, 150, 14, ("system", "user", "assistant"))
    assert result(turnrepair.repair_conversations(frame(spark, rows))) == plain(rows)


@pytest.mark.parametrize("chunk", [1, 3])
def test_long_conversations_in_chunks(spark, monkeypatch, chunk):
    rows = made_up(3, 6, 40) + [(7, 5, "user", "same.")] * 30 + [(8, i, "user", "again.") for i in range(25)]
    monkeypatch.setattr(turnrepair, "CHUNK_ROWS", chunk)
    monkeypatch.setattr(turnrepair, "FAN", 3)
    monkeypatch.setattr(turnrepair, "BIG_BROADCAST", 0)
    assert result(turnrepair.repair_conversations(frame(spark, rows))) == plain(rows)


def test_repaired_turns_are_the_digest(spark, monkeypatch):
    rows = made_up(4, 12, 20)
    want = {c: v[-1] for c, v in plain(rows).items()}
    for chunk in (1024, 2):
        monkeypatch.setattr(turnrepair, "CHUNK_ROWS", chunk)
        got = {c: [] for c in want}
        for r in sorted(turnrepair.repaired_turns(frame(spark, rows), damage=True).collect(), key=lambda r: (r["conv_id"] is None, r["conv_id"] or 0, r["place"])):
            assert r["place"] == len(got[r["conv_id"]])
            got[r["conv_id"]].append(f"{r['role']}:{r['text']}")
        assert {c: hashlib.sha256("\n".join(x).encode()).hexdigest() for c, x in got.items()} == want


def test_chunks_of_the_given_table(spark, monkeypatch):
    want = result(queries.QUERIES["op11_turn_repair"](spark, "/root/testdata/sf0.001"))
    monkeypatch.setattr(turnrepair, "CHUNK_ROWS", 2)
    assert result(queries.QUERIES["op11_turn_repair"](spark, "/root/testdata/sf0.001")) == want


def test_very_long_text_and_empty_table(spark):
    rows = [(1, 0, "user", "word " * 400_000 + "."), (1, 1, "assistant", "ok.")]
    assert result(turnrepair.repair_conversations(frame(spark, rows))) == plain(rows)
    assert turnrepair.repair_conversations(frame(spark, rows).limit(0)).count() == 0
    assert turnrepair.repaired_turns(frame(spark, rows).limit(0)).count() == 0
