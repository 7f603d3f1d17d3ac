"""Substring de-duplication: plain version, both join forms, small segments, the defined cases."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from auditora.llm import queries, substrings

SCHEMA = "doc_id bigint, text string, row bigint, id int, same string, place int, gram bigint, e1 bigint, words int, spans string, again boolean"
SF = "/root/testdata/sf0.001"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, "a", 3, 4, 5, 6, "b", True) for r in rows], SCHEMA)


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def plain(rows, size):
    """[(key, words, removed, kept)] for rows of different keys, or equal rows."""
    docs = sorted({r for r in rows}, key=lambda r: (r[0] is None, r[0] or 0))
    first, out = set(), {}
    for key, text in docs:
        words = split(text)
        gone = np.zeros(len(words), bool)
        for i in range(len(words) - size + 1):
            window = tuple(words[i:i + size])
            if window in first:
                gone[i:i + size] = True
            first.add(window)
        out[key, text] = (key, len(words), int(gone.sum()), " ".join(w for w, g in zip(words, gone) if not g))
    return sorted((out[r] for r in rows), key=str)


def run(df, size):
    return sorted((tuple(r) for r in substrings.remove_repeats(df, size=size).collect()), key=str)


def made_up(seed, n):
    r = random.Random(seed)
    vocab = ["a", "B", "b", "é", "word", "x" * 300, "the", "中文"] + [f"w{i}" for i in range(40)]
    passages = [[r.choice(vocab) for _ in range(r.randrange(5, 40))] for _ in range(6)]
    rows = []
    for i in range(n):
        words = []
        for _ in range(r.randrange(0, 6)):
            words += r.choice(passages) if r.random() < 0.5 else [r.choice(vocab) for _ in range(r.randrange(0, 25))]
        rows.append((i, r.choice([" ", "  ", "\n", "\t "]).join(words)))
    rows += [(n + k, rows[k * 3][1]) for k in range(8)] + [(n + 20 + k, " ".join(split(rows[k][1])[2:])) for k in range(10)]
    rows += [(n + 40, "same " * 100), (n + 41, "same " * 30 + "other"), (n + 42, "p q " * 50), (n + 43, None), (n + 44, ""), (n + 45, " \n"), (n + 46, "one"), (None, rows[5][1] + " end")]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("size", [1, 3, 8, 20])
def test_equals_the_plain_version(spark, size):
    rows = made_up(size, 120)
    assert run(frame(spark, rows), size) == plain(rows, size)


def test_shuffle_joins_and_small_segments_give_the_same(spark, monkeypatch):
    rows = made_up(7, 100)
    rows += rows[:5]  # equal rows are one document
    for name, value in (("GRAM_BROADCAST", 0), ("SIDE_BYTES", -1), ("SEGMENT", 7), ("GRAM", 3)):
        monkeypatch.setattr(substrings, name, value)
    assert run(frame(spark, rows).repartition(6), 12) == plain(rows, 12)


def test_equal_rows_and_one_key_with_two_texts(spark):
    text = " ".join(f"t{i}" for i in range(30))
    rows = [(1, text)] * 3 + [(2, text + " more")] * 2
    assert run(frame(spark, rows), 20) == sorted([(1, 30, 0, text)] * 3 + [(2, 31, 30, "more")] * 2, key=str)
    both = run(frame(spark, [(1, text + " x"), (1, text + " y")]), 20)
    assert sorted(r[2] for r in both) == [0, 30]


def test_paths_are_whole_passages_with_their_source(spark):
    passage = [f"p{i}" for i in range(60)]
    own = [[f"d{k}.{i}" for i in range(30)] for k in range(4)]
    rows = [(k, " ".join(own[k] + passage + own[k][::-1])) for k in range(4)] + [(9, " ".join(own[0][:25] + ["z"] + passage[10:40]))]
    got = sorted(map(tuple, substrings.repeated_paths(frame(spark, rows).coalesce(1), size=20).collect()))
    assert got == [(1, 30, 60, 0, 30), (2, 30, 60, 0, 30), (3, 30, 60, 0, 30), (9, 0, 25, 0, 0), (9, 26, 30, 0, 40)]


def test_a_path_that_is_not_proved_takes_no_words(spark, monkeypatch):
    run_ = substrings.Repeats(frame(spark, [(1, "a b c d e f"), (2, "x a b c d y")]), "doc_id", "text", 3)
    paths = run_.paths()
    monkeypatch.setattr(run_, "paths", lambda: paths.withColumn("from_place", F.col("from_place") + 1))
    got = {r["id"]: (r["n_removed"], r["unproved"]) for r in run_.cut().collect()}
    assert got == {1: (0, 0), 2: (0, 1)}


def test_given_documents_whole(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = queries.QUERIES["op12_substring_dedup"](spark, SF).select("doc_id", "n_words", "n_removed", "kept_sha256")
    import hashlib
    want = [(k, n, gone, hashlib.sha256(kept.encode()).hexdigest()) for k, n, gone, kept in plain(rows, 20)]
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_very_long_text_and_empty_table(spark):
    rows = [(1, " ".join(str(i) for i in range(300_000))), (2, " ".join(str(i) for i in range(100, 200)) + " " + "y" * 3_000_000)]
    assert run(frame(spark, rows), 20) == plain(rows, 20)
    assert run(frame(spark, rows).limit(0), 20) == []
