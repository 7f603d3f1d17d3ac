"""Mixing, licences, fingerprints: SQL twins, brute force and the defined cases."""

import hashlib
import math
import re
import textwrap

import pytest
from pyspark.sql import functions as F

from auditora.llm import fingerprints, licenses, mixing, queries
from tools.oracle_check import digest, run_duck

SF = "/root/testdata/sf0.001"
CLASH = "doc_id bigint, text string, source string, lang string, src string, parts string, cdf string, _key string, k string, t string, guard int, chunk int, h int, fp string"


def frame(spark, rows):
    """Documents with extra columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, s, "en", "a", "b", "c", "d", "e", "f", 1, 2, 3, "g") for i, t, s in rows], CLASH)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_sql_twin(spark, name):
    got = queries.QUERIES[name](spark, SF)
    rows = [tuple(r) for r in got.collect()]
    want = run_duck(SF, queries.SQL[name])
    assert sorted(got.columns) == sorted(want["cols"])
    assert digest(got.columns, rows)[0] == digest(want["cols"], want["rows"])[0]


def test_mix_defined_cases(spark):
    docs = frame(spark, [(None, "x", "a"), (None, None, None), (1, "", "a"), (1, "", "a"), (2, "z" * 100_000, None), (3, "q", "b")])
    got = mixing.mix_sources(docs, epochs=3.0, copy_col="copy")
    assert got.columns == [*docs.columns, "copy"]
    counts = {}
    for r in got.collect():
        counts[(r.doc_id, r.text, r.source)] = counts.get((r.doc_id, r.text, r.source), 0) + 1
    assert counts.get((1, "", "a"), 0) % 2 == 0  # repeated rows draw alike
    assert mixing.mix_sources(docs.limit(0)).count() == 0
    assert mixing.mix_sources(docs, spark.createDataFrame([("zz", 1.0)], "s string, w double")).count() == 0


def test_mix_hits_target_weights_above_the_part_mean(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"),
                                    F.when(F.col("id") < 2990, "big").otherwise("small").alias("source"))
    targets = spark.createDataFrame([("big", 1.0), ("small", 1.0)], "s string, w double")
    n = {r["source"]: r["count"] for r in mixing.mix_sources(docs, targets, epochs=2.0).groupBy("source").count().collect()}
    for s in ("big", "small"):  # 3000 expected copies each; the small source repeats 300 times on average
        assert abs(n[s] - 3000) < 6 * math.sqrt(3000)


def test_mix_salted_join_gives_the_same_copies(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    pick = ["doc_id", "source"]
    want = sorted(map(tuple, mixing.mix_sources(docs).select(pick).collect()))
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)
    assert sorted(map(tuple, mixing.mix_sources(docs).select(pick).collect())) == want


def test_license_rules_and_defined_cases(spark):
    mit = "\n".join(s[0] + "." for s in (licenses.SENTENCES["MITgrant"], licenses.SENTENCES["MITnotice"], licenses.SENTENCES["MITasis"]))
    wrapped = mit.replace(" and ", "\nand ").replace(" without ", "\n   without ")
    rows = [(1, "Blah.\nReleased under the MIT License.\nMore", "x"), (2, mit, "x"), (3, wrapped, "x"), (None, None, "x"), (5, "", "x"),
            (6, "Licensed under CC BY-NC 4.0. Licensed under the Apache License, Version 2.0.", "x"), (6, "no such thing", "x"),
            (7, licenses.SENTENCES["GPLsee"][0], "x"), (8, "This is about a license. " * 5000, "x")]
    got = sorted((r.doc_id or 0, r.licenses, r.unmatched, r.n_known) for r in licenses.scan_licenses(frame(spark, rows)).collect())
    assert got == [(0, "", "", 0), (1, "MIT", "", 1), (2, "MIT", "", 3), (3, "MIT", "", 3), (5, "", "", 0), (6, "", "", 0),
                   (6, "Apache-2.0,CC-BY-NC-4.0", "", 2), (7, "", "<GPLsee>", 1), (8, "", "", 0)]
    assert licenses.scan_licenses(frame(spark, rows).limit(0)).count() == 0


def test_license_whole_notices_in_any_layout(spark):
    part = {k: v[0] for k, v in licenses.SENTENCES.items()}
    mit = part["MITgrant"] + ":", part["MITnotice"] + ".", part["MITasis"] + ". IN NO EVENT SHALL THE AUTHORS BE LIABLE."
    isc = (part["ISCgrant"] + ".",)
    url = "http://www.apache.org/licenses/LICENSE-2.0"
    apache = ('Licensed under the Apache License, Version 2.0 (the "License"); ' + part["ApacheUse"] + ". You may obtain a copy of the License at",
              url, part["ApacheBasis"] + ". " + part["ApacheSee"] + ".")
    ids = {"MIT": "<MITgrant><MITnotice><MITasis>", "ISC": "<ISCgrant>",
           "Apache-2.0": "<ApacheVer2><ApacheUse><ApacheCopy><ApacheBasis><ApacheSee>"}
    rows, want = [], {}

    def add(text, licence, sequence):
        rows.append((len(rows), text, "x"))
        want[len(rows) - 1] = (licence, sequence, "")

    for name, paragraphs in (("MIT", mit), ("ISC", isc), ("Apache-2.0", apache)):
        whole = ["Copyright (c) 2020 Some One", *paragraphs]
        wrapped = "\n\n".join(textwrap.fill(x, 60) for x in whole)
        add(wrapped, name, ids[name])
        add(wrapped.replace("\n", "\r\n"), name, ids[name])
        add("\n".join(f" * {x}" for x in wrapped.split("\n")), name, ids[name])
        add("\n".join(textwrap.fill(x, 60) for x in whole), name, ids[name])
        add("\n".join(whole), name, ids[name])
        add(" ".join(whole), name, ids[name])
        add(f"{name[:3]} License " + " ".join(whole), name, ids[name])
        add("Released under the BSD License\n\n" + wrapped, f"{name},BSD", "<BSDrelease>" + ids[name])
        add(wrapped + "\n\nReleased under the BSD License\nmore words", f"{name},BSD", ids[name] + "<BSDrelease>")
    for ids_, name in ((("AGPLfree3", "GPLhope", "AGPLsee"), "AGPL-3.0-or-later"), (("LGPLfree21", "LGPLhope", "LGPLsee"), "LGPL-2.1-or-later"),
                       (("LGPLfree3", "LGPLhope", "LGPLsee"), "LGPL-3.0-or-later"), (("MPLver2", "MPLcopy"), "MPL-2.0"), (("EPLver2",), "EPL-2.0"),
                       (("BSDredist", "BSDsource", "BSDbinary", "BSDendorse", "BSDasis"), "BSD-3-Clause"), (("ISCgrant", "ISCasis"), "ISC"),
                       (("Zlibasis", "Zlibgrant"), "Zlib"), (("BSL1",), "BSL-1.0")):
        add("\n\n".join(textwrap.fill(part[x], 60) + "." for x in ids_), name, "".join(f"<{x}>" for x in ids_))
    for name in licenses.SPDX_NAMES:
        add(f"# SPDX-License-Identifier: {name}\n\nimport this", name, f"<SPDX><SPDX:{name}>")
    add("The licence is\nMIT\nor so", "", "")
    gpl = "\n".join(textwrap.fill(part[x], 60) + "." for x in ("GPLfree2", "GPLhope", "GPLsee"))
    add(gpl, "GPL-2.0-or-later", "<GPLfree2><GPLhope><GPLsee>")
    add("This is not licensed under the MIT License. Nor is it\x02released under the MIT License; so there", "", "")
    add("Licensed under the MIT License " * 20_000, "MIT", "<MITrelease>" * 20_000)
    got = {r.doc_id: (r.licenses, r.sentence_ids, r.unmatched) for r in licenses.scan_licenses(frame(spark, rows)).collect()}
    assert {k: v[:2] for k, v in got.items()} == {k: v[:2] for k, v in want.items()}


def shingles(text):
    w = re.split(r"[\x20\x09-\x0D]+", text.lower().strip(" \t\n\x0b\x0c\r"))
    w = [] if w == [""] else w
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def jaccard(a, b):
    return 1.0 if not a and not b else len(a & b) / len(a | b)


def check_fingerprints(rows, got):
    """rows: (id, text) in next-document order."""
    texts = [t or "" for _, t in rows]
    by = {}
    for r in got:
        by.setdefault((r.doc_id, r.edited_sha256), []).append(r)
    worst, total = 0.0, 0.0
    for n, (i, t) in enumerate(zip([i for i, _ in rows], texts)):
        nxt = texts[(n + 1) % len(texts)]
        k = len(t) // 4
        edited = t[:len(t) - k] + nxt[:k]
        r = by[(i, hashlib.sha256(edited.encode()).hexdigest())].pop()
        assert r.n_chars == len(t)
        for near, other in ((r.near_edited, edited), (r.near_next, nxt)):
            assert 0 <= near <= 1
            error = abs(near - jaccard(shingles(t), shingles(other)))
            worst, total = max(worst, error), total + error
    assert worst < 0.25 and total / (2 * len(rows)) < 0.03
    assert not any(by.values())


def test_fingerprints_against_whole_shingle_sets(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = fingerprints.edit_fingerprints(docs).collect()
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    check_fingerprints(rows, got)
    same = {}
    for (i, t), f in zip(rows, sorted((r.doc_id, r.fingerprint) for r in got)):
        assert same.setdefault(t, f[1]) == f[1]  # equal texts, equal fingerprints


def test_fingerprint_defined_cases(spark):
    rows = [(7, "a b c"), (8, ""), (9, None), (10, "  \n"), (11, "é" * 50_000), (12, "one two three four five six")]
    got = {r.doc_id: r for r in fingerprints.edit_fingerprints(frame(spark, [(i, t, "s") for i, t in rows])).collect()}
    check_fingerprints(rows, list(got.values()))
    assert got[8].fingerprint == got[9].fingerprint == got[10].fingerprint == "" and len(got[7].fingerprint) == 256
    assert got[8].near_next == 1.0 and got[7].near_next == 0.0
    assert fingerprints.edit_fingerprints(frame(spark, []).limit(0)).count() == 0
    lone = fingerprints.edit_fingerprints(frame(spark, [(1, "a b c d e f g h", "s")])).collect()
    assert len(lone) == 1 and lone[0].near_next == 1.0


def test_fingerprints_of_crowded_and_null_keys(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "ROWS_PER_CHUNK", 20)
    rows = [(5, f"word{n} x y z q {n}", "s") for n in range(120)] + [(None, f"null {n}", "s") for n in range(40)]
    rows += [(n, f"tail {n} b c d e f", "s") for n in range(100)] + [(5, "same text", "s")] * 3
    got = fingerprints.edit_fingerprints(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    # every text is the next one of exactly one document: the order is one cycle
    hashed = frame(spark, rows).select("doc_id", "text", F.xxhash64("text").alias("x")).collect()
    order = sorted(hashed, key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.x, r.text))
    want = {}
    for n, r in enumerate(order):
        nxt, k = order[(n + 1) % len(order)].text, len(r.text) // 4
        e = hashlib.sha256((r.text[:len(r.text) - k] + nxt[:k]).encode()).hexdigest()
        want[(r.doc_id, e)] = want.get((r.doc_id, e), 0) + 1
    have = {}
    for r in got:
        have[(r.doc_id, r.edited_sha256)] = have.get((r.doc_id, r.edited_sha256), 0) + 1
    assert have == want


def test_mix_weights_count_by_their_ratios(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = [r["source"] for r in docs.select("source").distinct().orderBy("source").collect()]

    def copies(scale):
        targets = spark.createDataFrame([(n, scale * (1.0 + i)) for i, n in enumerate(names)], "s string, w double")
        return sorted(map(tuple, mixing.mix_sources(docs, targets, copy_col="c").select("doc_id", "c").collect()))
    want = copies(1.0)
    assert len(want) > 100 and copies(2.0 ** -40) == want and copies(2.0 ** 60) == want and copies(1e-10) == want
    for bad in (float("nan"), float("inf"), -1.0):
        with pytest.raises(ValueError, match="weights"):
            mixing.mix_sources(docs, spark.createDataFrame([(names[0], bad)], "s string, w double"))


def plain_fingerprint(text):
    """One permutation of shingle hashes, least hash of each bin, empty bins borrowing by the least hash of (bin, donor bin)."""
    import struct

    import xxhash

    def signed(x):
        return x - (1 << 64) if x >> 63 else x

    def chain(parts):
        seed = 42
        for p in parts:
            seed = xxhash.xxh64(p, seed=seed).intdigest()
        return seed

    words = [w for w in re.split(r"[\x20\x09-\x0D]+", (text or "").lower()) if w]
    if not words:
        return ""
    hashes = [chain(w.encode() for w in words[i:i + 5]) for i in range(len(words) - 4)] or [chain([" ".join(words).encode()])]
    bins = {}
    for h in hashes:
        at = h >> (64 - fingerprints.BIN_BITS)
        bins[at] = min(h, bins.get(at, h))
    out = []
    for b in range(fingerprints.BINS):
        if b in bins:
            h = bins[b]
        else:
            h = min(bins.items(), key=lambda x: (signed(chain([struct.pack("<i", b), struct.pack("<i", x[0])])), signed(x[1])))[1]
        out.append(f"{h & ((1 << fingerprints.LOW_BITS) - 1):0{fingerprints.DIGITS}x}")
    return "".join(out)


def test_fingerprints_equal_the_plain_version_digit_for_digit(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").filter(F.length("text") < 20_000).limit(60).select("doc_id", "text")
    odd = [(-1, None), (-2, ""), (-3, "one"), (-4, "one two three four"), (-5, "a b c d e"), (-6, "Same same " * 40), (-7, "ünï 中文 x y z w")]
    docs = docs.unionByName(spark.createDataFrame(odd, docs.schema))
    rows = fingerprints.fingerprint_documents(docs).collect()
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert len(rows) == len(text) and all(r["fingerprint"] == plain_fingerprint(text[r["doc_id"]]) for r in rows)
    # likeness: agreeing bins corrected for chance agreement of the low bits
    pairs = [(plain_fingerprint(a), plain_fingerprint(b)) for a, b in zip(list(text.values())[:20], list(text.values())[1:21])]
    chance = 1 / (1 << fingerprints.LOW_BITS)
    df = spark.createDataFrame(pairs, "a string, b string")
    for r in df.select("a", "b", fingerprints.likeness(F.col("a"), F.col("b")).alias("l")).collect():
        d = fingerprints.DIGITS
        same = sum(r["a"][i:i + d] == r["b"][i:i + d] for i in range(0, fingerprints.BINS * d, d)) / fingerprints.BINS if r["a"] and r["b"] else 0
        want = 1.0 if r["a"] == r["b"] else 0.0 if not (r["a"] and r["b"]) else max(0.0, (same - chance) / (1 - chance))
        assert abs(r["l"] - want) < 1e-12
