"""Source divergence audit: plain version, hot groups, the defined cases."""

import random
import re
from collections import Counter, defaultdict

import pandas as pd

from auditora.llm import divergence

SCHEMA = "doc_id bigint, text string, lang string, source string, term string, n int, at int, kept int, item string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, s, "a", 1, 2, 3, "b") for i, (t, lang, s) in enumerate(rows)], SCHEMA)


def plain(rows, min_docs=3, top=200):
    low = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}
    counts, docs = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        found = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(low))
        counts[lang or "", source or ""].update(found)
        docs[lang or ""].update(set(found))
    out = []
    for lang in docs:
        kept = [t for t, n in docs[lang].items() if n >= min_docs]
        of = {s: c for (g, s), c in counts.items() if g == lang}
        whole = Counter()
        for c in of.values():
            whole.update(c)

        def shares(c):
            total = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 1) // (total + len(kept)) for t in kept}

        q, p = shares(whole), {s: shares(c) for s, c in of.items()}
        for s in of:
            pairs = [(-sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept), o.encode(), o) for o in of if o != s]
            best = [(-((p[s][t] - q[t]) ** 2 // q[t]), t.encode(), t) for t in kept if of[s][t] and p[s][t] > q[t]]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(best)[:top])):
                out += [(lang, s, part, item, -v, k) for k, (v, _, item) in enumerate(found, 1)]
    return sorted(out)


def run(df, **kw):
    return sorted(map(tuple, divergence.divergence(df, **kw).collect()))


def test_equals_the_plain_version_with_a_hot_source_and_ties(spark):
    r = random.Random(5)
    words = ["a" * k + c for k in range(1, 12) for c in "bcdéß中"] + ["THE", "the", "ﬁn", "𝒳y"]
    rows = [(" ".join(r.choices(words, k=r.randrange(0, 60))) + ". 1x2", r.choice(["en", "de", None]), r.choice(["hot"] * 6 + ["b", "é", None, ""])) for _ in range(240)]
    rows += [("same same words", "en", "hot")] * 50 + [("zz qq. ww", "en", "rare")] * 3 + [("alone", "fr", "x"), ("two", "fr", "y"), (None, "it", "z"), ("", "en", "none")]
    for top in (200, 3):  # 3: ties at the last rank
        assert run(frame(spark, rows), top=top) == plain(rows, top=top)


def test_small_cuts_give_the_same_rows(spark, monkeypatch):
    rows = [(" ".join(random.Random(i).choices("ab cd ef gh ij kl mn op".split(), k=40)), "en", f"s{i % 5}") for i in range(60)]
    want = run(frame(spark, rows))
    for name, value in (("HELD_TERMS", 3), ("PIECE", 7), ("PROFILE_ROWS", 1), ("SLAB", 1), ("CELL_BROADCAST", 0)):
        monkeypatch.setattr(divergence, name, value)
    assert run(frame(spark, rows).repartition(5)) == want == plain(rows)


def test_long_text_terms_are_cut_between_terms(monkeypatch):
    text = ("Word é1 " * 1000 + "x" * 5000 + " end").encode()
    want = list(divergence.terms(text))[0]
    monkeypatch.setattr(divergence, "PIECE", 64)
    assert [t for some in divergence.terms(text) for t in some] == want


def test_shares_pass_64_bits_exactly(spark):
    n, total, kept = 9 * 10**17, 10**18, 12345
    df = spark.createDataFrame([(n, total, kept)], "n bigint, t bigint, v bigint")
    got = df.select(divergence.share(df.n, df.t, df.v).alias("p")).first()["p"]
    assert got == 1 + 10**9 * (n + 1) // (total + kept)


def test_add_up_of_nothing():
    none = pd.DataFrame({"lang": [], "ats": [], "ps": [], "m": []})
    assert len(divergence._add_up(none, pd.DataFrame({"at": [], "p0": []}))) == 0


def test_empty_table(spark):
    assert divergence.divergence(frame(spark, [("a", "b", "c")]).limit(0)).count() == 0
