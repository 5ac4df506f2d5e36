import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from driftloom.llm import divergence

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, top=200):
    """The audit in Python integers."""
    per_group, df, by_lang = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        words = re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", (text or "").translate(LOWER))
        by_lang[lang].add(source)
        per_group[lang, source].update(words)
        df[lang].update(set(words))
    out = []
    for lang, sources in by_lang.items():
        kept = [w for w, n in df[lang].items() if n >= 3]
        count = {s: per_group[lang, s] for s in sources}
        total = {s: sum(count[s][w] for w in kept) for s in sources}
        p = lambda n, whole: 1 + 10**9 * (n + 1) // (whole + len(kept))
        f = lambda a, b: (a - b) ** 2 // b
        whole = sum(total.values())
        for s in sources:
            pairs = [(-sum(f(p(count[s][w], total[s]), p(count[o][w], total[o])) for w in kept), o) for o in sources if o != s]
            terms = [(w, p(count[s][w], total[s]), p(sum(count[o][w] for o in sources), whole)) for w in kept if count[s][w]]
            terms = [(-f(a, b), w) for w, a, b in terms if a > b]
            for part, items in (("pair", pairs), ("term", terms)):
                ordered = sorted(items, key=lambda x: (x[0], x[1].encode()))
                out += [(lang, s, part, item, -v, k + 1) for k, (v, item) in enumerate(ordered) if part == "pair" or k < top]
    return sorted(out)


def audited(df, **options):
    return sorted(tuple(r[c] for c in ("lang", "source", "part", "item", "value", "rank")) for r in divergence.audit(df, **options).collect())


def corpus():
    r = random.Random(3)
    words = [f"{a}{b}" for a in "abcdefghé" for b in "Abcdß日"]
    rows = []
    for k in range(400):
        lang = r.choice(["en", "en", "en", "de", None])
        source = "s0" if r.random() < 0.4 else r.choice([f"s{i}" for i in range(11)] + [None])
        rows.append((lang, source, " ".join(r.choice(words[: 8 + 5 * (k % 9)]) + r.choice(["", "", ",", "9 ", "_x", "\x7fy", "\x00"]) for _ in range(r.randrange(0, 60)))))
    rows += [("en", "empty", None), ("en", "empty too", ""), ("en", "digits", "12 34"), ("fr", "one", "seul " * 5), ("it", "a", "uno due"), ("it", "b", "tre"), ("en", "s1", ("lang " * 900 + "x" * 500 + " ") * 3)]
    return rows + [("en", "s2", "twin text twin")] * 3


@pytest.mark.parametrize("small", [False, True])
def test_against_brute_force(spark, monkeypatch, small):
    if small:  # several blocks, chunks, stripes, hand-overs and slices
        for name, value in (("CHUNK", 5), ("BLOCK", 3), ("STRIPE", 2), ("ENTRIES", 40), ("SLICE", 64)):
            monkeypatch.setattr(divergence, name, value)
    df = spark.createDataFrame([(*row, 0, "v") for row in corpus()], "lang string, source string, text string, value int, term string")
    assert audited(df, top=7) == brute(corpus(), top=7)


def test_empty_table_and_one_group(spark):
    schema = "lang string, source string, text string"
    assert audited(spark.createDataFrame([], schema)) == []
    assert audited(spark.createDataFrame([(None, None, None)], schema)) == []


def test_shares_are_exact_beyond_doubles():
    counts, totals = np.array([[0, 10**13 + 1, 7 * 10**14]]), np.array([8 * 10**15 + 3])
    assert divergence._shares(counts, totals, 999_983).tolist() == [[1 + 10**9 * (int(c) + 1) // (int(totals[0]) + 999_983) for c in counts[0]]]


def test_share_in_spark_equals_integers(spark):
    from pyspark.sql import functions as F

    rows = [(0, 1, 1), (5, 7, 3), (10**13 + 1, 8 * 10**15 + 3, 999_983)]
    df = spark.createDataFrame(rows, "n long, total long, v long").select("n", "total", "v", divergence.share(F.col("n"), F.col("total"), F.col("v")).alias("p"))
    assert all(r["p"] == 1 + 10**9 * (r["n"] + 1) // (r["total"] + r["v"]) for r in df.collect())
