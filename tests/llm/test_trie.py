import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from driftloom.llm import trie

SCHEMA = "conv_id long, turn long, role string, text string, depth string"


def brute(rows):
    """The trie of the op11 contract over plain tuples."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(turns)] for c, turns in own.items()}
    built = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        built[c] = own.get(c - int(abs(c) % 5) * (1 if c > 0 else -1), [])[:h] + own[c][h:]
    members = defaultdict(list)
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    out = []
    for node, convs in members.items():
        under = [x for x in members if x[: len(node)] == node]
        kids = [x for x in under if len(x) == len(node) + 1]
        leaves = [x for x in under if not any(len(y) == len(x) + 1 and y[: len(x)] == x for y in under)]
        saved = sum((len(members[x]) - 1) * len(x[-1][1].encode()) for x in under if x)
        ends = ",".join(map(str, sorted(c for c in convs if len(built[c]) == len(node))))
        parent = min(members[node[:-1]]) if node else None
        out.append((min(convs), len(node), parent, len(convs), len(kids), len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out)


def made(df):
    turns = trie.ordered_turns(df)
    base, taken = F.col("conv_id") - F.col("conv_id") % 5, F.crc32(F.col("conv_id").cast("string").cast("binary")) % 9
    nodes = trie.prefix_trie(*trie.with_openings(turns, base, taken, 8))
    return sorted(tuple(r) for r in nodes.collect())


def conversations():
    r = random.Random(5)
    rows = []
    for c in [*range(60), 101, 102, 104, 5000, 5001, -7, -5]:
        for turn in range(r.randrange(1, 12)):
            rows.append((c, turn, r.choice(["user", "assistant"]) if turn else "user", r.choice(["hi", "hi", "hé", ""]) if turn < 4 else f"t{r.randrange(3)}"))
    long = [(t, "user", f"same {t}") for t in range(11)]
    rows += [(c, *x) for c in (200, 205, 210) for x in long] + [(215, *x) for x in long[:-1]]  # deep copies, over several sweeps
    rows += [(300, None, "user", "first"), (300, 2, None, None), (300, 2, None, None), (300, 2, "a", "tie"), (None, 0, "user", "no id"), (301, 0, "user", "x" * 5000)]
    rows += [(c, 0, "user", "alike") for c in range(4000, 4400, 5)]  # a group of copies over several segments
    return rows


@pytest.mark.parametrize(("segment", "subtree"), [(12, 10_000), (6, 30)])
def test_against_brute_force(spark, monkeypatch, segment, subtree):
    monkeypatch.setattr(trie, "SEGMENT", segment)
    monkeypatch.setattr(trie, "SUBTREE", subtree)
    monkeypatch.setattr(trie, "SWEEP", 4)
    rows = conversations()
    assert made(spark.createDataFrame([(*x, "c") for x in rows], SCHEMA)) == brute(rows)


def test_small_tables(spark):
    assert made(spark.createDataFrame([], SCHEMA)) == []
    for rows in ([(0, 0, "user", "alone"), (0, 1, "user", "still")], [(3, 0, "u", "only taken away")], [(None, 0, "u", "x")], [(5, None, None, None), (10, None, None, None)]):
        assert made(spark.createDataFrame([(*x, "c") for x in rows], SCHEMA)) == brute(rows)


def test_role_and_text_are_kept_apart(spark):
    rows = [(0, 0, "ab", "c"), (5, 0, "a", "bc"), (10, 0, "", "abc"), (15, 0, "2:", "c")]
    assert made(spark.createDataFrame([(*x, "c") for x in rows], SCHEMA)) == brute(rows)


def test_rounds_alone(spark, monkeypatch):
    monkeypatch.setattr(trie, "SUBTREE", 0)
    rows = [(c, t, "user", f"t{t}" if c < 20 else "x") for c in (0, 5, 10, 20, 25) for t in range(3 - c // 10)] + [(6, 0, "user", "t0"), (6, 1, "user", "own")]
    assert made(spark.createDataFrame([(*x, "c") for x in rows], SCHEMA)) == brute(rows)
