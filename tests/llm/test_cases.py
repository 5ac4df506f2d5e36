"""The defined results for nulls, empty and long texts, ties, repeats, empty tables, and clashing columns."""

import math
import random

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from driftloom.llm import bpe, chat, linededup, minhash, packing, pqdedup, tokencount, topk, toxicity, urlfilter

DOCS = "doc_id long, text string, lang string"
BYTES, WORDS, PIECES = P.path("byte_bpe_multi_50k.tiktoken"), P.path("word_bpe_49k.json"), P.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def odd(spark):
    """Null and repeated ids, null, empty, blank and long texts."""
    long = " ".join(f"w{k % 997}x{k}" for k in range(30_000))
    rows = [(1, None, None), (2, "", "en"), (3, " \n\t", "en"), (4, long, "en"), (5, long, None), (None, "some words that are here", "en"), (7, "a b c", "x"), (7, "a b c", "x"), (8, "A  B\tc", "x"), (9, "x" * 20_000, "y")]
    return spark.createDataFrame(rows, DOCS)


def rows_of(df, *names):
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=str)


# --- top k ------------------------------------------------------------------------------------------------------------


def test_topk(spark):
    r = random.Random(1)
    vectors = [(i, [r.gauss(0, 1) for _ in range(24)], "n") for i in range(400)]
    vectors += [(400, None, ""), (401, [None] * 24, ""), (402, [float("nan")] * 24, ""), (403, [math.inf] + [0.0] * 23, ""), (404, [], ""), (None, [1.0] * 24, ""), (410, [2.0, 1.0], ""), (420, vectors[7][1], ""), (420, vectors[7][1], "")]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<float>, score string")
    got = {}
    for x in topk.top_k(topk.integer_vectors(df, 256), F.col("vec_id") % 10 == 0, 5).collect():
        got.setdefault(x["query_id"], []).append((x["rank"], x["vec_id"], x["score"]))
    whole = {i: np.array([math.floor(256 * float(np.float32(c))) for c in v]) for i, v, _ in vectors[:400] + vectors[-1:]}
    for q in [i for i in whole if i % 10 == 0]:
        best = sorted((-int(whole[q] @ v), i) for i, v in whole.items() if i != q)[:5]
        assert sorted(got[q]) == [(k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert set(got) == {i for i in whole if i % 10 == 0}
    assert topk.top_k(topk.integer_vectors(df.limit(0), 256), F.lit(True), 5).count() == 0


def test_topk_with_many_rows_of_one_id_and_huge_components(spark):
    r = random.Random(4)
    vectors = [(i if i < 40 else 7, [r.gauss(0, 1) for _ in range(8)]) for i in range(500)]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>")
    whole = [(i, np.array([math.floor(256 * c) for c in v])) for i, v in vectors]
    got = {}
    for x in topk.top_k(topk.integer_vectors(df, 256), F.col("vec_id") % 20 == 7, 5).collect():
        got.setdefault(x["query_id"], []).append((x["rank"], x["vec_id"], x["score"]))
    assert set(got) == {7, 27}
    for q in got:
        best = {}
        for a, u in whole:
            for b, v in whole:
                if a == q != b:
                    best[b] = max(best.get(b, -(10**9)), int(u @ v))
        want = sorted((-s, b) for b, s in best.items())[:5]
        assert sorted(got[q]) == [(k + 1, b, -s) for k, (s, b) in enumerate(want)]


def test_topk_keeps_vectors_of_any_length(spark, monkeypatch):
    monkeypatch.setattr(topk, "LONG_BLOCK", 7)
    r = random.Random(5)
    vectors = [(0, [1.0, 0.0]), (1, [1e7, 0.0]), (2, [0.5, 0.0]), (3, [0.25, 1.0]), (4, [1e300, -1e300]), (5, [-1.7e308, 1.7e308]), (6, []), (7, []), (8, [1.0])]
    vectors += [(i, [r.choice([1, -1]) * 10.0 ** r.uniform(-3, e) for _ in range(2)]) for i, e in zip(range(10, 90), [3, 8, 20, 300] * 20)]
    df = spark.createDataFrame([(*v, "x") for v in vectors], "vec_id long, embedding array<double>, x string")
    whole = {i: topk.whole_numbers(v, 256) for i, v in vectors}
    assert whole[4][0] == 256 * int(1e300) and whole[2] == [128, 0]
    got = {}
    for row in topk.top_k(topk.integer_vectors(df, 256), F.lit(True), 5).collect():
        got.setdefault(row["query_id"], []).append((row["rank"], row["vec_id"], row["score"]))
    longs = lambda s: max(-(2**63), min(2**63 - 1, s))
    for q, u in whole.items():
        best = sorted((-sum(a * b for a, b in zip(u, v)), i) for i, v in whole.items() if i != q and len(v) == len(u))[:5]
        assert sorted(got.get(q, [])) == [(k + 1, i, longs(-s)) for k, (s, i) in enumerate(best)], q
    # the case of one long vector among short ones
    few = topk.top_k(topk.integer_vectors(df.where("vec_id < 4"), 256), F.col("vec_id") == 0, 5)
    assert sorted(map(tuple, few.collect())) == [(0, 1, 1, 655_360_000_000), (0, 2, 2, 32_768), (0, 3, 3, 16_384)]


def test_bounds_are_bounds():
    r = np.random.default_rng(0)
    a, b = r.normal(size=(20, 17)), r.normal(size=(30, 17))
    for s in topk.RESOLUTIONS:
        assert (topk.segment_statistics(a, s) @ topk.segment_statistics(b, s).T >= a @ b.T - 1e-9).all()


# --- near copies ------------------------------------------------------------------------------------------------------


def brute(docs, width, percent):
    sets, up = {}, {}
    for i, t in docs:
        w = t.lower().encode().split()
        sets[i] = {tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set()
        up[i] = i

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                up[y] = x
    return sorted((i, len(sets[i]), root(i), root(i) == i) for i in sets)


def test_minhash_against_brute_force(spark, monkeypatch):
    r = random.Random(4)
    base = [[f"t{r.randrange(5000)}" for _ in range(r.randrange(3, 120))] for _ in range(40)]
    docs = []
    for i in range(420):
        words = list(base[0] if i % 3 == 0 else r.choice(base))
        for _ in range(r.choice([0, 0, 1, 1, 2, 3])):
            words[r.randrange(len(words))] = f"n{r.randrange(9)}"
        docs.append((i, " ".join(words)))
    # small parts and shares, so that regions go deep and hubs are dealt to several shares
    for name, value in (("REGION", 3), ("SHARE", 16), ("BLOCK", 5), ("PAIRS", 16)):
        monkeypatch.setattr(minhash, name, value)
    df = spark.createDataFrame([(i, t, "e") for i, t in docs], DOCS)
    got = rows_of(minhash.near_duplicates(df, width=4), "doc_id", "n_shingles", "component_id", "kept")
    assert got == sorted(brute(docs, 4, 80), key=str)


def test_common_words_alone_link_nothing_and_copy_little(spark, monkeypatch):
    r = random.Random(9)
    monkeypatch.setattr(minhash, "REGION", 8)
    common = " ".join(f"c{k}" for k in range(120))
    docs = [(i, common + " " + " ".join(f"u{i}x{k}" for k in range(r.randrange(70, 110))), "e") for i in range(500)]
    # near copies of some, of which each must find its own among all the others
    docs += [(1000 + i, docs[i][1] + f" more{i}", "e") for i in range(0, 500, 25)]
    df = spark.createDataFrame(docs, DOCS)
    classes = minhash.sketch(df, "doc_id", "text", 4).select(F.col("doc_id").alias("rep"), "sig")
    pairs, members = (x.collect() for x in minhash.forest(classes))
    assert len({m["rep"] for m in members}) > 350  # most share a region with others
    for end in ("src", "dst"):
        assert max(sum(1 for p in pairs if p[end] == i) for i in range(500)) <= 8 * minhash.TREES
    assert len(pairs) <= 2 * minhash.TREES * len(docs)
    got = rows_of(minhash.near_duplicates(df, width=4), "doc_id", "component_id")
    assert got == sorted([(i, i - 1000 if i >= 1000 else i) for i, _, _ in docs], key=str)


def test_what_the_forest_leaves_is_decided_exactly(spark):
    r = random.Random(10)
    rows = []
    for i in range(160):
        words = [f"w{k}" for k in range(60)]
        for k in r.sample(range(60), r.choice([0, 1, 2, 3])):
            words[k] = f"n{r.randrange(40)}"
        rows.append((i, " ".join(words), "e"))
    df = spark.createDataFrame(rows, DOCS)
    sets = minhash._sets_of(df, df.select(F.col("doc_id").alias("rep")), "doc_id", "text", 4).cache()
    one_region = df.select(F.lit(1).cast("long").alias("region"), F.col("doc_id").alias("rep"))
    nothing = spark.createDataFrame([], "node long, component long")
    pairs = minhash.left_pairs(one_region, nothing, sets, 80)
    links = {(x["dst"], x["src"]) for x in minhash.confirmed(pairs, sets, 80).collect()}
    held = {x["rep"]: np.frombuffer(x["s"], np.uint64) for x in sets.collect()}
    assert links == {(a, b) for a in held for b in held if a < b and minhash.similar(held[a], held[b], 80)} and len(links) > 100


def test_shared_paragraphs_leave_few_pairs(spark):
    """Texts of 8 of 40 paragraphs share regions and shingles but link with nothing, but for a few; what is left must not grow with the pairs that share a paragraph."""
    r = random.Random(1)
    paragraphs = [" ".join(f"p{p}w{r.randrange(400)}" for _ in range(40)) for p in range(40)]
    for n in (400, 1500, 3000):
        docs = [(i, " ".join(r.sample(paragraphs, 8)), "e") for i in range(n)]
        docs += [(10_000 + i, docs[i][1] + " and more", "e") for i in range(0, n, 40)]
        df = spark.createDataFrame(docs, DOCS)
        classes = minhash.sketch(df, "doc_id", "text", 4).select(F.col("doc_id").alias("rep"), "sig")
        members = minhash.forest(classes)[1].cache()
        sets = minhash._sets_of(df, members.select("rep").distinct(), "doc_id", "text", 4).cache()
        left = minhash.left_pairs(members, spark.createDataFrame([], "node long, component long"), sets, 80)
        pairs = {(x["dst"], x["src"]) for x in left.collect()}
        assert {(i, 10_000 + i) for i in range(0, n, 40)} <= pairs and len(pairs) < n // 20
        if n > 400:
            continue
        held = {x["rep"]: np.frombuffer(x["s"], np.uint64) for x in sets.collect()}
        region = {}
        for m in members.collect():
            region.setdefault(m["region"], []).append(m["rep"])
        assert all((a, b) in pairs for own in region.values() for a in own for b in own if a < b and minhash.similar(held[a], held[b], 80))
        got = rows_of(minhash.near_duplicates(df, width=4), "doc_id", "component_id")
        assert got == sorted([(i, i - 10_000 if i >= 10_000 else i) for i, _, _ in docs], key=str)


def test_counts_of_any_size_bound_the_overlap():
    r = np.random.default_rng(3)
    pool = np.unique(r.integers(0, 1 << 63, 90_000).astype(np.uint64) * np.uint64(2))
    sets = [np.sort(r.choice(pool, n, replace=False)) for n in (40, 50, 3000, 3100, 88_000)] + [pool, pool[: 88_000]]
    packed = []
    for s in sets:
        c = np.bincount((s >> np.uint64(56)).astype(np.int64), minlength=minhash.SLOTS)
        packed.append(c.astype(np.min_scalar_type(int(c.max()))).tobytes())
    n, ids = np.array([len(s) for s in sets]), np.arange(len(sets))
    asks = np.arange(len(sets)) >= 5
    x, y = minhash.possible(np.concatenate([asks[asks], np.zeros(len(sets), bool)]), np.concatenate([asks[asks], asks]), np.concatenate([ids[asks], ids]), np.concatenate([ids[asks], ids]), np.concatenate([n[asks], n]), minhash._unpacked([p for p, a in zip(packed, asks) if a] + packed), 80)
    got = {tuple(sorted(p)) for p in zip(x.tolist(), y.tolist())}
    want = {(a, b) for a in range(len(sets)) for b in range(a) if (asks[a] or asks[b]) and minhash.similar(sets[a], sets[b], 80)}
    assert {tuple(sorted(p)) for p in want} <= got


def test_minhash_cases(spark, odd):
    got = rows_of(minhash.near_duplicates(odd.withColumns({"sig": F.lit(1), "rep": F.lit(2), "kept": F.lit(3)})), "doc_id", "n_shingles", "component_id", "kept")
    assert got == sorted([(1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (4, 29_996, 4, True), (5, 29_996, 4, False), (None, 1, None, True), (7, 1, 7, True), (7, 1, 7, True), (8, 1, 7, False), (9, 1, 9, True)], key=str)
    assert minhash.near_duplicates(odd.limit(0)).count() == 0


# --- byte BPE, token counts -------------------------------------------------------------------------------------------


def test_bpe_round_trip(spark, odd):
    texts = [(20, "日本語 👩‍👩‍👧 don't  \n\n x" * 50, ""), (21, "\u0000\ufffd é́", "")]
    df = odd.unionByName(spark.createDataFrame(texts, DOCS)).withColumn("ids", F.lit("clash"))
    coded = bpe.encode(df, BYTES, P.PATTERN)
    back = bpe.decode(coded, BYTES, P.PATTERN)
    assert sorted(back.columns) == ["decoded", "doc_id", "ids", "lang", "text"]
    assert all(bytes(r["decoded"]) == (r["text"] or "").encode() for r in back.collect())
    assert back.count() == df.count() and bpe.encode(df.limit(0), BYTES, P.PATTERN).count() == 0


def test_decoding_has_a_result_for_any_ids(spark):
    rows = [(1, None), (2, b""), (3, b"\x01\x00"), (4, np.array([97, 4_000_000_000, 98], "<u4").tobytes()), (5, np.array([0, 1], "<u4").tobytes() + b"\x07")]
    coder = bpe.coder(BYTES, P.PATTERN)
    names = {v: k for k, v in coder.ranks.items()}
    got = {r["k"]: None if r["decoded"] is None else bytes(r["decoded"]) for r in bpe.decode(spark.createDataFrame(rows, "k int, ids binary"), BYTES, P.PATTERN).collect()}
    assert got == {1: b"", 2: b"", 3: None, 4: None, 5: None}
    assert coder.decode(np.array([97, 98], "<u4").tobytes()) == names[97] + names[98]
    assert bpe.decode(spark.createDataFrame([], "k int, ids binary"), BYTES, P.PATTERN).count() == 0


def test_merges_take_the_leftmost_smallest():
    ranks = {bytes([c]): c for c in b"ab"} | {b"aa": 200, b"ab": 150, b"aaa": 300}
    def slow(p):
        parts = [p[i : i + 1] for i in range(len(p))]
        while True:
            options = [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks]
            if not options:
                return [ranks[x] for x in parts]
            _, i = min(options)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
    r = random.Random(0)
    for _ in range(500):
        p = bytes(r.choice(b"ab") for _ in range(r.randrange(1, 20)))
        assert bpe.merge_ranks(p, ranks) == slow(p)


def test_token_count_cases(spark, odd):
    got = rows_of(tokencount.count_tokens(odd.withColumn("n_tokens", F.lit("clash")), PIECES), "doc_id", "n_tokens")
    assert (1, 0) in got and (2, 0) in got and got.count((7, 3)) == 2 and len(got) == 10
    assert tokencount.count_tokens(odd.limit(0), PIECES).count() == 0


def test_ties_go_to_the_earlier_candidate():
    c = tokencount.Counter([("<unk>", 0.0), ("a", -1.0), ("b", -1.0), ("ab", -2.0), ("▁", -1.0)])
    # "ab" is put first and "a", "b" isn't strictly better
    assert c.count("ab") == 2 and c.count("abz") == 3 and c.count("abzz") == 3
    with pytest.raises(ValueError):
        tokencount.Counter([])


@pytest.mark.parametrize("kind", ["fractions", "ties", "inner marks", "no mark", "bytes"])
def test_unigram_vocabularies_against_the_library(kind):
    from tokenizers import Tokenizer, models, normalizers

    r = random.Random(kind)
    letters = "abcdé日"
    names = {"".join(r.choice(letters) for _ in range(r.randrange(1, 5))) for _ in range(60)} - {"日"}
    names |= {"▁" + n for n in list(names)[:25]}
    if kind == "inner marks":
        names |= {n + "▁" + m for n, m in zip(list(names)[:12], list(names)[12:24])}
    if kind != "no mark":
        names.add("▁")
    if kind == "bytes":
        names |= {f"<0x{b:02X}>" for b in range(256)}
    # many sums that are equal but for rounding
    score = (lambda: r.choice([-0.1, -0.2, -0.3, -0.7])) if kind in ("ties", "inner marks") else lambda: -r.uniform(1, 12)
    pieces = [("<unk>", 0.0)] + [(n, score()) for n in sorted(names)]
    tok = Tokenizer(models.Unigram(pieces, 0, kind == "bytes"))
    tok.normalizer = normalizers.Sequence([normalizers.Prepend("▁"), normalizers.Replace(" ", "▁")])
    own = tokencount.Counter(pieces)
    assert own.by_bytes == (kind == "bytes") and not own.exact
    for _ in range(400):
        text = "".join(r.choice(letters + "  zy") for _ in range(r.choice([3, 30, 300])))
        assert own.count(text) == len(tok.encode(text, add_special_tokens=False).ids), text


# --- URLs -------------------------------------------------------------------------------------------------------------


def test_urls(spark):
    rules = [urlfilter.Rule("allow", "org", "/"), urlfilter.Rule("block", "example.org", "/es/")]
    urls = [(1, "http://WWW.Example.ORG/es/1?x#y"), (2, "https://example.org/en"), (3, None), (4, "no scheme"), (5, "a://b?c"), (None, "http://notorg/"), (7, "http://x.org"), (8, "x://org/" + "p" * 5000), (9, "http://a\n.org/é/")]
    df = spark.createDataFrame([(i, u, "h") for i, u in urls], "page_id long, url string, rule string")
    got = {(r["page_id"], r["host"], r["path"], r["rule"]): r["verdict"] for r in urlfilter.judge(df, rules).collect()}
    assert got[(1, "www.example.org", "/es/1", "example.org/es/")] == "block" and got[(2, "example.org", "/en", "org/")] == "allow"
    assert (3, "", "", None) in got and (4, "", "", None) in got and (5, "b", "", None) in got and (None, "notorg", "/", None) in got
    assert (7, "x.org", "", None) in got and got[(8, "org", "/" + "p" * 5000, "org/")] == "allow" and (9, "a\n.org", "/é/", "org/") in got
    assert len(got) == 9 and set(got.values()) <= {"allow", "block"}
    nothing = urlfilter.judge(df.where("page_id IN (3, 5)"), rules).collect()
    assert {r["verdict"] for r in nothing} == {"allow"}
    assert urlfilter.judge(df.limit(0), rules).count() == 0
    plan = urlfilter.judge(df, rules)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_hot_urls_and_windows_and_the_held_out_error(spark, monkeypatch):
    from driftloom.llm import skew

    monkeypatch.setattr(skew, "PARTS", 8)
    r = random.Random(2)
    word = lambda letters: "".join(r.choice(letters) for _ in range(8))
    rows = [(i, f"http://good.org/{word('abcde')}/{word('abcde')}") for i in range(300)] + [(1000 + i, f"http://bad.com/de/{word('vwxyz')}/{word('vwxyz')}") for i in range(300)]
    rows += [(2000 + i, f"http://other.net/{word('abcde')}/{word('abcde')}") for i in range(30)] + [(3000 + i, f"http://other.net/{word('vwxyz')}/{word('vwxyz')}") for i in range(30)]
    rows += [(5000 + i, None) for i in range(400)]
    rules = [urlfilter.Rule("allow", "org", "/"), urlfilter.Rule("block", "com", "/de/")]
    df = spark.createDataFrame(rows, "page_id long, url string")
    got = {x["page_id"]: x["verdict"] for x in urlfilter.judge(df, rules).collect()}
    assert len(got) == len(rows)
    assert sum(got[2000 + i] == "allow" for i in range(30)) >= 28 and sum(got[3000 + i] == "block" for i in range(30)) >= 28
    ruled = df.select(urlfilter.host_of(F.col("url")).alias("host"), urlfilter.path_of(F.col("url")).alias("path"))
    ruled = ruled.withColumn("label", urlfilter.matched_rule(rules, F.col("host"), F.col("path"))["verdict"])
    _, errors = urlfilter.calibrate(urlfilter.scored_texts(ruled).where("label IS NOT NULL"))
    assert set(errors) == {"allow", "block"} and max(errors.values()) < 0.05


# --- embeddings -------------------------------------------------------------------------------------------------------


def test_embedding_dedup(spark):
    r = np.random.default_rng(3)
    base = r.normal(size=(60, 32))
    rows = []
    for i in range(700):
        v = base[0] if i % 3 == 0 else base[r.integers(60)]
        rows.append((i, [float(np.float32(c)) for c in v + r.normal(size=32) * r.choice([0.0, 0.05, 0.2, 0.4])]))
    odd = [(900, None), (901, [0.0] * 32), (902, [None] * 32), (903, [math.nan] * 32), (904, [1.0, 2.0]), (905, [2.0, 4.0]), (906, []), (None, [1.0] * 32), (907, [1e-300] * 32), (908, [1e300] * 32)]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows + odd], "vec_id long, embedding array<double>, n long")
    got = {x["vec_id"]: x for x in pqdedup.near_duplicates(df, 0.9, params=pqdedup.Params(block=64, lists=17, lengths=1)).collect()}
    x = np.array([v for _, v in rows])
    x /= np.linalg.norm(x, axis=1)[:, None]
    near = x @ x.T >= 0.9
    true, found = near.sum() - 700, sum(got[i]["n_links"] for i in range(700))
    assert 0.97 * true <= found <= true and all(got[i]["n_links"] <= near[i].sum() - 1 for i in range(700))
    assert got[905]["component_id"] == 904 and got[904]["n_links"] == 1 and not got[905]["kept"]
    assert got[908]["component_id"] == 907
    for i in (900, 901, 902, 903, 906):
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (0, i, True)
    assert got[None]["kept"] and got[None]["component_id"] is None
    assert pqdedup.near_duplicates(df.limit(0)).count() == 0


@pytest.mark.parametrize("lists,coarse", [(1100, 40), (30, 1024)])
def test_embedding_recall_over_many_lists(spark, lists, coarse):
    r = np.random.default_rng(1)
    base = r.normal(size=(700, 48))
    x = (base[r.integers(700, size=6000)] + r.normal(size=(6000, 48)) * r.choice([0.1, 0.2, 0.3, 0.35], size=6000)[:, None]).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = {t["vec_id"]: t["n_links"] for t in pqdedup.near_duplicates(df, 0.9, params=pqdedup.Params(lists=lists, coarse=coarse)).collect()}
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    true = (unit @ unit.T >= 0.9).sum(axis=1) - 1
    assert 0.95 * true.sum() <= sum(got.values()) <= true.sum() and all(got[i] <= true[i] for i in got)


# --- toxicity ---------------------------------------------------------------------------------------------------------


def test_toxicity_cases(spark, odd):
    r = random.Random(0)
    rows = [(i, " ".join(r.choice("the of and to".split()) for _ in range(30)) + (" awful" if i % 4 == 0 else ""), "e") for i in range(400)]
    docs = spark.createDataFrame(rows, DOCS)
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(400)] + [(None, 1), (3, None), (5000, 1)], "doc_id long, label int")
    weights = toxicity.train(docs, labels)
    got = toxicity.score(odd.unionByName(docs).withColumn("score", F.lit("clash")), weights)
    scores = {}
    for x in got.collect():
        scores.setdefault(x["doc_id"], set()).add(x["score"])
    assert all((min(scores[i]) >= 0.5) == (i % 4 == 0) for i in range(10, 400))
    assert scores[1] | scores[2] == scores[2] or len(scores[1]) == 2
    assert toxicity.score(docs.limit(0), weights).count() == 0
    none = toxicity.train(docs, labels.limit(0))
    assert len(none[0]) == 0 and {x["score"] for x in toxicity.score(docs, none).collect()} == {0.5}


def test_training_against_plain_ftrl(spark):
    """One update after the other, a feature at a time."""
    r = random.Random(7)
    rows = [(i, " ".join(r.choice("red green blue bad worse ugly good fine".split()) for _ in range(r.randrange(0, 9)))) for i in range(150)]
    rows += [(5, "bad again"), (5, "bad again"), (9, None)]
    own = [(i, int("bad" in (t or "") or "ugly" in (t or ""))) for i, t in rows[:150]]
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(own, "doc_id long, label int")
    p = toxicity.Params(l1=0.5, min_docs=2)
    names, w, bias = toxicity.train(docs, labels, p)
    order = {x["doc_id"]: x["h"] for x in docs.select("doc_id", F.xxhash64("doc_id").alias("h")).collect()}
    by_id = dict(own)
    found = [(order[i], next(toxicity.row_features(pa.array([t])), np.zeros(0, np.uint64)), by_id[i]) for i, t in rows]
    counts = {}
    for _, row, _ in found:
        for f in row.tolist():
            counts[f] = counts.get(f, 0) + 1
    known = sorted((f for f in counts if counts[f] >= p.min_docs))
    at = {f: k for k, f in enumerate(known)}
    lists = sorted((h, np.array([at[f] for f in row.tolist() if f in at], np.int32).tobytes(), y) for h, row, y in found)
    z, n = {}, {}

    def weight(f):
        zf, nf = z.get(f, 0.0), n.get(f, 0.0)
        if f == "bias":
            return -zf / ((p.beta + nf**0.5) / p.alpha)
        return 0.0 if abs(zf) <= p.l1 else -math.copysign(abs(zf) - p.l1, zf) / ((p.beta + nf**0.5) / p.alpha + p.l2)

    for _ in range(p.epochs):
        for _, packed, y in lists:
            fs = [*np.frombuffer(packed, np.int32).tolist(), "bias"]
            ws = [weight(f) for f in fs]
            g = 1 / (1 + math.exp(-sum(ws))) - y
            for f, wf in zip(fs, ws):
                nf = n.get(f, 0.0)
                z[f] = z.get(f, 0.0) + g - ((nf + g * g) ** 0.5 - nf**0.5) / p.alpha * wf
                n[f] = nf + g * g
    want = {f: weight(at[f]) for f in known if weight(at[f])}
    got = dict(zip(names.tolist(), w.tolist()))
    assert got.keys() == want.keys() and len(want) > 10 and all(abs(got[f] - want[f]) < 1e-9 for f in want) and abs(bias - weight("bias")) < 1e-9


def test_the_sample_is_bounded_though_ids_repeat(spark):
    docs = spark.createDataFrame([(i % 4, f"text {i}") for i in range(400)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(4)], "doc_id long, label int")
    assert toxicity._sample(docs, labels, toxicity.Params(max_rows=50), "doc_id", "text", "label").count() == 50
    assert toxicity._sample(docs, labels, toxicity.Params(max_rows=400), "doc_id", "text", "label").count() == 400


# --- packing ----------------------------------------------------------------------------------------------------------


def test_packing_cases(spark, odd):
    out = packing.pack_documents(odd, WORDS, 64, 1, with_ids=True).collect()
    assert sum(r["length"] for r in out if r["doc_id"] == 1) == 1 and sum(1 for r in out if r["doc_id"] == 7) == 2
    for i in (4, 5):
        own = sorted((r for r in out if r["doc_id"] == i), key=lambda r: r["piece"])
        assert [r["start"] for r in own] == [64 * k for k in range(len(own))] and all(len(r["ids"]) == 4 * r["length"] for r in own)
    bins = {}
    for r in out:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert all(sum(n for _, n in b) <= 64 and sorted(b)[0][0] == 0 for b in bins.values())
    assert packing.pack_documents(odd.limit(0), WORDS).count() == 0


def test_words_are_encoded_as_in_whole_texts():
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(WORDS)
    r = random.Random(8)
    bits = ["a", "B", "é", "ß", "İ", "Σ", "́", "don't", "12", "½", ",", ".", "<|endoftext|>", "<|STARTOFTEXT|>", " ", "\n", "\u00a0", "\x1c", "\x85", "日", "가", "ᄀ", "ᅡ", "K", "'s"]
    texts = ["".join(r.choice(bits) for _ in range(r.randrange(30))) for _ in range(3000)]
    got = packing.WordEncoder(WORDS).encode(texts)
    for text, ids in zip(texts, got):
        assert np.frombuffer(ids, "<u4").tolist() == tok.encode(text, add_special_tokens=False).ids, text


def test_genetic_packing_beats_best_fit():
    r = random.Random(1)
    triplets = []
    for _ in range(60):
        a = r.randrange(380, 490)
        b = r.randrange(250, (1000 - a) // 2 + 1)
        triplets += [a, b, 1000 - a - b]
    for lengths, capacity in ((triplets, 1000), ([r.randrange(1200, 1900) for _ in range(600)], 4096)):
        plain = packing.best_fit([], packing.longest_first(range(len(lengths)), lengths), lengths, capacity)
        assert len(plain) > -(-sum(lengths) // capacity)
        best, crossovers = packing.evolve(lengths, [], capacity, random.Random(2), 20)
        assert crossovers == 40 and len(best) < len(plain)
        assert sorted(i for _, held in best for i in held) == list(range(len(lengths)))
        assert all(fill == sum(lengths[i] for i in held) <= capacity for fill, held in best)


def test_genetic_packing_against_brute_force():
    def least(lengths, capacity):
        best = len(lengths)

        def put(i, bins):
            nonlocal best
            if len(bins) >= best:
                return
            if i == len(lengths):
                best = len(bins)
                return
            for b in range(len(bins)):
                if bins[b] + lengths[i] <= capacity:
                    put(i + 1, bins[:b] + [bins[b] + lengths[i]] + bins[b + 1 :])
            put(i + 1, [*bins, lengths[i]])

        put(0, [])
        return best

    r = random.Random(6)
    for seed in range(60):
        lengths = [r.choice([r.randrange(20, 60), r.randrange(1, 100)]) for _ in range(r.randrange(1, 11))]
        best, _ = packing.evolve(lengths, [], 100, random.Random(seed), 30)
        assert len(best) == least(lengths, 100), lengths


def test_every_shard_evolves_and_rounds_go_on_to_one(spark, monkeypatch):
    for name, value in (("SHARD", 60), ("LEAST_BINS", 4)):
        monkeypatch.setattr(packing, name, value)
    r = random.Random(3)
    lengths = [r.choice([100, r.randrange(1, 100), r.randrange(30, 50)]) for _ in range(700)]
    pieces = spark.createDataFrame(list(enumerate(lengths)), "uid long, length long")
    shards = 5
    elites = packing.evolved(pieces.where("length < 100").withColumn("shard", F.col("uid") % shards), shards, 100)
    seen = {(x["shard"], x["island"]) for x in elites.where(F.col("crossovers") == 2 * packing.GENERATIONS).collect()}
    assert seen == {(s, i) for s in range(shards) for i in range(packing.ISLANDS)} and elites.where("crossovers = 0").isEmpty()
    bins = {}
    for x in packing.pack(pieces, 100).collect():
        bins.setdefault(x["sequence_id"], []).append((x["offset"], lengths[x["uid"]]))
    assert sum(len(b) for b in bins.values()) == 700
    for held in bins.values():
        held.sort()
        assert held[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(held, held[1:])) and sum(n for _, n in held) <= 100
    plain = packing.best_fit([], packing.longest_first(range(700), lengths), lengths, 100)
    assert len(bins) <= len(plain) * 1.01 + 1


# --- chat -------------------------------------------------------------------------------------------------------------


def test_chat_is_reversible():
    r = random.Random(3)
    bits = [*chat.CONTROLS, " [/INST]\n", "</s>\n", "\\", "\n", " ", "a", "<", "[", "é"]
    for _ in range(4000):
        turns = [(r.choice(["user", "assistant", "system", "x\\<</ROLE>>", ""]), "".join(r.choice(bits) for _ in range(r.randrange(9)))) for _ in range(r.randrange(5))]
        text, spans = chat.render(turns)
        assert chat.parse(text) == turns
        assert [chat.unescape(text[a:b]) for a, b in spans] == [t for role, t in turns if role == "assistant"]


def test_templates():
    run = chat.compile_template('{% if true and not false %}{{ "a" + "b" }}{% else %}never{% endif %}{% for t in turns %}{% if t.role == "u" or t.text != "" %}[{{ t.text }}]{% elif t.role == "v" %}v{% endif %}{% endfor %}')
    assert run({"turns": [{"role": "u", "text": ""}, {"role": "v", "text": ""}, {"role": "w", "text": "{{ x }}"}]}) == ("ab[]v[{{ x }}]", [])
    folded = chat.fold(chat.parse_template('x{% if "a" == "a" %}{{ "y" }}{% endif %}z'))
    assert folded == chat.Block((chat.Put(chat.Text("xyz")),))
    for bad in ("{% if x %}", "{% endfor %}", "{{ x.__class__.y }}", "{{ f() }}", "{{ }}", "{% import os %}", "{% for x in y.z %}{% endfor %}", "{% generation %}{% generation %}"):
        with pytest.raises(chat.TemplateError):
            chat.compile_template(bad)
    assert chat.compile_template("{{ t.__class__ }}")({"t": "text"}) == ("", [])


def test_chat_cases(spark):
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", None), (2, None, None, "x"), (None, 0, "user", "u"), (3, 0, "user", "t"), (3, 0, "user", "t"), (4, 0, "assistant", "y" * 50_000)]
    df = spark.createDataFrame([(*r, "z") for r in rows], "conv_id long, turn long, role string, text string, formatted string")
    got = {r["conv_id"]: r for r in chat.read_back(chat.format_conversations(df)).collect()}
    assert [tuple(t) for t in got[1]["turns"]] == [("user", ""), ("assistant", "b")] and got[1]["loss_text"] == "b"
    assert [tuple(t) for t in got[2]["turns"]] == [("", "x")] and len(got[3]["turns"]) == 2 and got[None]["turns"][0]["text"] == "u"
    assert got[4]["loss_text"] == "y" * 50_000 and chat.format_conversations(df.limit(0)).count() == 0


def test_reading_back_what_nothing_wrote(spark):
    schema = "conv_id long, formatted string, loss_spans array<struct<start: long, end: long>>"
    rows = [(1, None, None), (2, "no control string", []), (3, "", []), (4, "a</s>\n", None), (5, "a</s>\n", [(0, 99)])]
    got = {r["conv_id"]: (r["turns"] and [tuple(t) for t in r["turns"]], r["loss_text"]) for r in chat.read_back(spark.createDataFrame(rows, schema)).collect()}
    assert got == {1: (None, None), 2: (None, ""), 3: ([], ""), 4: ([("assistant", "a")], ""), 5: ([("assistant", "a")], "a</s>\n")}
    with pytest.raises(chat.TemplateError):
        chat.format_conversations(spark.createDataFrame([], "conv_id long, turn long, role string, text string"), "{% for t in turns %}{{ t.text }}{% endfor %}", reversible=True)


# --- line dedup -------------------------------------------------------------------------------------------------------


def test_line_dedup(spark):
    common, near = "This line is shared by several documents", "  this LINE is shared by several documents\t"
    rows = [(1, common + "\nown\n" + common, "a"), (2, near, "b"), (3, "short\n" + common, "c"), (4, "two hold this line, not three of them\nshort", "d"), (5, "two hold this line, not three of them\nshort\n", "e"), (6, None, "f"), (7, "", "g"), (None, common, "h"), (2, "other\n" + common, "i")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_dropped string")
    got = {(r["doc_id"], r["text"], r["n_lines"], r["n_dropped"]) for r in linededup.drop_repeated_lines(df).collect()}
    assert got == {(1, "own", 3, 2), (2, "", 1, 1), (2, "other", 2, 1), (3, "short\n" + common, 2, 0), (4, rows[3][1], 2, 0), (5, rows[4][1], 3, 0), (6, "", 1, 0), (7, "", 1, 0), (None, common, 1, 0)}
    assert linededup.drop_repeated_lines(df.limit(0)).count() == 0


def test_runs_are_levelled(spark):
    runs = linededup.LineRuns(3)
    r = random.Random(0)
    want = {}
    for b in range(10):
        keys = {r.randrange(60) for _ in range(20)}
        for k in keys:
            n, top = want.get(k, (0, 0))
            want[k] = (n + 1, max(top, b))
        runs.add(spark.createDataFrame([(k, k, 1, 2, b) for k in keys], "h1 long, h2 long, n_docs long, n_lines long, keeper long"))
    # nine batches are three compactions of level 0 and one of level 1; the tenth lies at level 0 again
    assert runs.compactions == 4 and {level: len(x) for level, x in runs.levels.items()} == {0: 1, 1: 0, 2: 1}
    assert {x["h1"] for run in runs.runs() for x in run.bucketed.collect()} == set(want)
    assert {x["h1"]: (x["n_docs"], x["n_lines"] // 2, x["keeper"]) for x in runs.common(3).collect()} == {k: (v[0], *v) for k, v in want.items() if v[0] >= 3}
    a, b = (run.bucketed for run in runs.runs())
    plan = a.hint("merge").join(b.select("h1", "h2"), ["h1", "h2"], "left")._jdf.queryExecution().toString()
    assert "Exchange" not in plan and "SortMergeJoin" in plan


def test_line_dedup_with_several_compactions(spark):
    r = random.Random(5)
    lines = [f"this is the line with number {k} of them" for k in range(30)] + ["hot line that every document holds"] * 6
    rows = [(i, "\n".join(r.choice(lines) for _ in range(r.randrange(1, 12)))) for i in range(120)]
    holders = {}
    for i, text in rows:
        for line in text.split("\n"):
            holders.setdefault(line, set()).add(i)
    want = {i: "\n".join(x for x in text.split("\n") if len(holders[x]) < 3 or max(holders[x]) == i) for i, text in rows}
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for batches in (10, 1):
        assert {x["doc_id"]: x["text"] for x in linededup.drop_repeated_lines(df, batches=batches).collect()} == want


# --- clashing names ---------------------------------------------------------------------------------------------------


def test_stages_keep_columns_of_any_name(spark, sf, odd):
    import corpus_pipeline

    own = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang").limit(60)
    names = ["score", "N_lines", "n_dropped", "_row", "_doc", "_gone", "_lines", "rep", "cluster", "a.b", "uid", "h1"]
    docs = odd.unionByName(own).withColumn("n_chars", F.char_length("text").cast("long")).withColumns({n: F.concat(F.lit(n), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) for n in names})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, sf)
        assert kept.columns == docs.columns, name
        rows = kept.collect()
        assert rows and all(r[n] == f"{n}{'' if r['doc_id'] is None else r['doc_id']}" for r in rows for n in names), name
    assert corpus_pipeline.pack(spark, docs, sf).count() >= docs.count()


def test_outputs_replace_columns_in_any_case(spark, odd):
    docs = odd.withColumns({"N_TOKENS": F.lit("x"), "IDS": F.lit("x"), "Score": F.lit("x"), "N_Dropped": F.lit("x")})
    assert dict(tokencount.count_tokens(docs, PIECES).dtypes).keys() == {"doc_id", "text", "lang", "IDS", "Score", "N_Dropped", "n_tokens"}
    assert bpe.encode(docs, BYTES, P.PATTERN).select("ids").dtypes == [("ids", "binary")]
    weights = (np.zeros(0, np.uint64), np.zeros(0), 0.0)
    assert [r["score"] for r in toxicity.score(docs, weights).select("score").collect()] == [0.5] * 10
    assert linededup.drop_repeated_lines(docs).select("n_dropped").dtypes == [("n_dropped", "bigint")]
