import zlib

import pytest
from compare import same_rows

from driftloom.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_against_sql(name, spark, sf, duck):
    assert same_rows(queries.QUERIES[name](spark, sf), duck, queries.ORACLE_SQL[name]) > 0


def test_byte_bpe_against_the_library(spark, sf, duck):
    import base64
    import hashlib

    import numpy as np
    import public_tokenizers as P
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = dict(duck.execute("SELECT doc_id, coalesce(text, '') FROM documents").fetchall())
    got = {r["doc_id"]: r for r in queries.QUERIES["op3_byte_bpe"](spark, sf).collect()}
    assert got.keys() == texts.keys()
    for i, text in texts.items():
        ids = own.encode_ordinary(text)
        assert got[i]["n_tokens"] == len(ids)
        assert got[i]["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()


def test_packing_against_the_library(spark, sf, duck):
    import numpy as np
    import public_tokenizers as P
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    rows = queries.QUERIES["op7_packing"](spark, sf).collect()
    texts = dict(duck.execute("SELECT doc_id, coalesce(text, '') FROM documents").fetchall())
    pieces = {}
    for r in rows:
        pieces.setdefault(r["doc_id"], []).append(r)
    assert pieces.keys() == texts.keys()
    for i, own in pieces.items():
        ids = tok.encode(texts[i], add_special_tokens=False).ids + [1]
        own.sort(key=lambda r: r["piece"])
        assert [r["piece"] for r in own] == list(range(-(-len(ids) // 4096)))
        for r in own:
            part = ids[r["start"] : r["start"] + r["length"]]
            assert r["start"] == 4096 * r["piece"] and len(part) == r["length"] == min(4096, len(ids) - r["start"])
            assert r["ids_crc32"] == zlib.crc32(np.array(part, "<u4").tobytes())
    bins = {}
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for held in bins.values():
        held.sort()
        assert held[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(held, held[1:])) and sum(n for _, n in held) <= 4096
    assert len(bins) <= -(-sum(r["length"] for r in rows) // 4096) + 1


def test_toxicity_on_the_held_out_fold(spark, sf, duck):
    rows = {r["doc_id"]: r for r in queries.QUERIES["op6_toxicity"](spark, "/root/testdata/sf0.1").collect()}
    import duckdb

    labels = dict(duckdb.execute("SELECT doc_id, toxic FROM '/root/testdata/sf0.1/labels.parquet'").fetchall())
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for i, r in rows.items())
    held = [(rows[i]["predicted"], y) for i, y in labels.items() if rows[i]["held_out"]]
    # about an eighth of the toxic labels there are on texts without any word that marks others
    assert sum(p for p, y in held if y) >= 0.8 * sum(y for _, y in held)
    assert sum(p for p, y in held if not y) <= 0.01 * sum(1 - y for _, y in held)


def test_token_counts_against_the_library(spark, sf, duck):
    import public_tokenizers as P
    from tokenizers import Tokenizer, models, normalizers

    from driftloom.llm.tokencount import MARK, read_pieces

    tok = Tokenizer(models.Unigram(read_pieces(P.path("piece_bpe_32k.model")), 0, True))
    tok.normalizer = normalizers.Sequence([normalizers.Prepend(MARK), normalizers.Replace(" ", MARK)])
    texts = dict(duck.execute("SELECT doc_id, coalesce(text, '') FROM documents").fetchall())
    got = {r["doc_id"]: r["n_tokens"] for r in queries.QUERIES["op10_token_count"](spark, sf).collect()}
    assert got == {i: len(tok.encode(t, add_special_tokens=False).ids) for i, t in texts.items()}


def test_pipeline_against_its_stages_by_hand(spark, sf, duck):
    import corpus_pipeline
    from pyspark.sql import functions as F

    from driftloom.llm import toxicity

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = corpus_pipeline.drop_toxic(spark, docs, sf)
    assert kept.columns == docs.columns
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", F.col("toxic").alias("label")).where(~toxicity.held_out())
    scores = {r["doc_id"]: r["score"] for r in toxicity.score(docs, toxicity.train(docs, labels)).collect()}
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    texts = {i: t for i, t in texts.items() if scores[i] < 0.5}
    assert {r["doc_id"] for r in kept.collect()} == set(texts)
    # line dedup
    strip = " \t\n\x0b\x0c\r"
    key = lambda line: "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(strip))
    holders = {}
    for i, t in texts.items():
        for line in t.split("\n"):
            holders.setdefault(key(line), set()).add(i)
    gone = lambda i, k: len(k) >= 20 and len(holders[k]) >= 3 and max(holders[k]) != i
    texts = {i: "\n".join(x for x in t.split("\n") if not gone(i, key(x))) for i, t in texts.items()}
    # near copies by four words
    sets = {}
    for i, t in texts.items():
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in t).encode().split()
        sets[i] = {tuple(w[k : k + 4]) for k in range(max(1, len(w) - 3))} if w else set()
    up = {i: i for i in texts}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    order = sorted(texts)
    for a in order:
        for b in order:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                up[y] = x
    want = {i for i in texts if root(i) == i}
    out = corpus_pipeline.run(spark, sf).collect()
    assert {r["doc_id"] for r in out} == want
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "minhash_dedup", "packing"]
    import public_tokenizers as P

    from driftloom.llm.packing import WordEncoder

    total = {}
    for r in out:
        total[r["doc_id"]] = total.get(r["doc_id"], 0) + r["length"]
    ids = WordEncoder(P.path("word_bpe_49k.json")).encode([texts[i] for i in sorted(want)])
    assert [total[i] for i in sorted(want)] == [len(x) // 4 + 1 for x in ids]
