import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from driftloom.llm import queries, wavelet

WORDS = P.path("word_bpe_49k.json")


@given(st.lists(st.lists(st.sampled_from([0, 1, 2, 3, 5, 8, 300, 49_407, 70_000]), max_size=300), max_size=6))
@settings(max_examples=60, deadline=None)
def test_shard_against_plain_arrays(docs):
    shard = wavelet.Shard.from_bytes(wavelet.Shard.of(pa.array(range(len(docs)), pa.int64()), [np.array(d, np.uint32) for d in docs]).to_bytes())
    flat = np.array([i for d in docs for i in d], dtype=np.int64)
    assert shard.n == len(flat) and shard.doc_ids.to_pylist() == list(range(len(docs)))
    assert (shard.decode() == flat).all() and (shard.access(np.arange(len(flat))) == flat).all()
    low, high = len(flat) // 3, len(flat) - len(flat) // 5
    for token in {*flat.tolist(), 4}:
        assert shard.places(token).tolist() == np.flatnonzero(flat == token).tolist()
        assert shard.count(token, low, high) == int((flat[low:high] == token).sum())
        assert shard.places(token, low, high).tolist() == [k for k in range(low, high) if flat[k] == token]


def test_planes_of_several_blocks():
    r = np.random.default_rng(2)
    for n, share in ((0, 0.5), (1, 1.0), (512, 0.0), (513, 0.5), (5000, 0.01), (4096, 0.97)):
        bits = r.random(n) < share
        plane = wavelet.Plane.of(bits)
        assert (plane.bits() == bits).all() and plane.zeros == int((~bits).sum())
        assert plane.rank(np.arange(n + 1)).tolist() == [0, *np.cumsum(bits).tolist()]
        for one in (True, False):
            want = np.flatnonzero(bits == one)
            assert plane.select(np.arange(len(want)), one).tolist() == want.tolist()


def test_no_other_format_is_read():
    with pytest.raises(ValueError):
        wavelet.Shard.from_bytes(b"PAR1" + bytes(60))


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    """Documents with odd texts and ids, their ids by the library, and the folder that they were written to in small shards."""
    long = " ".join(f"w{k % 97}x{k}" for k in range(5_000))
    rows = [(k, f"Some words, again {k % 7} and {k}!" * (k % 5), "en") for k in range(10, 300)]
    rows += [(1, None, "en"), (2, "", "en"), (3, " \n\t", "en"), (4, long, "en"), (None, "no id", "x"), (7, "a b c", "x"), (7, "a b c", "x"), (7, "d", "x"), (-5, "<|startoftext|> é 日本", "y")]
    folder = str(tmp_path_factory.mktemp("tokens") / "out")
    size = wavelet.SHARD
    wavelet.SHARD = 700
    try:
        wavelet.write_shards(spark.createDataFrame(rows, "doc_id long, text string, data string"), WORDS, folder)
    finally:
        wavelet.SHARD = size
    tok = Tokenizer.from_file(WORDS)
    return [(i, tok.encode(t or "", add_special_tokens=False).ids + [1]) for i, t, _ in rows], folder


def test_documents_come_back(spark, stored):
    docs, folder = stored
    got = sorted(wavelet.documents(spark, folder, with_ids=True).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == sorted((i for i, _ in docs), key=lambda i: -(10**9) if i is None else i)
    at = 0
    left = {}
    for i, ids in docs:
        left.setdefault(i, []).append(ids)
    for r in got:
        ids = np.frombuffer(r["ids"], "<u4").tolist()
        left[r["doc_id"]].remove(ids)
        assert r["start"] == at and r["n_tokens"] == len(ids) and r["ids_crc32"] == zlib.crc32(r["ids"])
        at += len(ids)
    assert not any(left.values())


def test_lookups(spark, stored):
    docs, folder = stored
    common = docs[5][1][0]
    counts = {r["token"]: r["n"] for r in wavelet.count_ids(spark, folder, [1, common, 49_000, 1]).collect()}
    assert counts == {t: sum(ids.count(t) for _, ids in docs) for t in (1, common, 49_000)}
    found = sorted((str(r["doc_id"]), r["offset"]) for r in wavelet.find_ids(spark, folder, [common]).collect())
    assert found == sorted((str(i), k) for i, ids in docs for k, t in enumerate(ids) if t == common)
    wanted = [(4, 0), (4, 4_000), (4, 10**9), (12, 3), (None, 0), (77, -1), (77, 0), (77, 0), (9999, 0)]
    got = sorted((r["doc_id"], r["offset"], r["token"]) for r in wavelet.ids_at(spark.createDataFrame(wanted, "doc_id long, offset long"), folder).collect())
    own = dict(docs)
    assert got == [(i, k, own[i][k]) for i, k in ((4, 0), (4, 4_000), (12, 3), (77, 0))]


def test_empty_table(spark, tmp_path):
    wavelet.write_shards(spark.createDataFrame([], "doc_id long, text string"), WORDS, f"{tmp_path}/out")
    assert wavelet.documents(spark, f"{tmp_path}/out").count() == 0


def test_query_against_the_library(spark, sf, duck):
    tok = Tokenizer.from_file(WORDS)
    got = {r["doc_id"]: r for r in queries.QUERIES["op13_token_output"](spark, sf).collect()}
    at = 0
    for i, text in duck.execute("SELECT doc_id, coalesce(text, '') FROM documents ORDER BY doc_id").fetchall():
        ids = tok.encode(text, add_special_tokens=False).ids + [1]
        r = got.pop(i)
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert not got
