import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from driftloom.llm import textkernel

TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet=" \t\n\x0b\x0c\rabAB.é日 \x1c", max_size=40)), max_size=12)


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()


@given(TEXTS)
@settings(max_examples=200, deadline=None)
def test_words_are_runs_between_ascii_space(texts):
    names, seen = {}, set()
    for at, end, raw, offsets in textkernel.slices(pa.array(texts, pa.string())):
        words, first = textkernel.word_hashes(raw, offsets)
        for i in range(end - at):
            want, got = lowered(texts[at + i]), words[first[i] : first[i + 1]]
            assert len(got) == len(want)
            for word, h in zip(want, got.tolist()):
                assert names.setdefault(word, h) == h
            seen.add(at + i)
    assert len(set(names.values())) == len(names) and seen == set(range(len(texts)))


def test_slices_cover_long_texts_whole(monkeypatch):
    monkeypatch.setattr(textkernel, "SLICE_BYTES", 64)
    texts = ["a b c " * 50, "", None, "x" * 300, "y z"] * 3
    got = [(at, end) for at, end, _, _ in textkernel.slices(pa.chunked_array([texts[:4], texts[4:]]))]
    assert got[0][0] == 0 and got[-1][1] == 15 and all(a[1] == b[0] for a, b in zip(got, got[1:]))


def test_shingles():
    w = np.arange(1, 8, dtype=np.uint64)
    assert len(textkernel.shingle_hashes(w, 4)) == 4 and len(textkernel.shingle_hashes(w[:2], 4)) == 1 and len(textkernel.shingle_hashes(w[:0], 4)) == 0
    assert textkernel.shingle_hashes(w, 4)[1] == textkernel.shingle_hashes(w[1:5], 4)[0]
    assert textkernel.shingle_hashes(w[:2], 4)[0] != textkernel.shingle_hashes(w[:3], 4)[0]
