import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from strandloom.llm.textkit import Tokens, chunks, span_hashes, unique_by_text, windows

from .common import tokens

TEXTS = st.lists(st.one_of(st.none(), st.text(max_size=60)), min_size=1, max_size=8)


@settings(max_examples=150, deadline=None)
@given(TEXTS)
def test_tokens_are_those_of_the_regular_expression(texts):
    t = Tokens(texts)
    got = [[bytes(t.data[t.starts[k] : t.ends[k]]).decode() for k in range(t.offsets[n], t.offsets[n + 1])] for n in range(len(texts))]
    assert got == [[w.encode("utf-8", "replace").decode() for w in tokens(x.encode("utf-8", "replace").decode() if x else x)] for x in texts]


@settings(max_examples=100, deadline=None)
@given(TEXTS)
def test_hashes_depend_on_the_token_alone(texts):
    together, seen = Tokens(texts), {}
    for n, x in enumerate(texts):
        alone = Tokens([x])
        assert (alone.hashes == together.hashes[together.offsets[n] : together.offsets[n + 1]]).all()
        for w, h in zip(tokens(x), alone.hashes):
            assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)


def test_windows_stay_inside_texts():
    t = Tokens(["a b c", "", "a b", "x a b c"])
    v, text = windows(t.hashes, t.offsets, 3)
    assert text.tolist() == [0, 3, 3] and v[0] == v[2] != v[1]
    v, text = unique_by_text(*windows(t.hashes, t.offsets, 1))
    assert np.bincount(text).tolist() == [3, 0, 2, 4]


def test_chunks_cover_all_rows():
    batch = pa.RecordBatch.from_arrays([pa.array(["a" * n if n % 3 else None for n in range(50)]), pa.array(range(50))], ["t", "k"])
    parts = list(chunks(iter([batch]), "t", 100))
    assert [k for p in parts for k in p.column("k").to_pylist()] == list(range(50)) and len(parts) > 5


def test_two_bases_differ():
    data = np.frombuffer(b"abcabc", np.uint8)
    a, b = np.array([0, 3]), np.array([3, 6])
    assert span_hashes(data, a, b)[0] == span_hashes(data, a, b)[1] != span_hashes(data, a, b, second=True)[0]
