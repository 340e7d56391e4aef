import random

import numpy as np
import pytest
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st

from strandloom.llm import token_frames as T

from .common import LONG, awkward, clashing, sentence, table

ENCODER = T.encoder_of(T.TOKENIZER)


def check(texts, encoder=ENCODER):
    ids, bounds = encoder.encode(texts)
    for k, t in enumerate(texts):
        assert ids[bounds[k] : bounds[k + 1]].tolist() == encoder.bpe.encode_ordinary(t or "")


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet=st.characters(exclude_categories=["Cs"]), max_size=40), st.text(alphabet=" ab'sé 　\n\t1.Ã", max_size=40)), min_size=1, max_size=6))
def test_tokens_equal_plain_encoding(texts):
    check(texts)


def test_long_and_repeated_texts():
    rng = random.Random(1)
    small = T.Encoder(T.TOKENIZER, most_pieces=50)
    for _ in range(3):
        texts = [sentence(rng, "fr", 300), sentence(rng, "de", 300), LONG[:20000], " " * 300 + "x"]
        check(texts)
        check(texts, small)


def test_shards_read_back(spark):
    docs = table(spark, awkward()).repartition(2)
    shards = T.write_shards(clashing(docs), shard_bytes=4000).cache()
    assert shards.count() > 1
    got = sorted(((r.doc_id, list(r.tokens)) for r in T.read_documents(shards).collect()), key=repr)
    assert got == sorted(((r.doc_id, ENCODER.bpe.encode_ordinary(r.text or "")) for r in docs.collect()), key=repr)
    wanted = table(spark, [(7,), (8,), (99,)], "doc_id long")
    assert {r.doc_id for r in T.read_documents(shards, wanted).collect()} == {7, 8}
    assert T.write_shards(table(spark, [])).count() == 0


def shard():
    w = T.ShardWriter()
    for k in range(20):
        w.add(None if k == 3 else k, np.arange(k * 50, dtype="<u2"))
    return w.close()


def test_frames_are_standard_and_independent():
    data = shard()
    table_ = T.seek_table(data)
    assert len(table_) == 21
    ids, dtype = T.directory(T.read_frames(data, [0])[0])
    assert dtype == np.dtype("<u2") and ids.tolist() == [T.NULL_ID if k == 3 else k for k in range(20)]
    # whatever happens to other frames, one can be read
    broken = bytearray(data)
    at = table_[5, 0]
    broken[at : at + table_[5, 1]] = bytes(int(table_[5, 1]))
    assert np.frombuffer(T.read_frames(bytes(broken), [8])[0], "<u2").tolist() == list(range(350))
    with pytest.raises((ValueError, zstandard.ZstdError)):
        T.read_frames(bytes(broken), [5])
    reader = zstandard.ZstdDecompressor().stream_reader(data, read_across_frames=True)
    assert len(reader.read()) == table_[:, 2].sum()


@pytest.mark.parametrize("damage", [lambda d: d[:-1], lambda d: d[:-9] + b"\0" * 9, lambda d: d[:100] + d[101:]])
def test_damaged_tables_are_refused(damage):
    with pytest.raises(ValueError):
        T.whole_table(damage(shard()))


def test_wide_tokens_and_files(spark, tmp_path):
    w = T.ShardWriter(dtype="<u4")
    for k in (5, 6, None):
        w.add(k, np.array([1 << 20, k or 0]))
    (tmp_path / "x.tok.zst").write_bytes(w.close())
    got = [(i, x.tolist()) for i, x in T.read_file(str(tmp_path / "x.tok.zst"))]
    assert got == [(5, [1 << 20, 5]), (6, [1 << 20, 6]), (None, [1 << 20, 0])]
    assert [i for i, _ in T.read_file(str(tmp_path / "x.tok.zst"), {6, 99})] == [6]
    wide = spark.createDataFrame([("x", 3, 6, [5, 6, None], bytearray((tmp_path / "x.tok.zst").read_bytes()))], T.RESULT)
    assert {(r.doc_id, tuple(r.tokens)) for r in T.read_documents(wide).collect()} == {(5, (1 << 20, 5)), (6, (1 << 20, 6)), (None, (1 << 20, 0))}
    docs = table(spark, awkward())
    paths = [r.path for r in T.save(T.write_shards(docs, shard_bytes=4000), str(tmp_path / "shards")).collect()]
    assert len(paths) > 1
    read = sorted(((i, x.tolist()) for p in paths for i, x in T.read_file(p)), key=repr)
    assert read == sorted(((r.doc_id, ENCODER.bpe.encode_ordinary(r.text or "")) for r in docs.collect()), key=repr)
    for bad in (b"", b"short", w.close()[:-20]):
        (tmp_path / "bad").write_bytes(bad)
        with pytest.raises(ValueError):
            list(T.read_file(str(tmp_path / "bad")))


def test_wrong_checksum_is_found():
    data = bytearray(shard())
    data[-9 - 12 * 4 + 8] ^= 1  # the checksum of the fourth frame from the end
    with pytest.raises(ValueError, match="damaged"):
        T.read_frames(bytes(data), [17])
