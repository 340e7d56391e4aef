"""The pipeline, stage by stage, against what each stage may and must do."""

import random
from collections import Counter

import pytest

import __spark_entry__ as entry
import corpus_pipeline as P
from strandloom.llm import token_frames

from .common import awkward, sentence, table


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(7)
    items = [(k, sentence(rng, n=40)) for k in range(5)]
    docs = [(100 + k, sentence(rng, rng.choice(["en", "fr", "de"]), 120)) for k in range(150)]
    langs = {i: rng.choice(["en"]) for i, _ in docs}
    docs += [(300 + k, docs[k][1] + " one more") for k in range(20)]  # near copies
    docs += [(400 + k, sentence(rng, n=40) + " " + items[k][1] + " " + sentence(rng, n=40)) for k in range(5)]
    docs += [(500 + k, "漢字 かな 交じり 文" * 9) for k in range(3)]
    rows = [(i, t, langs.get(i), f"s{i % 3 if i % 5 else 0}", len(t)) for i, t in docs] + awkward()
    d = str(tmp_path_factory.mktemp("pipe"))
    table(spark, rows).write.parquet(d + "/documents.parquet")
    table(spark, items, "item_id long, text string").write.parquet(d + "/benchmark.parquet")
    return d


def test_stages(spark, folder):
    docs = spark.read.parquet(folder + "/documents.parquet")
    columns, seen = docs.dtypes, []
    for number, (name, stage) in enumerate(P.STAGES):
        path = f"{folder}/{number}-{name}"
        stage(spark, docs, folder).write.parquet(path)
        docs = spark.read.parquet(path)
        seen.append([r.doc_id for r in docs.collect()] if number < 4 else docs)
        assert number == 4 or docs.dtypes == columns
    language, unique, clean, mixed = map(Counter, seen[:4])
    assert not [i for i in language if i in (500, 501, 502, 3, 4, 5, 6)] and all(language[i] for i in range(100, 250))
    assert all(unique[300 + k] + unique[100 + k] == 1 for k in range(20)) and unique[1] + unique[2] + unique[None] == 1
    assert not any(clean[400 + k] for k in range(5)) and sum(unique.values()) - sum(clean.values()) == 5
    assert set(mixed) <= set(clean)
    back = Counter(r.doc_id for r in token_frames.read_documents(seen[4]).collect())
    assert back == mixed


def test_run_and_registration(spark, folder):
    assert P.run(spark, folder).select("n_docs").agg({"n_docs": "sum"}).first()[0] > 100
    names = entry.queries()
    assert "pipeline" in names and all(any(x.startswith(f"op{n}_") for x in names) for n in range(1, 11))


@pytest.mark.parametrize("name", ["op3_embedding_tiles", "embedding_tiles_loose", "op8_line_dedup", "op10_warc_zstd"])
def test_queries_equal_their_sql(spark, sf, name):
    from tests.compare import connect, same

    rows = same(entry.queries()[name](spark, sf), connect(sf), entry.oracle_sql()[name])
    assert rows > 0 or name == "op3_embedding_tiles"  # these vectors have no near-duplicates, which is why there is the loose one
