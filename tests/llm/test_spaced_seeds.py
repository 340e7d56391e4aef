import itertools
import random
import tracemalloc

import numpy as np
import pytest

from strandloom.llm import bloom
from strandloom.llm import spaced_seeds as S

from .common import awkward, clashing, rows_of, sentence, table, tokens

ITEMS = "item_id long, text string"


@pytest.fixture(scope="module")
def planted():
    rng = random.Random(9)
    items = [(k, sentence(rng, n=rng.choice([6, 9, 15, 25, 50]))) for k in range(40)]
    docs, truth = [], {}
    for d in range(200):
        words = sentence(rng, n=200).split()
        if d % 2:
            k = rng.randrange(40)
            part = items[k][1].split()
            if len(part) >= 15:
                for at in rng.sample(range(len(part)), rng.choice([0, 1, 2])):
                    part[at] = "other"
            words[50:50] = part
            truth[d] = k
        docs.append((d, " ".join(words), "en", "s", None))
    return docs, items, truth


def brute(doc, item, min_match=13, min_identity=0.75):
    """All diagonals, all stretches by the same score."""
    a, b = np.array([hash(x) for x in tokens(doc)]), np.array([hash(x) for x in tokens(item)])
    return S.overlaps(a, b, list(range(-len(b) + 1, len(a))), min_match, min_identity)


def test_equals_all_diagonals(spark, planted):
    docs, items, truth = planted
    got = {(r.doc_id, r.item_id): r for r in S.contaminated(table(spark, docs), table(spark, items, ITEMS)).collect()}
    assert all((d, k) in got for d, k in truth.items())
    want = {(d, k): brute(t, x) for (d, t, *_), (k, x) in itertools.product(docs, items)}
    want = {k: v for k, v in want.items() if v}
    assert len(set(want) & set(got)) >= 0.98 * len(want) and set(got) <= set(want)
    assert all(got[k].n_match == want[k][3] for k in set(got) & set(want))
    kept = {r.doc_id for r in S.drop_contaminated(table(spark, docs), table(spark, items, ITEMS)).collect()}
    assert kept == {d for d, *_ in docs} - {d for d, _ in got}


def test_masks_survive_two_substitutions():
    for n in (15, 20):
        for gone in itertools.combinations(range(n), 2):
            assert any(all(o + i not in gone for i in S._offsets(m)) for m in S.MASKS for o in range(n - len(m) + 1))


def test_short_items_survive_all_that_verification_accepts(spark):
    rng = random.Random(17)
    items = [(n, " ".join(f"w{n}x{k}" for k in range(n))) for n in range(3, 17)]
    docs, truth = [], set()
    for n, text in items:
        lost = n - S.needed(n, 13)
        for gone in itertools.combinations(range(n), lost):
            words = ["other" if k in gone else w for k, w in enumerate(text.split())]
            i = len(docs)
            docs.append((i, f"{sentence(rng, n=20)} {' '.join(words)} {sentence(rng, n=20)}", "en", "s", None))
            if n >= 5 and brute(docs[i][1], text):
                truth.add((i, n))
    got = {(r.doc_id, r.item_id) for r in S.contaminated(table(spark, docs), table(spark, items, ITEMS)).collect()}
    assert got == truth and len(truth) > 300
    least = {r.item_id for r in S.contaminated(table(spark, docs), table(spark, items, ITEMS), min_item=3).collect()}
    assert least == set(range(3, 17))


def test_awkward_rows(spark):
    docs = table(spark, awkward())
    same = awkward()[0][1]
    items = table(spark, [(1, same), (1, same), (None, same), (2, None), (3, ""), (4, "one"), (5, "...")], ITEMS)
    found = S.contaminated(docs, items)
    # four rows with the text, three equal items
    assert found.count() == 4 * 3 and rows_of(found.select("doc_id").distinct()) == [(1,), (2,), (None,)]
    kept = S.drop_contaminated(clashing(docs), items)
    assert kept.columns == clashing(docs).columns and kept.count() == docs.count() - 4
    empty = table(spark, [])
    assert S.contaminated(empty, items).count() == 0 == S.contaminated(docs, table(spark, [], ITEMS)).count()
    assert S.drop_contaminated(docs, table(spark, [], ITEMS)).count() == docs.count()


def test_no_seed_is_lost_in_the_bitmap(spark, planted):
    _, items, _ = planted
    seeds = S._seed_table(table(spark, items, ITEMS).selectExpr("item_id AS item", "text AS t"), {9: S.masks_of(9, 13)})
    bits = bloom.bitmap(seeds)
    h = np.array([r.h for r in seeds.collect()]).view(np.uint64)
    for b in bloom.bits(h):
        assert (bits[b >> 3] >> (b & 7).astype(np.uint8) & 1).all()


def test_memory_of_the_search_does_not_grow_with_the_masks():
    """Items of 5 to 16 tokens have 65 masks between them; a megabyte of text has 170,000 windows for each."""
    rng = random.Random(41)
    doc = S.Tokens([" ".join("".join(rng.choices("abcdefgh", k=5)) for _ in range(30_000)) for _ in range(6)])
    masks = (*S.MASKS, *itertools.chain.from_iterable(S.masks_of(n, 13) for n in range(5, 17)))
    h, text, at = S.seeds(doc, masks)
    own = np.sort(np.random.default_rng(1).choice(len(h), 500, replace=False))
    bits = np.zeros(1 << (bloom.BITS - 3), dtype=np.uint8)
    for b in bloom.bits(h[own]):
        np.bitwise_or.at(bits, b >> 3, np.uint8(1) << (b & 7).astype(np.uint8))
    want = bloom.probe(bits, h)
    assert set(own) <= set(want) and len(want) < 2000
    want = [x[want] for x in (h, text, at)]
    del h, text, at
    tracemalloc.start()
    try:
        got = S.probed(doc, masks, bits)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert all(np.array_equal(a, b) for a, b in zip(got, want)) and peak < 30 << 20
