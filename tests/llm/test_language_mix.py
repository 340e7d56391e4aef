import math
import random
import re

import numpy as np
import pytest

from strandloom.llm import language_mix as L

from .common import awkward, clashing, rows_of, sentence, table


@pytest.fixture(scope="module")
def labelled():
    rng = random.Random(1)
    return [(k, sentence(rng, lang, 80), lang, "s", None) for k, lang in enumerate(["en", "fr", "de"] * 60)]


@pytest.fixture(scope="module")
def model(spark, labelled):
    return L.train(table(spark, labelled))


def test_held_out_accuracy_and_mixtures(model):
    rng = random.Random(2)
    texts = [sentence(rng, lang, 50) for lang in ("en", "fr", "de") for _ in range(30)]
    shares, _ = L.infer(texts, model)
    names = [*model.languages, L.UND]
    assert np.mean([names[k] == lang for k, lang in zip(shares.argmax(1), np.repeat(["en", "fr", "de"], 30))]) >= 0.98
    mixed, _ = L.infer([sentence(rng, "en", 200) + " " + sentence(rng, "de", 100)], model)
    got = dict(zip(names, mixed[0]))
    assert abs(got["en"] - 2 / 3) < 0.12 and abs(got["de"] - 1 / 3) < 0.12 and got["fr"] == 0


def test_batched_em_equals_a_plain_loop(model):
    rng = random.Random(4)
    texts = [sentence(rng, "en", 30) + " " + sentence(rng, "fr", n) for n in (1, 10, 30, 90)]
    buckets, first, offsets = L._grams(texts)
    score = np.add.reduceat(model.table[buckets], first, axis=0)
    p = np.exp(np.maximum(score - score.max(1, keepdims=True), -12)).astype(np.float32)
    doc = np.repeat(np.arange(4), np.diff(offsets))
    got = L._em(p, doc, offsets[:-1], np.ones((4, p.shape[1])), 400, 1e-7)
    for d in range(4):
        w = np.full(p.shape[1], 1 / p.shape[1])
        for _ in range(400):
            r = p[doc == d] * w
            w = (r / r.sum(1, keepdims=True)).mean(0)
        assert np.abs(got[d] - w).max() < 2e-3


def plain(text, model, penalty=3.0, rounds=60, tolerance=1e-3):
    """The whole inference of one text by loops over words and nested sets, as the docstring has it."""
    words = re.findall("[a-z\u0080-\U0010ffff]+", (text or "").lower())
    parts = len(model.languages) + 1
    if not words:
        return None, 0
    p = []
    for w in words:
        data = b" " + w.encode() + b" "
        total = np.zeros(parts)
        for k in range(1, len(data) - 1):
            code = (data[k - 1] << 16 | data[k] << 8 | data[k + 1]) & 0xFFFFFFFF
            total += model.table[(code * 2654435761 & 0xFFFFFFFF) >> 16]
        p.append(np.exp(np.maximum(total - total.max(), -12)))

    def em(members):
        share = {m: 1 / len(members) for m in members}
        for _ in range(rounds):
            new = dict.fromkeys(members, 0.0)
            for x in p:
                whole = sum(x[m] * share[m] for m in members)
                for m in members:
                    new[m] += x[m] * share[m] / max(whole, 1e-30) / len(p)
            moved = max(abs(new[m] - share[m]) for m in members)
            share = new
            if moved <= tolerance:
                break
        return share, sum(math.log(max(sum(x[m] * share[m] for m in members), 1e-30)) for x in p)

    cost = penalty * math.log(len(p) + 1)
    alone = [sum(math.log(x[m]) for x in p) for m in range(parts)]
    best = ({int(np.argmax(alone)): 1.0}, max(alone) - cost)
    order = sorted(range(parts), key=lambda m: -em(range(parts))[0][m])
    for k in range(2, parts + 1):
        share, likelihood = em(order[:k])
        if likelihood - k * cost > best[1]:
            best = (share, likelihood - k * cost)
    return best[0], len(words)


def test_sets_and_shares_equal_a_plain_loop(spark, model):
    """The query as a whole: which set the penalised likelihood selects, its shares, and what is accepted."""
    rng = random.Random(14)
    texts = [sentence(rng, "en", 40), sentence(rng, "en", 40) + " " + sentence(rng, "de", 40), " ".join(sentence(rng, x, 30) for x in ("en", "fr", "de")), "xqzj kwvv zzzx qqkw " * 5, sentence(rng, "fr", 30) + " " + "xqzj kwvv zzzx qqkw " * 8, "der", "", None, "12 34"]
    rows = [(k, t, None, None, None) for k, t in enumerate(texts)]
    got = {r.doc_id: r for r in L.language_mix(table(spark, rows), model).collect()}
    names = [*model.languages, L.UND]
    for k, t in enumerate(texts):
        share, n = plain(t, model)
        assert got[k].n_words == n
        if share is None:
            assert got[k].lang is None and got[k].languages is None and not got[k].accepted
            continue
        found = {x.split(":")[0]: float(x.split(":")[1]) for x in got[k].languages.split(",")}
        assert set(found) == {names[m] for m, w in share.items() if w > 0} and all(abs(found[names[m]] - w) < 5e-3 for m, w in share.items())
        assert got[k].accepted == (sum(w for m, w in share.items() if names[m] != L.UND) >= 0.5)


def test_unknown_text_is_rejected(model):
    shares, n = L.infer(["これは日本語の文章です 東京 漢字", "xqzj kwvv zzzx qqkw vvbx jjkk qwxz", "123 456"], model)
    assert shares[:2, -1].min() > 0.5 and n[2] == 0 and shares[2].sum() == 0


def test_awkward_rows(spark, model):
    docs = table(spark, awkward())
    found = L.language_mix(docs, model)
    assert found.count() == docs.count()
    by_text = {r.doc_id: r for r in found.collect()}
    assert by_text[3].lang is None and not by_text[4].accepted and by_text[6].n_words == 0 and by_text[2].lang == "en" and by_text[2].accepted
    kept = L.keep_identified(clashing(docs), model)
    assert kept.columns == clashing(docs).columns
    ids = [r[0] for r in rows_of(kept, "doc_id")]
    # the four rows with the English text are kept; nulls, blanks and letterless texts aren't
    assert [i for i in ids if i in (1, 2, None)].count(1) == 2 and 2 in ids and None in ids and not {3, 4, 5, 6} & set(ids)
    assert ids.count(None) == 1 and sorted(ids, key=repr) == sorted((r.doc_id for r in found.where("accepted").collect()), key=repr)
    empty = table(spark, [])
    none = L.train(empty)
    assert none.languages == () and L.language_mix(docs, none).where("accepted").count() == 0 and L.keep_identified(empty, model).count() == 0


def test_sample_bound_does_not_depend_on_partitions(spark, labelled):
    a = L.train(table(spark, labelled).repartition(1), sample_per_language=10)
    b = L.train(table(spark, labelled).repartition(7), sample_per_language=10)
    assert a.languages == b.languages and (a.table == b.table).all()


def test_every_label_gets_a_table(spark):
    rng = random.Random(6)
    words = {f"l{k:02}": ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(5)) for _ in range(12)] for k in range(70)}
    rows = [(k, " ".join(rng.choice(words[lang]) for _ in range(40)), lang, "s", None) for k, lang in enumerate(list(words) * 3)]
    model = L.train(table(spark, rows))
    assert model.languages == tuple(sorted(words))
    found = {r.doc_id: r for r in L.language_mix(table(spark, rows), model).collect()}
    assert all(found[k].lang == lang and found[k].accepted for k, _, lang, *_ in rows)
