import collections
import random

import numpy as np
import pytest

from strandloom.llm import toxic_neighbours as X

from .common import awkward, clashing, rows_of, sentence, table, tokens

BAD = "vile rotten scumbag lousy filthy".split()
#: Abusive words of a language that inflects and runs words together: no form is frequent, the stems are.
STEMS = {"fr": ("vequ", "réeux"), "de": ("lowei", "achlich")}
ENDINGS = {"fr": "té ta aire eur ance oir mo ille ju con ç î".split(), "de": "schaft ent en ei isch tum ig strau zer ng kr an".split()}
LABELS = "doc_id long, quality int, toxic int"


def abusive(rng, lang):
    return rng.choice(BAD) if lang == "en" else rng.choice(STEMS[lang]) + rng.choice(ENDINGS[lang]) + rng.choice(ENDINGS[lang])


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(3)
    docs, labels = [], []
    for k in range(1500):
        lang, toxic = rng.choice(["en", "fr", "de"]), rng.random() < 0.25
        words = sentence(rng, lang, rng.choice([30, 80])).split()
        if toxic:
            for _ in range(6):
                words.insert(rng.randrange(len(words)), abusive(rng, lang))
        docs.append((k, " ".join(words), lang, "s", None))
        labels.append((k, 1, int(toxic)))
    return docs, labels


@pytest.fixture(scope="module")
def index(spark, corpus):
    docs, labels = corpus
    return X.fit(table(spark, docs), table(spark, labels[:900], LABELS))


def test_neighbours_are_exact(index, corpus):
    texts = [t for _, t, *_ in corpus[0][900:1100]] + [None, "", "qqqqqq"]
    top, cosine = X.nearest(index, texts, 17)
    v, m = len(index.vocabulary), len(index.ids)
    place = {int(i): k for k, i in enumerate(index.ids)}
    examples = [None] * m
    for i, t, *_ in corpus[0]:
        if i in place:
            examples[place[i]] = t
    dense = []
    for part in (examples, texts):
        text, term, w = X.vectors(part, index.vocabulary, index.idf)
        d = np.zeros((len(part), v))
        d[text, term] = w
        dense.append(d)
    full = dense[1] @ dense[0].T
    best = -np.sort(-full, axis=1)[:, :17]
    assert np.abs(np.maximum(best, 0) - cosine).max() < 1e-5
    rows = np.arange(len(texts))[:, None]
    assert np.abs(full[rows, np.maximum(top, 0)] - cosine)[top >= 0].max() < 1e-5
    assert (top[-3:] == -1).all() and (cosine[-3:] == 0).all()


def test_terms_are_those_of_a_plain_loop():
    texts = ["The  re-read NAÏVE ab c\nabcdefghijklmnop", None, "", "x" * 300_000 + " end", "ab " * 70_000]
    vocabulary, want = {}, []
    for n, text in enumerate(texts):
        for w in tokens(text):
            w = w.encode()
            found = [(b" " + w + b" ")[k : k + 4] for k in range(len(w) - 1)] + [(k, w[:k]) for k in range(4, 13) if len(w) >= k]
            want += [(n, f) for f in found]
    got = [(int(n), int(h)) for h, text in X.terms(texts) for h, n in zip(h, text)]
    assert len(got) == len(want)
    names: dict[int, object] = {}
    for n in range(len(texts)):
        own = [collections.Counter(h for m, h in got if m == n), collections.Counter(f for m, f in want if m == n)]
        assert sorted(own[0].values()) == sorted(own[1].values())
    one = lambda w: {int(h) for h, _ in X.terms([w]) for h in h}
    assert len(one("abcde")) == 6 and one("abcde") & one("abcdx") and not one("abcd") & one("wxyz") and one("Ab") == one("ab")
    vocabulary = np.array(sorted(one("abcdefgh")), np.uint64)
    assert X.counts(["abcdefgh abcdefgh"], vocabulary)[2].tolist() == [2] * len(vocabulary)


def test_held_out_documents(spark, index, corpus):
    docs, labels = corpus
    got = {r.doc_id: r for r in X.score(table(spark, docs[900:]), index).collect()}
    truth = {i: y for i, _, y in labels[900:]}
    lang = {i: x for i, _, x, *_ in docs}
    for name in ("en", "fr", "de"):
        assert np.mean([got[i].toxic for i, y in truth.items() if y and lang[i] == name]) >= 0.9, name
    assert np.mean([got[i].toxic for i, y in truth.items() if not y]) <= 0.01
    p = np.array([got[i].probability for i in truth])
    assert abs(p.mean() - np.mean(list(truth.values()))) < 0.06  # calibrated
    shown = [[float(x.split(":")[1]) for x in r.evidence.split(",")] for r in got.values() if r.toxic]
    assert all(1 <= len(x) <= 21 and x == sorted(x, reverse=True) for x in shown)


def test_chosen_terms_depend_on_the_label(spark, index, corpus):
    """The vocabulary against a plain count of 2 by 2 tables over the examples."""
    ids = set(index.ids.tolist())
    y = {i: c for i, _, c in corpus[1] if i in ids}
    have = {i: {int(h) for part, _ in X.terms([t]) for h in part} for i, t, *_ in corpus[0] if i in ids}
    with_it = {c: collections.Counter(h for i, own in have.items() if y[i] == c for h in own) for c in (0, 1)}
    n = [sum(c == k for c in y.values()) for k in (0, 1)]
    want = set()
    for h in {*with_it[0], *with_it[1]}:
        a, b = with_it[0][h], with_it[1][h]
        cells = np.array([[a, n[0] - a], [b, n[1] - b]], float)
        expected = cells.sum(1, keepdims=True) * cells.sum(0) / cells.sum()
        if expected.all() and ((cells - expected) ** 2 / expected).sum() >= 15.1:
            want.add(h)
    assert want == {int(h) for h in index.vocabulary} and len(want) > 20


def test_own_example_is_left_out(index, corpus):
    text = {i: t for i, t, *_ in corpus[0]}
    own = np.arange(20)
    weights = X.vectors([text[int(index.ids[k])] for k in own], index.vocabulary, index.idf)
    top, _ = X.nearest_to(index, 20, *weights, 5, own)
    assert not (top == own[:, None]).any()


def test_isotonic():
    at, value = X.isotonic(np.array([1.0, 2, 3, 4, 4]), np.array([0.0, 1, 0, 1, 1]), np.ones(5), shrink=0)
    assert at.tolist() == [1, 2, 4] and value.tolist() == [0, 0.5, 1]
    assert (np.diff(X.isotonic(np.random.default_rng(0).random(200), np.random.default_rng(1).integers(0, 2, 200), np.ones(200))[1]) >= 0).all()


def test_awkward_rows(spark, index):
    docs = clashing(table(spark, awkward()))
    got = X.score(docs, index)
    assert got.count() == docs.count() and got.where("doc_id = 3 OR doc_id = 4").agg({"probability": "max"}).first()[0] == 0
    labels = table(spark, [(1, 1, 0), (1, 1, 1), (None, 1, 1), (2, 1, None), (99, 1, 1), (8, 0, 0)], LABELS)
    few = X.fit(docs, labels, min_chi2=0)
    assert sorted(zip(few.ids.tolist(), few.labels.tolist())) == [(1, 1), (8, 0)]
    none = X.fit(table(spark, []), table(spark, [], LABELS))
    assert rows_of(X.score(docs, none).where("toxic")) == [] and X.score(table(spark, []), index).count() == 0
