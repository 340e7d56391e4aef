import random
from collections import Counter, defaultdict

import pytest

from strandloom.llm import containment_dedup as D

from .common import awkward, clashing, rows_of, sentence, table, tokens


def shingles(text, k=4):
    w = tokens(text)
    return {tuple(w[j : j + k]) for j in range(len(w) - k + 1)}


def edited(rng, text, share):
    return " ".join("changed" + str(rng.random())[2:8] if rng.random() < share else w for w in text.split())


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    passage = sentence(rng, n=55)
    rows = []
    for g in range(60):
        base = sentence(rng, n=rng.choice([40, 120, 400, 1500]))
        rows.append(base)
        for _ in range(rng.choice([0, 1, 1, 2, 25 if g % 20 == 0 else 3])):
            rows.append(edited(rng, base, rng.choice([0, 0.02, 0.05])))
        if g % 5 == 0:
            rows.append(" ".join(base.split()[: max(30, len(base.split()) // 3)]))  # contained
    rows += [sentence(rng, n=150) + " " + passage + " " + sentence(rng, n=150) for _ in range(40)]  # share a passage only
    rng.shuffle(rows)
    return [(k, t, "en", "s", None) for k, t in enumerate(rows)]


def components(sets, order):
    """Groups by brute force: near-duplicates both ways, and each text with the first that it is contained in."""
    inverted = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            inverted[x].append(i)
    shared = Counter((a, b) for ids in inverted.values() for a in ids for b in ids if a != b)
    over = {(q, x) for (q, x), n in shared.items() if n >= 0.65 * len(sets[q]) and order[x] < order[q]}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    def join(q, x):
        a, b = sorted((find(q), find(x)), key=order.get)
        root[b] = a

    first = {}
    for q, x in over:
        first[q] = min(first.get(q, x), x, key=order.get)
        if shared[(q, x)] >= 0.65 * len(sets[x]):
            join(q, x)
    for q, x in first.items():
        join(q, x)
    return {i: find(i) for i in sets}, shared, over


def order_of(sets, texts):
    u = {}
    for i, t in texts.items():
        h = D.Tokens([t])
        u[i] = int(D.as_int64(D.span_hashes(h.hashes, h.offsets[:1], h.offsets[1:]))[0])
    return {i: (-len(sets[i]), u[i], i) for i in sets}


def test_groups_against_brute_force(spark, corpus):
    text = {i: t for i, t, *_ in corpus}
    sets = {i: shingles(t) for i, t in text.items()}
    root, shared, over = components(sets, order_of(sets, text))
    want = {i for i, r in root.items() if r != i}
    dropped = {r.doc_id: r for r in D.duplicates(table(spark, corpus)).collect()}
    exact = Counter(" ".join(tokens(t)) for t in text.values())
    assert len(want & set(dropped)) >= 0.97 * len(want)
    for i, r in dropped.items():  # whatever goes is a near-duplicate of another text or contained in it
        assert exact[" ".join(tokens(text[i]))] > 1 or any(shared[(i, x)] >= 0.65 * len(sets[i]) for x in sets)
        assert r.duplicate_of not in dropped and (root[i] == root[r.duplicate_of] or exact[" ".join(tokens(text[i]))] > 1)
    kept = {r.doc_id for r in D.keep_one_of_each(table(spark, corpus)).collect()}
    assert kept == set(text) - set(dropped)


def test_short_texts_in_much_longer_ones(spark):
    rng = random.Random(13)
    line = sentence(rng, n=12)  # in every text: a passage that says nothing
    rows, inside = [], set()
    for k in range(60):
        size, ratio = rng.choice([14, 20, 30, 60]), rng.choice([5, 12, 40])
        part = sentence(rng, n=size)
        # as it is, or with a few words changed
        rows.append((2 * k, sentence(rng, n=size * ratio // 2) + " " + edited(rng, part, rng.choice([0, 0, 0.03])) + " " + line + " " + sentence(rng, n=size * ratio // 2)))
        rows.append((2 * k + 1, part))
    sets = {i: shingles(t) for i, t in rows}
    for q, x in ((2 * k + 1, 2 * k) for k in range(60)):
        if len(sets[q] & sets[x]) >= 0.65 * len(sets[q]):
            inside.add(q)
    dropped = {r.doc_id: r.duplicate_of for r in D.duplicates(table(spark, [(i, t, "en", "s", None) for i, t in rows])).collect()}
    assert len(inside) > 40 and set(dropped) <= inside and all(x == q - 1 for q, x in dropped.items())
    assert len(dropped) >= 0.97 * len(inside)


def test_awkward_rows(spark):
    docs = table(spark, awkward())
    kept = rows_of(D.keep_one_of_each(docs), "doc_id")
    # one of the five equal texts and of the two short copies; nulls, blanks and tokenless texts stay
    assert Counter(kept) == Counter([(1,), (3,), (None,), (4,), (5,), (6,), (7,), (8,), (10,)])
    assert rows_of(D.duplicates(docs), "doc_id", "duplicate_of") == [(2, 1), (9, 8), (None, 1)]
    extra = clashing(docs)
    assert D.keep_one_of_each(extra).columns == extra.columns and rows_of(D.keep_one_of_each(extra), "doc_id") == kept
    empty = table(spark, [])
    assert D.keep_one_of_each(empty).count() == 0 == D.duplicates(empty).count()


def test_long_chain_ends_in_one_root(spark):
    # each text holds the one before it and a little more
    w = sentence(random.Random(8), n=900).split()
    rows = [(k, " ".join(w[: 100 + 40 * k]), "en", "s", None) for k in range(20)]
    got = {r.doc_id: r.duplicate_of for r in D.duplicates(table(spark, rows)).collect()}
    assert got == {k: 19 for k in range(19)}


def test_bands_follow_the_jaccard_threshold():
    b = D.bands(12, 0.65, 0.97, 4)
    assert (b[3:] >= 30).all() and D.jaccard_of(1.0, 10, 10) == 1.0 and D.jaccard_of(0.5, 100, 300) == 50 / 350


def test_components_of_any_shape(spark):
    rng = random.Random(4)
    edges = [(k, k + 1) for k in range(40)] + [(100, 100 + k) for k in range(1, 30)] + [(300 + k, 300 + rng.randrange(60)) for k in range(60)] + [(200, 201), (201, 202), (202, 200)]
    size = {i: rng.randrange(5, 9) for e in edges for i in e}
    before = lambda i: (-size[i], i)
    rows = [(max(e, key=before), min(e, key=before)) for e in edges if e[0] != e[1]]
    df = spark.createDataFrame([(q, size[q], x, size[x]) for q, x in rows], "q long, nq int, x long, nx int")
    got = {r.u: r.root for r in D._roots(df).collect()}
    root = {i: i for i in size}
    for _ in range(100):
        for q, x in rows:
            root[q] = root[x] = min(root[q], root[x], key=before)
    assert {i: got.get(i, i) for i in size} == root and all(u != r for u, r in got.items())


@pytest.mark.parametrize("share", [0.05, 0.08])
def test_recall_in_a_large_group_of_heavily_edited_copies(spark, share):
    rng = random.Random(21)
    base = sentence(rng, n=300)
    texts = dict(enumerate([base] + [edited(rng, base, share) for _ in range(400)]))
    sets = {i: shingles(t) for i, t in texts.items()}
    root = components(sets, order_of(sets, texts))[0]
    want = {i for i, r in root.items() if r != i}
    dropped = {r.doc_id for r in D.duplicates(table(spark, [(k, t, "en", "s", None) for k, t in texts.items()])).collect()}
    assert len(want) > 300 and dropped <= want and len(dropped) >= 0.97 * len(want)


def test_a_group_linked_through_one_text_stays_together(spark):
    """Copies with words inserted: each and the original hold one another, copies among themselves may not."""
    rng = random.Random(2)
    base = sentence(rng, n=300).split()
    longer = lambda: " ".join(w if rng.random() > 0.07 else w + " new" + str(rng.random())[2:9] for w in base)
    texts = dict(enumerate([" ".join(base)] + [longer() for _ in range(20)]))
    sets = {i: shingles(t) for i, t in texts.items()}
    root = components(sets, order_of(sets, texts))[0]
    got = D.duplicates(table(spark, [(k, t, "en", "s", None) for k, t in texts.items()])).collect()
    assert {r.doc_id: r.duplicate_of for r in got} == {i: r for i, r in root.items() if r != i} and len(got) >= 18


def test_no_bucket_hides_a_text_that_contains_another(spark):
    """Between each text and the one that holds it, larger and smaller texts have half of its shingles each."""
    rng = random.Random(31)
    rows, want = [], {}
    for g in range(12):
        part = sentence(rng, n=110).split()
        rows.append((100 * g, " ".join(part)))
        rows.append((100 * g + 1, sentence(rng, n=600) + " " + " ".join(part) + " " + sentence(rng, n=600)))
        want[100 * g] = 100 * g + 1
        for k in range(8):  # runs of ten words of the text, among others
            runs = [part[j : j + 14] if rng.random() < 0.55 else sentence(rng, n=14).split() for j in range(0, 110, 10)]
            filler = 200 if k % 2 else 1600
            rows.append((100 * g + 10 + k, " ".join(sentence(rng, n=filler // 11) + " " + " ".join(r) for r in runs)))
    sets = {i: shingles(t) for i, t in rows}
    held = {(q, x) for q in want for x in sets if q != x and len(sets[q] & sets[x]) >= 0.65 * len(sets[q])}
    assert {(q, x) for q, x in want.items()} <= held
    got = {r.doc_id: r.duplicate_of for r in D.duplicates(table(spark, [(i, t, "en", "s", None) for i, t in rows])).collect()}
    assert set(got) == {q for q, _ in held} and all((q, x) in held for q, x in got.items())


def test_few_jobs_and_few_pairs_whatever_the_groups(spark, monkeypatch):
    """What the driver plans, and the pairs that are checked, don't grow with a crowded group's pairs."""
    rng = random.Random(33)
    base = sentence(rng, n=200)
    rows = [(k, edited(rng, base, 0.03), "en", "s", None) for k in range(300)]
    rows += [(1000 + k, " ".join(base.split()[40 : 55 + k % 3]), "en", "s", None) for k in range(300)]
    verified, seen = D._verified, []
    monkeypatch.setattr(D, "_verified", lambda pairs, *more: seen.append(pairs) or verified(pairs, *more))
    spark.sparkContext.setJobGroup("few", "few")
    try:
        dropped = D.duplicates(table(spark, rows)).count()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert dropped == 599 and len(spark.sparkContext.statusTracker().getJobIdsForGroup("few")) <= 80
    assert sum(p.count() for p in seen) < 40 * 600


def test_components_by_all_tasks_and_by_one_are_the_same(spark):
    rng = random.Random(6)
    edges = {(rng.randrange(300), rng.randrange(300)) for _ in range(200)} | {(k, k + 1) for k in range(400, 460)}
    rows = [(max(e), 5, min(e), 5 + (min(e) % 3 == 0)) for e in edges if e[0] != e[1]]
    size = {i: 5 + (i % 3 == 0) for e in edges for i in e}
    df = spark.createDataFrame([(q, size[q], x, size[x]) for q, _, x, _ in rows], "q long, nq int, x long, nx int")
    assert rows_of(D._roots(df), "u", "root") == rows_of(D._roots(df, here=0), "u", "root")


def test_names_of_texts_take_less_room_than_their_shingles_in_many_partitions(spark):
    rng = random.Random(9)
    rows = [(k, sentence(rng, n=200)) for k in range(200)]
    docs = spark.createDataFrame(rows, "i long, t string").coalesce(1)
    n = sum(len(shingles(t)) for _, t in rows)
    sent = D._hashed(docs, 4, 400).where("NOT meta").selectExpr("sum(length(v) + length(w) + length(x) + length(y) + length(z))").first()[0]
    assert sent < 14 * n  # 6 bytes a shingle are its hash


def test_sets_are_the_same_however_shingles_are_cut(spark, corpus, monkeypatch):
    docs = spark.createDataFrame([(k, t) for k, t, *_ in corpus], "i long, t string")
    texts = {k: shingles(t) for k, t, *_ in corpus}
    had = Counter(x for s in {t: texts[k] for k, t, *_ in corpus}.values() for x in s)
    shared = {k: sum(had[x] > 1 for x in s) for k, s in texts.items()}
    before = spark.conf.get("spark.sql.shuffle.partitions")
    for partitions, at_once in ((3, 1 << 21), (3, 500), (60, 100)):
        monkeypatch.setattr(D, "AT_ONCE", at_once)
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        try:
            found = [r for r in D._sets(docs, 4, 0.65).collect()]
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", before)
        assert sorted(i for r in found for i in r.i) == sorted(texts)
        for r in found:
            assert all((r.n, len(r.s), len(set(r.s))) == (len(texts[i]), shared[i], shared[i]) for i in r.i)
            assert r.p == max(0, min(shared[r.i[0]], int(0.35 * r.n + 1e-6) + 1 - (r.n - len(r.s))))


def test_bitmaps_rule_out_pairs_that_share_a_passage_and_none_that_hold(spark, corpus):
    docs = spark.createDataFrame([(k, t) for k, t, *_ in corpus], "i long, t string")
    sets = D._sets(docs, 4, 0.65).localCheckpoint()
    held = {r.u: (r.n, set(r.s)) for r in sets.collect() if r.s}
    pairs = {(q, x): len(a & b) / n for q, (n, a) in held.items() for x, (_, b) in held.items() if q != x and a & b}
    rows = spark.createDataFrame(list(pairs), "q long, x long")
    left = {(r.q, r.x) for r in D._possible(rows, sets, 0.65).collect()}
    assert left <= set(pairs) and {p for p, c in pairs.items() if c >= 0.65} <= left
    out = [p for p, c in pairs.items() if c < 0.35]
    assert len(out) > 1000 and len(left.intersection(out)) < 0.1 * len(out)
