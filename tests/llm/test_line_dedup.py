import random

import duckdb
import pytest

from strandloom.llm import line_dedup as D

from .common import awkward, clashing, rows_of, sentence, table


def within_one(a, b):
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1:
        return False
    p = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    return a[p + 1 :] == b[p + 1 :] or a[p + 1 :] == b[p:] or a[p:] == b[p + 1 :]


def brute(rows, least=16):
    lines = sorted({(i is None, i or 0, n, line.strip(" \t\r")) for i, t, *_ in rows if t for n, line in enumerate(t.split("\n")) if len(line.strip(" \t\r")) >= least})
    out = []
    for k, (z, i, n, line) in enumerate(lines):
        for z2, i2, n2, other in lines[:k]:
            if within_one(line, other):
                out.append((None if z else i, n, None if z2 else i2, n2, int(line != other)))
                break
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(6)
    pool = [sentence(rng, lang, 6) for lang in ("en", "fr", "de") for _ in range(60)]

    def line():
        x = rng.choice(pool)
        k, kind = rng.randrange(len(x)), rng.randrange(5)
        return {0: x, 1: x[:k] + "é" + x[k + 1 :], 2: x[:k] + x[k + 1 :], 3: x[:k] + "q" + x[k:], 4: "  " + x + "\r"}[kind]

    return [(d, "\n".join(line() for _ in range(8)), "en", "s", None) for d in range(80)]


def test_equals_brute_force(spark, rows):
    got = rows_of(D.duplicate_lines(table(spark, rows)))
    assert got == brute(rows) and {g[4] for g in got} == {0, 1}


def test_equals_its_sql(spark, rows):
    import pandas as pd

    documents = pd.DataFrame([r[:2] for r in rows], columns=["doc_id", "text"])  # noqa: F841
    df = D.duplicate_lines(table(spark, rows))
    assert rows_of(df) == sorted(duckdb.sql(f"SELECT {', '.join(df.columns)} FROM ({D.ORACLE})").fetchall(), key=repr)


def test_a_line_in_every_document(spark, rows):
    common = "Released under a licence that every document repeats."
    docs = [(i, f"{common}\n{t}\n{common[:-1]}", *rest) for i, t, *rest in rows]
    assert rows_of(D.duplicate_lines(table(spark, docs))) == brute(docs)


def test_what_lies_beyond_the_parameters_stays(spark):
    docs = [(1, "short line\nthe very same long line of text", None, None, None), (2, "short line\nthe vary sane long line of text", None, None, None)]
    assert rows_of(D.duplicate_lines(table(spark, docs))) == []
    assert rows_of(D.duplicate_lines(table(spark, docs), min_chars=5)) == [(2, 0, 1, 0, 0)]


def test_awkward_rows(spark):
    docs = awkward() + [(20, "x" * 5000 + "\n" + "x" * 4999 + "y\nshort\nshort", None, None, None)]
    got = rows_of(D.duplicate_lines(clashing(table(spark, docs))))
    assert got == brute([(i, t) for i, t, *_ in docs])
    assert D.duplicate_lines(table(spark, [])).count() == 0
    assert rows_of(D.duplicate_lines(table(spark, docs), max_edits=0), "edits") == [(0,)] * sum(1 for g in got if g[4] == 0)
    with pytest.raises(ValueError):
        D.duplicate_lines(table(spark, docs), max_edits=2)
