import numpy as np
import pytest

from strandloom.llm import embedding_tiles as E

from .common import rows_of, table

SCHEMA = "vec_id long, embedding array<float>, label int"


def vectors(n=700, d=24, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d)) * np.linspace(2, 0.3, d)
    for k in range(0, n - 40, 10):
        x[k + 1] = x[k] + rng.normal(size=d) * rng.choice([0.01, 0.1, 0.3])
    x[-30:] = x[0] * rng.uniform(0.5, 2, size=(30, 1))  # many copies
    return x.astype(np.float32)


def brute(ids, x, threshold):
    x = x.astype(np.float64)
    s = np.linalg.norm(x, axis=1)
    c = (x @ x.T) / np.outer(s, s)
    return {(min(ids[i], ids[j]), max(ids[i], ids[j])) for i in range(len(x)) for j in range(i) if c[i, j] >= threshold and ids[i] != ids[j]}


@pytest.mark.parametrize(("threshold", "tile", "group"), [(0.95, 64, 3), (0.6, 100, 2), (0.95, 4096, 8)])
def test_all_pairs_are_found(spark, threshold, tile, group):
    x = vectors()
    df = table(spark, [(k, v.tolist(), 0) for k, v in enumerate(x)], SCHEMA)
    got = {(r.vec_a, r.vec_b) for r in E.similar_pairs(df, threshold, tile, group, lead=4).collect()}
    assert got == brute(list(range(len(x))), x, threshold)


def test_sample_table_at_a_low_threshold(spark, sf):
    df = spark.read.parquet(f"{sf}/embeddings.parquet")
    rows = df.collect()
    got = {(r.vec_a, r.vec_b) for r in E.similar_pairs(df, 0.4).collect()}
    assert got == brute([r.vec_id for r in rows], np.array([r.embedding for r in rows], np.float32), 0.4) and got


def test_bounds_hold():
    x = vectors(200)
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    for lead in (1, 5, 24):
        a, b = E._bounds(x[:100], lead), E._bounds(x[100:], lead)
        assert (x[:100] @ x[100:].T).max() <= E.reach(a, b) + 1e-5


def test_the_bound_in_sql_is_the_bound(spark):
    x = vectors(300).astype(np.float64)
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    for lead in (1, 3):
        bounds = [E._bounds(x[k : k + 50], lead) for k in range(0, 300, 50)]
        df = spark.createDataFrame([(k, b[0].tolist(), b[1].tolist(), b[2]) for k, b in enumerate(bounds)], "k int, lo array<double>, hi array<double>, rest double")
        got = df.alias("a").crossJoin(df.alias("b")).selectExpr("a.k", "b.k AS m", E._reach_sql(lead, "a", "b") + " AS r").collect()
        assert all(abs(r.r - E.reach(bounds[r.k], bounds[r.m])) < 1e-9 for r in got)


def test_awkward_rows(spark):
    v, w = [1.0, 2.0, 3.0], [3.0, -1.0, 0.5]
    nan = float("nan")
    rows = [(1, v, 0), (1, v, 0), (2, v, 0), (3, w, 0), (4, None, 0), (5, [], 0), (6, [0.0] * 3, 0), (7, [nan, 1.0, 1.0], 0), (8, [1.0, None, 1.0], 0), (9, [1.0, 2.0], 0), (None, v, 0), (10, [float("inf"), 1.0, 1.0], 0), (11, [-1.0, -2.0, -3.0], 0)]
    df = table(spark, rows, SCHEMA).selectExpr("*", "1 AS i", "2 AS e", "3 AS cell", "'x' AS x", "4 AS g")
    got = rows_of(E.similar_pairs(df))
    assert [g[:2] for g in got] == [(1, 2)] and abs(got[0][2] - 1) < 1e-12
    assert E.similar_pairs(table(spark, [], SCHEMA)).count() == 0


@pytest.mark.parametrize("repeated", [False, True])
def test_classes_and_links_against_brute_force(spark, repeated):
    x = vectors()
    ids = [k if not repeated or k % 50 else k // 2 for k in range(len(x))]
    rows = [(i, v.tolist(), 0) for i, v in zip(ids, x)] + [(5000, None, 0), (5001, [0.0] * 24, 0), (None, x[0].tolist(), 0)]
    pairs = brute(ids, x, 0.9)
    root = {i: i for i in [*ids, 5000, 5001]}
    for _ in root:
        before = dict(root)
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
        if before == root:
            break
    want = sorted((i, r, sum(i in p for p in pairs)) for i, r in root.items())
    got = rows_of(E.similar_classes(table(spark, rows, SCHEMA), 0.9, tile=64, group_tiles=3, lead=4), "vec_id", "class_id", "links")
    assert got == sorted(want, key=repr) and max(n for *_, n in got) >= 29 and len(got) == len(root)


def test_the_query_has_a_row_a_vector_and_equals_its_sql(spark, tmp_path):
    from strandloom.llm import queries
    from tests.compare import connect, same

    for n in (200, 400):  # half of them copies: the pairs grow with the square
        x = vectors(n)
        x[: n // 2] = x[0]
        folder = tmp_path / str(n)
        folder.mkdir()
        df = table(spark, [(k, v.tolist(), 0) for k, v in enumerate(x)], SCHEMA)
        df.toPandas().to_parquet(folder / "embeddings.parquet")
        found = queries.op3_embedding_tiles(spark, str(folder))
        assert same(found, connect(str(folder)), queries.oracle_sql()["op3_embedding_tiles"]) == n


def test_small_groups_are_joined_before_tiles_are_moved(spark, monkeypatch):
    """A tile goes to a bounded number of groups, whatever number of tiles was asked for; the pairs stay the same."""
    x = vectors(1500)
    df = table(spark, [(k, v.tolist(), 0) for k, v in enumerate(x)], SCHEMA)
    moved, cut = [], E.cut

    def counted(made):
        kept = cut(made)
        if "tile" in kept.columns:
            moved.append(kept.select("g").distinct().count())
        return kept

    monkeypatch.setattr(E, "cut", counted)
    got = {(r.vec_a, r.vec_b) for r in E.similar_pairs(df, 0.35, 16, 2, lead=4).collect()}
    assert got == brute(list(range(len(x))), x, 0.35)
    assert moved == [12]
