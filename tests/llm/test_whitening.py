import numpy as np
import pytest

from docloom.llm import whitening
from docloom.llm.common import table

SCHEMA = "vec_id long, embedding array<float>, label int, x string, n int"
NAN, INF = float("nan"), float("inf")


def brute(rows, components=16):
    """Per (vec_id, deviation): the whitened values of each component by a dense eigendecomposition, up to signs."""
    kept = [(i, np.array(v, float)) for i, v in rows if v and all(c is not None and np.isfinite(c) for c in v)]
    lengths = [len(v) for _, v in kept]
    d = max(set(lengths), key=lambda k: (lengths.count(k), k))
    kept = [(i, np.floor(64 * v).astype(int) + 1_000_000) for i, v in kept if len(v) == d]
    fit = np.unique([x for _, x in kept], axis=0)
    n, total = len(fit), fit.sum(0)
    c = (n * fit - total) / n
    cov = c.T @ c / n
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1], vectors[:, ::-1]
    k = min(components, int((values > d * 2.3e-16 * values[0]).sum()))
    out = [(i, int(((n * x - total).astype(object) ** 2).sum()), ((n * x - total) / n) @ vectors[:, :k] / np.sqrt(values[:k])) for i, x in kept]
    return n, out, values[:k] / np.trace(cov)


def check(spark, rows, schema_rows=None):
    data = schema_rows or [(i, None if v is None else list(v), 1, "x", 2) for i, v in rows]
    found = whitening.whiten(spark.createDataFrame(data, SCHEMA).repartition(3)).toPandas()
    n, want, explained = brute(rows)
    k = len(explained)
    assert len(found) == len(want) * k and (found["n"] == n).all() and found["identity_error"].nunique() == 1 and found["identity_error"].max() < 1e-10
    for j, part in found.groupby("component"):
        assert np.allclose(part["explained"], explained[j - 1], rtol=1e-9)
        got = sorted(zip(part["vec_id"].fillna(-1), part["deviation"], part["whitened"]))
        own = sorted((-1 if i is None else i, dev, w[j - 1]) for i, dev, w in want)
        assert [x[:2] for x in got] == [x[:2] for x in own]
        a, b = np.array([x[2] for x in got]), np.array([x[2] for x in own])
        assert min(abs(a - b).max(), abs(a + b).max()) < 1e-9


def spread(n, d, seed=0):
    rng = np.random.default_rng(seed)
    return (rng.standard_normal((n, d)) * np.linspace(3, 0.3, d)).astype(np.float32).astype(float)


def test_odd_vectors_are_left_out(spark):
    rows = list(enumerate(spread(60, 5).tolist())) + [(100, None), (101, []), (102, [1.0, None, 2.0, 3.0, 4.0]), (103, [NAN] * 5), (104, [1.0, -INF, 0.0, 0.0, 0.0]), (105, [1.0, 2.0])]
    check(spark, rows)


def test_repeats_count_once_and_ids_may_be_null(spark):
    v = spread(40, 20).tolist()
    check(spark, [*enumerate(v), *((None, v[3]) for _ in range(50)), (7, v[1]), (7, v[2])])


def test_more_dimensions_than_vectors(spark):
    check(spark, list(enumerate(spread(6, 30).tolist())))


def test_large_entries(spark):
    found = whitening.whiten(spark.createDataFrame([(i, [float(x) for x in v], 1, "", 1) for i, v in enumerate([[1e30, 1.0], [-1e30, 2.0], [0.0, 3.0]])], SCHEMA)).toPandas()
    assert len(found) == 3  # the second component is below rounding
    assert found["deviation"].isna().any() and np.isfinite(found["whitened"]).all()


@pytest.mark.parametrize("rows", [[], [(1, [1.0, 2.0])], [(1, [1.0, 2.0])] * 5, [(1, None), (2, [])]])
def test_no_variance_gives_no_rows(spark, rows):
    found = whitening.whiten(spark.createDataFrame([(i, v, 1, "x", 1) for i, v in rows], SCHEMA))
    assert found.count() == 0 and found.columns == [f.split()[0] for f in whitening.WHITENED.split(", ")]


def test_many_parts_are_added_up_by_spark(spark, monkeypatch):
    monkeypatch.setattr(whitening, "PARTIALS", 1)
    monkeypatch.setattr(whitening, "BLOCK", 7)
    check(spark, list(enumerate(spread(90, 18).tolist())))


@pytest.mark.parametrize("seed,n,d,wanted", [(0, 300, 64, 16), (1, 500, 200, 16), (2, 50, 3, 3), (3, 100, 1, 1), (4, 400, 40, 39)])
def test_solver_against_a_dense_one(seed, n, d, wanted):
    c = np.random.default_rng(seed).standard_normal((n, d)) * np.logspace(0, -2, d)
    v = c.T @ c / n
    values, vectors = whitening.leading(lambda b: v @ b, d, wanted)
    assert np.allclose(values, np.linalg.eigvalsh(v)[::-1][:wanted], rtol=0, atol=1e-14 * values[0] * d)
    assert np.linalg.norm(v @ vectors - vectors * values, axis=0).max() <= 1e-14 * values[0]


def test_solver_with_equal_eigenvalues():
    v = np.diag([5.0] * 6 + [3.0] * 20 + [1.0] * 10)
    values, vectors = whitening.leading(lambda b: v @ b, 36, 8)
    assert np.allclose(values, [5] * 6 + [3] * 2) and np.allclose(vectors.T @ vectors, np.eye(8), atol=1e-12)


def test_minres_solves_indefinite_systems():
    rng = np.random.default_rng(5)
    a = rng.standard_normal((12, 12))
    a = a + a.T
    b = rng.standard_normal((12, 3))
    assert np.allclose(a @ whitening.minres(lambda v: a @ v, b, 40, 1e-13), b, atol=1e-8)


def test_query_on_a_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in table(spark, sf, "embeddings").select("vec_id", "embedding").collect()]
    check(spark, rows)
