"""Whitening against numpy's eigenvectors of the whole covariance."""

import numpy as np
import pytest

from tillcast.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, label int, x string, id string"


def frame(spark, vectors):
    rows = [(i, v and [c if c is None else float(c) for c in v], 1, "x", "y") for i, v in vectors]
    return spark.createDataFrame(rows, SCHEMA)


def check(got, pairs, k=4):
    """``pairs``: the remaining (id, vector) rows."""
    x = np.array([[int(np.floor(256 * np.float64(np.float32(c)))) for c in v] for _, v in pairs])
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(axis=0)
    y = fit - s / n
    e, u = np.linalg.eigh(y.T @ y / n)
    e, u = e[::-1], u[:, ::-1]
    k = min(k, int((e > 1e-9 * e[0]).sum()))
    by = {}
    for r in got:
        by.setdefault((r["vec_id"], r["deviation"]), {})[r["component"]] = r
    assert len(got) == len(pairs) * k and {r["component"] for r in got} == set(range(1, k + 1))
    w = np.array([[by[i, int(((n * v - s) ** 2).sum())][c + 1]["whitened"] for c in range(k)] for (i, _), v in zip(pairs, x)])
    want = (x - s / n) @ u[:, :k] / np.sqrt(e[:k])
    sign = np.sign((w * want).sum(axis=0))
    assert np.abs(w - want * sign).max() < 1e-8
    assert all(r["n"] == n and r["identity_error"] < 1e-10 for r in got)
    assert all(abs(r["explained"] - e[r["component"] - 1] / e.sum()) < 1e-12 for r in got)


def test_query_on_given_embeddings(spark, sf_dir):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    rows = [(i, v) for i, v in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    check(whitening.op13_embedding_whitening(spark, sf_dir).collect(), rows)


def test_odd_rows(spark):
    """Null vectors and entries, infinities, other lengths, copies (a third of all rows) and repeated ids."""
    rng = np.random.default_rng(3)
    good = [(i, rng.standard_normal(6).tolist()) for i in range(40)] + [(100, [0.5] * 6)] * 20 + [(7, [-0.001] * 6), (None, [0.25, 0, 0, 0, 0, -3.0])]
    bad = [(200, None), (201, [1.0, None, 0, 0, 0, 0]), (202, [float("nan")] * 6), (203, [float("-inf")] + [0.0] * 5),
           (204, []), (205, [1.0] * 5), (206, [3e38] * 6)]
    got = whitening.whiten(frame(spark, good + bad)).collect()
    assert {r["vec_id"] for r in got} == {i for i, _ in good}
    check(got, good)


def test_few_dimensions(spark):
    check(whitening.whiten(frame(spark, [(i, [float(i), 2.0 * i, 1.0]) for i in range(9)])).collect(),
          [(i, [float(i), 2.0 * i, 1.0]) for i in range(9)])
    assert whitening.whiten(frame(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).count() == 0
    assert whitening.whiten(frame(spark, [])).columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


@pytest.mark.parametrize("values", [[5, 5, 5, 5, 1, 0], [9, 4, 1e-6, 0, 0, 0, 0], [3, 3, 2, 2, 2, 1, 1, 1, 1, 1] * 5, [2], [1e12, 1, 1e-3, 1e-3] + [1e-4] * 30])
def test_eigenpairs(values):
    """Equal, tiny and zero eigenvalues: values and residuals to double precision."""
    rng = np.random.default_rng(len(values))
    q, _ = np.linalg.qr(rng.standard_normal((len(values), len(values))))
    a = (q * values) @ q.T
    a, asked = (a + a.T) / 2, []
    e, u = whitening.eigenpairs(lambda v: asked.append(v.shape[1]) or a @ v, len(values), 4)
    want = np.sort(values)[::-1][:4]
    assert np.abs(e - want).max() <= 1e-13 * want[0] and np.abs(u.T @ u - np.eye(len(e))).max() < 1e-13
    assert np.linalg.norm(a @ u - u * e, axis=0).max() <= 1e-12 * want[0] and len(asked) < 300
