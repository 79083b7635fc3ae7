"""Whitening against dense eigenvectors and exact integer sums."""

import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tillweave.llm import whitening
from tillweave.llm.queries import QUERIES

SMALL = "/root/testdata/sf0.01"


@pytest.mark.parametrize("width", [1, 2, 3, 17, 64])
def test_singular_values_and_vectors(width):
    draw = np.random.default_rng(width)
    r = np.triu(draw.normal(size=(width, width)) * 10.0 ** draw.uniform(-6, 0, width))
    values, vectors = whitening.principal(r, 8)
    want = np.linalg.svd(r)
    assert values == pytest.approx(want[1], rel=1e-10)
    k = vectors.shape[1]
    assert k == min(8, width)
    assert np.abs(vectors.T @ vectors - np.eye(k)).max() < 1e-12
    assert np.abs(np.abs(np.sum(vectors * want[2][:k].T, 0)) - 1).max() < 1e-9


def test_small_singular_values_keep_their_digits():
    # Bidiagonal, graded over 24 orders: known to a few digits of machine precision each.
    diagonal, upper = 10.0 ** -np.arange(0, 24, 2.0), 0.5 * 10.0 ** -np.arange(1, 23, 2.0)
    got = whitening.singular_values(diagonal, upper)
    # The product of all values is that of the diagonal, and the inverse has the inverse ones.
    assert math.prod(got) == pytest.approx(math.prod(diagonal), rel=1e-12)
    inverse = np.linalg.inv(np.diag(diagonal) + np.diag(upper, 1))
    assert 1 / got[-1] == pytest.approx(np.linalg.norm(inverse, 2), rel=1e-12)


@pytest.mark.parametrize("case", ["zero", "one", "equal", "rank", "split", "close"])
def test_degenerate_triangles(case):
    draw = np.random.default_rng(5)
    q = np.linalg.qr(draw.normal(size=(9, 9)))[0]
    r = {
        "zero": np.zeros((4, 4)),
        "one": np.diag([3.0, 0, 0, 0]),
        "equal": 2.0 * np.eye(9),
        "rank": np.linalg.qr(draw.normal(size=(30, 3)) @ draw.normal(size=(3, 9)), mode="r"),
        "split": np.diag([1.0, 5, 2, 5, 2, 5, 0, 0, 1]),
        "close": np.linalg.qr(np.diag([5, 5 + 1e-9, 5 + 2e-9, 4, 4, 3, 2, 1, 1e-8]) @ q, mode="r"),
    }[case]
    values, vectors = whitening.principal(r, 8)
    want = np.linalg.svd(r, compute_uv=False)
    assert np.abs(values - want).max() <= 1e-13 * max(1, want[0])
    k = vectors.shape[1]
    if want[0]:
        live = values[:k] > 1e-9 * want[0]
        image = (r @ vectors)[:, live]
        assert np.abs(image.T @ image - np.diag(values[:k][live] ** 2)).max() < 1e-11 * want[0] ** 2


def by_id(df):
    out = {}
    for r in df.collect():
        out.setdefault(r[0], []).append(r)
    return {k: sorted(v, key=lambda r: r["component"]) for k, v in out.items()}


def test_query_equals_dense_arithmetic(spark):
    rows = duckdb.connect().execute(f"SELECT vec_id, embedding FROM '{SMALL}/embeddings.parquet' ORDER BY 1").fetchall()
    x = np.array([[math.floor(1024 * float(np.float32(c))) + 100000 for c in v] for _, v in rows], np.int64)
    n, s = len(x), x.sum(0)
    z = (n * x - s) / n
    e, v = np.linalg.eigh(z.T @ z / n)
    e, v = e[::-1][:8], v[:, ::-1][:, :8]
    want = z @ v / np.sqrt(e)
    got = by_id(QUERIES["op12_embedding_whitening"](spark, SMALL))
    assert len(got) == n
    mine = np.array([[r["whitened"] for r in got[i]] for i, _ in rows])
    signs = np.sign((mine * want).sum(0))
    assert np.abs(mine - want * signs).max() < 1e-8
    exact = [sum((n * int(a) - int(b)) ** 2 for a, b in zip(row, s)) for row in x]
    assert [got[i][0]["deviation"] for i, _ in rows] == exact
    first = got[rows[0][0]]
    trace = sum(exact) / n**3
    assert [r["explained"] for r in first] == pytest.approx((e / trace).tolist(), rel=1e-9)
    assert [r["component"] for r in first] == list(range(1, 9)) and first[0]["n"] == n
    assert 0 <= first[0]["identity_error"] < 1e-10


def test_odd_vectors(spark):
    rows = [(1, [1.0, 2.0]), (1, [1.0, 2.0]), (None, [3.0, 1.0]), (4, [0.5, 9.0]), (5, None), (6, []), (7, [1.0, None])]
    rows += [(8, [float("nan"), 1.0]), (9, [float("inf"), 1.0]), (10, [1.0, 2.0, 3.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 AS x", "2 AS id", "3 AS n", "4 AS component")
    whole = df.where(whitening.usable(F.col("embedding"))).withColumn("embedding", whitening.whole_numbers(F.col("embedding"), 1024, 0))
    got = whitening.whiten(whole)
    assert got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    kept = [tuple(r) for r in got.collect()]
    assert sorted(str(r[0]) for r in kept) == sorted(["1"] * 4 + ["None"] * 2 + ["4"] * 2)
    assert {r[2] for r in kept} == {4} and all(r[6] < 1e-9 for r in kept)
    one = whitening.whiten(whole.where("vec_id = 4")).collect()
    assert [(r["whitened"], r["explained"], r["identity_error"], r["deviation"]) for r in one] == [(None, None, None, 0)] * 2
    line = spark.createDataFrame([(i, [i, 2 * i, 7]) for i in range(9)], "vec_id long, embedding array<bigint>")
    flat = by_id(whitening.whiten(line))
    assert [r["whitened"] is None for r in flat[3]] == [False, True, True] and flat[3][0]["explained"] == pytest.approx(1)
    for empty in (whole.limit(0), spark.createDataFrame([(5, None), (6, [])], "vec_id long, embedding array<bigint>")):
        assert whitening.whiten(empty).count() == 0
