"""Whitening of vectors: QR in blocks, bidiagonal form, qd singular values, twisted factorisations.

Every task reduces its centred rows to one triangle by QR, batch after batch, and triangles are reduced again until one
is left; its squared singular values are those of the covariance. That triangle, as wide as a vector is long, is all
that the driver sees. There Householder reflections make it bidiagonal, the differential qd algorithm with shifts (dqds)
finds the singular values to high relative accuracy, and a twisted factorisation for each one wanted gives its vector.
No covariance is formed on the way, so small components keep their digits.

Vectors hold whole numbers: sums over all rows are exact, and a centred entry is the exact n x - S over n.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from math import inf, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillweave.llm.common import materialize

#: Triangles that meet in one task are those of a share of all tasks; this many shares, then one.
FAN_IN = 32
#: Values closer than this, relative to their size, are a cluster whose vectors are made orthogonal.
CLUSTER_GAP = 1e-3
_EPS = float(np.finfo(float).eps)


def usable(vector: Column) -> Column:
    """True for a vector that is there, with no null, infinite or NaN entry."""
    bad = F.exists(vector, lambda c: c.isNull() | F.isnan(c.cast("double")) | (F.abs(c.cast("double")) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(True))


def whole_numbers(vector: Column, factor: int, offset: int) -> Column:
    """Entries as floor(factor x entry) + offset; null for an entry that is not finite or beyond 52 bits."""

    def whole(c: Column) -> Column:
        scaled = c.cast("double") * factor
        return F.when(F.abs(scaled) < 2.0**52, F.floor(F.when(F.abs(scaled) < 2.0**52, scaled).otherwise(0.0)) + offset)

    return F.transform(vector, whole)


# The small problem: one triangle.


def bidiagonal(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(diagonal, upper diagonal, V) of U' R V by Householder reflections from both sides."""
    a, d = np.array(r, float), r.shape[0]
    v = np.eye(d)

    def reflector(x: np.ndarray) -> np.ndarray | None:
        size = np.linalg.norm(x)
        if not size or not np.linalg.norm(x[1:]):
            return None
        w = x / size
        w[0] += np.copysign(1.0, w[0])
        return w / np.linalg.norm(w)

    for k in range(d):
        w = reflector(a[k:, k])
        if w is not None:
            a[k:, k:] -= 2 * np.outer(w, w @ a[k:, k:])
        w = reflector(a[k, k + 1 :]) if k + 2 < d else None
        if w is not None:
            a[k:, k + 1 :] -= 2 * np.outer(a[k:, k + 1 :] @ w, w)
            v[:, k + 1 :] -= 2 * np.outer(v[:, k + 1 :] @ w, w)
    return np.diag(a).copy(), np.diag(a, 1).copy(), v


def _lower_bound(q: list[float], e: list[float]) -> float:
    """A bound from below on the least squared singular value: one over the trace of the inverse, by a qd sweep."""
    d, total = q[0], 0.0
    for k in range(len(q)):
        if d <= 0.0:
            return 0.0
        total += 1.0 / d
        if k + 1 < len(q):
            d *= q[k + 1] / (d + e[k])
    return 1.0 / total if total < inf else 0.0


def _sweep(q: list[float], e: list[float], shift: float) -> tuple[list[float], list[float]] | None:
    """One dqds transform; None if the shift was too large."""
    new_q, new_e, d = [], [], q[0] - shift
    for k in range(len(e)):
        if d < 0.0:
            return None
        head = d + e[k]
        if head == 0.0:  # both are zero: nothing moves on
            new_q.append(0.0)
            new_e.append(0.0)
            d = q[k + 1] - shift
            continue
        ratio = q[k + 1] / head
        new_q.append(head)
        new_e.append(e[k] * ratio)
        d = d * ratio - shift
    if d < 0.0:
        return None
    return [*new_q, d], new_e


def singular_values(diagonal: Sequence[float], upper: Sequence[float]) -> np.ndarray:
    """Singular values of an upper bidiagonal matrix, largest first, by dqds.

    The shift of a sweep is a lower bound on the least value left, so values come out smallest first; a negligible
    off-diagonal splits the problem.
    """
    scale = float(max(np.abs(diagonal).max(initial=0.0), np.abs(upper).max(initial=0.0)))
    if not scale:
        return np.zeros(len(diagonal))
    found: list[float] = []
    blocks = [([(float(x) / scale) ** 2 for x in diagonal], [(float(x) / scale) ** 2 for x in upper], 0.0)]
    while blocks:
        q, e, moved = blocks.pop()
        while len(q) > 1:
            cut = next((k for k in reversed(range(len(e))) if e[k] <= _EPS * _EPS * (moved + q[k + 1]) or e[k] <= _EPS * _EPS * q[k]), None)
            if cut is not None:
                blocks.append((q[: cut + 1], e[:cut], moved))
                q, e = q[cut + 1 :], e[cut + 1 :]
                continue
            if 1.5 * q[0] < q[-1]:
                q, e = q[::-1], e[::-1]
            shift = _lower_bound(q, e) * (1.0 - 4.0 * _EPS * len(q))
            if shift < _EPS * moved:
                shift = 0.0
            made = _sweep(q, e, shift)
            while made is None:
                shift = shift / 2 if shift > _EPS * moved else 0.0
                made = _sweep(q, e, shift)
            (q, e), moved = made, moved + shift
        found.append(moved + q[0])
    return scale * np.sqrt(np.sort(np.array(found))[::-1])


def twisted_vector(diagonal: np.ndarray, upper: np.ndarray, value: float, twist: int = 0) -> np.ndarray:
    """Unit right singular vector of a bidiagonal matrix for a singular value, from the twisted factorisation of
    B'B less the squared value. ``twist`` 0 takes the place where it is nearest to singular, 1 the next one, and so on.
    """
    size = max(np.abs(diagonal).max(), np.abs(upper).max(initial=0.0))
    a = np.where(np.abs(diagonal) > _EPS * size, diagonal, _EPS * size) / size
    b, n = upper / size, len(a)
    lam, tiny = (value / size) ** 2, _EPS * _EPS
    d, low = a * a, b / a[:-1]
    s, p = np.empty(n), np.empty(n)
    down, up = np.zeros(max(n - 1, 0)), np.zeros(max(n - 1, 0))
    s[0], p[-1] = -lam, d[-1] - lam
    for k in range(n - 1):  # from the top
        head = s[k] + d[k]
        head = head if abs(head) > tiny else tiny
        down[k] = d[k] * low[k] / head
        s[k + 1] = down[k] * low[k] * s[k] - lam
    for k in range(n - 2, -1, -1):  # from the bottom
        head = d[k] * low[k] * low[k] + p[k + 1]
        head = head if abs(head) > tiny else tiny
        up[k] = low[k] * d[k] / head
        p[k] = p[k + 1] * (d[k] / head) - lam
    at = int(np.argsort(np.abs(s + p + lam), kind="stable")[min(twist, n - 1)])
    z = np.zeros(n)
    z[at] = 1.0
    for k in range(at - 1, -1, -1):
        z[k] = -down[k] * z[k + 1]
    for k in range(at, n - 1):
        z[k + 1] = -up[k] * z[k]
    return z / np.linalg.norm(z)


def principal(r: np.ndarray, components: int) -> tuple[np.ndarray, np.ndarray]:
    """All singular values of a triangle, largest first, and the right vectors of the first ones as columns.

    The entry of a vector that is largest in size is positive.
    """
    diagonal, upper, v = bidiagonal(r)
    values = singular_values(diagonal, upper)
    if not values.any():
        return values, np.eye(len(values))[:, :components]
    made: list[np.ndarray] = []
    for j in range(min(components, len(values))):
        near = [made[i] for i in range(j) if values[i] - values[j] <= CLUSTER_GAP * values[i]]
        best, left = None, -1.0
        for twist in range(len(values)):
            z = twisted_vector(diagonal, upper, float(values[j]), twist)
            for _ in range(2):
                for other in near:
                    z = z - (other @ z) * other
            size = float(np.linalg.norm(z))
            if size > left:
                best, left = z, size
            if left > 0.1:
                break
        made.append(best / left)
    vectors = v @ np.stack(made, 1) if made else np.zeros((len(values), 0))
    signs = np.sign(vectors[np.abs(vectors).argmax(0), np.arange(vectors.shape[1])])
    return values, vectors * np.where(signs == 0, 1.0, signs)


# The large problem: all rows.


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _sums(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, total = 0, np.zeros(width, np.int64)
        for batch in batches:
            rows += batch.num_rows
            total += _matrix(batch.column(0), width).sum(0)
        if rows:
            columns = [pa.array([rows], pa.int64()), pa.array([total.tolist()], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["n", "sums"])

    return run


def _centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    return (n * x - sums) / n


def _triangle(parts: Iterator[np.ndarray], width: int) -> Iterator[pa.RecordBatch]:
    """QR of a stream of blocks, one block and the triangle so far at a time."""
    r, rows = np.zeros((0, width)), 0
    for block in parts:
        rows += len(block)
        r = np.linalg.qr(np.concatenate([r, block]), mode="r")
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array([r.tobytes()], pa.binary())], ["triangle"])


def covariance_triangle(vectors: DataFrame, width: int, n: int, sums: np.ndarray) -> np.ndarray:
    """R with R'R = the sum of the outer products of the centred rows; at most ``width`` rows of ``width`` numbers."""

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _triangle((_centred(_matrix(b.column(0), width), n, sums) for b in batches if b.num_rows), width)

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _triangle((np.frombuffer(t, float).reshape(-1, width) for b in batches for t in b.column(0).to_pylist()), width)

    parts = vectors.mapInArrow(first, "triangle binary")
    parts = parts.repartition(FAN_IN).mapInArrow(again, "triangle binary")
    rows = parts.coalesce(1).mapInArrow(again, "triangle binary").collect()
    square = np.zeros((width, width))
    if rows:
        r = np.frombuffer(bytes(rows[0]["triangle"]), float).reshape(-1, width)
        square[: len(r)] = r
    return square


def _exact_squares(x: np.ndarray, n: int, sums: np.ndarray) -> list[int | None]:
    """Sum over dimensions of (n x - S)^2; None beyond 64 bits."""
    gap = n * x - sums
    largest = int(np.abs(gap).max(initial=0))
    if largest * largest * x.shape[1] < 2**63:
        return (gap * gap).sum(1).tolist()
    exact = [sum(int(g) * int(g) for g in row) for row in gap]
    return [e if e < 2**63 else None for e in exact]


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = 8) -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error): one row per vector and component.

    ``vector_col`` is an array of bigint. Vectors that are null, empty or hold a null are left out, as are those of
    another length than most have (of equally frequent lengths the greatest counts). The components are the unit
    eigenvectors of the covariance (divisor n), numbered from 1 by falling eigenvalue; there are as many as asked, or as
    a vector has entries. ``whitened`` is the centred vector along the component over the root of the eigenvalue, and
    null where that is zero, as for a single vector or a dimension too many. ``deviation`` is the exact sum over
    dimensions of (n x - S)^2, null beyond 64 bits. ``explained`` is the share of the eigenvalue in the trace, null if
    that is zero. ``identity_error`` is one value: the largest entry of the covariance of ``whitened`` less the
    identity, over the components that have values; null if none has. Repeated rows each count and are each returned,
    also those without id. An empty table gives no rows. Other columns are not read.
    """
    kind = vectors.schema[id_col].dataType.simpleString()
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("x"))
    rows = rows.where(F.col("x").isNotNull() & (F.size("x") > 0) & ~F.exists("x", lambda c: c.isNull()))
    schema = f"{id_col} {kind}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    common = rows.groupBy(F.size("x").alias("width")).count().orderBy(F.desc("count"), F.desc("width")).first()
    if common is None:
        return vectors.sparkSession.createDataFrame([], schema)
    width = common["width"]
    rows = rows.where(F.size("x") == width)
    parts = rows.select("x").mapInArrow(_sums(width), "n bigint, sums array<bigint>")
    totals = parts.select("n", F.posexplode("sums").alias("place", "part")).groupBy("place").agg(F.sum("n").alias("n"), F.sum("part").alias("total"))
    found = sorted(totals.collect(), key=lambda r: r["place"])
    n, sums = found[0]["n"], np.array([r["total"] for r in found], np.int64)
    values, axes = principal(covariance_triangle(rows.select("x"), width, n, sums), components)
    eigen, trace = values**2 / n, float((values**2).sum() / n)
    eigen = eigen[: axes.shape[1]]
    # A value at the rounding error of the largest is a zero one.
    live = eigen > trace * (width * _EPS) ** 2
    scaled = axes[:, live] / np.sqrt(eigen[live])
    k = int(live.sum())

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column(1), width)
                out = _centred(x, n, sums) @ scaled
                columns = [batch.column(0), pa.array(_exact_squares(x, n, sums), pa.int64())]
                yield pa.RecordBatch.from_arrays([*columns, *(pa.array(out[:, j]) for j in range(k))], ["id", "deviation", *(f"w{j}" for j in range(k))])

    made = ", ".join([f"id {kind}", "deviation bigint", *(f"w{j} double" for j in range(k))])
    # Written, as the check of the result reads it before it is returned.
    whitened = materialize(rows.mapInArrow(project, made), "whitened")
    error = F.lit(None).cast("double")
    if k:
        cells = [F.abs(F.covar_pop(f"w{i}", f"w{j}") - float(i == j)) for i in range(k) for j in range(i + 1)]
        worst = whitened.agg(F.greatest(*cells) if len(cells) > 1 else cells[0]).first()[0]
        error = F.lit(float(worst))
    shares = [float(e / trace) if trace else None for e in eigen]
    per_component = F.array(
        *[
            F.struct(
                F.lit(j + 1).alias("component"),
                (F.col(f"w{j}") if live[j] else F.lit(None).cast("double")).alias("whitened"),
                F.lit(shares[j]).cast("double").alias("explained"),
            )
            for j in range(len(eigen))
        ]
    )
    return whitened.select("id", "deviation", F.explode(per_component).alias("c")).select(
        F.col("id").alias(id_col),
        "c.component",
        F.lit(n).cast("bigint").alias("n"),
        "deviation",
        "c.whitened",
        "c.explained",
        error.alias("identity_error"),
    )
