"""Operator 11: whitening directions of embeddings from a bidiagonal form of their centred rows."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType

from ..operators.scale import frozen
from .common import ship

SCALE, SHIFT = 64, 1_000_000  # an entry c counts as floor(SCALE * c) + SHIFT
EXTREME = 1 << 32  # no entry counts as more than this from zero
COMPONENTS = 32
ROWS = 2048  # rows that a task holds as doubles at a time
MET = 16  # triangles that are reduced together
EPS = float(np.finfo(float).eps)
TIGHT = 1e-3  # relative gap below which eigenvalues are treated as one cluster


def integers(vectors: pa.Array, dims: int | None = None) -> tuple[np.ndarray, list[np.ndarray]]:
    """Rows that remain and their integer vectors; with ``dims`` those of that length alone.

    Vectors that are null, empty, or hold null or non-finite entries do not remain. Without
    ``dims`` the second part has one array per length that occurs, otherwise one array.
    """
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    lengths = vectors.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    flat = vectors.flatten()
    values = flat.to_numpy(zero_copy_only=False).astype(np.float64)  # null becomes NaN
    bad = np.concatenate(([0], np.cumsum(~np.isfinite(values))))
    ends = np.cumsum(lengths)
    starts = ends - lengths
    good = (lengths > 0) & (bad[ends] == bad[starts])
    out, kept = [], []
    for n in [dims] if dims is not None else sorted(set(lengths[good].tolist())):
        rows = np.flatnonzero(good & (lengths == n))
        kept.append(rows)
        x = np.floor(values[starts[rows][:, None] + np.arange(n)] * SCALE)
        out.append(np.clip(x + SHIFT, -EXTREME, EXTREME).astype(np.int64))
    return (np.concatenate(kept) if kept else np.zeros(0, np.int64)), out


def _centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """n*x - S, exact: as int64 where that holds it, else as Python's integers."""
    if (int(np.abs(x).max(initial=0)) + EXTREME) * n < 1 << 62:
        return x * n - sums
    return x.astype(object) * n - sums.astype(object)


def bidiagonal(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Householder's reduction: diagonal a, superdiagonal b and V of R = U B V'."""
    r = r.copy()
    d = len(r)
    v = np.eye(d)

    def reflector(x: np.ndarray) -> tuple[np.ndarray, float]:
        size = np.abs(x).max(initial=0.0)
        if size == 0 or not x[1:].any():
            return np.zeros_like(x), 0.0
        x = x / size
        u = x.copy()
        u[0] += math.copysign(np.linalg.norm(x), x[0])
        return u, 2.0 / (u @ u)

    for k in range(d):
        u, t = reflector(r[k:, k])
        if t:
            r[k:, k:] -= np.outer(t * u, u @ r[k:, k:])
        if k < d - 2:
            u, t = reflector(r[k, k + 1 :])
            if t:
                r[k:, k + 1 :] -= np.outer(r[k:, k + 1 :] @ u, t * u)
                v[:, k + 1 :] -= np.outer(v[:, k + 1 :] @ u, t * u)
    return np.diag(r).copy(), np.diag(r, 1).copy(), v


def dqds(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squares of the singular values of the bidiagonal (a, b), falling, to high relative accuracy.

    The differential quotient-difference transform with shifts: a step takes away a shift below
    the smallest eigenvalue with products and quotients of positive numbers only. A shift that
    was too large shows as a negative number, and the step is done again with a smaller one.
    """
    q, e = (a * a).tolist(), (b * b).tolist()
    biggest = max([*q, *e, 0.0])
    out: list[float] = []
    # a superdiagonal that is nothing splits the problem
    stack = [(q, e, 0.0)]
    while stack:
        q, e, sigma = stack.pop()
        guess = 0.0
        while q:
            if len(q) == 1:
                out.append(sigma + q[0])
                break
            cut = next(
                (
                    i
                    for i in range(len(e) - 1, -1, -1)
                    if e[i] <= EPS * EPS * (sigma + min(q[i], q[i + 1]))
                    or e[i] <= EPS * EPS * EPS * biggest
                ),
                None,
            )
            if cut is not None:
                stack.append((q[: cut + 1], e[:cut], sigma))
                q, e, guess = q[cut + 1 :], e[cut + 1 :], 0.0
                continue
            tries = 0
            while True:
                shift = guess if tries < 3 else 0.0
                step = _step(q, e, shift)
                if step is not None:
                    break
                guess *= 0.25 if tries else 0.5
                tries += 1
            q, e, least = step
            sigma += shift
            guess = 0.9 * least if least > EPS * sigma else 0.0
    return np.array(sorted(out, reverse=True))


def _step(q: list[float], e: list[float], shift: float):
    """One step; the smallest of its inner values bounds the next shift. None if it fails."""
    new_q, new_e = [], []
    d = q[0] - shift
    least = d
    for i in range(len(e)):
        if d < 0 or (shift and d == 0):
            return None
        total = d + e[i]
        new_q.append(total)
        if total == 0:  # a zero row: what follows is untouched
            new_e.append(0.0)
            d = q[i + 1] - shift
        else:
            ratio = q[i + 1] / total
            new_e.append(e[i] * ratio)
            d = d * ratio - shift
        least = min(least, d)
    if d < 0:
        return None
    new_q.append(d)
    return new_q, new_e, max(least, 0.0)


def twisted(a: np.ndarray, b: np.ndarray, value: float) -> np.ndarray:
    """The unit eigenvector of B'B for an eigenvalue, by the best twisted factorisation.

    B'B - value is factored from the top (stationary) and from the bottom (progressive); where
    the two meet with the smallest pivot, the solution of the two-sided recurrence is the vector.
    """
    d = len(a)
    tiny = max(float(np.max(a * a, initial=0.0)), float(np.max(b * b, initial=0.0))) * EPS * EPS
    tiny = tiny or 1.0

    def safe(x: float) -> float:
        return x if abs(x) > tiny else math.copysign(tiny, x)

    q = (a * a).tolist()
    e = (b * b).tolist()
    # B'B = L D L' with D = q and L = b / a; its off-diagonals are a_i b_i
    off = (a[:-1] * b).tolist()
    down, s = [0.0] * d, [0.0] * d
    s[0] = -value
    for i in range(d - 1):
        down[i] = safe(s[i] + q[i])
        s[i + 1] = e[i] * (s[i] / down[i]) - value
    down[d - 1] = safe(s[d - 1] + q[d - 1])
    up, p = [0.0] * d, [0.0] * d
    p[d - 1] = q[d - 1] - value
    for i in range(d - 2, -1, -1):
        up[i + 1] = safe(e[i] + p[i + 1])
        p[i] = q[i] * (p[i + 1] / up[i + 1]) - value
    twist = min(range(d), key=lambda i: abs(s[i] + p[i] + value))
    z = np.zeros(d)
    z[twist] = 1.0
    for i in range(twist - 1, -1, -1):
        z[i] = -off[i] / down[i] * z[i + 1]
        if abs(z[i]) > 1e100:
            z /= abs(z[i])
    for i in range(twist + 1, d):
        z[i] = -off[i - 1] / up[i] * z[i - 1]
        if abs(z[i]) > 1e100:
            z /= abs(z[i])
    return z / np.linalg.norm(z)


def directions(r: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """The largest eigenvalues of R'R, all of them, and unit eigenvectors of the first ``count``.

    Vectors of eigenvalues that nearly agree are fixed as a space only, which single twisted
    factorisations don't span: those of a cluster are made orthogonal, turned to the axes of R
    within their space, and refilled where two came out alike.
    """
    size = float(np.abs(r).max(initial=0.0))
    if size == 0:
        return np.zeros(len(r)), np.zeros((len(r), 0))
    a, b, v = bidiagonal(r / size)
    values = dqds(a, b)
    floor = values[0] * len(r) * EPS
    count = min(count, int((values > floor).sum()))
    # clusters reach beyond the last wanted value, so that their spaces are whole
    ends = [k for k in range(1, len(values)) if values[k - 1] - values[k] > TIGHT * values[k - 1]]
    bounds = list(zip([0, *ends], [*ends, len(values)], strict=True))
    core = np.diag(a) + np.diag(b, 1)
    rng = np.random.default_rng(0)
    columns: list[np.ndarray] = []
    done = np.zeros((len(r), 0))
    for lo, hi in bounds:
        if lo >= count:
            break
        z = np.stack([twisted(a, b, float(values[k])) for k in range(lo, hi)], 1)
        if hi - lo > 1:
            z = _spanned(a, b, z, values[lo:hi], done, rng)
            image = core @ z
            z = z @ np.linalg.svd(image, full_matrices=False)[2].T
        columns.append(z)
        done = np.concatenate((done, z), 1)
    z = np.concatenate(columns, 1)[:, :count]
    return values * size * size, v @ z


def _spanned(a, b, z, values, done, rng) -> np.ndarray:
    """An orthonormal basis of a cluster's space that starts from its twisted vectors."""
    out = np.zeros((len(a), 0))
    for k in range(z.shape[1]):
        x = z[:, k]
        for attempt in range(20):
            before = np.concatenate((done, out), 1)
            y = x - before @ (before.T @ x)
            y -= before @ (before.T @ y)
            norm = np.linalg.norm(y)
            if norm > 0.1:
                break
            # alike: inverse iteration from a new start, orthogonal to what is there
            x = rng.standard_normal(len(a))
            for _ in range(3):
                x -= before @ (before.T @ x)
                x = _solved(a, b, float(values[k]), x)
                x /= np.linalg.norm(x)
        out = np.concatenate((out, (y / norm)[:, None]), 1)
    return out


def _solved(a: np.ndarray, b: np.ndarray, value: float, x: np.ndarray) -> np.ndarray:
    """(B'B - value) y = x, with the value moved off the eigenvalue by a rounding error."""
    t = np.diag(a * a)
    t[np.arange(1, len(a)), np.arange(1, len(a))] += b * b
    t += np.diag(a[:-1] * b, 1) + np.diag(a[:-1] * b, -1)
    top = float(np.abs(t).max())
    return np.linalg.solve(t - (value + 4 * EPS * top) * np.eye(len(a)), x)


def _stacked(triangles: list[np.ndarray]) -> np.ndarray:
    return np.linalg.qr(np.concatenate(triangles), mode="r")


_RESULT = (
    ("n", LongType()),
    ("deviation", LongType()),
    ("whitened", ArrayType(DoubleType())),
    ("explained", ArrayType(DoubleType())),
    ("identity_error", DoubleType()),
)


def whitened(
    vectors: DataFrame, key: str = "vec_id", column: str = "embedding", components: int = COMPONENTS
) -> DataFrame:
    """``row`` (all columns but the vector), ``deviation`` and the ``whitened`` coordinates, with
    the fit's ``n``, ``explained`` shares and ``identity_error``.

    An entry counts as an integer, so that means are exact. The centred rows are reduced to
    triangles, a block of rows and then a few triangles at a time, which squares no condition
    number and holds at most a block and a triangle; the last triangle (dimensions squared, the
    only thing the driver holds besides the sums) is made bidiagonal, its singular values come
    from qd steps and the directions from twisted factorisations.

    Rows whose vector is null or empty or holds null or non-finite entries have no result, and
    neither have vectors of another length than the commonest one (the longer of two equally
    common). Directions without variance are left out, so a table of equal vectors has none.
    Entries beyond 2^32 in their integer form count as that. A deviation too large for a long is
    null. Repeated rows count as often as they stand there. Coordinates are those of the rows as
    they lie; nothing is shuffled but sums and triangles.
    """
    spark = vectors.sparkSession
    rows = vectors.select(
        F.struct(*[F.col(f"`{c}`") for c in vectors.columns if c != column]).alias("row"),
        F.col(f"`{column}`").cast("array<double>").alias("v"),
    )

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, list] = {}
        for batch in batches:
            for x in integers(batch["v"])[1]:
                total = totals.setdefault(x.shape[1], [0, np.zeros(x.shape[1], np.int64)])
                total[0] += len(x)
                total[1] += x.sum(0)
        for dims, (n, sums) in totals.items():
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([dims] * dims, pa.int32()),
                    pa.array(range(dims), pa.int32()),
                    pa.array([n] * dims, pa.int64()),
                    pa.array(sums, pa.int64()),
                ],
                ["dims", "dim", "n", "s"],
            )

    totals = frozen(
        rows.select("v")
        .mapInArrow(add, "dims int, dim int, n long, s long")
        .groupBy("dims", "dim")
        .agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    )
    common = totals.filter("dim = 0").orderBy(F.desc("n"), F.desc("dims")).first()
    out = rows.drop("v").schema
    for name, kind in _RESULT:
        out = out.add(name, kind)
    if common is None:
        return spark.createDataFrame([], out)
    dims, n = common["dims"], common["n"]
    sums = np.array(
        [r["s"] for r in totals.filter(F.col("dims") == dims).orderBy("dim").collect()], np.int64
    )

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = np.zeros((0, dims))
        for batch in batches:
            x = integers(batch["v"], dims)[1][0]
            for k in range(0, len(x), ROWS):
                r = _stacked([r, _centred(x[k : k + ROWS], n, sums).astype(float) / n])
        if len(r):
            yield pa.RecordBatch.from_arrays(
                [pa.array([int(part())], pa.int64()), pa.array([r.tobytes()], pa.binary())], ["part", "r"]
            )

    def part() -> int:
        from pyspark import TaskContext

        return TaskContext.get().partitionId()

    triangles = frozen(rows.select("v").mapInArrow(reduce, "part long, r binary"))

    def meet(found: pd.DataFrame) -> pd.DataFrame:
        many = [np.frombuffer(r).reshape(-1, dims) for r in found.sort_values("part").r]
        return pd.DataFrame({"part": [found.up.iloc[0]], "r": [_stacked(many).tobytes()]})

    parts = triangles.agg(F.max("part")).first()[0] + 1
    while parts > 1:
        up = F.floor(F.col("part") / MET).alias("up")
        triangles = frozen(
            triangles.select("*", up).groupBy("up").applyInPandas(meet, "part long, r binary")
        )
        parts = -(-parts // MET)
    r = np.frombuffer(triangles.first()["r"]).reshape(-1, dims)
    if len(r) < dims:  # fewer rows than dimensions
        r = np.concatenate((r, np.zeros((dims - len(r), dims))))
    values, axes = directions(r, components)
    shares = (values[: axes.shape[1]] / values.sum()) if axes.shape[1] else np.zeros(0)
    # x - S/n on an axis over the root of its eigenvalue, where R'R = n V
    axes = axes / np.sqrt(values[: axes.shape[1]] / n)
    width = axes.shape[1]

    def coordinates(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        kept, (x,) = integers(batch["v"], dims)
        c = _centred(x, n, sums)
        return kept, c, c.astype(float) / n @ axes

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, square = np.zeros(width), np.zeros((width, width))
        for batch in batches:
            w = coordinates(batch)[2]
            total += w.sum(0)
            square += w.T @ w
        i, j = np.divmod(np.arange(width * width), max(width, 1))
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(i, pa.int32()),
                pa.array(j, pa.int32()),
                pa.array(square.ravel()),
                pa.array(total[i]),
                pa.array(total[j]),
            ],
            ["i", "j", "ww", "wi", "wj"],
        )

    error = (
        rows.select("v")
        .mapInArrow(moments, "i int, j int, ww double, wi double, wj double")
        .groupBy("i", "j")
        .agg(
            (
                F.sum("ww") / n
                - F.sum("wi") * F.sum("wj") / n / n
                - F.when(F.col("i") == F.col("j"), 1.0).otherwise(0.0)
            ).alias("x")
        )
        .agg(F.max(F.abs("x")))
        .first()[0]
    )

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, c, w = coordinates(batch)
            m = len(kept)
            if not m or not width:
                continue
            top = int(np.abs(c).max())
            if top * top * dims < 1 << 62:
                deviation = (c * c).sum(1).tolist()
            else:
                big = (c.astype(object) ** 2).sum(1).tolist()
                deviation = [x if x < 1 << 63 else None for x in big]
            yield pa.RecordBatch.from_arrays(
                [
                    batch["row"].take(pa.array(kept)),
                    pa.array([n] * m, pa.int64()),
                    pa.array(deviation, pa.int64()),
                    _lists(w),
                    _lists(np.broadcast_to(shares, (m, width))),
                    pa.array([error] * m, pa.float64()),
                ],
                ["row", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return rows.mapInArrow(finish, out)


def _lists(values: np.ndarray) -> pa.Array:
    m, width = values.shape
    return pa.ListArray.from_arrays(
        pa.array(np.arange(m + 1) * width, pa.int32()), pa.array(np.ascontiguousarray(values).ravel())
    )


ship(__name__)
