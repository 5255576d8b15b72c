"""Embedding whitening by incremental eigendecomposition.

Vectors become integers (``floor(1024 * c) + 100000``), so counts and sums are exact. Each task keeps the
spectrum of the scatter matrix of the rows it has seen and takes each row in as a centred rank-one
update: the new eigenvalues are the roots of a secular equation, found for all roots at once between the
old ones; components that the row does not touch and equal eigenvalues are deflated first. Spectra of
tasks are combined in the same way, by successive rank-one updates with the scaled eigenvectors of the
one and the difference of the means, a few spectra per task and level until one is left. A distributed
Rayleigh-Ritz step over all rows then projects the centred rows on that basis, sums their products and
rotates the basis, which takes out the rounding of the updates.

A spectrum is d numbers and d vectors, whatever the number of rows: this is all that leaves a task, and
the last one, the sums and the d x d products are all that the driver holds.

Edge cases: vectors that are NULL or hold NULL, NaN or infinite entries are dropped; so are vectors of
another length than the most frequent one (of equally frequent lengths the greatest stays); NULL ids are
ids like others; repeated rows count each; components without variance are left out, so equal vectors, a
single one or an empty table give no rows; ``deviation`` is exact and NULL where a long cannot hold it;
further columns are not read, so their names cannot clash.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cutline.session import materialise

SCALE, SHIFT = 1024, 100_000
MOST = 8  # components given out
FAN = 16  # spectra (or sums) that a task combines
EPS = np.finfo(np.float64).eps


# ---- one spectrum ------------------------------------------------------------------


def secular_roots(d: np.ndarray, z2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Roots of ``1 + sum(z2 / (d - x)) = 0``, one above each of the rising ``d``.

    Returns for each root the number of the pole it is measured from and the distance, so that
    differences to poles keep their digits. All roots are iterated together: the sums over
    the poles below and above are replaced by one fraction each (the "middle way"), and a step that
    leaves its bracket is replaced by the bracket's middle.
    """
    k = len(d)
    # A pole without weight above the last root makes all intervals alike.
    poles = np.append(d, d[-1] + 2 * z2.sum())
    weights = np.append(z2, 0.0)
    gap = np.diff(poles)
    at = np.arange(k)
    below = at[:, None] >= np.arange(k + 1)
    middle = 1 + (weights / (poles - (d + gap / 2)[:, None])).sum(1)
    origin = np.where((middle < 0) & (at < k - 1), at + 1, at)
    delta = poles - poles[origin][:, None]
    low = np.where(origin > at, -gap / 2, 0.0)
    high = np.where(origin > at, 0.0, np.where(middle < 0, gap, gap / 2))
    low = np.where((origin == at) & (middle < 0), gap / 2, low)
    x = (low + high) / 2
    for _ in range(60):
        off = delta - x[:, None]
        part = weights / off
        f = 1 + part.sum(1)
        scale = 1 + np.abs(part).sum(1)
        slope = part / off
        d1 = (slope * below).sum(1)
        d2 = slope.sum(1) - d1
        low, high = np.where(f < 0, x, low), np.where(f < 0, high, x)
        done = (np.abs(f) <= 4 * EPS * scale) | (high - low <= 2 * EPS * np.abs(x))
        if done.all():
            break
        p, q = off[at, at], off[at, at + 1]
        c = f - p * d1 - q * d2
        a = (p + q) * f - p * q * (d1 + d2)
        b = p * q * f
        with np.errstate(all="ignore"):
            root = np.sqrt(np.maximum(a * a - 4 * b * c, 0))
            step = np.where(a <= 0, (a - root) / (2 * c), 2 * b / (a + root))
        new = x + step
        bad = ~np.isfinite(new) | (new <= low) | (new >= high)
        x = np.where(done, x, np.where(bad, (low + high) / 2, new))
    return origin, x


def _deflate_equal(d: np.ndarray, z: np.ndarray, q: np.ndarray, tol: float) -> None:
    """Turns neighbours of (nearly) equal eigenvalue so that one of them is untouched; in place."""
    for i in range(len(d) - 1):
        r2 = z[i] * z[i] + z[i + 1] * z[i + 1]
        if r2 and abs((d[i + 1] - d[i]) * z[i] * z[i + 1]) <= tol * r2:
            r = np.sqrt(r2)
            c, s = z[i + 1] / r, z[i] / r
            q[:, [i, i + 1]] = np.stack([c * q[:, i] - s * q[:, i + 1], s * q[:, i] + c * q[:, i + 1]], 1)
            d[i], d[i + 1] = c * c * d[i] + s * s * d[i + 1], s * s * d[i] + c * c * d[i + 1]
            z[i], z[i + 1] = 0.0, r


def rank_one(d: np.ndarray, q: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spectrum of ``q diag(d) q' + v v'``: rising eigenvalues and their vectors as columns.

    ``q`` may have fewer columns than rows; a part of ``v`` outside its span becomes a new column
    with eigenvalue 0.
    """
    z = v @ q
    rest = v - q @ z
    again = rest @ q
    z, rest = z + again, rest - q @ again
    norm = np.sqrt(rest @ rest)
    size = np.sqrt(v @ v)
    if q.shape[1] < len(v) and norm > 64 * EPS * size:
        d, z = np.append(0.0, d), np.append(norm, z)
        q = np.column_stack([rest / norm, q])
    else:
        d, z, q = d.copy(), z.copy(), q.copy()
    if not len(d) or not size:
        return d, q
    tol = 8 * EPS * max(d[-1], size * size)
    # The untouched columns stay as they are; only the others enter the equation.
    z[np.abs(z) * size <= tol] = 0.0
    touched = np.flatnonzero(z)
    dt, zt = d[touched], z[touched]
    if len(touched) > 1 and ((np.diff(dt) * np.abs(zt[1:] * zt[:-1])) <= tol * (zt[1:] ** 2 + zt[:-1] ** 2)).any():
        qt = q[:, touched]
        _deflate_equal(dt, zt, qt, tol)
        d[touched], q[:, touched] = dt, qt
        order = np.argsort(dt, kind="stable")
        touched, zt = touched[order], zt[order]
        keep = zt != 0
        touched, zt = touched[keep], zt[keep]
        dt = d[touched]
    if len(touched) == 1:
        d[touched] += zt * zt
    elif len(touched):
        z2 = zt * zt
        origin, x = secular_roots(dt, z2)
        # ahead[i, j]: root i minus pole j.
        ahead = x[:, None] - (dt - dt[origin][:, None])
        # Weights for which these roots are exact make the vectors orthogonal to full precision.
        ratio = np.ones_like(ahead)
        n = len(dt)
        apart = dt[:, None] - dt  # pole i minus pole j
        lower = np.tri(n, k=-1, dtype=bool)  # i > j
        upper = ~np.tri(n, dtype=bool)  # i < j
        # Root i lies above pole i: root i pairs with pole i below j, with pole i + 1 from j on.
        ratio[upper] = ahead[upper] / apart[upper]
        above = lower[1:]
        ratio[:-1][above] = ahead[:-1][above] / apart[1:][above]
        ratio[-1] = ahead[-1]
        weight = np.sqrt(np.maximum(ratio.prod(0), 0.0)) * np.sign(zt)
        turn = weight / -ahead
        turn /= np.sqrt((turn * turn).sum(1))[:, None]
        q[:, touched] = q[:, touched] @ turn.T
        d[touched] = dt[origin] + x
    order = np.argsort(d, kind="stable")
    return d[order], q[:, order]


@dataclass
class Spectrum:
    """Count, exact sums of the shifted integers, mean, and the scatter matrix's eigenpairs."""

    n: int
    sums: np.ndarray
    mean: np.ndarray
    values: np.ndarray
    vectors: np.ndarray

    @classmethod
    def empty(cls, dim: int) -> Spectrum:
        return cls(0, np.zeros(dim, np.int64), np.zeros(dim), np.zeros(0), np.zeros((dim, 0)))

    def add(self, x: np.ndarray) -> None:
        off = x - self.mean
        if self.n:
            step = off * np.sqrt(self.n / (self.n + 1))
            self.values, self.vectors = rank_one(self.values, self.vectors, step)
        self.n += 1
        self.sums += x
        self.mean += off / self.n

    def merge(self, other: Spectrum) -> None:
        """Takes in ``other``'s scaled eigenvectors and the difference of the means, one by one."""
        if not other.n:
            return
        if not self.n:
            self.__dict__.update(other.__dict__)
            return
        for value, vector in zip(other.values, other.vectors.T):
            if value > 0:
                self.values, self.vectors = rank_one(self.values, self.vectors, vector * np.sqrt(value))
        n = self.n + other.n
        off = (other.mean - self.mean) * np.sqrt(self.n / n * other.n)
        self.values, self.vectors = rank_one(self.values, self.vectors, off)
        self.n, self.sums = n, self.sums + other.sums
        self.mean = self.mean + (other.mean - self.mean) * (other.n / n)

    def row(self) -> tuple:
        lists = self.sums, self.mean, self.values, self.vectors.ravel()
        return (self.n, *[a.tolist() for a in lists])

    @classmethod
    def of(cls, n, sums, mean, values, vectors) -> Spectrum:
        mean = np.array(mean, np.float64)
        shaped = np.array(vectors, np.float64).reshape(len(mean), len(values))
        return cls(n, np.array(sums, np.int64), mean, np.array(values, np.float64), shaped)


SPECTRUM = "n long, sums array<long>, mean array<double>, values array<double>, vectors array<double>"


# ---- over all rows -----------------------------------------------------------------


def usable(df: DataFrame, vector: str) -> DataFrame:
    """Rows whose vector has numbers throughout and the most frequent length."""
    sound = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    whole = F.col(vector).isNotNull() & F.forall(vector, sound)
    rows = df.filter(whole)
    size = F.size(vector).alias("size")
    counts = rows.groupBy(size).agg(F.count(F.lit(1)).alias("n"))
    common = counts.orderBy(F.desc("n"), F.desc("size")).limit(1).collect()
    dim = common[0]["size"] if common else 0
    return rows.filter(F.size(vector) == dim)


def integers(batch: pa.RecordBatch, vector: str) -> np.ndarray:
    """The vectors of a batch, all of one length, as shifted integers less the shift."""
    lists = batch.column(batch.schema.get_field_index(vector))
    numbers = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return np.floor(SCALE * numbers).astype(np.int64).reshape(batch.num_rows, -1)


KINDS = {"long": pa.int64(), "array<long>": pa.list_(pa.int64()), "array<double>": pa.list_(pa.float64())}


def _one_row(part: int, schema: str, values: tuple) -> pa.Table:
    """A table of one row: ``part`` and the values, typed as ``schema`` says (lists may be empty)."""
    kinds = dict(f.split() for f in f"part long, {schema}".split(", "))
    made = {n: pa.array([v], KINDS[k]) for (n, k), v in zip(kinds.items(), (part, *values))}
    return pa.table(made)


def _combined(parts: DataFrame, merge: Callable, schema: str, label: str) -> tuple | None:
    """One row from many, ``FAN`` to a task and level; None of none.

    Each level is written, so a lost executor costs no more than its own groups.
    """
    level = materialise(parts, label)
    left = level.count()
    groups = left
    while left > 1:
        groups = max(1, -(-groups // FAN))

        def fold(table: pa.Table) -> pa.Table:
            rows = [tuple(r.values()) for r in table.drop_columns(["part"]).to_pylist()]
            return _one_row(table.column("part")[0].as_py(), schema, merge(rows))

        dealt = level.withColumn("part", F.pmod("part", F.lit(groups)))
        arrow = dealt.groupBy("part").applyInArrow(fold, f"part long, {schema}")
        level = materialise(arrow, label)
        left = level.count()
    rows = level.drop("part").collect()
    return tuple(rows[0]) if rows else None


def _per_task(rows: DataFrame, vector: str, start: Callable, schema: str) -> DataFrame:
    """A row per task that has rows: ``start()`` gives a function of integer rows and one of the result."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        take, result = None, None
        for batch in batches:
            if batch.num_rows:
                x = integers(batch, vector)
                if take is None:
                    take, result = start(x.shape[1])
                take(x)
        if take is not None:
            yield from _one_row(TaskContext.get().partitionId(), schema, result()).to_batches()

    return rows.select(vector).mapInArrow(run, f"part long, {schema}")


def spectrum(rows: DataFrame, vector: str) -> Spectrum | None:
    """Spectrum of the scatter matrix of all rows."""

    def start(dim: int):
        held = Spectrum.empty(dim)

        def take(x: np.ndarray) -> None:
            for row in x:
                held.add(row)

        return take, held.row

    def merge(rows: list[tuple]) -> tuple:
        total, *others = sorted((Spectrum.of(*r) for r in rows), key=lambda s: (-s.n, s.sums.tolist()))
        for s in others:
            total.merge(s)
        return total.row()

    found = _combined(_per_task(rows, vector, start, SPECTRUM), merge, SPECTRUM, "spectrum")
    return Spectrum.of(*found) if found else None


def _products(rows: DataFrame, vector: str, project: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """Sum over all rows of y y' and of y, as one array: products of (y, 1) with itself."""
    schema = "sums array<double>"

    def start(dim: int):
        held = [0.0]

        def take(x: np.ndarray) -> None:
            y = np.column_stack([project(x), np.ones(len(x))])
            held[0] = held[0] + y.T @ y

        return take, lambda: (held[0].ravel().tolist(),)

    def merge(rows: list[tuple]) -> tuple:
        return (np.sum([np.array(r[0]) for r in rows], axis=0).tolist(),)

    (found,) = _combined(_per_task(rows, vector, start, schema), merge, schema, "products")
    side = round(len(found) ** 0.5)
    return np.array(found).reshape(side, side)


@dataclass
class Whitener:
    """Components (rising numbers, falling variances) of the integer vectors."""

    n: int
    sums: np.ndarray  # of the integers less the shift
    values: np.ndarray
    components: np.ndarray  # as columns
    explained: np.ndarray

    def project(self, x: np.ndarray) -> np.ndarray:
        """Whitened coordinates of integer rows."""
        return ((x - self.sums / self.n) @ self.components) / np.sqrt(self.values)


def fit(rows: DataFrame, vector: str = "embedding", most: int = MOST) -> Whitener | None:
    """The ``most`` leading components over ``rows`` (usable ones), or None without any row.

    Reads ``rows`` twice: pass a table. Every component's sign makes its greatest entry positive.
    """
    found = spectrum(rows, vector)
    if found is None:
        return None
    centre = found.sums / found.n
    basis = np.linalg.qr(found.vectors)[0]
    inner = _products(rows, vector, lambda x: (x - centre) @ basis)[:-1, :-1] / found.n
    values, turn = np.linalg.eigh((inner + inner.T) / 2)
    values, turn = values[::-1], turn[:, ::-1]
    trace = values.sum()
    keep = int((values[:most] > 1e-12 * max(trace, 0)).sum())
    vectors = basis @ turn[:, :keep]
    largest = vectors[np.abs(vectors).argmax(0), np.arange(keep)] if keep else np.zeros(0)
    vectors = vectors * np.sign(largest)
    return Whitener(found.n, found.sums, values[:keep], vectors, values[:keep] / trace if keep else values[:0])


def identity_error(rows: DataFrame, vector: str, model: Whitener) -> float:
    """Largest entry of the whitened rows' covariance minus the identity."""
    total = _products(rows, vector, model.project)
    mean = total[-1, :-1] / model.n
    covariance = total[:-1, :-1] / model.n - np.outer(mean, mean)
    return float(np.abs(covariance - np.eye(len(mean))).max(initial=0.0))


OUT = "component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(df: DataFrame, key: str = "vec_id", vector: str = "embedding", most: int = MOST) -> DataFrame:
    """A row per usable row of ``df`` and component. Reads ``df`` four times: pass a table."""
    rows = usable(df.select(F.col(key), F.col(vector)), vector)
    schema = f"`{key}` {df.schema[key].dataType.simpleString()}, {OUT}"
    model = fit(rows, vector, most)
    if model is None or not len(model.values):
        return df.sparkSession.createDataFrame([], schema)
    error = identity_error(rows, vector, model)
    count = len(model.values)
    # n * x - S = n * y - r with y the distance to the rounded mean: small whole numbers.
    centre = np.rint(model.sums / model.n).astype(np.int64)
    r = [int(v) for v in model.sums - model.n * centre]
    own = sum(v * v for v in r)
    rest = np.array(r, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = integers(batch, vector)
            y = x - centre
            squares, cross = (y * y).sum(1).tolist(), _dot(y, rest)
            n = model.n
            exact = [n * n * a - 2 * n * b + own for a, b in zip(squares, cross)]
            exact = pa.array([v if v < 1 << 63 else None for v in exact], pa.int64())
            each = np.repeat(np.arange(len(x)), count)
            ids = batch.column(batch.schema.get_field_index(key)).take(pa.array(each))
            columns = [
                ids,
                pa.array(np.tile(np.arange(1, count + 1, dtype=np.int32), len(x))),
                pa.array(np.full(len(each), n, np.int64)),
                exact.take(pa.array(each)),
                pa.array(model.project(x).ravel()),
                pa.array(np.tile(model.explained, len(x))),
                pa.array(np.full(len(each), error)),
            ]
            yield pa.RecordBatch.from_arrays(columns, [key, *[f.split()[0] for f in OUT.split(", ")]])

    return rows.mapInArrow(run, schema)


def _dot(y: np.ndarray, r: np.ndarray) -> list[int]:
    """Exact sums of products as Python integers: the low and high halves of ``r`` apart."""
    high, low = r >> 24, r & ((1 << 24) - 1)
    return [(a << 24) + b for a, b in zip((y @ high).tolist(), (y @ low).tolist())]


def op13_whitening(spark, sf_dir: str) -> DataFrame:
    """All embeddings on their first eight components."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return whiten(vectors)
