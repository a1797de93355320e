"""Whitening of embeddings by a polarisation covariance.

An entry c becomes the whole number x = floor(64 c) + 1000000. Sums of x give the mean; a second pass adds up exact squares of centred values, for
every dimension and for every sum of two dimensions. As Var(a + b) - Var(a) - Var(b) = 2 Cov(a, b), these variances alone give
all covariances. They are assembled on the driver and decomposed by ``eigh``.

Squares are taken of y = x - m with m the whole number next to the mean, and sum((n x - S)^2) = n^2 sum(y^2) - n sum(y)^2 holds exactly, so
all sums are whole numbers: 64 bits inside a batch where a bound on the values allows it, Python's unbounded ones where not, decimals across tasks.

A task holds one batch and d (d + 1) / 2 sums for vectors of d entries, the driver a matrix of d x d numbers.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType


SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 32
#: Entries whose scaled value is not an exact 64-bit whole number in double precision count as non-finite.
LARGEST = float(1 << 52)


@dataclass(frozen=True)
class Model:
    """``n`` vectors of ``dims`` entries with sums ``sums``; unit ``axes`` (one in each row), their ``variances`` and the ``trace``."""

    n: int
    sums: list[int]
    axes: list[list[float]]
    variances: list[float]
    trace: float

    @property
    def dims(self) -> int:
        return len(self.sums)


def usable(vectors: DataFrame, vector_col: str = "embedding") -> DataFrame:
    """Rows whose vector has entries, none of them null, non-finite or too large."""
    v = F.col(vector_col)
    bad = lambda c: c.isNull() | F.isnan(c.cast("double")) | (F.abs(c.cast("double") * SCALE) > LARGEST)
    return vectors.filter(v.isNotNull() & (F.size(v) > 0) & ~F.exists(v, lambda c: F.coalesce(bad(c), F.lit(True))))


def _whole(column):
    """The vectors of an Arrow list column of equal lengths as x, one in each row."""
    import numpy as np

    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return (np.floor(flat * SCALE).astype(np.int64) + SHIFT).reshape(len(column), -1)


def _partial_sums(batches):
    """Rows (dims, dim, n, total) of a task: number and sums of the vectors of each length."""
    import numpy as np
    import pyarrow as pa

    found: dict[int, list] = {}
    for batch in batches:
        column = batch.column(0)
        lengths = column.value_lengths().to_numpy(zero_copy_only=False)
        for dims in np.unique(lengths):
            x = _whole(column.filter(pa.array(lengths == dims)))
            n, total = found.get(int(dims), (0, 0))
            add = x.sum(0) if np.abs(x).max() < (1 << 62) // len(x) else x.astype(object).sum(0)
            found[int(dims)] = (n + len(x), total + add.astype(object))
    for dims, (n, total) in found.items():
        yield pa.RecordBatch.from_arrays([
            pa.array([dims] * dims, pa.int32()), pa.array(range(dims), pa.int32()), pa.array([n] * dims, pa.int64()), pa.array([str(t) for t in total])],
            names=["dims", "dim", "n", "total"])


def _squares(centre):
    def run(batches):
        """Rows (i, j, total) of a task: sums of squares of y_i (j = -1) and of y_i + y_j (i < j)."""
        import numpy as np
        import pyarrow as pa

        m, d = np.array(centre, np.int64), len(centre)
        single, pairs = np.zeros(d, object), [np.zeros(d - i - 1, object) for i in range(d)]
        seen = False
        for batch in batches:
            if not batch.num_rows:
                continue
            seen = True
            y = _whole(batch.column(0)) - m
            if int(np.abs(y).max()) ** 2 * 4 * len(y) >= 1 << 62:
                y = y.astype(object)
            single += (y * y).sum(0)
            y = np.ascontiguousarray(y.T)
            for i in range(d - 1):
                both = y[i + 1:] + y[i]
                pairs[i] += (both * both).sum(1)
        if seen:
            rows = [(i, -1, single[i]) for i in range(d)] + [(i, i + 1 + k, t) for i in range(d) for k, t in enumerate(pairs[i])]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), pa.array([str(r[2]) for r in rows])], names=["i", "j", "total"])

    return run


def fit(vectors: DataFrame, vector_col: str = "embedding", components: int = COMPONENTS) -> Model | None:
    """Mean and principal axes of the usable vectors; None if there are none.

    Vectors of another length than most (the larger length of a tie) belong to no common space and are left out, of the fit and of ``whitened``.
    """
    import numpy as np

    rows = usable(vectors, vector_col).select(F.col(vector_col).alias("vector"))
    exact = F.sum(F.col("total").cast("decimal(38,0)")).alias("total")
    lengths = rows.groupBy(F.size("vector").alias("dims")).count().orderBy(F.desc("count"), F.desc("dims")).head()
    if lengths is None:
        return None
    dims = lengths["dims"]
    rows = rows.filter(F.size("vector") == dims)
    sums = rows.mapInArrow(_partial_sums, "dims int, dim int, n long, total string").groupBy("dim").agg(F.sum("n").alias("n"), exact).collect()
    n, total = sums[0]["n"], [0] * dims
    for r in sums:
        total[r["dim"]] = int(r["total"])
    centre = [(2 * s + n) // (2 * n) for s in total]
    found = rows.mapInArrow(_squares(centre), "i int, j int, total string").groupBy("i", "j").agg(exact).collect()
    squares = {(r["i"], r["j"]): int(r["total"]) for r in found}
    rest = [s - n * m for s, m in zip(total, centre, strict=True)]
    # sums of (n u - sum(u))^2 over all vectors, u a dimension or a sum of two: exact, n^3 times the variance of u
    own = [n * (n * squares[i, -1] - rest[i] ** 2) for i in range(dims)]
    cov = np.zeros((dims, dims))
    for i in range(dims):
        cov[i, i] = own[i] / n**3
        for j in range(i + 1, dims):
            both = n * (n * squares[i, j] - (rest[i] + rest[j]) ** 2)
            cov[i, j] = cov[j, i] = (both - own[i] - own[j]) / (2 * n**3)
    variances, axes = np.linalg.eigh(cov)
    order = np.argsort(-variances, kind="stable")[:components]
    return Model(n, total, axes.T[order].tolist(), variances[order].tolist(), sum(own) / n**3)


def whitened(vectors: DataFrame, model: Model | None, vector_col: str = "embedding", name: str = "whitened") -> DataFrame:
    """The columns of ``vectors`` (but those named like the new ones), ``name`` (an array by component) and ``deviation`` of the usable rows.

    A component without variance (constant dimensions, fewer vectors than dimensions) can't be scaled: its value is null. ``deviation`` is null where it
    exceeds a long. Repeated rows are rows of their own, an empty table gives an empty one.
    """
    import pyarrow as pa

    keep = [F.col(f"`{c}`") for c in vectors.columns if c not in (name, "deviation")]
    schema = vectors.select(*keep).schema.add(name, ArrayType(DoubleType())).add("deviation", "long")
    rows = usable(vectors, vector_col)
    if model is None:
        return rows.select(*keep, F.lit(None).cast("array<double>").alias(name), F.lit(None).cast("long").alias("deviation"))
    rows = rows.filter(F.size(vector_col) == model.dims).select(*keep, F.col(vector_col).alias("_vector_to_whiten"))

    def run(batches):
        import numpy as np

        n, axes, variances = model.n, np.array(model.axes), np.array(model.variances)
        centre = np.array([(2 * s + n) // (2 * n) for s in model.sums], np.int64)
        rest = np.array([s - n * int(m) for s, m in zip(model.sums, centre, strict=True)], np.int64)
        scaled = variances > model.dims * np.finfo(float).eps * max(variances[0], 0)
        onto = (axes / np.sqrt(np.where(scaled, variances, 1))[:, None]).T
        for batch in batches:
            y = _whole(batch.column(batch.num_columns - 1)) - centre
            values = (y - rest / n) @ onto
            wide = y.size and (n * int(np.abs(y).max()) + n) ** 2 * model.dims >= 1 << 63
            off = (y.astype(object) if wide else y) * n - rest
            deviation = [int(t) if t < 1 << 63 else None for t in (off * off).sum(1)]
            flat = pa.array(values.ravel(), pa.float64(), mask=np.tile(~scaled, len(y)))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(y) + 1) * len(variances), pa.int32()), flat)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], lists, pa.array(deviation, pa.int64())], names=[*batch.schema.names[:-1], name, "deviation"])

    return rows.mapInArrow(run, schema)


def identity_error(rows: DataFrame, model: Model | None, name: str = "whitened") -> float | None:
    """Largest absolute entry of the covariance of the whitened rows minus the identity, over the components that have variance."""
    import numpy as np

    if model is None:
        return None

    def partial(batches):
        import pyarrow as pa

        total, size, seen = 0.0, 0.0, 0
        for batch in batches:
            if batch.num_rows:
                w = np.nan_to_num(batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1))
                total, size, seen = total + w.sum(0), size + w.T @ w, seen + len(w)
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary()), pa.array([size.tobytes()], pa.binary()), pa.array([seen], pa.int64())], names=["total", "size", "n"])

    k = len(model.variances)
    total, size, n = np.zeros(k), np.zeros((k, k)), 0
    for r in rows.select(name).mapInArrow(partial, "total binary, size binary, n long").toLocalIterator():  # k (k + 1) numbers for each task
        total, size, n = total + np.frombuffer(r["total"]), size + np.frombuffer(r["size"]).reshape(k, k), n + r["n"]
    scaled = np.array(model.variances) > model.dims * np.finfo(float).eps * max(model.variances[0], 0)
    gap = np.abs(size / n - np.outer(total / n, total / n) - np.eye(k))[np.ix_(scaled, scaled)]
    return float(gap.max()) if gap.size else 0.0
