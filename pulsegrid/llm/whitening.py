"""Embedding whitening by Golub-Kahan-Lanczos bidiagonalisation.

Entries become whole numbers x; with n vectors and per-dimension sums S the centred rows are
y = (n*x - S) / n, whose numerators are exact.  Blocks of x are written once.  Step k
multiplies: u = Yv - (what u has of the earlier u's) in every block, and Y'u summed over the blocks. All
earlier u's are had from the block again (YV = UR with a small triangle R, solved in the task), so u is
orthogonalised against all of them without ever being stored: what it still has of them goes into R. Where
that is not small the step is repeated with the corrected R. v is orthogonalised on the driver.
The driver holds V, R and the bidiagonal matrix only, each of the size of dimensions by steps; the
bidiagonal matrix' singular value decomposition gives components and deviations.  The steps end with
the last dimension, or, where there are many more than wanted, once the wanted components have converged; where a direction ends
early, another one that is orthogonal to all goes on.

Defined results: rows go whose vector is null, empty, of another length than most rows' (the longer of two as frequent),
or has an entry that is null, not finite or beyond `MOST` in size; a deviation that a long can't hold is an error; components without variance are not returned, so equal rows, or
one row, give no rows; repeated ids are rows of their own and null ids stay; an empty table gives no rows; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import settled, stored, table

COMPONENTS, SCALE, SHIFT = 32, 64, 1_000_000
#: Entries beyond it have no whole number that a double holds.
MOST = float(1 << 46)
#: Rows of a block; what counts as nothing, against the largest singular value.
BLOCK_ROWS, NOTHING = 4096, 1e-11


def usable(table_: DataFrame, ident: str, vector: str) -> DataFrame:
    """(id, v) of the rows that take part, v of one length."""
    rows = table_.select(F.col(ident).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    rows = rows.where(F.size("v") > 0).where(F.forall("v", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) <= MOST)))
    lengths = rows.groupBy(F.size("v").alias("d")).count()
    most = lengths.agg(F.max_by("d", F.struct("count", "d"))).first()[0]
    return rows.where(F.size("v") == F.lit(most or 0))


def whole_numbers(rows: DataFrame, scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    """(id, x) with x = floor(scale * v) + shift."""
    return rows.select("id", F.transform("v", lambda e: F.floor(e * scale).cast("long") + shift).alias("x"))


@dataclass
class Fit:
    """n rows with sums S; components by column, their variances, the sum of all variances."""

    n: int
    sums: np.ndarray
    components: np.ndarray
    variances: np.ndarray
    total: float


def blocks(rows: DataFrame, d: int) -> DataFrame:
    """(id, some, x): blocks of rows, packed; every task packs what it reads."""

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(lo, BLOCK_ROWS)
                x = part.column("x").flatten().to_numpy(zero_copy_only=False).astype("<i8")
                ids = part.column("id")
                some = ids.is_valid().to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays([pa.array([ids.fill_null(0).to_numpy().astype("<i8").tobytes()], pa.binary()), pa.array([some.tobytes()], pa.binary()), pa.array([x.tobytes()], pa.binary())], names=["id", "some", "x"])

    return rows.mapInArrow(run, "id binary, some binary, x binary")


def centred(blob: pa.Scalar, n: int, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """n*x - S in whole numbers, and over n."""
    base = sums // n
    x = np.frombuffer(blob.as_buffer(), "<i8").reshape(-1, len(sums)) - base
    if int(np.abs(x).max(initial=0)) * n >= 1 << 62:
        raise OverflowError("n times a vector's distance from the mean is beyond a long")
    whole = n * x - (sums - n * base)
    return whole, whole / n


def summed(packed: DataFrame, width: int, f: Callable[[pa.Scalar], np.ndarray]) -> np.ndarray:
    """The sum over all blocks of f(block), an array of `width` numbers: one array from each task, and these in one."""

    def run(batches):
        total = np.zeros(width)
        for batch in batches:
            for blob in batch.column("x"):
                total += f(blob)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["part"])

    def add(batches):
        total = np.zeros(width)
        for batch in batches:
            for part in batch.column("part"):
                total += np.frombuffer(part.as_buffer())
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["part"])

    return np.frombuffer(packed.select("x").mapInArrow(run, "part binary").repartition(1).mapInArrow(add, "part binary").first()[0])


def lanczos(packed: DataFrame, n: int, sums: np.ndarray, wanted: int, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Right singular vectors (by column) of the centred rows and their singular values, the `wanted` largest at least."""
    d = len(sums)
    rng = np.random.default_rng(seed)
    steps, top = d, 0.0
    v_all, back_all, r = np.zeros((d, steps)), np.zeros((d, steps)), np.zeros((steps, steps))
    v = _unit(rng.standard_normal(d), v_all[:, :0])
    for k in range(steps):
        v_all[:, k] = v
        for _ in range(4):
            back, shared, norm = _step(packed, n, sums, v_all[:, : k + 1], r[:k, : k + 1])
            top = max(top, norm)
            small = np.abs(shared).max(initial=0.0) <= 1e-7 * norm
            if norm <= NOTHING * top or small:
                break
            r[:k, k] += shared
        if norm > NOTHING * top:  # what is left of the earlier u's is taken off here, as it is small
            r[:k, k] += shared
            back = back - back_all[:, :k] @ shared
            norm = np.sqrt(max(norm * norm - shared @ shared, 0.0))
            r[k, k], back_all[:, k] = norm, back / norm
        if k + 1 == steps:
            break
        ahead = back_all[:, k] - r[k, k] * v
        size = np.linalg.norm(ahead - v_all[:, : k + 1] @ (v_all[:, : k + 1].T @ ahead))
        if size > NOTHING * top:
            v = _unit(ahead, v_all[:, : k + 1])
            r[k, k + 1] = size
        else:  # the space of the steps so far is closed: another direction goes on
            v = _unit(rng.standard_normal(d), v_all[:, : k + 1])
        if d > 4 * wanted and k + 1 > wanted and (k + 1) % 8 == 0 and size > NOTHING * top:
            left, value, _ = np.linalg.svd(r[: k + 1, : k + 1])
            if (size * np.abs(left[-1, :wanted]) <= 1e-15 * value[0]).all():
                steps = k + 1
                break
    _, value, right = np.linalg.svd(r[:steps, :steps])
    return v_all[:, :steps] @ right.T, value


def _step(packed: DataFrame, n: int, sums: np.ndarray, own: np.ndarray, r: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """With u = Yv - U * (last column of r), v the last column of `own` and U the earlier u's: Y'u, U'u and the length of u."""
    d, k = own.shape[0], own.shape[1] - 1
    live = np.flatnonzero(np.diag(r) > 0)

    def product(blob):
        _, y = centred(blob, n, sums)
        z = y @ own
        u = np.zeros((len(y), k))
        for j in live:
            u[:, j] = (z[:, j] - u[:, :j] @ r[:j, j]) / r[j, j]
        new = z[:, k] - u @ r[:, k]
        return np.concatenate([new @ y, new @ u, [new @ new]])

    got = summed(packed, d + k + 1, product)
    return got[:d], got[d:-1], float(np.sqrt(max(got[-1], 0.0)))


def _unit(v: np.ndarray, others: np.ndarray) -> np.ndarray:
    for _ in range(3):
        v = v - others @ (others.T @ v)
        v = v / np.linalg.norm(v)
    return v


def fit(packed: DataFrame, n: int, sums: np.ndarray, wanted: int = COMPONENTS) -> Fit:
    """The principal components of the blocks' rows."""

    def squares(blob):
        _, y = centred(blob, n, sums)
        return np.array([(y * y).sum()])

    total = float(summed(packed, 1, squares)[0]) / n
    if not total:
        return Fit(n, sums, np.zeros((len(sums), 0)), np.zeros(0), 0.0)
    vectors, values = lanczos(packed, n, sums, min(wanted, len(sums)))
    good = np.flatnonzero(values > NOTHING * 10 * values[0])[:wanted]
    return Fit(n, sums, vectors[:, good], values[good] ** 2 / n, total)


def identity_error(packed: DataFrame, model: Fit) -> float:
    """The largest absolute entry of the whitened rows' covariance minus the identity."""
    k = model.components.shape[1]
    if not k:
        return 0.0

    def sums(blob):
        _, y = centred(blob, model.n, model.sums)
        w = y @ model.components / np.sqrt(model.variances)
        return np.concatenate([w.sum(0), (w.T @ w).ravel()])

    got = summed(packed, k + k * k, sums)
    mean = got[:k] / model.n
    return float(np.abs(got[k:].reshape(k, k) / model.n - np.outer(mean, mean) - np.eye(k)).max())


RESULT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(vectors: DataFrame, ident: str = "vec_id", vector: str = "embedding", wanted: int = COMPONENTS) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) of each row and component."""
    return settled(lambda: _whitened(vectors, ident, vector, wanted))


def _whitened(vectors: DataFrame, ident: str, vector: str, wanted: int) -> DataFrame:
    spark = vectors.sparkSession
    rows = whole_numbers(usable(vectors, ident, vector))
    width = rows.select(F.size("x")).first()
    if width is None:
        return spark.createDataFrame([], RESULT)
    d = width[0]
    packed = stored(blocks(rows, d))

    def sums_of(batches):
        total = np.zeros(d + 1, object)
        for batch in batches:
            for blob in batch.column("x"):
                x = np.frombuffer(blob.as_buffer(), "<i8").reshape(-1, d)
                total += np.array([*x.sum(0).tolist(), len(x)], object)
        yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.int64()))], names=["part"])

    parts = packed.select("x").mapInArrow(sums_of, "part array<long>")
    got = parts.agg(*[F.sum(F.get("part", F.lit(i))).alias(f"s{i}") for i in range(d + 1)]).first()
    n, sums = got[-1], np.array(got[:-1], np.int64)
    model = fit(packed, n, sums, wanted)
    error = identity_error(packed, model)
    k = len(model.variances)
    weights, explained = model.components / np.sqrt(model.variances), model.variances / (model.total or 1.0)

    def run(batches):
        for batch in batches:
            for ident_, some, blob in zip(*(batch.column(c) for c in ("id", "some", "x")), strict=True):
                whole, y = centred(blob, n, sums)
                m = len(whole)
                if float(np.abs(whole).max(initial=0)) ** 2 * d >= 2.0**63:
                    deviation = [sum(int(v) ** 2 for v in row) for row in whole]  # an Arrow error where a long can't hold it
                else:
                    deviation = (whole * whole).sum(1)
                ids = pa.array(np.frombuffer(ident_.as_buffer(), "<i8"), mask=~np.frombuffer(some.as_buffer(), bool))
                at = pa.array(np.repeat(np.arange(m), k))
                yield pa.RecordBatch.from_arrays(
                    [ids.take(at), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, n, np.int64)), pa.array(deviation, pa.int64()).take(at), pa.array((y @ weights).ravel()), pa.array(np.tile(explained, m)), pa.array(np.full(m * k, error))],
                    names=[c.split()[0] for c in RESULT.split(", ")],
                )

    return packed.mapInArrow(run, RESULT)


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))
