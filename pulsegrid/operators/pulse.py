"""Pulse signals and heart rates from colour traces.

Traces are rows (key, win_id, at, r, g, b): `at` counts from 0 inside a window.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import filters
from ..functions.modes import modes

RGB = ("r", "g", "b")
#: The band of the plane-orthogonal extractor's own filter, in Hz.
PLANE_BAND = (0.75, 3.0)


def numbers(values: np.ndarray) -> Column:
    """A constant array, as one expression: thousands of literals one by one would take longer than many a query."""
    return F.expr(f"array({', '.join(f'{float(v)!r}D' for v in values)})")


def integrated(df: DataFrame, keys: Sequence[str], value: str, order: str = "at") -> DataFrame:
    return df.withColumn("total", F.sum(value).over(Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)))


def plane_projections(x: np.ndarray, ell: int) -> np.ndarray:
    """The plane-orthogonal pulses (n, size) of n windows (3, n, size).

    A stretch of l frames that begins at m adds v + alpha*u, applied to the frame's colours over
    their means, to each of its frames; the mean it takes off is zero, as both projections cancel means.
    So a stretch is three coefficients, found from sums over its frames, and a frame has those of the l
    stretches over it.  The last frame of a window is in no stretch.  A stretch with a mean of zero adds nothing.
    """
    size = x.shape[2]
    if size <= ell:
        return np.zeros(x.shape[1:])
    over = lambda v, n: np.lib.stride_tricks.sliding_window_view(v, ell, axis=-1)[:, :n].sum(-1)
    mu = [over(c, size - ell) / ell for c in x]
    cov = {(c, d): over(x[c] * x[d], size - ell) / ell - mu[c] * mu[d] for c in range(3) for d in range(c, 3)}

    def spread(w: dict[int, float]) -> np.ndarray:
        terms = [w[c] * w[d] * cov[min(c, d), max(c, d)] / (mu[c] * mu[d]) for c in w for d in w]
        return np.sqrt(np.maximum(sum(terms[1:], terms[0]), 0.0))

    with np.errstate(divide="ignore", invalid="ignore"):
        u, v = spread({1: 1.0, 2: -1.0}), spread({0: -2.0, 1: 1.0, 2: 1.0})
        alpha = np.divide(u, v, out=np.zeros_like(u), where=v != 0)
        some = (mu[0] != 0) & (mu[1] != 0) & (mu[2] != 0)
        weight = [np.where(some, w / m, 0.0) for w, m in zip((-2 * alpha, 1 + alpha, alpha - 1), mu, strict=True)]
    return sum(c * over(np.pad(w, ((0, 0), (ell - 1, ell))), size) for c, w in zip(x, weight, strict=True))


def plane_orthogonal(df: DataFrame, keys: Sequence[str], size: int, fps: float = 30.0, at_once: int = 256) -> DataFrame:
    """(keys, at, h): the plane-orthogonal-to-skin pulse of whole windows, many of them at once. A null counts as nothing in sums, and its frame's pulse is null."""
    ell = math.ceil(1.6 * fps)
    whole = df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("at", *[F.col(c).cast("double").alias(c) for c in RGB]))).alias("_x")).where(F.size("_x") == size)
    schema = whole.withColumn("_x", F.lit(None).cast("array<double>")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, at_once):
                part = batch.slice(at, at_once)
                rows = part.column(part.num_columns - 1).flatten()
                x = np.stack([rows.field(c).fill_null(0.0).to_numpy(zero_copy_only=False).reshape(-1, size) for c in RGB])
                missing = np.any([rows.field(c).is_null().to_numpy(zero_copy_only=False) for c in RGB], axis=0)
                h = pa.array(plane_projections(x, ell).ravel(), mask=missing)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.ListArray.from_arrays(pa.array(np.arange(0, len(h) + 1, size), pa.int32()), h)], names=schema.names)

    return whole.mapInArrow(run, schema).select(*keys, F.posexplode("_x").alias("_at", "h")).select(*keys, F.col("_at").cast(df.schema["at"].dataType).alias("at"), "h")


def plane_pulse(df: DataFrame, keys: Sequence[str], size: int, fps: float = 30.0) -> DataFrame:
    """(keys, at, y): the plane-orthogonal pulse, detrended and filtered as the extractor returns it."""
    return matrix_applied(plane_orthogonal(df, keys, size, fps), keys, "h", filters.finishing_matrix(size, PLANE_BAND, fps))


def chrominance(df: DataFrame, keys: Sequence[str], size: int, fps: float = 30.0, filtered: bool = True) -> DataFrame:
    """The chrominance pulse (keys, at, s): half-overlapping stretches, each filtered, tuned and Hann-weighted, added up.

    The filter of a stretch is a constant matrix, so a stretch's filtered X and Y are sums over its frames.
    """
    ell = math.ceil(1.6 * fps)
    ell += ell % 2
    half = ell // 2
    n = (size - half) // half
    rows = df.withColumn("_i", F.explode(F.array(F.floor(F.col("at") / half) - 1, F.floor(F.col("at") / half)))).where((F.col("_i") >= 0) & (F.col("_i") < n))
    rows = rows.withColumn("_j", (F.col("at") - F.col("_i") * half).cast("int"))
    hann = 0.5 - 0.5 * np.cos(2 * math.pi * np.arange(ell) / (ell - 1))
    place = F.col("_i") * half + F.col("_j")
    stretch = Window.partitionBy(*keys, "_i")
    norm = {c: F.col(c) / F.col(f"_m{c}") for c in RGB}
    rows = rows.withColumns({f"_m{c}": F.avg(c).over(stretch) for c in RGB})
    rows = rows.select(*keys, "_i", "_j", (3 * norm["r"] - 2 * norm["g"]).alias("x"), (1.5 * norm["r"] + norm["g"] - 1.5 * norm["b"]).alias("y"))
    if filtered:
        matrix = filters.filtfilt_matrix(ell, 3, 0.7, 2.5, fps)
        sums = [F.sum(F.col(c) * F.get(numbers(row), F.col("_j"))).alias(f"_{c}{j}") for c in "xy" for j, row in enumerate(matrix)]
        each = rows.groupBy(*keys, "_i").agg(*sums)
        both = each.select(*keys, "_i", *[F.array(*[f"_{c}{j}" for j in range(ell)]).alias(c) for c in "xy"])
        both = both.withColumn("_alpha", _spread(F.col("x"), ell) / _spread(F.col("y"), ell))
        tuned = F.zip_with(F.zip_with("x", "y", lambda x, y: x - F.col("_alpha") * y), numbers(hann), lambda v, w: v * w)
        parts = both.select(*keys, "_i", F.posexplode(tuned).alias("_j", "_s")).withColumn("at", place)
        return parts.groupBy(*keys, "at").agg(F.sum("_s").alias("s"))
    alpha = F.stddev_pop("x").over(stretch) / F.stddev_pop("y").over(stretch)
    parts = rows.withColumn("_s", (F.col("x") - alpha * F.col("y")) * F.get(numbers(hann), F.col("_j"))).withColumn("at", place)
    return parts.groupBy(*keys, "at").agg(F.sum("_s").alias("s"))


def _spread(values: Column, n: int) -> Column:
    """Population deviation of an array of n numbers."""
    mean = F.aggregate(values, F.lit(0.0), lambda a, v: a + v) / n
    return F.get(F.transform(F.array(mean), lambda m: F.sqrt(F.aggregate(values, F.lit(0.0), lambda a, v: a + (v - m) * (v - m)) / n)), F.lit(0))


def spectral_rate(df: DataFrame, keys: Sequence[str], value: str, size: int, fps: float = 30.0, cumulative: bool = False, detrended: bool = False, filtered: bool = False, own_band: tuple[float, float] | None = None) -> DataFrame:
    """Heart rate of each window: an extractor's own finish, integration, detrending, band-pass and periodogram as one weighted sum for each bin.

    The strongest in-band bin wins, the lowest of ties.
    """
    bins, re, im = filters.rate_weights(size, fps, cumulative, detrended, filtered, own_band)
    at = F.col("at").cast("int")
    sums = [F.sum(F.col(value) * F.get(numbers(w[i]), at)).alias(f"_{p}{i}") for p, w in (("r", re), ("i", im)) for i in range(len(bins))]
    power = [F.struct((F.col(f"_r{i}") * F.col(f"_r{i}") + F.col(f"_i{i}") * F.col(f"_i{i}")).alias("p"), F.lit(-k).alias("k")) for i, k in enumerate(bins)]
    best = F.array_max(F.array(*power))
    per_bin = fps / filters.next_power_of_2(size) * 60
    return df.groupBy(*keys).agg(*sums).withColumn("bin", -best["k"]).withColumn("heart_rate", F.col("bin") * F.lit(per_bin)).select(*keys, "bin", "heart_rate")


def peak_rate(df: DataFrame, keys: Sequence[str], value: str, fps: float = 30.0) -> DataFrame:
    """Heart rate from the mean gap of local maxima; a plateau counts once, at its middle; null under two maxima."""
    w = Window.partitionBy(*keys).orderBy("at")
    runs = df.withColumn("_new", F.coalesce((F.col(value) != F.lag(value).over(w)).cast("int"), F.lit(1))).withColumn("_run", F.sum("_new").over(w))
    flat = runs.groupBy(*keys, "_run").agg(F.first(value).alias("_v"), F.min("at").alias("_a"), F.max("at").alias("_b"))
    v = Window.partitionBy(*keys).orderBy("_run")
    near = flat.withColumns({"_before": F.lag("_v").over(v), "_after": F.lead("_v").over(v)})
    peak = (F.col("_v") > F.col("_before")) & (F.col("_v") > F.col("_after"))
    place = F.when(peak, F.floor((F.col("_a") + F.col("_b")) / 2))
    counts = near.withColumn("_p", place).groupBy(*keys).agg(F.count("_p").alias("n_peaks"), F.min("_p").alias("_first"), F.max("_p").alias("_last"))
    gap = (F.col("_last") - F.col("_first")) / (F.col("n_peaks") - 1)
    return counts.select(*keys, "n_peaks", F.when(F.col("n_peaks") > 1, 60.0 / (gap / fps)).alias("heart_rate"))


def matrix_applied(df: DataFrame, keys: Sequence[str], value: str, matrix: np.ndarray) -> DataFrame:
    """(keys, at, y): a constant matrix times each window's values, one product for a batch of windows; a window with a null gives nulls."""
    size, each = matrix.shape[1], len(matrix)
    whole = df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("at", value))).alias("_x")).where(F.size("_x") == size)
    rows = whole.select(*keys, F.transform("_x", lambda s: s[value].cast("double")).alias("_x"))
    schema = rows.withColumnRenamed("_x", "_y").schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(batch.num_columns - 1).flatten().to_numpy(zero_copy_only=False).reshape(-1, size)
            y = pa.array((x @ matrix.T).ravel(), from_pandas=True)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.ListArray.from_arrays(pa.array(np.arange(0, len(y) + 1, each), pa.int32()), y)], names=schema.names)

    return rows.mapInArrow(run, schema).select(*keys, F.posexplode("_y").alias("at", "y"))


def jade(x: np.ndarray) -> np.ndarray:
    """Independent components (rows) of signals (rows) of a window, or of many windows at once: whitening, fourth-order cumulants, Jacobi rotations.

    A window whose rotations have become small is turned by nothing while others go on.
    """
    if x.ndim == 2:
        return jade(x[None])[0]
    n, m, t = x.shape
    across = lambda v: v.transpose(0, 2, 1)
    x = x - x.mean(2, keepdims=True)
    value, vector = np.linalg.eigh(x @ across(x) / t)
    white = across(vector / np.sqrt(np.maximum(value, 1e-12))[:, None])[:, ::-1]
    z = white @ x
    stack = []
    for i in range(m):
        for j in range(i, m):
            q = (z * z[:, i : i + 1] * z[:, j : j + 1]) @ across(z) / t - (i == j) * np.eye(m)
            q[:, i, j] -= 1
            q[:, j, i] -= 1
            stack.append(q * (1 if i == j else math.sqrt(2)))
    c, turn, moved = np.stack(stack, 1), np.broadcast_to(np.eye(m), (n, m, m)), True
    while moved:
        moved = False
        for p in range(m):
            for q in range(p + 1, m):
                g, h = c[..., p, p] - c[..., q, q], c[..., p, q] + c[..., q, p]
                on, off = (g * g).sum(1) - (h * h).sum(1), 2 * (g * h).sum(1)
                angle = 0.5 * np.arctan2(off, on + np.hypot(on, off))
                far = np.abs(np.sin(angle)) > 0.01 / math.sqrt(t)
                if far.any():
                    moved = True
                    angle = np.where(far, angle, 0.0)
                    r = np.tile(np.eye(m), (n, 1, 1))
                    r[:, p, p] = r[:, q, q] = np.cos(angle)
                    r[:, p, q], r[:, q, p] = -np.sin(angle), np.sin(angle)
                    c = across(r)[:, None] @ c @ r[:, None]
                    turn = turn @ r
    return across(turn) @ z


def unmixed(df: DataFrame, keys: Sequence[str], key_schema: str, size: int, fps: float, finish: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray], at_once: int = 256) -> DataFrame:
    """(keys, pulse): detrended, standardised channels are unmixed; finish(channels, sources, tallest normalised peak of each) gives a signal, which is filtered. Windows are worked on together."""
    detrend, band = filters.detrend_matrix(size), filters.filtfilt_matrix(size, 3, 0.7, 2.5, fps)
    whole = df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("at", *[F.col(c).cast("double").alias(c) for c in RGB]))).alias("_x")).where(F.size("_x") == size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, at_once):
                part = batch.slice(at, at_once)
                rows = part.column(part.num_columns - 1).flatten()
                x = np.stack([rows.field(c).to_numpy(zero_copy_only=False).reshape(-1, size) for c in RGB], 1) @ detrend.T
                x = (x - x.mean(2, keepdims=True)) / x.std(2, keepdims=True)
                sources = jade(x)
                p = np.abs(np.fft.fft(sources, axis=2)[..., 1:][..., : (size - 1) // 2]) ** 2
                pulse = finish(x, sources, (p / p.sum(2, keepdims=True)).max(2)) @ band.T
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.ListArray.from_arrays(pa.array(np.arange(0, pulse.size + 1, size), pa.int32()), pa.array(pulse.ravel()))], names=[*keys, "pulse"])

    return whole.mapInArrow(run, f"{key_schema}, pulse array<double>")


def independent_component(df: DataFrame, keys: Sequence[str], key_schema: str, size: int, fps: float = 30.0) -> DataFrame:
    """(keys, pulse): detrended, standardised channels are unmixed, the source with the tallest normalised peak is filtered."""
    return unmixed(df, keys, key_schema, size, fps, lambda x, sources, peak: sources[np.arange(len(x)), peak.argmax(1)])


def moving_average(df: DataFrame, keys: Sequence[str], value: str, width: int) -> DataFrame:
    """The centred mean of `width` samples, zeros beyond the window."""
    near = Window.partitionBy(*keys).orderBy("at").rowsBetween(-(width // 2), (width - 1) // 2)
    return df.withColumn("smooth", F.sum(value).over(near) / width)


def guided_component(df: DataFrame, keys: Sequence[str], key_schema: str, size: int, fps: float = 30.0) -> DataFrame:
    """(keys, pulse): as independent_component, but the source is chosen by its peak times its likeness to green,
    reduced to its three fastest modes, smoothed over two seconds and filtered."""
    width = int(fps * 2)

    def finish(x: np.ndarray, sources: np.ndarray, peak: np.ndarray) -> np.ndarray:
        s, green = sources - sources.mean(2, keepdims=True), x[:, 1:2] - x[:, 1:2].mean(2, keepdims=True)
        likeness = np.abs((s * green).sum(2) / np.sqrt((s * s).sum(2) * (green * green).sum(2)))
        best = sources[np.arange(len(x)), (peak * likeness).argmax(1)]
        parts = [(b, modes(b)) for b in best]
        return np.stack([np.convolve(np.sum(m, axis=0) if m else b, np.ones(width) / width, mode="same") for b, m in parts])

    return unmixed(df, keys, key_schema, size, fps, finish)


def whole_clips(df: DataFrame, key: str, size: int = 180) -> DataFrame:
    """Rows with their clip's number; fails for a key whose rows don't fill whole clips."""
    n = F.count("*").over(Window.partitionBy(key))
    fills = F.assert_true(n % size == 0, F.concat(F.lit(f"not a multiple of {size} frames: "), F.col(key).cast("string")))
    return df.withColumn("clip_id", F.when(fills.isNull(), F.floor(F.col("pos") / size)))
