"""Frames as bytes: resampling, letterboxing, padding and crops, many frames of one shape at once.

A frame is a row with height, width and pixels (bytes in height, width, channel order). Resampling is linear
between the centres of pixels, first along rows and then along columns, each a table of two neighbours and
a weight for every output pixel; values are rounded, halves up. Other columns stay as they are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T


def neighbours(n: int, to: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each of `to` outputs along an axis of n pixels: the pixel before, the one after, and the weight of the latter."""
    place = (np.arange(to) + 0.5) * n / to - 0.5
    before = np.floor(place)
    return np.clip(before, 0, n - 1).astype(int), np.clip(before + 1, 0, n - 1).astype(int), place - before


def resample(stack: np.ndarray, h: int, w: int) -> np.ndarray:
    """Frames (n, height, width, channels) of bytes in h x w."""
    if stack.shape[1:3] == (h, w):
        return stack
    a, b, f = neighbours(stack.shape[2], w)
    f = f[:, None]
    wide = stack[:, :, a] * (1 - f) + stack[:, :, b] * f
    a, b, f = neighbours(stack.shape[1], h)
    f = f[:, None, None]
    return np.floor(wide[:, a] * (1 - f) + wide[:, b] * f + 0.5).astype(np.uint8)


def pad(stack: np.ndarray, h: int, w: int) -> tuple[np.ndarray, int, int]:
    """Frames in the middle of black ones, and where their left and upper edges are."""
    top, left = (h - stack.shape[1]) // 2, (w - stack.shape[2]) // 2
    out = np.zeros((len(stack), h, w, stack.shape[3]), stack.dtype)
    out[:, top : top + stack.shape[1], left : left + stack.shape[2]] = stack
    return out, left, top


def fit_into(ih: int, iw: int, h: int, w: int) -> tuple[int, int]:
    """Height and width of an image that is scaled to fit into h x w."""
    scale = min(w / iw, h / ih)
    return min(round(ih * scale), h), min(round(iw * scale), w)


def letterbox(stack: np.ndarray, h: int, w: int) -> tuple[np.ndarray, int, int, float]:
    """Frames scaled to fit into h x w, padded unless they are square; offsets and gain of their pixels."""
    ih, iw = stack.shape[1:3]
    if (ih, iw) == (h, w):
        return stack, 0, 0, 1.0
    nh, nw = fit_into(ih, iw, h, w)
    scaled, gain = resample(stack, nh, nw), min(nh / ih, nw / iw)
    return (*pad(scaled, h, w), gain) if ih != iw else (scaled, 0, 0, gain)


def by_shape(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, frames) for each shape in a batch; rows without pixels are left out."""
    h, w, pixels = (batch.column(c) for c in ("height", "width", "pixels"))
    size = np.array([len(p.as_buffer()) if p.is_valid else 0 for p in pixels])
    shape = np.stack([h.fill_null(0).to_numpy(), w.fill_null(0).to_numpy(), size], 1)
    kinds, of = np.unique(shape, axis=0, return_inverse=True)
    for k, (ih, iw, n) in enumerate(kinds.tolist()):
        if n and ih and iw:
            rows = np.flatnonzero(of == k)
            data = np.stack([np.frombuffer(pixels[int(i)].as_buffer(), np.uint8) for i in rows])
            yield rows, data.reshape(len(rows), ih, iw, -1)


Made = Callable[[np.ndarray], tuple]


def _changed(frames: DataFrame, made: Made, extra: dict[str, T.DataType]) -> DataFrame:
    """frames with height, width and pixels of made(stack)[0] and further results as columns; null where there are no pixels."""
    names = frames.columns
    schema = T.StructType([*[T.StructField(f.name, T.IntegerType() if f.name in ("height", "width") else f.dataType) for f in frames.schema], *[T.StructField(n, t) for n, t in extra.items()]])

    def run(batches):
        for batch in batches:
            n = batch.num_rows
            out = {"pixels": [None] * n, "height": [None] * n, "width": [None] * n, **{e: [None] * n for e in extra}}
            for rows, stack in by_shape(batch):
                new, *more = made(stack)
                for j, i in enumerate(rows):
                    out["pixels"][i], out["height"][i], out["width"][i] = new[j].tobytes(), new.shape[1], new.shape[2]
                    for e, v in zip(extra, more, strict=True):
                        out[e][i] = v
            kind = {"pixels": pa.binary(), "height": pa.int32(), "width": pa.int32()}
            own = [pa.array(out[c], kind[c]) if c in kind else batch.column(c) for c in names]
            yield pa.RecordBatch.from_arrays([*own, *[pa.array(out[e], pa.float64() if t == T.DoubleType() else pa.int32()) for e, t in extra.items()]], names=[*names, *extra])

    return frames.mapInArrow(run, schema)


def letterboxed(frames: DataFrame, w: int, h: int) -> DataFrame:
    """Frames scaled into w x h, with dx, dy and gain that lead back to the image; square ones are only scaled."""
    return _changed(frames, lambda stack: letterbox(stack, h, w), {"dx": T.IntegerType(), "dy": T.IntegerType(), "gain": T.DoubleType()})


def padded(frames: DataFrame, w: int, h: int) -> DataFrame:
    """Frames, none larger than w x h, in the middle of black ones, with dx and dy."""
    return _changed(frames, lambda stack: pad(stack, h, w), {"dx": T.IntegerType(), "dy": T.IntegerType()})


def resampled(frames: DataFrame, w: int, h: int) -> DataFrame:
    return _changed(frames, lambda stack: (resample(stack, h, w),), {})


def scaled(frames: DataFrame, factor: float) -> DataFrame:
    """Frames in `factor` of their height and width, whole pixels at least one."""
    return frames if factor == 1.0 else _changed(frames, lambda stack: (resample(stack, max(1, int(stack.shape[1] * factor)), max(1, int(stack.shape[2] * factor))),), {})


def cropped(frames: DataFrame) -> DataFrame:
    """The part of each frame inside its box (x1, y1, x2, y2), which may reach over the edges; no pixels where nothing is left.

    A box that begins at a negative number counts from the far edge, as slices of arrays do, unless it is cut to the frame before.
    """
    schema = T.StructType([T.StructField(f.name, T.IntegerType() if f.name in ("height", "width") else f.dataType) for f in frames.schema])
    names = frames.columns

    def run(batches):
        for batch in batches:
            box = [batch.column(c).to_pylist() for c in ("x1", "y1", "x2", "y2")]
            out = {"pixels": [None] * batch.num_rows, "height": [None] * batch.num_rows, "width": [None] * batch.num_rows}
            for rows, stack in by_shape(batch):
                for i, frame in zip(rows, stack, strict=True):
                    x1, y1, x2, y2 = (b[i] for b in box)
                    part = frame[y1:y2, x1:x2] if None not in (x1, y1, x2, y2) else frame[:0]
                    if part.size:
                        out["pixels"][i], out["height"][i], out["width"][i] = part.tobytes(), part.shape[0], part.shape[1]
            kind = {"pixels": pa.binary(), "height": pa.int32(), "width": pa.int32()}
            yield pa.RecordBatch.from_arrays([pa.array(out[c], kind[c]) if c in kind else batch.column(c) for c in names], names=names)

    return frames.mapInArrow(run, schema)


def channel_means(frames: DataFrame) -> DataFrame:
    """Adds r, g and b, the means of the first three channels; null where there are no pixels or fewer channels."""
    names = frames.columns
    schema = T.StructType([*frames.schema, *[T.StructField(c, T.DoubleType()) for c in "rgb"]])

    def run(batches):
        for batch in batches:
            means = np.full((batch.num_rows, 3), np.nan)
            for rows, stack in by_shape(batch):
                if stack.shape[3] >= 3:
                    means[rows] = stack[..., :3].sum((1, 2), dtype=np.int64) / (stack.shape[1] * stack.shape[2])
            yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(means[:, c], from_pandas=True) for c in range(3)]], names=[*names, *"rgb"])

    return frames.mapInArrow(run, schema)
