"""Names for pulse extractors and rate estimators, and a place for networks whose weights a user brings."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import detections, geometry, pulse, tracking

#: name -> f(trace windows, keys, size, fps) giving rows (keys, at, v)
EXTRACTORS: dict[str, Callable[..., DataFrame]] = {}
#: name -> f(rows (keys, at, v), keys, size, fps) giving rows (keys, heart_rate)
ESTIMATORS: dict[str, Callable[..., DataFrame]] = {}
#: name -> f(planes, sizes, settings, key) giving rows (key, faces)
DETECTORS: dict[str, Callable[..., DataFrame]] = {}
#: name -> f(boxes by frame, key, most_missing) giving rows (key, frame_idx, object_id, x1 .. y2, is_stale)
TRACKERS: dict[str, Callable[..., DataFrame]] = {}
#: name -> f(boxes, frame_w, frame_h) adding rx1 .. ry2, null where nothing is left
REGIONS: dict[str, Callable[..., DataFrame]] = {}


def detector(name: str):
    def put(f):
        DETECTORS[name] = f
        return f

    return put


def tracker(name: str):
    def put(f):
        TRACKERS[name] = f
        return f

    return put


def region(name: str):
    def put(f):
        REGIONS[name] = f
        return f

    return put


def extractor(name: str):
    def put(f):
        EXTRACTORS[name] = f
        return f

    return put


def estimator(name: str):
    def put(f):
        ESTIMATORS[name] = f
        return f

    return put


@detector("distance")
@detector("variance")
def _planes(planes: DataFrame, sizes: DataFrame, settings: detections.Detector, key: str) -> DataFrame:
    return detections.faces(planes, sizes, settings, key)


@tracker("centroid")
def _centroid(boxes: DataFrame, key: str, most_missing: int) -> DataFrame:
    return tracking.tracked(boxes, key, boxes.schema[key].dataType.simpleString(), most_missing)


@region("full")
def _full(boxes: DataFrame, frame_w: int, frame_h: int) -> DataFrame:
    """The box itself, cut to the frame."""
    cut = {"rx1": ("x1", frame_w), "ry1": ("y1", frame_h), "rx2": ("x2", frame_w), "ry2": ("y2", frame_h)}
    out = boxes.withColumns({r: F.greatest(F.lit(0), F.least(F.col(c), F.lit(most))) for r, (c, most) in cut.items()})
    some = (F.col("rx2") > F.col("rx1")) & (F.col("ry2") > F.col("ry1"))
    return out.select(*boxes.columns, *[F.when(some, F.col(r)).alias(r) for r in cut])


@region("square")
def _square(boxes: DataFrame, frame_w: int, frame_h: int) -> DataFrame:
    return geometry.square_region(boxes, frame_w, frame_h)


@extractor("plane_orthogonal")
def _plane(df: DataFrame, keys: Sequence[str], size: int, fps: float) -> DataFrame:
    return pulse.plane_pulse(df, keys, size, fps).withColumnRenamed("y", "v")


@extractor("chrominance")
def _chrominance(df: DataFrame, keys: Sequence[str], size: int, fps: float) -> DataFrame:
    return pulse.chrominance(df, keys, size, fps).withColumnRenamed("s", "v")


def _unmixed(f: Callable[..., DataFrame], df: DataFrame, keys: Sequence[str], size: int, fps: float) -> DataFrame:
    schema = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys)
    return f(df, keys, schema, size, fps).select(*keys, F.posexplode("pulse").alias("at", "v"))


@extractor("independent")
def _independent(df: DataFrame, keys: Sequence[str], size: int, fps: float) -> DataFrame:
    return _unmixed(pulse.independent_component, df, keys, size, fps)


@extractor("guided")
def _guided(df: DataFrame, keys: Sequence[str], size: int, fps: float) -> DataFrame:
    return _unmixed(pulse.guided_component, df, keys, size, fps)


@extractor("green")
def _green(df: DataFrame, keys: Sequence[str], size: int, fps: float) -> DataFrame:
    return df.select(*keys, "at", "g").withColumnRenamed("g", "v")


@estimator("spectrum")
def _spectrum(df: DataFrame, keys: Sequence[str], size: int, fps: float) -> DataFrame:
    return pulse.spectral_rate(df, keys, "v", size, fps, detrended=True, filtered=True).select(*keys, "heart_rate")


@estimator("peaks")
def _peaks(df: DataFrame, keys: Sequence[str], size: int, fps: float) -> DataFrame:
    return pulse.peak_rate(df, keys, "v", fps).select(*keys, "heart_rate")


def heart_rates(df: DataFrame, keys: Sequence[str], size: int, fps: float = 30.0, extract: str = "plane_orthogonal", estimate: str = "spectrum") -> DataFrame:
    return ESTIMATORS[estimate](EXTRACTORS[extract](df, keys, size, fps), keys, size, fps)


def network_signal(clips: DataFrame, weights: bytes, shape: Sequence[int], schema: str) -> DataFrame:
    """(key, at, v) from rows (key, tensor): the network runs in the tasks, its session is made once for each.

    `weights` is an ONNX model of the user's; `shape` is that of one clip's tensor.
    """
    shared = clips.sparkSession.sparkContext.broadcast(weights)  # one model file
    key = clips.columns[0]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import onnxruntime

        session = onnxruntime.InferenceSession(shared.value, providers=["CPUExecutionProvider"])
        name = session.get_inputs()[0].name
        for pdf in parts:
            for k, tensor in zip(pdf[key], pdf["tensor"], strict=True):
                v = session.run(None, {name: np.asarray(tensor, np.float32).reshape(shape)})[0].ravel()
                yield pd.DataFrame({key: k, "at": np.arange(len(v)), "v": v.astype(float)})

    return clips.mapInPandas(run, schema)
