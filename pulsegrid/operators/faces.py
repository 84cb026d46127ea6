"""From frames to heart rates, every step by the name of what does it: detector, tracker, region, extractor, estimator."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import pixels, windows
from .extensions import DETECTORS, ESTIMATORS, EXTRACTORS, REGIONS, TRACKERS

KEYS = ["video_id", "object_id"]
BOX = ("x1", "y1", "x2", "y2")


def _named(table: dict, name: str, what: str):
    if name not in table:
        raise ValueError(f"no {what} {name}: {', '.join(sorted(table))}")
    return table[name]


def boxes(planes: DataFrame, sizes: DataFrame, settings, detect: str) -> DataFrame:
    """(video_id, frame_idx, det, x1 .. y2) from a detector's planes, which have video_id and frame_idx; the best face is det 0."""
    key = F.struct("video_id", "frame_idx").alias("frame")
    found = _named(DETECTORS, detect, "detector")(planes.withColumn("frame", key), sizes.withColumn("frame", key), settings, "frame")
    return found.select("frame.*", F.posexplode("faces").alias("det", "_f")).select("video_id", "frame_idx", F.col("det").cast("long").alias("det"), *[F.col(f"_f.{c}").alias(c) for c in BOX])


def colour_traces(frames: DataFrame, found: DataFrame, frame_w: int, frame_h: int, track: str = "centroid", region: str = "square", most_missing: int = 50) -> DataFrame:
    """(video_id, object_id, frame_idx, r, g, b): the mean colours of every live object's region in every frame of a video.

    A missing object keeps its last box, as long as its tracker does; regions without an area give no row.
    """
    tracks = _named(TRACKERS, track, "tracker")(found, "video_id", most_missing)
    placed = _named(REGIONS, region, "region")(tracks, frame_w, frame_h).where("rx1 is not null")
    regions = placed.select(*KEYS, "frame_idx", *[F.col(f"r{c}").alias(c) for c in BOX])
    cut = pixels.cropped(frames.join(regions, ["video_id", "frame_idx"]).select(*KEYS, "frame_idx", "height", "width", "pixels", *BOX))
    return pixels.channel_means(cut.where("pixels is not null")).select(*KEYS, "frame_idx", "r", "g", "b")


def heart_rates(traces: DataFrame, size: int = 180, fps: float = 30.0, extract: str = "plane_orthogonal", estimate: str = "spectrum") -> DataFrame:
    """(video_id, object_id, win_id, heart_rate) of each full window of an object's frames."""
    keyed = traces.withColumn("_face", F.to_json(F.struct(*KEYS)))
    placed = windows.tumbling(windows.positions(keyed, "_face", ["frame_idx"]), "_face", size)
    keys = [*KEYS, "win_id"]
    signal = _named(EXTRACTORS, extract, "extractor")(placed, keys, size, fps)
    return _named(ESTIMATORS, estimate, "estimator")(signal, keys, size, fps).select(*keys, "heart_rate")
