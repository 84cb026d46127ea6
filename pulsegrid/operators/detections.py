"""From a detector's raw output planes to faces: layer order, dequantising, one row for each anchor, decoding, suppression.

A plane is a row (frame, layer, height, width, channels, data, zero, scale): bytes in height, width, channel
order that stand for (byte - zero) * scale. The table function `raw_outputs` takes the planes of a frame together and gives
only the anchors whose score passes, so the rest of the chain is built-in operators on few rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udtf

from . import geometry

# Output layers of the published detectors, in order box, score, landmarks for each stride from fine to coarse.
SCRFD_500M = tuple(f"scrfd_500m/conv{k}" for k in (27, 26, 25, 33, 32, 34, 39, 38, 40))
SCRFD_2_5G = tuple(f"scrfd_2_5g/conv{k}" for k in (43, 42, 44, 50, 49, 51, 56, 55, 57))
SCRFD_10G = tuple(f"scrfd_10g/conv{k}" for k in (42, 41, 43, 50, 49, 51, 57, 56, 58))
RETINA = tuple(f"retinaface_mobilenet_v1/conv{k}" for k in (41, 42, 43, 32, 33, 34, 23, 24, 25))

POINTS = 5


@dataclass(frozen=True)
class Detector:
    """kind `distance`: boxes as distances from grid corners, one score, kept from `least` on; `variance`: offsets from priors, two logits, kept above `least`."""

    kind: str
    layers: Sequence[str]
    width: int = 640
    height: int = 640
    steps: Sequence[int] = geometry.STEPS
    sizes: Sequence[Sequence[int]] = geometry.SIZES
    least: float = 0.5
    most: float = 0.4
    labels: dict[str, str] = field(default_factory=dict)

    def __post_init__(self):
        if self.kind not in ("distance", "variance"):
            raise ValueError(f"no detector {self.kind}: distance or variance")
        if len(self.layers) % len(self.steps) or len(self.layers) // len(self.steps) not in (2, 3):
            raise ValueError(f"{len(self.layers)} layers for {len(self.steps)} strides")

    @property
    def strict(self) -> bool:
        return self.kind == "variance"

    @property
    def category(self) -> int:
        return int(self.kind == "variance")

    @property
    def label(self) -> str:
        return self.labels.get(str(self.category), f"class_{self.category}")

    def anchors(self, spark: SparkSession) -> DataFrame:
        if self.kind == "distance":
            return geometry.grid_anchors(spark, self.width, self.height, len(self.sizes[0]), self.steps)
        return geometry.prior_boxes(spark, self.width, self.height, self.steps, self.sizes)

    def outputs(self, planes: dict[str, tuple[int, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
        """Boxes, scores and landmarks of all anchors, fine strides first; planes: channels and values by layer."""
        missing = [x for x in self.layers if x not in planes]
        if missing:
            raise ValueError(f"no plane of layer {missing[0]}")
        per, logits = len(self.layers) // len(self.steps), 1 if self.kind == "distance" else 2
        parts: list[list[np.ndarray]] = [[], [], []]
        for s, own in enumerate(self.sizes):
            for j, each in enumerate((4, logits, 2 * POINTS)[:per]):
                name = self.layers[s * per + j]
                channels, values = planes[name]
                if channels != each * len(own):
                    raise ValueError(f"layer {name} has {channels} channels instead of {each * len(own)}")
                cells = (self.height // self.steps[s]) * (self.width // self.steps[s])
                if values.size != cells * channels:
                    raise ValueError(f"layer {name} has {values.size} values instead of {cells * channels}")
                parts[j].append(values.reshape(-1, each))
        box, score = np.concatenate(parts[0]), np.concatenate(parts[1])
        if logits == 2:
            e = np.exp(score - score.max(1, keepdims=True))
            score = (e / e.sum(1, keepdims=True))[:, 1:]
        return box, score[:, 0], np.concatenate(parts[2]) if per == 3 else None


def raw_outputs(planes: DataFrame, detector: Detector, key: str = "frame_idx") -> DataFrame:
    """(key, anchor_id, score, d, points) of the anchors whose score passes; planes have key, layer, channels, data, zero, scale."""
    kind = planes.schema[key].dataType.simpleString()

    @arrow_udtf(returnType=f"frame {kind}, anchor_id long, score double, d array<double>, points array<double>")
    class Outputs:
        def __init__(self):
            self.key, self.planes = None, {}

        def eval(self, rows):
            for i, layer, channels, data, zero, scale in zip(*(rows[c] if isinstance(rows, pa.Table) else rows.column(c) for c in ("frame", "layer", "channels", "data", "zero", "scale")), strict=True):
                self.key = i
                values = (np.frombuffer(data.as_buffer(), np.uint8).astype(np.float64) - zero.as_py()) * scale.as_py()
                self.planes[layer.as_py()] = (channels.as_py(), values)
            return iter(())

        def terminate(self):
            if not self.planes:
                return
            box, score, points = detector.outputs(self.planes)
            good = np.flatnonzero(score > detector.least if detector.strict else score >= detector.least)
            lists = lambda x: pa.array([row.tolist() for row in x[good]] if x is not None else [None] * len(good), pa.list_(pa.float64()))
            yield pa.table({"frame": pa.array([self.key.as_py()] * len(good), self.key.type), "anchor_id": pa.array(good, pa.int64()), "score": pa.array(score[good]), "d": lists(box), "points": lists(points)})

    rows = planes.select(F.col(key).alias("frame"), "layer", F.col("channels").cast("int"), "data", F.col("zero").cast("double"), F.col("scale").cast("double"))
    return Outputs(rows.asTable().partitionBy("frame")).withColumnRenamed("frame", key)


def decoded(raw: DataFrame, detector: Detector) -> DataFrame:
    """Boxes x1 .. y2 and landmarks p0x .. p4y, null where the detector has none, in pixels of the detector's input."""
    spark, w, h = raw.sparkSession, detector.width, detector.height
    flat = {f"d{i}": F.get("d", F.lit(i)) for i in range(4)} | {f"q{i}": F.get("points", F.lit(i)) for i in range(2 * POINTS)}
    rows = raw.withColumns(flat).join(F.broadcast(detector.anchors(spark)), "anchor_id")  # some ten thousand rows, by the size of the input
    pairs = [(f"q{2 * i}", f"q{2 * i + 1}") for i in range(POINTS)]
    if detector.kind == "distance":
        out = geometry.distance_points(geometry.distance_boxes(rows, w, h), w, h, pairs)
    else:
        out = geometry.variance_points(geometry.variance_boxes(rows), pairs)
        across, down = ["x1", "x2", *[f"p{i}x" for i in range(POINTS)]], ["y1", "y2", *[f"p{i}y" for i in range(POINTS)]]
        out = out.withColumns({c: F.col(c) * w for c in across} | {c: F.col(c) * h for c in down})
    return out.drop(*flat, "d", "points", "cx", "cy", "sx", "sy")


def faces(planes: DataFrame, sizes: DataFrame, detector: Detector, key: str = "frame_idx") -> DataFrame:
    """(key, faces): category, label, score, box in the image's own whole pixels and landmarks in pixels of the detector's input, by score.

    sizes has key, iw, ih of each frame's image. Frames without a face give no row.
    """
    points = [f"p{i}{a}" for i in range(POINTS) for a in "xy"]
    boxed = decoded(raw_outputs(planes, detector, key), detector).select(key, "anchor_id", "score", "x1", "y1", "x2", "y2", *points)
    alive = geometry.suppressed(boxed, [key], detector.most, "anchor_id")
    back = geometry.letterbox(alive.join(sizes.select(key, "iw", "ih"), key), detector.width, detector.height)
    for k in "12":
        back = geometry.unletterbox(back, f"x{k}", f"y{k}", detector.width, detector.height).withColumns({f"_x{k}": F.col("ox").cast("int"), f"_y{k}": F.col("oy").cast("int")}).drop("ox", "oy")
    marks = F.when(F.col("p0x").isNotNull(), F.array(*[F.struct(F.lit(i).alias("category_id"), F.col(f"p{i}x").alias("x"), F.col(f"p{i}y").alias("y")) for i in range(POINTS)])).otherwise(F.array())
    face = F.struct((-F.col("score")).alias("rank"), "anchor_id", F.lit(detector.category).alias("category_id"), F.lit(detector.label).alias("label"), "score", *[F.col(f"_{c}").alias(c) for c in ("x1", "y1", "x2", "y2")], marks.alias("landmarks"))
    ordered = F.array_sort(F.collect_list(face))
    kept = ("category_id", "label", "score", "x1", "y1", "x2", "y2", "landmarks")
    return back.groupBy(key).agg(F.transform(ordered, lambda f: F.struct(*[f[c].alias(c) for c in kept])).alias("faces"))
