"""The chain from frames to rates, by names."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsegrid.operators import detections, extensions, faces, pixels

FRAMES, BOXES = "video_id long, frame_idx long, height int, width int, pixels binary", "video_id long, frame_idx long, det long, x1 int, y1 int, x2 int, y2 int"


def moving(spark, n=64):
    """A bright square that pulses on bin 3 of 64 samples and moves to the right; a dim one that stands still."""
    rng, rows, boxes = np.random.default_rng(1), [], []
    for i in range(n):
        frame = rng.integers(0, 5, (12, 40, 3)).astype(np.uint8)
        x = i // 4
        frame[2:6, x : x + 4] = [120, round(120 + 40 * np.sin(2 * np.pi * 3 * i / 64)), 90]
        frame[6:10, 30:34] = 60
        rows.append((7, i, 12, 40, bytearray(frame.tobytes())))
        if i != 20:
            boxes += [(7, i, 0, x, 2, x + 4, 6), (7, i, 1, 30, 6, 34, 10)]
    return spark.createDataFrame(rows, FRAMES), spark.createDataFrame(boxes, BOXES)


@pytest.mark.parametrize("region", ["full", "square"])
def test_rate_of_a_moving_face(spark, region):
    frames, boxes = moving(spark)
    traces = faces.colour_traces(frames, boxes, 40, 12, region=region)
    first = traces.where("object_id = 0").orderBy("frame_idx").collect()
    assert len(first) == 63 and first[5]["r"] == 120 and first[5]["g"] == round(120 + 40 * np.sin(2 * np.pi * 15 / 64))
    second = faces.heart_rates(traces, 63, extract="green").collect()
    rates = {(r["video_id"], r["object_id"]): r["heart_rate"] for r in second}
    assert set(rates) == {(7, 0), (7, 1)} and rates[7, 0] == pytest.approx(3 * 30 / 64 * 60)


def test_names(spark):
    frames, boxes = moving(spark, 3)
    for wrong in ({"track": "none"}, {"region": "none"}):
        with pytest.raises(ValueError, match="no tracker|no region"):
            faces.colour_traces(frames, boxes, 40, 12, **wrong)
    with pytest.raises(ValueError, match="no extractor none: chrominance"):
        faces.heart_rates(faces.colour_traces(frames, boxes, 40, 12), 3, extract="none")
    with pytest.raises(ValueError, match="no detector"):
        faces.boxes(frames, frames, None, "none")

    @extensions.tracker("each")
    def _(found, key, most_missing):
        return found.select(key, "frame_idx", F.col("det").alias("object_id"), *faces.BOX, F.lit(False).alias("is_stale"))

    assert faces.colour_traces(frames, boxes, 40, 12, track="each", region="full").count() == 6


def test_boxes_from_planes(spark):
    detector = detections.Detector("distance", detections.SCRFD_500M, 32, 32, least=0.5)
    rows = []
    for s, own in enumerate(detector.sizes):
        cells = (32 // detector.steps[s]) ** 2
        for j, each in enumerate((4, 1, 10)):
            x = np.full((cells, each * len(own)), 32, np.uint8)
            if j == 1:
                x[:] = 0
                if s == 0:
                    x[5, 0] = 200
            rows.append((1, 4, detector.layers[s * 3 + j], each * len(own), bytearray(x.tobytes()), 0.0, 1 / 64 if j != 1 else 1 / 256))
    planes = spark.createDataFrame(rows, "video_id long, frame_idx long, layer string, channels int, data binary, zero double, scale double")
    sizes = spark.createDataFrame([(1, 4, 32, 32)], "video_id long, frame_idx long, iw int, ih int")
    got = [tuple(r) for r in faces.boxes(planes, sizes, detector, "distance").collect()]
    assert got == [(1, 4, 0, 4, 4, 12, 12)]


def test_regions_at_the_edges(spark):
    boxes = spark.createDataFrame([(0, -5, 2, 4, 8), (1, 38, 3, 60, 9), (2, 50, 3, 60, 9)], "id long, x1 int, y1 int, x2 int, y2 int")
    got = {r["id"]: (r["rx1"], r["ry1"], r["rx2"], r["ry2"]) for r in extensions.REGIONS["full"](boxes, 40, 12).collect()}
    assert got == {0: (0, 2, 4, 8), 1: (38, 3, 40, 9), 2: (None,) * 4}


def test_means_of_frames(spark):
    x = np.arange(24, dtype=np.uint8).reshape(2, 4, 3)
    rows = [(1, 2, 4, bytearray(x.tobytes())), (2, 2, 4, None), (3, 2, 4, bytearray(x[..., :1].tobytes()))]
    out = {r["id"]: (r["r"], r["g"], r["b"]) for r in pixels.channel_means(spark.createDataFrame(rows, "id long, height int, width int, pixels binary")).collect()}
    assert out == {1: tuple(x.mean((0, 1))), 2: (None,) * 3, 3: (None,) * 3}
