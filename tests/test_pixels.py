"""Frames as bytes against direct loops."""

import numpy as np
import pytest

from pulsegrid.operators import geometry, pixels
from pulsegrid.sources import files

SCHEMA = "id long, height int, width int, pixels binary"


def direct(image, h, w):
    """Linear between centres, one pixel after the other."""
    ih, iw, c = image.shape
    out = np.zeros((h, w, c), np.uint8)
    for y in range(h):
        for x in range(w):
            sy, sx = (y + 0.5) * ih / h - 0.5, (x + 0.5) * iw / w - 0.5
            y0, x0 = int(np.floor(sy)), int(np.floor(sx))
            at = lambda j, i: image[min(max(j, 0), ih - 1), min(max(i, 0), iw - 1)].astype(float)
            fy, fx = sy - y0, sx - x0
            top, low = at(y0, x0) * (1 - fx) + at(y0, x0 + 1) * fx, at(y0 + 1, x0) * (1 - fx) + at(y0 + 1, x0 + 1) * fx
            out[y, x] = np.floor(top * (1 - fy) + low * fy + 0.5)
    return out


def frames(seed=1):
    rng = np.random.default_rng(seed)
    return [rng.integers(0, 256, s).astype(np.uint8) for s in ((6, 9, 3), (9, 6, 3), (7, 7, 3), (12, 16, 3), (6, 9, 3), (1, 1, 3), (30, 40, 3))]


def table(spark, images):
    rows = [(i, x.shape[0], x.shape[1], bytearray(x.tobytes())) for i, x in enumerate(images)] + [(99, 4, 4, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(2)


def image(r):
    return np.frombuffer(r["pixels"], np.uint8).reshape(r["height"], r["width"], 3)


def test_letterbox_equals_a_loop_and_the_boxes_geometry(spark):
    images = frames()
    out = {r["id"]: r for r in pixels.letterboxed(table(spark, images), 16, 12).collect()}
    assert out[99]["pixels"] is None and out[99]["dx"] is None
    sizes = spark.createDataFrame([(i, x.shape[1], x.shape[0]) for i, x in enumerate(images)], "id long, iw int, ih int")
    plan = {r["id"]: r for r in geometry.letterbox(sizes, 16, 12).collect()}
    for i, x in enumerate(images):
        r, p = out[i], plan[i]
        assert (r["dx"], r["dy"]) == (p["dx"], p["dy"]) and r["gain"] == pytest.approx(p["gain"])
        want = direct(x, p["nh"], p["nw"])
        if x.shape[0] != x.shape[1]:
            canvas = np.zeros((12, 16, 3), np.uint8)
            canvas[p["dy"] : p["dy"] + p["nh"], p["dx"] : p["dx"] + p["nw"]] = want
            want = canvas
        assert (image(r) == want).all()


def test_frames_of_a_saved_array(spark, tmp_path):
    a = np.random.default_rng(2).integers(0, 256, (20, 6, 10, 3)).astype(np.uint8)
    np.save(f"{tmp_path}/a.npy", a)
    read = files.read_frames(spark, f"{tmp_path}/a.npy").select("frame_idx", "height", "width", "pixels")
    out = pixels.letterboxed(read, 8, 8).orderBy("frame_idx").collect()
    for r, x in zip(out, a, strict=True):
        canvas = np.zeros((8, 8, 3), np.uint8)
        canvas[1:6] = direct(x[..., ::-1], 5, 8)
        assert (image(r) == canvas).all() and (r["dx"], r["dy"]) == (0, 1)
    half = pixels.scaled(read, 0.5).orderBy("frame_idx").first()
    assert (image(half) == direct(a[0][..., ::-1], 3, 5)).all()
    assert pixels.scaled(read, 1.0) is read


def test_pad_and_resample(spark):
    images = frames()[:2]
    for r in pixels.padded(table(spark, images), 11, 10).where("id < 99").collect():
        x = images[r["id"]]
        assert (image(r)[r["dy"] : r["dy"] + x.shape[0], r["dx"] : r["dx"] + x.shape[1]] == x).all() and image(r).sum() == x.sum()
    for r in pixels.resampled(table(spark, images), 5, 4).where("id < 99").collect():
        assert (image(r) == direct(images[r["id"]], 4, 5)).all()


def test_crops(spark):
    images = frames()[:4]
    boxes = [(1, 2, 5, 6), (0, 0, 99, 99), (3, 3, 3, 6), (4, 20, 9, 30)]
    rows = [(i, x.shape[0], x.shape[1], bytearray(x.tobytes()), *b) for i, (x, b) in enumerate(zip(images, boxes, strict=True))] + [(9, 6, 9, bytearray(images[0].tobytes()), None, 0, 4, 4)]
    out = {r["id"]: r for r in pixels.cropped(spark.createDataFrame(rows, SCHEMA + ", x1 int, y1 int, x2 int, y2 int")).collect()}
    assert (image(out[0]) == images[0][2:6, 1:5]).all() and (image(out[1]) == images[1]).all()
    assert all(out[i]["pixels"] is None and out[i]["height"] is None for i in (2, 3, 9))
