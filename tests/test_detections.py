"""Detectors from raw planes, against direct loops over anchors."""

import json

import numpy as np
import pytest

from pulsegrid.operators import detections, geometry
from pulsegrid.sources import files

PLANES = "frame_idx long, layer string, height int, width int, channels int, data binary, zero double, scale double"


def planes_of(detector, frames, seed=1, per=3, score=None):
    """Random planes of some frames, and their values by frame and layer."""
    rng, rows, values = np.random.default_rng(seed), [], {}
    logits = 1 if detector.kind == "distance" else 2
    for f in frames:
        for s, own in enumerate(detector.sizes):
            for j, each in enumerate((4, logits, 10)[:per]):
                h, w, c = detector.height // detector.steps[s], detector.width // detector.steps[s], each * len(own)
                x = rng.integers(0, 256, (h, w, c)).astype(np.uint8)
                zero, scale = ((0.0, 1 / 64), (128.0, 1 / 32))[detector.kind == "variance"] if j == 0 else (0.0, 1 / 256) if j == 1 and logits == 1 else (128.0, 1 / 64)
                if j == 1 and score is not None:
                    x[:] = score
                name = detector.layers[s * per + j]
                rows.append((f, name, h, w, c, bytearray(x.tobytes()), zero, scale))
                values[f, name] = (x.astype(float) - zero) * scale
    rng.shuffle(rows)
    return [tuple(int(v) if isinstance(v, np.integer) else v for v in r) for r in rows], values


def direct(detector, values, f, iw, ih):
    """Faces by loops: (score, box, landmarks)."""
    found, w, h = [], detector.width, detector.height
    for s, (step, own) in enumerate(zip(detector.steps, detector.sizes, strict=True)):
        box, score, mark = (values[f, detector.layers[s * 3 + j]] for j in range(3))
        for i in range(h // step):
            for j in range(w // step):
                for a, size in enumerate(own):
                    d, q = box[i, j].reshape(len(own), 4)[a], mark[i, j].reshape(len(own), 10)[a]
                    if detector.kind == "distance":
                        p, cx, cy, sx, sy = score[i, j][a], j * step / w, i * step / h, step / w, step / h
                        x1, y1, x2, y2 = (cx - d[0] * sx) * w, (cy - d[1] * sy) * h, (cx + d[2] * sx) * w, (cy + d[3] * sy) * h
                        points = [((cx + q[2 * k] * sx) * w, (cy + q[2 * k + 1] * sy) * h) for k in range(5)]
                        good = p >= detector.least
                    else:
                        z = score[i, j].reshape(len(own), 2)[a]
                        p = float(np.exp(z[1]) / np.exp(z).sum())
                        cx, cy, sx, sy = (j + 0.5) * step / w, (i + 0.5) * step / h, size / w, size / h
                        bw, bh = sx * np.exp(d[2] * 0.2), sy * np.exp(d[3] * 0.2)
                        x1, y1 = (cx + d[0] * 0.1 * sx - bw / 2) * w, (cy + d[1] * 0.1 * sy - bh / 2) * h
                        x2, y2 = x1 + bw * w, y1 + bh * h
                        points = [((cx + q[2 * k] * 0.1 * sx) * w, (cy + q[2 * k + 1] * 0.1 * sy) * h) for k in range(5)]
                        good = p > detector.least
                    if good:
                        found.append((p, len(found), (x1, y1, x2, y2), points))
    found.sort(key=lambda r: (-round(r[0], 12), r[1]))
    kept = []
    for r in found:
        def iou(a, b):
            inter = max(0, min(a[2], b[2]) - max(a[0], b[0])) * max(0, min(a[3], b[3]) - max(a[1], b[1]))
            return inter / ((a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - inter)
        if all(iou(r[2], k[2]) <= detector.most for k in kept):
            kept.append(r)
    scale = min(w / iw, h / ih)
    nw, nh = min(round(iw * scale), w), min(round(ih * scale), h)
    gain, dx, dy = min(nh / ih, nw / iw), (w - nw) // 2 if iw != ih else 0, (h - nh) // 2 if iw != ih else 0
    px = lambda x: int(min(max(0, (x - dx) / gain), iw))
    py = lambda y: int(min(max(0, (y - dy) / gain), ih))
    return [(p, (px(b[0]), py(b[1]), px(b[2]), py(b[3])), points) for p, _, b, points in kept]


DISTANCE = detections.Detector("distance", detections.SCRFD_500M, 64, 96, least=0.98, labels={"0": "face"})
VARIANCE = detections.Detector("variance", detections.RETINA, 96, 64, least=0.96)


@pytest.mark.parametrize("detector", [DISTANCE, VARIANCE])
def test_faces_equal_direct_loops(spark, detector):
    rows, values = planes_of(detector, [3, 4, 9])
    sizes = {3: (640, 480), 4: (100, 100), 9: (320, 500)}
    out = detections.faces(spark.createDataFrame(rows, PLANES), spark.createDataFrame([(f, *s) for f, s in sizes.items()], "frame_idx long, iw int, ih int"), detector).collect()
    assert len(out) == 3
    for r in out:
        want = direct(detector, values, r["frame_idx"], *sizes[r["frame_idx"]])
        got = r["faces"]
        assert len(got) == len(want) > 0
        for g, (p, box, points) in zip(got, want, strict=True):
            assert g["score"] == pytest.approx(p, abs=1e-12) and np.abs(np.subtract((g["x1"], g["y1"], g["x2"], g["y2"]), box)).max() <= 1
            assert np.allclose([(m["x"], m["y"]) for m in g["landmarks"]], points) and [m["category_id"] for m in g["landmarks"]] == list(range(5))
            assert (g["category_id"], g["label"]) == ((0, "face") if detector.kind == "distance" else (1, "class_1"))


def test_scores_at_the_threshold(spark):
    """One detector keeps a score that equals the threshold, the other drops it."""
    for detector, n in ((detections.Detector("distance", detections.SCRFD_10G, 32, 32, least=0.5), 42), (detections.Detector("variance", detections.RETINA, 32, 32, least=0.5), 0)):
        rows, _ = planes_of(detector, [1], score=128)  # 0.5; two equal logits
        assert detections.raw_outputs(spark.createDataFrame(rows, PLANES), detector).count() == n
    boxes = spark.createDataFrame([(1, d, s, 10, 10, 20.0 * d, 0.0, 20.0 * d + 5, 5.0) for d, s in enumerate((0.5, 0.6))], "frame_idx long, det long, score double, iw int, ih int, x1 double, y1 double, x2 double, y2 double")
    sizes = [len(geometry.faces_by_frame(boxes, ["frame_idx"], 64, 64, 0.5, 0.4, strict=s).first()["faces"]) for s in (False, True)]
    assert sizes == [2, 1]


def test_planes_without_landmarks_and_whole_size(spark):
    plain = detections.Detector("distance", [f"out{i}" for i in range(6)], 640, 640, least=0.99)
    rows, _ = planes_of(plain, [1, 2], per=2)
    raw = detections.raw_outputs(spark.createDataFrame(rows, PLANES), plain)
    assert 0 < raw.count() < 2 * 16800 and raw.where("points is not null").count() == 0
    sizes = spark.createDataFrame([(1, 640, 640), (2, 640, 640)], "frame_idx long, iw int, ih int")
    assert all(f["landmarks"] == [] for r in detections.faces(spark.createDataFrame(rows, PLANES), sizes, plain).collect() for f in r["faces"])


def test_wrong_planes_are_named(spark):
    rows, _ = planes_of(DISTANCE, [1])
    with pytest.raises(Exception, match="no plane of layer"):
        detections.raw_outputs(spark.createDataFrame(rows[1:], PLANES), DISTANCE).collect()
    with pytest.raises(Exception, match="channels instead of"):
        detections.raw_outputs(spark.createDataFrame(rows, PLANES).withColumn("channels", detections.F.lit(3)), DISTANCE).collect()
    with pytest.raises(ValueError, match="strides"):
        detections.Detector("distance", ["a"])
    with pytest.raises(ValueError, match="no detector"):
        detections.Detector("other", detections.RETINA)
    assert detections.raw_outputs(spark.createDataFrame([], PLANES), DISTANCE).count() == 0


def test_a_detector_from_its_configuration(spark, tmp_path):
    config = {"DEVICE": [{}], "PRE_PROCESS": [{"InputN": 1, "InputH": 64, "InputW": 96, "InputC": 3}], "POST_PROCESS": [{"LabelsPath": "labels.json", "AnchorConfig": {"MinSizes": [[16, 32], [64, 128], [256, 512]], "Steps": [8, 16, 32]}, "OutputNMSThreshold": 0.3}]}
    (tmp_path / "d.json").write_text(json.dumps(config, indent=1))
    (tmp_path / "labels.json").write_text(json.dumps({"0": "background", "1": "face"}))
    got = files.read_detector(spark, f"{tmp_path}/d.json", "variance", detections.RETINA)
    assert (got.width, got.height, got.least, got.most, got.label) == (96, 64, 0.5, 0.3, "face")
    assert got.sizes == ((16, 32), (64, 128), (256, 512)) and got.anchors(spark).count() == (12 * 8 + 6 * 4 + 3 * 2) * 2
    (tmp_path / "bad.json").write_text(json.dumps({"PRE_PROCESS": config["PRE_PROCESS"], "POST_PROCESS": [{"AnchorConfig": {"Steps": [8]}}]}))
    with pytest.raises(ValueError, match="labels"):
        files.read_detector(spark, f"{tmp_path}/bad.json", "variance", detections.RETINA)
