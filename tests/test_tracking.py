import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from pulsegrid.operators import geometry, tracking

A, B, C = (0, 0, 10, 10), (100, 100, 110, 110), (200, 0, 210, 10)


def test_registers_in_order_and_follows():
    t = tracking.step(tracking.Tracks(), [A, B])
    t = tracking.step(t, [(102, 101, 112, 111), (1, 1, 11, 11)])
    assert t.boxes == {0: (1, 1, 11, 11), 1: (102, 101, 112, 111)}


def test_disappears_after_too_many_frames():
    t = tracking.step(tracking.Tracks(), [A])
    for _ in range(50):
        t = tracking.step(t, [])
    assert 0 in t.boxes
    assert not tracking.step(t, []).boxes


def test_ids_are_not_used_again():
    t = tracking.step(tracking.Tracks(), [A])
    for _ in range(51):
        t = tracking.step(t, [])
    assert list(tracking.step(t, [A]).boxes) == [1]


def test_more_boxes_than_objects_do_not_age():
    t = tracking.step(tracking.Tracks(), [A, B])
    t = tracking.step(t, [(50, 50, 60, 60), (-300, -300, -290, -290), (-400, -400, -390, -390)])  # both objects want the first
    assert t.missing[0] == 0 and t.missing[1] == 0 and len(t.boxes) == 4 and t.boxes[1] == B


def test_unmatched_boxes_are_ignored_among_as_many_objects():
    t = tracking.step(tracking.Tracks(), [A, B])
    t = tracking.step(t, [(50, 50, 60, 60), (-400, -400, -390, -390)])
    assert t.boxes == {0: (50, 50, 60, 60), 1: B} and t.missing[1] == 1


@settings(max_examples=50, deadline=None)
@given(st.lists(st.lists(st.tuples(st.integers(0, 50), st.integers(0, 50)), max_size=4), max_size=12))
def test_ids_only_grow(frames):
    t, seen = tracking.Tracks(), -1
    for f in frames:
        before = set(t.boxes)
        t = tracking.step(t, [(x, y, x + 5, y + 5) for x, y in f], 2)
        new = set(t.boxes) - before
        assert all(i > seen for i in new)
        seen = max([seen, *new])


def test_suppression_leaves_no_large_overlap(spark):
    rng = np.random.default_rng(5)
    rows = [(0, i, int(x), int(y), int(x) + 40, int(y) + 40, float(s)) for i, (x, y, s) in enumerate(zip(rng.integers(0, 80, 30), rng.integers(0, 80, 30), rng.random(30), strict=True))]
    df = spark.createDataFrame(rows, "frame_idx long, det long, x1 int, y1 int, x2 int, y2 int, score double")
    kept = geometry.suppressed(df, ["frame_idx"], 0.3)
    assert geometry.overlaps(kept, ["frame_idx"]).where("iou > 0.3").count() == 0
    best = max(rows, key=lambda r: r[6])[1]
    assert best in {r["det"] for r in kept.collect()}


def test_a_region_with_nothing_left_is_null(spark):
    df = spark.createDataFrame([(700, 10, 720, 20), (-50, 10, 20, 60), (600, 300, 660, 400)], "x1 int, y1 int, x2 int, y2 int")
    got = [tuple(r)[4:] for r in geometry.square_region(df, 640, 360).collect()]
    assert got[1:] == [(0, 0, 70, 70), (540, 260, 640, 360)] and got[0] == (620, 5, 640, 25)
