"""Steps that larger tables found wanting."""

import duckdb
import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from pulsegrid.operators import geometry, pulse, tracking, windows
from pulsegrid.plans import registry


def test_spatial_mean_multiplies_in_single_precision(spark, tmp_path):
    """Products beside a half round as those of single numbers do."""
    spark.range(64_000).select(F.floor(F.col("id") / 64).alias("vec_id"), ((F.col("id") * 2 + 1) / 2000.0).cast("float").alias("v")).groupBy("vec_id").agg(F.sort_array(F.collect_list("v")).alias("embedding")).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = registry.QUERIES["spatial_mean"](spark, str(tmp_path)).toPandas().sort_values("vec_id", ignore_index=True)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    want = con.sql(registry.SQL["spatial_mean"]).df().sort_values("vec_id", ignore_index=True)
    pd.testing.assert_frame_equal(got, want, check_exact=True)


def _greedy(p: pd.DataFrame, most: float) -> list:
    """Suppression of one frame box by box."""
    kept = []
    for b in p.sort_values(["score", "det"], ascending=[False, True]).itertuples():
        area = lambda r: (r.x2 - r.x1) * (r.y2 - r.y1)
        inter = lambda r: max(0, min(b.x2, r.x2) - max(b.x1, r.x1)) * max(0, min(b.y2, r.y2) - max(b.y1, r.y1))  # noqa: E731, B023
        if all(inter(r) / (area(r) + area(b) - inter(r)) <= most for r in kept):
            kept.append(b)
    return [(r.frame_idx, r.det) for r in kept]


def test_suppression_takes_many_frames_at_once(spark):
    """Frames of all sizes, some longer than a batch; Python sees batches of rows, not a group for each frame."""
    rng = np.random.default_rng(3)
    size = np.concatenate([rng.integers(1, 40, 300), [130]])
    n = size.sum()
    x, y, w, h = (rng.integers(lo, hi, n) for lo, hi in ((0, 60), (0, 60), (5, 30), (5, 30)))
    pdf = pd.DataFrame({"frame_idx": np.repeat(np.arange(len(size)), size), "det": np.arange(n), "score": rng.integers(0, 20, n) / 20, "x1": x, "y1": y, "x2": x + w, "y2": y + h})
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "64")
    try:
        out = geometry.suppressed(spark.createDataFrame(pdf), ["frame_idx"], 0.3)
        got = sorted((r.frame_idx, r.det) for r in out.collect())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == sorted(k for _, p in pdf.groupby("frame_idx") for k in _greedy(p, 0.3))
    assert "FlatMapGroupsInPandas" not in out._jdf.queryExecution().executedPlan().toString()


def test_rolling_windows_sort_once(spark):
    """A task's rows are sorted once for all rolling windows, in as many tasks as the caller asks for."""
    df = spark.range(3000).select((F.col("id") % 3).alias("k"), F.floor(F.col("id") / 3).alias("pos"), (F.col("id") % 97 + 1.0).alias("v"))
    for out in (windows.rolling_stats(df, "k", "v", 60, parts=7), windows.rolling_diff_std(df, "k", "v", 60, parts=7), windows.standardised_chunks(df, "k", "v", 60, 10, parts=7)):
        plan = out._jdf.queryExecution().executedPlan().toString().partition("Initial Plan")[0]
        assert plan.count(" Sort [") == 1 and ", 7)" in plan
    forms = {(r["k"], r["pos"]): r for r in windows.rolling_forms(df, "k", "v", 60, 10, segment=128).collect()}
    whole = {(r["k"], r["pos"]): r for r in windows.rolling_forms(df, "k", "v", 60, 10).collect()}
    stats = {(r["k"], r["pos"]): r for r in windows.rolling_stats(df, "k", "v", 60).collect()}
    assert forms.keys() == whole.keys() == {(k, p) for k, p in stats if p % 10 == 9}
    for at, r in forms.items():
        for c in ("sums_std", "direct_std", "merged_std"):
            assert abs(r[c] - stats[at]["roll_std"]) < 1e-9 and abs(r["gt_diff_std"] - whole[at]["gt_diff_std"]) < 1e-12


def test_whole_windows_without_sizes_of_keys(spark):
    df = spark.range(1000).select((F.col("id") % 2).alias("k"), F.floor(F.col("id") / 2).alias("pos"))
    out = windows.tumbling(df, "k", 180, 5)
    assert sorted(map(tuple, out.groupBy("k", "win_id").count().collect())) == [(k, w, 180) for k in (0, 1) for w in (0, 1)]
    assert "Join" not in out._jdf.queryExecution().executedPlan().toString()


def test_assignment_makes_no_rows_of_pairs(spark):
    """Every object looks at the array of its frame's detections; ties go to the lower detection, then the lower object."""
    a = spark.createDataFrame([(1, 0, 0, 0), (1, 1, 4, 0), (1, 2, 9, 9), (2, 0, 5, 5)], "f long, obj long, cx long, cy long")
    b = spark.createDataFrame([(1, 7, 2, 0), (1, 5, 2, 0), (1, 9, 9, 8), (3, 0, 1, 1)], "f long, det long, cx long, cy long")
    out = geometry.nearest_matches(a, b, ["f"])
    assert sorted(map(tuple, out.collect())) == [(1, 0, 5, 2.0), (1, 2, 9, 1.0)]
    assert out._jdf.queryExecution().executedPlan().toString().partition("Initial Plan")[0].count(" Window ") == 1


def test_many_windows_are_unmixed_at_once(spark):
    """What a window gives doesn't depend on the others; Python gets batches of windows, not a group for each."""
    x = np.random.default_rng(4).laplace(size=(5, 3, 180)) * np.array([1.0, 2.0, 5.0])[:, None]
    assert np.allclose(pulse.jade(x), np.stack([pulse.jade(one) for one in x]), atol=1e-9)
    df = spark.createDataFrame([(1, w, i, *map(float, x[w, :, i])) for w in range(5) for i in range(180)], "face_id long, win_id long, at long, r double, g double, b double").where("win_id < 4 or at > 0")
    for f in (pulse.independent_component, pulse.guided_component):
        out = f(df, ["face_id", "win_id"], "face_id long, win_id long", 180)
        got = {r["win_id"]: r["pulse"] for r in out.collect()}
        (alone,) = f(df.where("win_id = 2"), ["face_id", "win_id"], "face_id long, win_id long", 180).collect()
        assert sorted(got) == [0, 1, 2, 3] and np.allclose(got[2], alone["pulse"], atol=1e-9)
        assert "FlatMapGroupsInPandas" not in out._jdf.queryExecution().executedPlan().toString()


def test_a_long_video_is_tracked_as_it_comes(spark):
    """Frames reach over batches and some have no boxes; Python sees batches of rows, not a group for each video, and small videos stay in many tasks."""
    rng = np.random.default_rng(6)
    rows = []
    for video in (1, 2, None):
        for f in range(60):
            n = int(rng.integers(0, 12))
            xy = rng.integers(-40, 40, (n, 2)).tolist()
            rows += [(video, f, d, x, y, x + 9, y + 7) for d, (x, y) in enumerate(xy)] or [(video, f, None, None, None, None, None)]
    df = spark.createDataFrame(rows, "video_id long, frame_idx long, det long, x1 int, y1 int, x2 int, y2 int")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        out = tracking.tracked(df, "video_id", "long", 3, 5)
        got = sorted(map(str, map(tuple, out.collect())))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    pdf = pd.DataFrame(rows, columns=df.columns)
    want = [(v, *r) for v in (1, 2, None) for r in tracking.fold(pdf[pdf["video_id"].isna() if v is None else pdf["video_id"] == v], tracking.Tracks(), 3)]
    assert got == sorted(map(str, want))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroupsInPandas" not in plan and "REPARTITION_BY_NUM" in tracking.tracked(df, "video_id", "long")._jdf.queryExecution().executedPlan().toString()


def test_nearest_boxes_of_few_and_many():
    rng = np.random.default_rng(7)
    objects, boxes = (rng.integers(-20, 20, (n, 4)).tolist() for n in (9, 11))
    nearest, far = tracking.nearest_boxes(objects, boxes)
    few = [tracking.nearest_boxes([o], boxes) for o in objects]
    assert len(objects) * len(boxes) >= tracking.MANY > len(boxes) and nearest == [n for (n,), _ in few] and far == [f for _, (f,) in few]


def test_rows_are_numbered_with_one_deal_and_sort(spark):
    """The number of rows ahead comes with the rows instead of by a join, in as many tasks as the caller asks for."""
    rows = [(None if i % 50 == 0 else i % 3, None if i % 17 == 0 else i * 37 % 400, i) for i in range(900)]
    df = spark.createDataFrame(rows, "k long, t long, id long")
    out = windows.positions(df, "k", ["t", "id"], coarse=F.floor(F.col("t") / 25), parts=7)
    assert sorted(map(str, out.collect())) == sorted(map(str, windows.positions(df, "k", ["t", "id"]).collect()))
    plan = out._jdf.queryExecution().executedPlan().toString().partition("Initial Plan")[2]
    assert "Join" not in plan and plan.count(", 7), REPARTITION_BY_NUM") == 3 and plan.count("Exchange") == 3


def test_plane_pulses_of_many_windows_at_once(spark):
    """No sum over neighbouring rows for each row; nulls and black frames don't touch other windows, incomplete windows are left out."""
    x = np.random.default_rng(8).uniform(50, 200, (5, 60, 3))
    rows = [(1, w, i, *(map(float, v) if w != 3 else (0.0, 0.0, 0.0))) for w in range(5) for i, v in enumerate(x[w])]
    df = spark.createDataFrame(rows, "face_id long, win_id long, at long, r double, g double, b double").where("win_id < 4 or at > 0")
    df = df.withColumn("g", F.expr("if(win_id = 2 and at = 7, null, g)"))
    out = pulse.plane_orthogonal(df, ["face_id", "win_id"], 60, at_once=2)
    got = out.orderBy("win_id", "at").toPandas()
    want = pulse.plane_projections(x.transpose(2, 0, 1), 48)
    h = {w: p["h"].to_numpy() for w, p in got.groupby("win_id")}
    assert sorted(h) == [0, 1, 2, 3] and all(np.allclose(h[w], want[w], atol=1e-9) for w in (0, 1))
    assert np.isnan(h[2][7]) and np.isfinite(np.delete(h[2], 7)).all() and not h[3].any() and dict(out.dtypes)["at"] == "bigint"
    assert "Window" not in out._jdf.queryExecution().executedPlan().toString()
    assert not pulse.plane_projections(x.transpose(2, 0, 1), 60).any()
