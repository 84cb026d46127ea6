import json

import numpy as np

from pulsegrid.operators import reports
from pulsegrid.sources import files


def test_saved_arrays_are_read_by_ranges(spark, tmp_path):
    video = np.random.default_rng(1).integers(0, 256, (25, 4, 6, 3), dtype=np.uint8)
    np.save(tmp_path / "v.npy", video)
    df = files.read_frames(spark, str(tmp_path / "v.npy"), framesPerPartition=10)
    assert df.rdd.getNumPartitions() == 3
    rows = df.orderBy("frame_idx").collect()
    assert [r["frame_idx"] for r in rows] == list(range(25))
    assert (np.frombuffer(rows[7]["pixels"], np.uint8).reshape(4, 6, 3) == video[7][..., ::-1]).all()
    assert files.replayed(df, "2020-01-01", 30.0).agg({"ts": "max"}).first()[0].microsecond == 800000


def test_logs_of_runs(spark, tmp_path):
    for name, text in (("2", "timestamp,fps\n1,10\n2,NaN\n3,20\n"), ("10", "timestamp,fps\n"), ("x", "timestamp,fps\n1,7\n")):
        (tmp_path / name).mkdir()
        (tmp_path / name / "fps.csv").write_text(text)
    logs = files.read_run_logs(spark, str(tmp_path))
    means = reports.mean_rates(logs, "folder", "fps")
    assert [tuple(r) for r in reports.numeric_order(means, "folder").collect()] == [("2", 15.0), ("x", 7.0)]
    best = reports.rate_extremes(means, "folder").first()
    assert (best["max_folder"], best["min_folder"], best["mean_fps"]) == ("2", "x", 11.0)


def test_nothing_is_written_for_no_rows(spark, tmp_path):
    df = spark.createDataFrame([(1.0, 2)], "timestamp double, face_id long")
    assert not files.write_if_any(df.limit(0), str(tmp_path / "a")) and not (tmp_path / "a").exists()
    assert files.write_if_any(df, str(tmp_path / "b"))
    files.write_by_run(df, str(tmp_path / "c"), "face_id")
    assert spark.read.parquet(str(tmp_path / "c")).first()["face_id"] == 2


def test_configuration_and_catalogue(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"POST_PROCESS": [{"OutputNMSThreshold": 0.6, "OutputConfThreshold": None, "AnchorConfig": {"Steps": [8]}}]}, indent=1))
    row = files.read_config(spark, str(tmp_path / "c.json")).first()
    assert (row["nms_threshold"], row["score_threshold"]) == (0.6, 0.5)
    assert files.subjects(spark).count() == 42


def test_means_without_numbers_and_rows_without_a_region(spark):
    rates = spark.createDataFrame([("a", 1.0), ("a", float("nan")), ("a", None), ("b", float("nan")), ("10", 2.0)], "folder string, fps double")
    assert {r["folder"]: r["average_fps"] for r in reports.mean_rates(rates, "folder", "fps").collect()} == {"a": 1.0, "b": 0.0, "10": 2.0}
    tracks = spark.createDataFrame([(1, 0), (1, 1), (2, 0)], "face_id long, det long")
    regions, values = spark.createDataFrame([(1, 0, 5)], "face_id long, det long, rx1 int"), spark.createDataFrame([(2, 60.0)], "face_id long, v double")
    got = reports.displayed(tracks, regions, values, ["face_id", "det"], ["face_id"]).select("face_id", "det", "rx1", "v")
    assert sorted(map(str, map(tuple, got.collect()))) == ["(1, 0, 5, None)", "(1, 1, None, None)", "(2, 0, None, 60.0)"]


def test_any_colour_is_one_of_the_fixed(spark):
    from pyspark.sql import functions as F

    from pulsegrid.functions import scalar

    fixed = {tuple(r[0]) for r in spark.range(15).select(scalar.track_colour(F.col("id"))).collect()}
    assert len(fixed) == 15
    got = spark.range(50).select(scalar.any_colour(1).alias("c")).collect()
    assert {tuple(r["c"]) for r in got} <= fixed


def test_all_logs_of_a_run(spark, tmp_path):
    import pytest

    fps = spark.createDataFrame([(1.0, 30.0)], "timestamp double, fps double")
    rates = spark.createDataFrame([], "timestamp double, face_id long, heart_rate double")
    metrics = spark.createDataFrame([(9 - k, m, float(9 - k)) for k, m in enumerate(reversed(reports.METRICS))], "ord int, metric string, value double")
    files.write_logs(str(tmp_path), fps, rates, metrics)
    assert not (tmp_path / "heart_rate.csv").exists() and (tmp_path / "fps.csv").exists()
    (part,) = (tmp_path / "processing_metrics.csv").glob("part-*.csv")
    lines = part.read_text().split()
    assert lines[0] == "Metric,Value" and part.read_text().splitlines()[7] == "Skipped Frames,6.0"
    back = files.read_metrics(spark, str(tmp_path / "processing_metrics.csv")).orderBy("ord").collect()
    assert [r["metric"] for r in back] == list(reports.METRICS) and [r["value"] for r in back] == [float(k) for k in range(10)]
    files.write_metrics(metrics.where("ord != 6"), str(tmp_path / "less"))
    with pytest.raises(Exception, match="not a metrics report"):
        files.read_metrics(spark, str(tmp_path / "less")).collect()


def test_summary_is_one_ordered_file(spark, tmp_path):
    means = spark.createDataFrame([(str(k), float(k)) for k in (10, 9, 100, 2)] + [("b", 1.5), ("a", None)], "folder string, average_fps double").repartition(4)
    files.write_fps_summary(means, f"{tmp_path}/summary.csv")
    parts = list(tmp_path.glob("summary.csv/*.csv"))
    assert len(parts) == 1
    assert parts[0].read_text().split() == ["folder,average_fps", "2,2.0", "9,9.0", "10,10.0", "100,100.0", 'a,""' if '""' in parts[0].read_text() else "a,", "b,1.5"]


def test_statistics_by_step(spark, tmp_path):
    rows = [(k, max(0, 30 * k - 150), 30 * k + 30, k > 0, *[k + x / 8 for x in range(6)]) for k in (11, 2, 0, 1)]
    stats = spark.createDataFrame(rows, "step long, start_idx long, end_idx long, ready boolean, gt_mean double, gt_std double, gt_diff_std double, sums_mean double, sums_std double, diff_std double").repartition(3)
    path = files.write_step_stats(stats, str(tmp_path), "video_07")
    (part,) = tmp_path.glob("video_07_preprocess_stats_rolling_step30_windowsize180.csv/*.csv")
    lines = part.read_text().splitlines()
    assert path.endswith("video_07_preprocess_stats_rolling_step30_windowsize180.csv") and lines[0].split(",") == list(files.STEP_STATS)
    assert [x.split(",")[0] for x in lines[1:]] == ["0", "1", "2", "11"]
    assert lines[1] == "0,0,30,0.0,0.125,0.25,ERROR,ERROR,ERROR" and lines[4] == "11,180,360,11.0,11.125,11.25,11.375,11.5,11.625"
