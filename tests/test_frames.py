"""Saved arrays as a stream with offsets, and as a sink."""

import glob
import os
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsegrid.operators import reports
from pulsegrid.sources import files, frames


def saved(folder, name, n, seed=0):
    a = np.random.default_rng(seed).integers(0, 256, (n, 4, 6, 3)).astype(np.uint8)
    np.save(f"{folder}/{name}.npy", a)
    return a


def run(stream, out, state, stop_after=None):
    """Runs a stream into Parquet until all is taken, or until so many batches are done."""
    q = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(processingTime="0 seconds" if stop_after is None else "2 seconds").start()
    try:
        if stop_after is None:
            q.processAllAvailable()
        else:
            end = time.time() + 60
            while time.time() < end and (not q.lastProgress or q.lastProgress["batchId"] < stop_after):
                time.sleep(0.05)
    finally:
        q.stop()


def test_restart_loses_and_repeats_nothing(spark, tmp_path):
    want = {"a": saved(tmp_path, "a", 50), "b": saved(tmp_path, "b", 23, 1)}
    out, state = f"{tmp_path}/out", f"{tmp_path}/state"
    stream = lambda: frames.read_frame_stream(spark, str(tmp_path), framesPerTrigger="7", framesPerPartition="3", frameRate="10")
    run(stream(), out, state, stop_after=1)
    first = spark.read.parquet(out).count()
    assert 0 < first < 73
    run(stream(), out, state)
    rows = spark.read.parquet(out).orderBy("video", "frame_idx").collect()
    assert [(r["video"], r["frame_idx"]) for r in rows] == [(v, i) for v in "ab" for i in range(len(want[v]))]
    for r in rows:
        assert (np.frombuffer(r["pixels"], np.uint8).reshape(4, 6, 3)[..., ::-1] == want[r["video"]][r["frame_idx"]]).all()
        assert r["shed"] == 0 and r["ts"].timestamp() == pytest.approx(r["frame_idx"] / 10)
    saved(tmp_path, "c", 5, 2)  # an array that comes later
    run(stream(), out, state)
    assert spark.read.parquet(out).where("video = 'c'").count() == 5 and spark.read.parquet(out).count() == 78


def test_frames_beyond_the_queue_are_shed_and_counted(spark, tmp_path):
    """Nothing is read while the clock runs, so a batch has more frames than the queue holds."""
    saved(tmp_path, "a", 400)
    reader = frames.FrameStreamReader({"path": f"{tmp_path}/a.npy", "fps": "1000", "queueFrames": "30", "framesPerPartition": "20"})
    start = reader.initialOffset()
    reader.latestOffset()
    time.sleep(0.15)
    end = reader.latestOffset()
    captured = end[f"{tmp_path}/a.npy"]
    parts = reader.partitions(start, end)
    assert captured > 100 and [(p.lo, p.hi) for p in parts] == [(0, 20), (20, 30)] and [p.shed for p in parts] == [0, captured - 30]
    assert parts == reader.partitions(start, end)
    rows = [r for p in parts for r in reader.read(p)]
    assert len(rows) == 30 and sum(r[-1] for r in rows) == captured - 30


def test_shed_frames_reach_the_metrics(spark, tmp_path):
    saved(tmp_path, "fast", 300)
    out = f"{tmp_path}/out"
    stream = frames.read_frame_stream(spark, f"{tmp_path}/fast.npy", fps="400", queueFrames="5")
    q = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{tmp_path}/state").trigger(processingTime="0 seconds").start()
    end = time.time() + 60
    while time.time() < end:
        got = spark.read.schema(stream.schema).parquet(out).agg(F.count("*"), F.sum("shed")).first() if os.path.exists(out) else (0, 0)
        if got[0] + (got[1] or 0) == 300:
            break
        time.sleep(0.3)
    q.stop()
    n, shed = got
    assert n + shed == 300 and shed > 0
    metrics = frames.capture_metrics(spark.read.parquet(out))
    assert {(r["metric"], r["value"]) for r in metrics.collect()} == {("Processing Count", n), ("Skipped Frames", shed)}
    assert reports.complete_runs(metrics, ["video"]).count() == 0


def test_regions_are_read_as_they_were_written(spark, tmp_path):
    rng = np.random.default_rng(3)
    clips = {"x": rng.integers(0, 256, (40, 3, 5, 3)).astype(np.uint8), "y": rng.integers(0, 256, (7, 2, 2, 3)).astype(np.uint8)}
    rows = [(run, 100 + 2 * i, f.shape[0], f.shape[1], bytearray(f.tobytes())) for run, clip in clips.items() for i, f in enumerate(clip)]
    df = spark.createDataFrame(rows, "run string, frame_idx long, height int, width int, pixels binary").repartition(6)
    folder = f"{tmp_path}/rois"
    frames.write_regions(df, folder)
    for name, clip in clips.items():
        assert (np.load(f"{folder}/{name}.npy")[..., ::-1] == clip).all()
        got = files.read_frames(spark, f"{folder}/{name}.npy").orderBy("frame_idx").collect()
        assert [bytes(r["pixels"]) for r in got] == [f.tobytes() for f in clip]
    with pytest.raises(Exception, match="x.npy|y.npy"):
        frames.write_regions(df, folder)
    frames.write_regions(df, folder, mode="overwrite", flip=False)
    assert (np.load(f"{folder}/x.npy") == clips["x"]).all()
    assert sorted(os.listdir(folder)) == ["x.npy", "y.npy"]


def test_a_failed_task_leaves_nothing(spark, tmp_path):
    rows = [("x", i, 2, 2, bytearray(12 if i != 30 else 24)) for i in range(60)]
    df = spark.createDataFrame(rows, "run string, frame_idx long, height int, width int, pixels binary")
    folder = f"{tmp_path}/rois"
    with pytest.raises(Exception, match="differ in shape"):
        frames.write_regions(df, folder)
    assert glob.glob(f"{folder}/*") == []


def test_other_stores_are_refused():
    with pytest.raises(ValueError, match="hdfs"):
        frames.local("hdfs://host/x.npy")
    assert frames.local("file:///a/b.npy") == frames.local("file:/a/b.npy") == "/a/b.npy"
