import numpy as np
from pyspark.sql import functions as F

from pulsegrid.operators import pulse, tracking, windows
from pulsegrid.streaming import heart_rate

SCHEMA = "face_id long, order long, v double"


def written(spark, tmp_path, rows, schema, parts):
    for k in range(parts):
        spark.createDataFrame(rows[k * len(rows) // parts : (k + 1) * len(rows) // parts], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


def test_stream_equals_batch(spark, tmp_path):
    rng = np.random.default_rng(4)
    rows = [(f, i, float(rng.integers(0, 100))) for i in range(75) for f in (1, 2)]
    got = heart_rate.run_to_end(heart_rate.window_rates(written(spark, tmp_path, rows, SCHEMA, 3), "face_id", "v", 32))
    batch = windows.tumbling(spark.createDataFrame(rows, SCHEMA).withColumn("pos", F.col("order")), "face_id", 32)
    want = pulse.spectral_rate(batch, ["face_id", "win_id"], "v", 32)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_tracker_stream_equals_batch(spark, tmp_path):
    rows = [(1, f, d, x, 0, x + 10, 10) for f in range(6) for d, x in enumerate(range(f, 200, 60))]
    schema = "video_id long, frame_idx long, det long, x1 int, y1 int, x2 int, y2 int"
    got = heart_rate.run_to_end(heart_rate.tracks(written(spark, tmp_path, rows, schema, 3), "video_id"))
    want = tracking.tracked(spark.createDataFrame(rows, schema), "video_id", "long")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_sliding_stream_equals_batch(spark, tmp_path):
    rng = np.random.default_rng(5)
    rows = [(f, i, float(rng.integers(0, 100))) for i in range(75) for f in (1, 2)]
    got = heart_rate.run_to_end(heart_rate.window_rates(written(spark, tmp_path, rows, SCHEMA, 3), "face_id", "v", 32, step=10))
    batch = windows.sliding(spark.createDataFrame(rows, SCHEMA).withColumn("pos", F.col("order")), "face_id", 32, 10)
    want = pulse.spectral_rate(batch, ["face_id", "win_id"], "v", 32)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


class Timer:
    """What update functions see of a key's state."""

    def __init__(self):
        self.value, self.exists, self.hasTimedOut, self.timeout = None, False, False, None

    get = property(lambda self: self.value)

    def update(self, value):
        self.value, self.exists = value, True

    def remove(self):
        self.value, self.exists = None, False

    def setTimeoutDuration(self, ms):
        self.timeout = ms


def test_idle_keys_lose_their_state(monkeypatch):
    import pandas as pd

    got = {}

    class Grouped:
        def groupBy(self, *_):
            return self

        def applyInPandasWithState(self, update, *_):
            got["update"], got["timeout"] = update, _[-1]

    heart_rate.window_rates(Grouped(), "face_id", "v", 32, idle_seconds=7)
    state = Timer()
    new = pd.DataFrame({"order": range(40), "v": np.arange(40.0)})
    assert len(pd.concat(list(got["update"]((1,), iter([new]), state)))) == 1
    assert state.timeout == 7000 and len(state.value[1]) == 8 and got["timeout"] == "ProcessingTimeTimeout"
    state.hasTimedOut = True
    assert list(got["update"]((1,), iter([]), state)) == [] and not state.exists


def test_rates_and_sessions_by_event_time(spark, tmp_path):
    rows = [(1, f"2020-01-01 00:00:0{s}") for s in (0, 0, 1, 3)] + [(1, "2020-01-01 00:05:00"), (2, "2020-01-01 00:00:02"), (2, "2020-01-01 00:09:00")]
    spark.createDataFrame(rows, "face_id long, ts string").withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema("face_id long, ts timestamp").parquet(str(tmp_path / "in"))
    base = 1577836800
    frames = {r["second"] - base: r["frames"] for r in heart_rate.run_to_end(heart_rate.frame_rates(stream())).collect()}
    assert {s: frames[s] for s in (0, 1, 2, 3, 300)} == {0: 2, 1: 1, 2: 1, 3: 1, 300: 1}
    spells = {(r["face_id"], r["start"] - base): r["frames"] for r in heart_rate.run_to_end(heart_rate.sessions(stream(), "face_id")).collect()}
    assert spells[1, 0] == 4 and spells[1, 300] == 1 and spells[2, 2] == 1
