"""The rate at a frame's own time, batch and stream."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsegrid.operators import reports
from pulsegrid.streaming import display

FRAMES, RATES = "face_id long, ts timestamp, n long", "face_id long, ts timestamp, id long, rate double"


def timed(spark, rows, schema):
    names = [c.split()[0] for c in schema.split(", ")]
    plain = schema.replace("ts timestamp", "sec long")
    return spark.createDataFrame(rows, plain).withColumn("ts", F.timestamp_micros(F.col("sec") * 1_000_000 + 10**15)).select(*names)


def data(seed=1, n=300):
    rng = np.random.default_rng(seed)
    frames = [(int(f) if f else None, int(t), i) for i, (f, t) in enumerate(zip(rng.integers(0, 4, n), rng.integers(0, 200, n), strict=True))]
    rates = [(int(f) if f else None, int(t), i, None if i % 9 == 0 else float(i)) for i, (f, t) in enumerate(zip(rng.integers(0, 5, 60), rng.integers(20, 200, 60), strict=True))]
    return frames, rates


def brute(frames, rates):
    out = []
    for f, t, n in frames:
        known = [(rt, i, v) for rf, rt, i, v in rates if rf == f and rt <= t]
        out.append((n, max(known, key=lambda r: r[:2])[2] if known else None))
    return sorted(out)


@pytest.mark.parametrize("seconds", [None, 30, 1])
def test_batch(spark, seconds):
    frames, rates = data()
    coarse = None if seconds is None else F.floor(F.unix_seconds("ts") / seconds)
    out = reports.as_of(timed(spark, frames, FRAMES), timed(spark, rates, RATES), "face_id", "rate", "ts", "id", coarse)
    assert out.columns == ["face_id", "ts", "n", "rate"]
    assert sorted((r["n"], r["rate"]) for r in out.collect()) == brute(frames, rates)


def test_no_rates_and_no_frames(spark):
    frames, rates = data()
    f, r = timed(spark, frames, FRAMES), timed(spark, rates, RATES)
    assert reports.as_of(f, r.where("false"), "face_id", "rate", "ts", "id").where("rate is not null").count() == 0
    assert reports.as_of(f.where("false"), r, "face_id", "rate", "ts", "id").count() == 0


def written(spark, df, folder, cuts):
    """df in files by ranges of seconds, one to a trigger."""
    sec = F.unix_seconds("ts") - 10**9
    for a, b in zip(cuts, cuts[1:], strict=False):
        df.where((sec >= a) & (sec < b)).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(folder)


def test_stream_equals_batch_over_triggers(spark, tmp_path):
    """Rates come up to 40 s after the frames that they belong to."""
    frames, rates = data(2)
    frames = [(f or 9, t, n) for f, t, n in frames] + [(9, 400, 999)]
    rates = [(f or 9, t, i, v) for f, t, i, v in rates]
    a = written(spark, timed(spark, frames, FRAMES), f"{tmp_path}/frames", [0, 40, 80, 120, 160, 200, 500])
    b = written(spark, timed(spark, rates, RATES), f"{tmp_path}/rates", [0, 20, 60, 100, 140, 180, 220])
    out = display.shown(a, b, "face_id", "rate", "ts", "id", late="60 seconds")
    query = out.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    got = sorted((r["n"], r["rate"]) for r in spark.read.schema(out.schema).parquet(f"{tmp_path}/out").collect())
    assert got == brute([f for f in frames if f[2] != 999], rates)  # the last one waits for its watermark


def test_table_of_latest_rates(spark, tmp_path):
    rates = [(1, 0, 0, 60.0), (2, 5, 1, 70.0), (1, 50, 2, 61.0)]
    stream = written(spark, timed(spark, rates, RATES), f"{tmp_path}/rates", [0, 20, 60])
    seen = []
    query = display.latest(stream, "face_id", "rate", "ts").writeStream.outputMode("update").foreachBatch(lambda df, _: seen.append(sorted((r["face_id"], r["rate"]) for r in df.collect()))).option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    assert [s for s in seen if s] == [[(1, 60.0), (2, 70.0)], [(1, 61.0)]]


def test_text(spark):
    rows = spark.createDataFrame([(3, 71.26), (4, None)], "id long, rate double")
    assert [r[0] for r in rows.select(reports.shown_text(F.col("id"), F.col("rate"))).collect()] == ["3 | 71.3", "4 | --"]


@pytest.mark.parametrize("groups", [1, 3])
def test_faces_that_share_a_state(spark, tmp_path, groups):
    """A group of faces gives what each would by itself; a face's frame that comes late and is earlier than what waits is let go in its time."""
    frames, rates = data(3)
    frames = [(f or 9, t, n) for f, t, n in frames if t < 120 or f != 1] + [(1, 130, 1000)]
    rates = [(f or 9, t, i, v) for f, t, i, v in rates]
    a = written(spark, timed(spark, [*frames, (2, 250, 999)], FRAMES), f"{tmp_path}/frames", [120, 200, 260])
    timed(spark, frames, FRAMES).where("n != 999 and unix_seconds(ts) < 1000000120").coalesce(1).write.mode("append").parquet(f"{tmp_path}/frames")
    b = written(spark, timed(spark, rates, RATES), f"{tmp_path}/rates", [0, 100, 220])
    out = display.shown(a, b, "face_id", "rate", "ts", "id", late="300 seconds", groups=groups)
    end = written(spark, timed(spark, [(7, 600, 0)], FRAMES), f"{tmp_path}/frames", [500, 700])  # moves the watermark to 300
    assert end.isStreaming
    query = out.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    rows = spark.read.schema(out.schema).parquet(f"{tmp_path}/out").where("face_id != 7").collect()
    assert out.columns == ["face_id", "ts", "n", "rate"]
    assert sorted((r["n"], r["rate"]) for r in rows) == brute([*frames, (2, 250, 999)], rates)
