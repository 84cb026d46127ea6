"""The incremental stream against the batch operators, over several triggers, with expiry by timers."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsegrid.operators import windows
from pulsegrid.streaming import chunks, heart_rate

SCHEMA = "face_id long, order long, ts timestamp, v double"


def stream_of(spark, folder, parts):
    for rows in parts:
        spark.createDataFrame([(f, i, t, v) for f, i, t, v in rows], "face_id long, order long, sec double, v double").select("face_id", "order", F.timestamp_micros((F.col("sec") * 1e6).cast("long") + 10**15).alias("ts"), "v").coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)


def samples(n, faces=(1, 2), seed=4):
    rng = np.random.default_rng(seed)
    return [(f, i, i / 30, float(rng.integers(1, 100))) for i in range(n) for f in faces]


def closed(spark, rows, size):
    """What the batch operators say: standardised chunks of the rows."""
    df = spark.createDataFrame([(f, i, v) for f, i, _, v in rows], "face_id long, pos long, v double")
    out = windows.standardised_chunks(df, "face_id", "v", size, chunks.chunk_size(size)).collect()
    got = {}
    for r in sorted(out, key=lambda r: r["pos"]):
        std, diff = got.setdefault((r["face_id"], r["chunk_id"]), ([], []))
        std.append(r["std_value"])
        diff.append(r["diff_value"])
    return got


@pytest.mark.parametrize("cuts", [[0, 250], [0, 1, 40, 95, 96, 250], [0, 30, 31, 60, 61, 62, 250]])
def test_chunks_over_triggers_equal_the_batch(spark, tmp_path, cuts):
    rows = samples(250)
    parts = [[r for r in rows if a <= r[1] < b] for a, b in zip(cuts, cuts[1:], strict=False)]
    out = heart_rate.run_to_end(chunks.chunk_rates(stream_of(spark, f"{tmp_path}/in", parts), "face_id", "v", "ts", size=60, step=60)).collect()
    want = closed(spark, rows, 60)
    assert {(r["face_id"], r["chunk_id"]) for r in out} == set(want) and len(out) == len(want) == 48
    for r in out:
        std, diff = want[r["face_id"], r["chunk_id"]]
        assert np.allclose(r["std"], std, atol=1e-9) and np.allclose(r["diff"], diff, atol=1e-7)
        assert r["fresh"] == (r["chunk_id"] % 6 == 5) and (r["heart_rate"] is None) == (r["chunk_id"] < 5)
    plain = heart_rate.run_to_end(heart_rate.window_rates(stream_of(spark, f"{tmp_path}/in", []), "face_id", "v", 60))
    rated = {(r["face_id"], r["chunk_id"] // 6): r["heart_rate"] for r in out if r["fresh"]}
    assert rated == {(r["face_id"], r["win_id"]): r["heart_rate"] for r in plain.collect()}
    held = {(r["face_id"], r["chunk_id"]): r["heart_rate"] for r in out}
    for (f, c), v in held.items():
        assert v == (rated[f, (c - 5) // 6] if c >= 5 else None)


def test_a_face_expires_after_its_last_rate(spark, tmp_path):
    """Face 1 has a rate and then pauses; face 2 never has one; face 3 moves the watermark on."""
    first = [(1, i, i / 30, float(i % 7 + 1)) for i in range(70)] + [(2, i, i / 30, 1.0 + i % 3) for i in range(40)]
    later = [[(3, k, 20.0 * k, 1.0)] for k in range(1, 5)]
    again = [[(1, 70 + i, 90 + i / 30, float(i % 5 + 1)) for i in range(25)] + [(2, 40 + i, 90 + i / 30, 2.0 + i % 3) for i in range(25)]]
    stream = chunks.chunk_rates(stream_of(spark, f"{tmp_path}/in", [first, *later, *again]), "face_id", "v", "ts", size=60, step=60)
    query = stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    got = spark.read.schema(stream.schema).parquet(f"{tmp_path}/out")
    ids = lambda f: sorted(r["chunk_id"] for r in got.where(f"face_id = {f}").collect())
    assert ids(1) == sorted([0, 1, 2, 3, 4, 5, 0, 1])  # counts from nought again
    assert ids(2) == [0, 1, 2, 3, 4, 5]  # goes on
    left = chunks.state_of(spark, f"{tmp_path}/state", "progress").select("key.*", "value.*").collect()
    assert {(r["key"], r["n"]) for r in left} == {(1, 25), (2, 65), (3, 4)}


def test_rates_move_the_expiry_on(spark, tmp_path):
    parts = [[(1, i, i / 3, float(i % 7 + 1)) for i in range(k, k + 61)] for k in range(0, 610, 61)]  # a rate every 20 s
    stream = chunks.chunk_rates(stream_of(spark, f"{tmp_path}/in", parts), "face_id", "v", "ts", size=60, step=60)
    out = heart_rate.run_to_end(stream)
    assert sorted(r["chunk_id"] for r in out.collect()) == list(range(60))


def test_a_signal_of_the_users(spark, tmp_path):
    rows = samples(130, faces=(5,))
    stream = chunks.chunk_rates(stream_of(spark, f"{tmp_path}/in", [rows]), "face_id", "v", "ts", size=60, step=30, signal=lambda std, diff, values: std + diff)
    out = {r["chunk_id"]: r for r in heart_rate.run_to_end(stream).collect()}
    assert [c for c in sorted(out) if out[c]["fresh"]] == [5, 8, 11]
    pulse = np.concatenate([np.array(out[c]["std"]) + np.array(out[c]["diff"]) for c in range(6)])
    spectrum = np.abs(np.fft.rfft(pulse, 64)) ** 2
    k = np.arange(33)
    band = k[(k * 30 / 64 >= 0.75) & (k * 30 / 64 <= 2.5)]
    assert out[5]["heart_rate"] == pytest.approx(band[spectrum[band].argmax()] * 30 / 64 * 60)


def test_modes(spark, tmp_path):
    stream = stream_of(spark, f"{tmp_path}/in", [samples(130)])
    a, b = (sorted(map(tuple, heart_rate.run_to_end(chunks.rates(stream, "face_id", "v", mode, size=60, step=60)).collect())) for mode in ("windows", "chunks"))
    assert a == b and len(a) == 4
    with pytest.raises(ValueError):
        chunks.rates(stream, "face_id", "v", "neither")
    assert chunks.mode_of("green", None) == "windows" and chunks.mode_of("green", True) == "chunks" and chunks.mode_of("net", False, ["net"]) == "chunks"
