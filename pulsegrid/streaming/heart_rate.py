"""Streaming forms: tracks and heart rates with keyed state, rates of frames with watermarks."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import filters
from ..operators.tracking import OUT, Tracks, fold
from ..session import file_system, gone_at_the_end, shared_dir


def window_rates(stream: DataFrame, key: str, value: str, size: int, fps: float = 30.0, idle_seconds: int | None = None, step: int | None = None) -> DataFrame:
    """(key, win_id, bin, heart_rate) of the last `size` samples whenever a key has `step` more (`size` by default); what later windows need waits in the key's state.

    stream has the key (long), `order` (long) and the value. With idle_seconds, a key that is idle for longer loses its state.
    """
    bins, re, im = filters.rate_weights(size, fps)
    per_bin, move = fps / filters.next_power_of_2(size) * 60, step or size

    def update(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        done, waiting = state.get if state.exists else (0, [])
        new = pd.concat(list(parts)).sort_values("order")
        x = np.concatenate([np.array(waiting, float), new[value].to_numpy(float)])
        n = max(0, (len(x) - size) // move + 1)
        if n:
            w = np.lib.stride_tricks.sliding_window_view(x, size)[::move][:n]
            power = (w @ re.T) ** 2 + (w @ im.T) ** 2
            best = np.array(bins)[power.argmax(1)]
            yield pd.DataFrame({key: k[0], "win_id": done + np.arange(n), "bin": best, "heart_rate": best * per_bin})
        state.update((done + n, x[n * move :].tolist()))
        if idle_seconds:
            state.setTimeoutDuration(idle_seconds * 1000)

    return stream.groupBy(key).applyInPandasWithState(update, f"{key} long, win_id long, bin int, heart_rate double", "done long, waiting array<double>", "append", GroupStateTimeout.ProcessingTimeTimeout if idle_seconds else GroupStateTimeout.NoTimeout)


def tracks(stream: DataFrame, key: str, most_missing: int = 50) -> DataFrame:
    """All live objects after each new frame of a video; the tracker is the video's state."""
    names = [c.split()[0] for c in OUT.split(", ")]

    def update(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        tracker = Tracks()
        if state.exists:
            tracker.next_id, ids, boxes, missing = state.get
            flat = np.array(boxes, int).reshape(-1, 4)
            tracker.boxes = {int(i): tuple(int(v) for v in b) for i, b in zip(ids, flat, strict=True)}
            tracker.missing = {int(i): int(m) for i, m in zip(ids, missing, strict=True)}
        rows = fold(pd.concat(list(parts)), tracker, most_missing)
        ids = list(tracker.boxes)
        state.update((tracker.next_id, ids, [v for i in ids for v in tracker.boxes[i]], [tracker.missing[i] for i in ids]))
        out = pd.DataFrame(rows, columns=names)
        out.insert(0, key, k[0])
        yield out

    return stream.groupBy(key).applyInPandasWithState(update, f"{key} long, {OUT}", "next_id long, ids array<long>, boxes array<int>, missing array<int>", "append", GroupStateTimeout.NoTimeout)


def frame_rates(stream: DataFrame, ts: str = "ts", late: str = "10 seconds") -> DataFrame:
    """Frames by second of event time, late rows beyond the watermark dropped."""
    timed = stream.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", late)
    return timed.groupBy(F.window("_ts", "1 second")).agg(F.count("*").alias("frames")).select(F.unix_seconds("window.start").alias("second"), "frames")


def sessions(stream: DataFrame, key: str, gap: str = "30 seconds", ts: str = "ts", late: str = "10 seconds") -> DataFrame:
    """Spells of a key that no gap interrupts."""
    timed = stream.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", late)
    return timed.groupBy(key, F.session_window("_ts", gap)).agg(F.count("*").alias("frames")).select(key, F.unix_seconds("session_window.start").alias("start"), "frames")


def run_to_end(out: DataFrame) -> DataFrame:
    """Runs a stream over all there is, into files of the shared folder, and reads them; they go when the driver ends."""
    spark = out.sparkSession
    at = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    query = out.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).outputMode("append").start()
    query.awaitTermination()
    store, state = file_system(spark, f"{at}/state")
    store.delete(state, True)
    gone_at_the_end(spark, at)
    return spark.read.schema(out.schema).parquet(f"{at}/out")
