"""The incremental stream: chunks of a face's samples, prepared as they close, and rates from the last full window of them.

A face has four state variables: how far it is and its last rate, the samples that rolling statistics cover, the
signals of the chunks since the last rate, and when it expires.  A timer of event time drops all four `idle_seconds`
after the last rate; a face that never had one stays, as in the surveyed processor.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions import filters
from . import heart_rate

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
TINY = 1e-7
Signal = Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]


def chunk_size(window: int) -> int:
    """Frames of a chunk: six chunks to a window, at most 30 frames, at least one."""
    return max(1, min(30, window // 6))


def changes(x: np.ndarray) -> np.ndarray:
    """Normalised change from each value to the next."""
    return (x[1:] - x[:-1]) / (x[1:] + x[:-1] + TINY)


def prepared(chunk: np.ndarray, after: np.ndarray, seen: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """A closed chunk against rolling statistics at closing time: standardised values, normalised differences.

    `after` is the chunk's last value and the one that closed it; `seen` are the last size + 1 values.
    """
    mean, spread = seen.mean(), seen.std() if len(seen) > 1 else 0.0
    moves = changes(seen)[-size:]
    move_spread = np.sqrt(max(TINY, moves.var())) if len(moves) > 1 else 1.0
    return (chunk - mean) / (spread + TINY), changes(np.concatenate([chunk, after[-1:]])) / move_spread


class Chunks(StatefulProcessor):
    def __init__(self, key: str, order: Sequence[str], size: int, step: int, fps: float, idle_seconds: float, signal: Signal | None):
        self.key, self.order, self.size, self.fps = key, list(order), size, fps
        self.chunk = chunk_size(size)
        self.per_window, self.move = size // self.chunk, step // self.chunk
        self.idle, self.signal = int(idle_seconds * 1000), signal
        bins, re, im = filters.rate_weights(self.per_window * self.chunk, fps)
        self.bins, self.re, self.im = np.array(bins), re, im
        self.per_bin = fps / filters.next_power_of_2(self.per_window * self.chunk) * 60

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.progress = handle.getValueState("progress", "n long, rate double")
        self.recent = handle.getValueState("recent", "v array<double>")
        self.signals = handle.getListState("signals", "v array<double>")
        self.expiry = handle.getValueState("expiry", "at long")

    def rate(self, signal: np.ndarray) -> float:
        power = (self.re @ signal) ** 2 + (self.im @ signal) ** 2
        return float(self.bins[power.argmax()] * self.per_bin)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows)).sort_values(self.order)
        n, rate = self.progress.get() if self.progress.exists() else (0, None)
        old = np.array(self.recent.get()[0], float) if self.recent.exists() else np.zeros(0)
        buffer = [np.array(s[0], float) for s in self.signals.get()] if self.signals.exists() else []
        x = np.concatenate([old, new["value"].to_numpy(float)])
        base, c, out, rated = n - len(old), self.chunk, [], None
        first = (max(n, 1) + c - 1) // c * c
        for closing in range(first, n + len(new), c):
            at = closing - base
            values = x[at - c : at]
            std, diff = prepared(values, x[at : at + 1], x[max(0, at - self.size) : at + 1], self.size)
            buffer.append(values if self.signal is None else np.asarray(self.signal(std, diff, values), float))
            fresh = len(buffer) == self.per_window
            if fresh:
                rate, rated = self.rate(np.concatenate(buffer)), closing - n
                del buffer[: self.move]
            out.append((closing // c - 1, std.tolist(), diff.tolist(), fresh, rate))
        self.progress.update((n + len(new), rate))
        self.recent.update((x[-(self.size + c) :].tolist(),))
        self.signals.put([(s.tolist(),) for s in buffer]) if buffer else self.signals.clear()
        if rated is not None:
            self._expires(int(new["ms"].iloc[rated]) + self.idle)
        if out:
            frame = pd.DataFrame(out, columns=["chunk_id", "std", "diff", "fresh", "heart_rate"]).astype({"chunk_id": "int64", "heart_rate": "float64"})
            frame.insert(0, self.key, key[0])
            yield frame

    def _expires(self, at: int) -> None:
        if self.expiry.exists():
            self.handle.deleteTimer(self.expiry.get()[0])
        self.handle.registerTimer(at)
        self.expiry.update((at,))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        for state in (self.progress, self.recent, self.signals, self.expiry):
            state.clear()
        return iter(())


def chunk_rates(stream: DataFrame, key: str, value: str, ts: str, order: Sequence[str] = ("order",), size: int = 180, step: int = 180, fps: float = 30.0, idle_seconds: float = 30.0, late: str = "10 seconds", signal: Signal | None = None) -> DataFrame:
    """(key, chunk_id, std, diff, fresh, heart_rate) of every chunk that closes.

    std and diff are the chunk's six-channel input by halves: values against the rolling mean and deviation of the last size + 1 samples,
    differences over the deviation of the last `size` of them. heart_rate is the last rate that was found, `fresh` marks the
    chunk that gave it. `signal` makes a chunk's pulse of (std, diff, values); without one the values are the pulse.
    The rows of a trigger are ordered by `order`; those of the next trigger come after them.
    """
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)  # several state variables need it
    ranks = [f"order{i}" for i in range(len(order))]
    rows = stream.select(F.col(key).alias("key"), F.col(value).alias("value"), *[F.col(c).alias(r) for c, r in zip(order, ranks, strict=True)], F.col(ts).cast("timestamp").alias("time")).withWatermark("time", late)
    kind = stream.schema[key].dataType.simpleString()
    schema = f"{key} {kind}, chunk_id long, std array<double>, diff array<double>, fresh boolean, heart_rate double"
    return rows.withColumn("ms", F.unix_millis("time")).groupBy("key").transformWithStateInPandas(Chunks(key, ranks, size, step, fps, idle_seconds, signal), schema, "Append", "EventTime")


def rates(stream: DataFrame, key: str, value: str, mode: str, ts: str = "ts", size: int = 180, step: int = 180, fps: float = 30.0) -> DataFrame:
    """(key, at, heart_rate) by the mode: `windows` of samples as they fill, or `chunks`, whose last window is rated; `at` counts samples of the end."""
    if mode == "windows":
        found = heart_rate.window_rates(stream, key, value, size, fps, step=step)
        return found.select(key, (F.col("win_id") * step + size).alias("at"), "heart_rate")
    if mode != "chunks":
        raise ValueError(f"no mode {mode}: windows or chunks")
    found = chunk_rates(stream, key, value, ts, size=size, step=step, fps=fps)
    return found.where("fresh").select(key, ((F.col("chunk_id") + 1) * chunk_size(size)).alias("at"), "heart_rate")


def mode_of(extractor: str, incremental: bool | None, deep: Sequence[str] = ()) -> str:
    """Chunks where they are asked for or the extractor is one of the deep ones, which can't do without."""
    return "chunks" if incremental or extractor in deep else "windows"


def state_of(spark: SparkSession, checkpoint: str, name: str) -> DataFrame:
    """One of the state variables as a table, from a stream's checkpoint."""
    return spark.read.format("statestore").option("path", checkpoint).option("stateVarName", name).load()
