"""What is shown beside a face: the rate that is known at the frame's own time, and a table of the latest rates.

Frames wait in the state of a face, or of a group of faces, until the watermark has passed their time, as a rate of an earlier time may still come; a
timer lets them go. So the rows don't depend on how frames and rates are cut into triggers, and equal those of
reports.as_of over everything.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .chunks import ROCKS


#: What came for a group of faces in one batch of rows: frames' faces, times and columns, rates' faces, times, ties and values.
KEPT = "whose array<string>, frames array<long>, payloads array<string>, rated array<string>, rates array<long>, ties array<long>, values array<double>"
#: Rows of an entry that is written again, at most.
ENTRY = 1 << 13


def entry(frames: list[tuple], rates: list[tuple]) -> tuple:
    """An entry of the state from rows (time, columns, face) and (time, tie, value, face)."""
    at, payload, whose = zip(*frames, strict=True) if frames else ((), (), ())
    when, tie, value, rated = zip(*rates, strict=True) if rates else ((), (), (), ())
    return tuple(map(list, (whose, at, payload, rated, when, tie, value)))


class LastKnown(StatefulProcessor):
    """A batch of rows is one entry of the state, and a state is of a group of faces, as a call to the state takes longer than many rows do.

    There is a timer as long as frames wait, at the time of the first of them.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getListState("kept", KEPT)
        self.timer = handle.getValueState("timer", "at long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = []
        for part in rows:
            is_frame = part["is_frame"].to_numpy(bool)
            take = lambda of, *names: [part[c].to_numpy()[of].tolist() for c in names]  # noqa: E731, B023
            frames = list(zip(*take(is_frame, "at", "payload", "face"), strict=True))
            rates = [(a, t, None if pd.isna(v) else float(v), f) for a, t, v, f in zip(*take(~is_frame, "at", "tie", "value", "face"), strict=True)]
            self.kept.appendValue(entry(frames, rates))
            first += [min(f[0] for f in frames)] if frames else []
        if first:
            at, due = min(first) // 1000, self.timer.get()[0] if self.timer.exists() else None
            if due is None or at < due:
                if due is not None:
                    self.handle.deleteTimer(due)
                self._wait(at)
        return iter(())

    def _wait(self, at: int) -> None:
        self.handle.registerTimer(at)  # in milliseconds, frames are in microseconds
        self.timer.update((at,))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000 + 999
        kept = list(self.kept.get())
        frames = sorted((f for r in kept for f in zip(r[1], r[2], r[0], strict=True)), key=lambda f: f[:2])
        rates = sorted((q for r in kept for q in zip(r[4], r[5], r[6], r[3], strict=True)), key=lambda q: q[:2])
        out, k, last = [], 0, {}
        for at, payload, face in frames:
            if at > passed:
                break
            while k < len(rates) and rates[k][0] <= at:
                last[rates[k][3]] = rates[k]
                k += 1
            out.append((payload, last[face][2] if face in last else None))
        left, rates = frames[len(out) :], [*last.values(), *rates[k:]]  # a face's earlier rates are needed by none
        if left or rates:
            self.kept.put([entry(left[i : i + ENTRY], rates[i : i + ENTRY]) for i in range(0, max(len(left), len(rates)), ENTRY)])
        else:
            self.kept.clear()
        if left:
            self._wait(left[0][0] // 1000)
        else:
            self.timer.clear()
        if out:
            yield pd.DataFrame(out, columns=["payload", "value"]).astype({"value": "float64"})


def shown(frames: DataFrame, rates: DataFrame, key: str, value: str, ts: str, tie: str, late: str = "10 seconds", groups: int | None = None) -> DataFrame:
    """Each row of the stream `frames` with the value of the last row of the stream `rates` that isn't later than it; of rates of one time the one with the highest tie.

    Both streams may be late by `late`. The columns of frames, and value. Faces are put in so many `groups` that share a state, by default each is one;
    a group's waiting rows are in one task's memory when frames are let go.
    """
    frames.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    kind = F.struct(*frames.columns)
    no = F.lit(None)
    of = (F.pmod(F.xxhash64(key), F.lit(groups)) if groups else F.col(key)).alias("key")
    own = [of, F.col(key).cast("string").alias("face"), F.col(ts).cast("timestamp").alias("time"), micros.alias("at")]
    a = frames.select(*own, F.lit(True).alias("is_frame"), F.to_json(kind).alias("payload"), F.lit(0).cast("long").alias("tie"), no.cast("double").alias("value"))
    b = rates.select(*own, F.lit(False).alias("is_frame"), no.cast("string").alias("payload"), F.col(tie).cast("long").alias("tie"), F.col(value).cast("double").alias("value"))
    rows = a.unionByName(b).withWatermark("time", late)
    known = rows.groupBy("key").transformWithStateInPandas(LastKnown(), "payload string, value double", "Append", "EventTime")
    return known.select(F.from_json("payload", frames.select(kind.alias("r")).schema["r"].dataType).alias("r"), F.col("value").alias(value)).select("r.*", value)


def latest(stream: DataFrame, key: str, value: str, ts: str) -> DataFrame:
    """The last value of each key, for output mode `update`: a trigger gives the keys that changed."""
    return stream.groupBy(key).agg(F.max_by(value, ts).alias(value), F.max(ts).alias(ts))
