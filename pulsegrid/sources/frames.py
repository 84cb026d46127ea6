"""Saved arrays of frames as a stream with offsets, and as a sink: one array for each run.

The stream reads every array below a path.  An offset says for each array how many of its frames have been captured.
Without a pace a trigger takes what is there, at most `framesPerTrigger` of each array, and nothing is lost.  With
`fps` frames are captured by the clock; those of a trigger that exceed the queue (`queueFrames`) are shed,
and the last frame that was kept says how many went after it.  What is read between two offsets follows from the offsets
alone, so a restart from a checkpoint neither loses nor repeats a frame.

The sink's tasks write frames straight to their places in the array of their run; the header is written, and the array
gets its name, when all tasks are done.
"""

from __future__ import annotations

import glob
import os
import time
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceStreamReader, InputPartition, WriterCommitMessage

from ..operators.reports import as_metrics

STREAM = "video string, frame_idx long, ts timestamp, width int, height int, pixels binary, shed long"
HEADER = 128
#: Frames that wait at most, as in the surveyed capture loop.
QUEUE_FRAMES = 30


def local(path: str) -> str:
    """A path that tasks can open: local to all of them, or on a folder that they share."""
    scheme, found, rest = path.partition("://")
    if not found:
        return path.removeprefix("file:")
    if scheme != "file":
        raise ValueError(f"arrays are mapped from a file system, not from {scheme}://")
    return "/" + rest.lstrip("/")


@dataclass
class FrameRange(InputPartition):
    """Frames lo to hi of an array; `shed` more were lost after the last one."""

    path: str
    lo: int
    hi: int
    shed: int


class FrameStreamReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.path = local(options["path"])
        self.fps = float(options["fps"]) if "fps" in options else None
        self.limit = int(options["framesPerTrigger"]) if "framesPerTrigger" in options else None
        self.queue = int(options.get("queueFrames", QUEUE_FRAMES))
        self.part = int(options.get("framesPerPartition", 256))
        self.start = datetime.fromisoformat(options.get("start", "1970-01-01T00:00:00+00:00"))
        self.rate = float(options.get("frameRate", self.fps or 30.0))
        self.flip = str(options.get("flip", "true")).lower() == "true"
        self.at: dict[str, int] | None = None
        self.began: dict[str, float] = {}

    def arrays(self) -> list[str]:
        return sorted(glob.glob(os.path.join(self.path, "*.npy"))) if os.path.isdir(self.path) else sorted(glob.glob(self.path))

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        import numpy as np

        at = self.at if self.at is not None else self.initialOffset()
        new = dict(at)
        for path in self.arrays():
            done, total = at.get(path, 0), len(np.load(path, mmap_mode="r"))
            if self.fps:
                began = self.began.setdefault(path, time.time() - done / self.fps)  # after a restart the clock goes on from the last frame
                due = int((time.time() - began) * self.fps)
                new[path] = min(total, max(done, due))
            else:
                new[path] = min(total, done + self.limit) if self.limit else total
        self.at = new
        return new

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        if self.at is None:  # a restart plans the last batch again before it asks for more
            self.at = end
        out = []
        for path, hi in sorted(end.items()):
            lo = start.get(path, 0)
            kept = min(hi, lo + self.queue) if self.fps else hi
            for a in range(lo, kept, self.part):
                b = min(kept, a + self.part)
                out.append(FrameRange(path, a, b, hi - kept if b == kept else 0))
        return out

    def read(self, partition: FrameRange) -> Iterator[tuple]:
        import numpy as np

        frames, name = np.load(partition.path, mmap_mode="r"), os.path.basename(partition.path).removesuffix(".npy")
        for i in range(partition.lo, partition.hi):
            frame = np.ascontiguousarray(frames[i][..., ::-1] if self.flip else frames[i], dtype=np.uint8)
            ts = self.start + timedelta(microseconds=round(i * 1e6 / self.rate))
            yield name, i, ts, frame.shape[1], frame.shape[0], frame.tobytes(), partition.shed if i + 1 == partition.hi else 0


class FrameStream(DataSource):
    """spark.readStream.format("npy_frame_stream").load(path): arrays (frames, height, width, channels), channels reversed on load.

    Options: fps (paced, with a queue of queueFrames), framesPerTrigger, framesPerPartition, start and frameRate (event
    times), flip. An array may be longer at each trigger, and new arrays may come. With framesPerTrigger the trigger
    availableNow ends after one such step; the next run of the query goes on from there.
    """

    @classmethod
    def name(cls) -> str:
        return "npy_frame_stream"

    def schema(self) -> str:
        return STREAM

    def streamReader(self, schema) -> DataSourceStreamReader:
        return FrameStreamReader(self.options)


def read_frame_stream(spark: SparkSession, path: str, **options) -> DataFrame:
    spark.dataSource.register(FrameStream)
    return spark.readStream.format("npy_frame_stream").options(**options).load(path)


def capture_metrics(frames: DataFrame) -> DataFrame:
    """(video, ord, metric, value): frames that were processed and that were skipped, as rows of the metrics report."""
    totals = frames.groupBy("video").agg(F.count("*").alias("_n"), F.coalesce(F.sum("shed"), F.lit(0)).alias("_shed"))
    return as_metrics(totals, ["video"], {"Processing Count": "_n", "Skipped Frames": "_shed"})


@dataclass
class Written(WriterCommitMessage):
    """By run: shape of a frame, number of frames, the highest number."""

    runs: dict[str, tuple[tuple[int, int, int], int, int]]


def array_header(n: int, shape: tuple[int, int, int]) -> bytes:
    """The header of an array of bytes in version 1.0 of the format, padded to HEADER."""
    text = f"{{'descr': '|u1', 'fortran_order': False, 'shape': {(n, *shape)}, }}"
    size = HEADER - 10
    return b"\x93NUMPY\x01\x00" + size.to_bytes(2, "little") + text.ljust(size - 1).encode() + b"\n"


class FrameWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.folder, self.flip, self.overwrite = local(options["path"]), str(options.get("flip", "true")).lower() == "true", overwrite
        self.job = uuid.uuid4().hex

    def place(self, run: str) -> str:
        return os.path.join(self.folder, f"_{self.job}_{run}")

    def write(self, iterator) -> WriterCommitMessage:
        import numpy as np

        os.makedirs(self.folder, exist_ok=True)
        runs: dict[str, tuple[tuple[int, int, int], int, int]] = {}
        open_: dict[str, int] = {}
        try:
            for batch in iterator:
                columns = (batch.column(c).to_pylist() for c in ("run", "frame_idx", "height", "width"))
                for run, i, h, w, pixels in zip(*columns, batch.column("pixels"), strict=True):
                    data = np.frombuffer(pixels.as_buffer(), np.uint8).reshape(h, w, -1)
                    shape, n, top = runs.get(run, (data.shape, 0, -1))
                    if data.shape != shape:
                        raise ValueError(f"frames of run {run} differ in shape: {data.shape} and {shape}")
                    if run not in open_:
                        open_[run] = os.open(self.place(run), os.O_RDWR | os.O_CREAT)
                    os.pwrite(open_[run], np.ascontiguousarray(data[..., ::-1] if self.flip else data).tobytes(), HEADER + i * data.size)
                    runs[run] = (shape, n + 1, max(top, i))
        finally:
            for f in open_.values():
                os.close(f)
        return Written(runs)

    def commit(self, messages: list[Written | None]) -> None:
        runs: dict[str, tuple[tuple[int, int, int], int, int]] = {}
        for m in messages:
            for run, (shape, n, top) in (m.runs if m else {}).items():
                old = runs.get(run, (shape, 0, -1))
                if old[0] != shape:
                    raise ValueError(f"frames of run {run} differ in shape: {old[0]} and {shape}")
                runs[run] = (shape, old[1] + n, max(old[2], top))
        for run, (shape, n, top) in runs.items():
            if n != top + 1:
                raise ValueError(f"run {run} has {n} frames numbered up to {top}")
            if os.path.exists(self.named(run)) and not self.overwrite:
                raise FileExistsError(self.named(run))
        for run, (shape, n, _) in runs.items():
            with open(self.place(run), "r+b") as f:
                f.write(array_header(n, shape))
            os.replace(self.place(run), self.named(run))

    def named(self, run: str) -> str:
        return os.path.join(self.folder, f"{run}.npy")

    def abort(self, messages: list[Written | None]) -> None:
        for path in glob.glob(os.path.join(glob.escape(self.folder), f"_{self.job}_*")):
            os.remove(path)


class FrameArrays(DataSource):
    """df.write.format("npy_arrays").mode(..).save(folder): rows (run, frame_idx, height, width, pixels), one array run.npy for each run."""

    @classmethod
    def name(cls) -> str:
        return "npy_arrays"

    def schema(self) -> str:
        return "run string, frame_idx long, height int, width int, pixels binary"

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return FrameWriter(self.options, overwrite)


def write_regions(frames: DataFrame, folder: str, run: str = "run", order: Sequence[str] = ("frame_idx",), mode: str = "append", flip: bool = True) -> None:
    """Each run's regions in order, numbered from 0 without gaps, as one array; frames have height, width and pixels.

    All regions of a run have one shape. Nothing is left where a task fails; with `append` an array that is there already
    is an error, with `overwrite` it is replaced.
    """
    frames.sparkSession.dataSource.register(FrameArrays)
    at = F.row_number().over(Window.partitionBy(run).orderBy(*order)) - 1
    rows = frames.select(F.col(run).cast("string").alias("run"), at.cast("long").alias("frame_idx"), F.col("height").cast("int"), F.col("width").cast("int"), "pixels")
    rows.write.format("npy_arrays").mode(mode).option("flip", str(flip).lower()).save(folder)
