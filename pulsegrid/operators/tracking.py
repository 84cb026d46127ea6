"""Tracking of several subjects through frames: a keyed state, stepped frame by frame.

One step is a plain function of (state, boxes); the batch operator folds it over each video's
frames as they come in order, the streaming one over what has arrived.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

BOX = ("x1", "y1", "x2", "y2")
#: Pairs of an object and a box in a frame from which on arrays are faster than plain numbers.
MANY = 64


@dataclass
class Tracks:
    """Live objects by id: box, centroid and for how many frames they are missing."""

    next_id: int = 0
    boxes: dict[int, tuple[int, int, int, int]] = field(default_factory=dict)
    missing: dict[int, int] = field(default_factory=dict)

    def add(self, box) -> None:
        self.boxes[self.next_id], self.missing[self.next_id] = tuple(int(v) for v in box), 0
        self.next_id += 1

    def age(self, ids, most: int) -> None:
        for i in list(ids):
            self.missing[i] += 1
            if self.missing[i] > most:
                del self.boxes[i], self.missing[i]


def centroids(boxes) -> np.ndarray:
    b = np.asarray(boxes, float).reshape(-1, 4)
    return np.trunc((b[:, :2] + b[:, 2:]) / 2)


def nearest_boxes(objects: list, boxes: list) -> tuple[list[int], list[float]]:
    """For each object the number of its nearest box, the first of equals, and how far it is."""
    if len(objects) * len(boxes) >= MANY:
        gap = centroids(objects)[:, None] - centroids(boxes)[None]
        dist = np.sqrt((gap**2).sum(2))
        return dist.argmin(1).tolist(), dist.min(1).tolist()
    centre = lambda b: (float(math.trunc((b[0] + b[2]) / 2)), float(math.trunc((b[1] + b[3]) / 2)))
    there, nearest, far = [centre(b) for b in boxes], [], []
    for x, y in map(centre, objects):
        dist = [math.sqrt((x - u) * (x - u) + (y - v) * (y - v)) for u, v in there]
        far.append(min(dist))
        nearest.append(dist.index(far[-1]))
    return nearest, far


def step(tracks: Tracks, boxes: list, most_missing: int = 50) -> Tracks:
    """The tracks after one more frame.

    Objects in order of the distance to their nearest box take it unless it is taken; there is no limit of
    distance. With at least as many objects as boxes the unmatched objects age, otherwise the unmatched
    boxes become objects. Missing objects keep their last box.
    """
    if not len(boxes):
        tracks.age(tracks.boxes, most_missing)
        return tracks
    if not tracks.boxes:
        for b in boxes:
            tracks.add(b)
        return tracks
    ids = list(tracks.boxes)
    nearest, far = nearest_boxes(list(tracks.boxes.values()), boxes)
    taken: set[int] = set()
    matched: set[int] = set()
    for r in sorted(range(len(ids)), key=far.__getitem__):
        c = nearest[r]
        if c not in taken:
            taken.add(c)
            matched.add(ids[r])
            tracks.boxes[ids[r]], tracks.missing[ids[r]] = tuple(int(v) for v in boxes[c]), 0
    if len(ids) >= len(boxes):
        tracks.age([i for i in ids if i not in matched], most_missing)
    else:
        for c in range(len(boxes)):
            if c not in taken:
                tracks.add(boxes[c])
    return tracks


OUT = "frame_idx long, object_id long, x1 int, y1 int, x2 int, y2 int, is_stale boolean"


def live(tracks: Tracks, frame: int) -> list[tuple]:
    return [(frame, i, *b, tracks.missing[i] > 0) for i, b in tracks.boxes.items()]


def fold(pdf: pd.DataFrame, tracks: Tracks, most_missing: int = 50) -> list[tuple]:
    """All live objects after each frame of one video; frames without boxes have a row with a null det."""
    rows = []
    for frame, part in pdf.sort_values(["frame_idx", "det"]).groupby("frame_idx"):
        tracks = step(tracks, part.dropna(subset=["det"])[list(BOX)].to_numpy().tolist(), most_missing)
        rows += live(tracks, int(frame))
    return rows


def tracked(detections: DataFrame, key: str, key_type: str, most_missing: int = 50, parts: int | None = None) -> DataFrame:
    """(key, frame_idx, object_id, box, is_stale) from (key, frame_idx, det, box): videos are independent, and dealt to `parts` tasks (as many as a shuffle has by default).

    Their few bytes are much work, so partitions are not put together by size. A task takes the frames of its videos one after the other and holds a batch of rows and one video's live objects, however long a
    video is. Rows without a frame's number are left out.
    """
    names = [c.split()[0] for c in OUT.split(", ")]
    rows = detections.where("frame_idx is not null").select(key, "frame_idx", "det", *BOX)
    ordered = rows.repartition(parts or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), key).sortWithinPartitions(key, "frame_idx", "det", *BOX)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        video = frame = boxes = kinds = None
        tracks = Tracks()

        def made(out: list[tuple]) -> pa.RecordBatch:
            columns = zip(*out, strict=True) if out else [()] * len(kinds)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=[key, *names])

        for batch in batches:
            kinds, out = [batch.schema.field(0).type, pa.int64(), pa.int64(), *[pa.int32()] * 4, pa.bool_()], []
            for k, f, det, *box in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if boxes is None or f != frame or k != video:
                    if boxes is not None:
                        out += [(video, *r) for r in live(step(tracks, boxes, most_missing), frame)]
                    if k != video:
                        tracks = Tracks()
                    video, frame, boxes = k, f, []
                if det is not None:
                    boxes.append(box)
            yield made(out)
        if boxes is not None:
            yield made([(video, *r) for r in live(step(tracks, boxes, most_missing), frame)])

    return ordered.mapInArrow(run, f"{key} {key_type}, {OUT}")
