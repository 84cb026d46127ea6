"""Document fingerprints: a digest of improbable features.

A feature is a window of 64 bytes.  Its entropy, in `BINS` steps, has a rank: the rarer the step
among all windows of the corpus, the more improbable the feature, the lower the rank.  Each run
of 64 successive windows votes for its lowest rank (the leftmost of ties); windows with at
least `VOTES` votes are selected.  They enter a chain of Bloom filters of 2048 bits, five bits
each, `FILTER_FEATURES` to a filter, in order of their first occurrence.

The likeness of two digests is the mean, over the filters of the one with fewer filters, of the
best match among the other's: the bits in common beyond those expected by chance, as a part of
the most possible.

Entropies are sums of integers, so a window's step doesn't depend on what stands around it, and
equal texts have equal fingerprints.

Defined results: null and empty texts have the empty fingerprint, alike (1) to itself and unlike
(0) to others; a text without a selectable window has one feature, the whole text; repeated ids
are ordered by text; rows without an id come last; of a single row the next document is itself; the
length of a text has no bound; an empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels as K
from .chunks import CHUNK_BYTES, chunk_of, cut_points
from .common import partitions, table

SIZE, BINS, VOTES, FILTER_FEATURES, FILTER_BITS, HASHES = 64, 1000, 16, 128, 2048, 5
#: Windows under half a bit of entropy (runs of one byte and the like) are no features.
LEAST_ENTROPY = 0.5
_F = np.concatenate([[0], np.round(np.arange(1, SIZE + 1) * np.log2(np.arange(1, SIZE + 1)) * (1 << 20)).astype(np.int64)])
_G = np.diff(_F)
_U = K.U


def padded(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts with gaps of a window between them; where each begins; and which positions start a whole window."""
    length = np.diff(at)
    begin = at[:-1] + SIZE * np.arange(len(length))
    out = np.zeros(len(data) + SIZE * (len(length) + 1), np.uint8)
    place = np.arange(len(data)) + np.repeat(SIZE * np.arange(len(length)), length)
    out[place] = data
    delta = np.zeros(len(out) + 1, np.int64)
    full = np.flatnonzero(length >= SIZE)
    delta[begin[full]] = 1
    delta[begin[full] + length[full] - SIZE + 1] -= 1
    return out, begin, np.cumsum(delta)[:-1] > 0


def entropy_steps(x: np.ndarray) -> np.ndarray:
    """The step of the window that starts at each position (the last ones have none: 0).

    Sliding by one byte adds one to a count and takes one from another; both counts are the numbers
    of equal bytes among the 63 neighbours, gathered by 63 shifted comparisons.
    """
    n = len(x)
    before, after = np.zeros(n, np.uint8), np.zeros(n, np.uint8)
    tile = 1 << 16  # stays in cache
    for lo in range(0, n, tile):
        hi = min(n, lo + tile)
        for d in range(1, SIZE):
            if hi - d <= 0:
                break
            a = max(lo, d)
            before[a:hi] += (x[a:hi] == x[a - d : hi - d]).view(np.uint8)
            b = min(hi, n - d)
            if b > lo:
                after[lo:b] += (x[lo:b] == x[lo + d : b + d]).view(np.uint8)
    total = np.zeros(n, np.int64)
    if n >= SIZE:
        total[0] = _F[np.bincount(x[:SIZE], minlength=256)].sum()
        total[1 : n - SIZE + 1] = total[0] + np.cumsum(_G[before[SIZE:]] - _G[after[: n - SIZE]])
    return (BINS - 1 - total * (BINS - 1) // _F[SIZE]).astype(np.int32)


def rarity(docs: DataFrame) -> np.ndarray:
    """Rank of each entropy step by its count over all windows of all texts, the rarest first."""

    def run(batches):
        for batch in batches:
            total = np.zeros(BINS, np.int64)
            for _, _, data, at in K.blocks(batch.column("text"), 1 << 20):
                x, _, valid = padded(data, at)
                total += np.bincount(entropy_steps(x)[valid], minlength=BINS)
            step = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(step, pa.int32()), pa.array(total[step])], names=["step", "n"])

    counts = np.zeros(BINS, np.int64)
    for r in docs.select("text").mapInArrow(run, "step int, n long").groupBy("step").agg(F.sum("n").alias("n")).collect():
        counts[r["step"]] = r["n"]
    rank = np.empty(BINS, np.int64)
    rank[np.lexsort((np.arange(BINS), counts))] = np.arange(BINS)
    return rank


def selected(x: np.ndarray, valid: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the windows with enough votes, and all positions' votes."""
    step = entropy_steps(x)
    valid = valid & (step >= LEAST_ENTROPY / 6 * BINS)
    kind, shift = (np.uint32, 21) if len(x) < 1 << 21 else (np.uint64, 40)
    key = np.where(valid, (rank[step].astype(kind) << kind(shift)) | np.arange(len(x), dtype=kind), np.iinfo(kind).max)
    low = key.copy()
    for s in (1, 2, 4, 8, 16, 32):
        low[:-s] = np.minimum(low[:-s], low[s:])
    votes = np.bincount((low[valid] & kind((1 << shift) - 1)).astype(np.int64), minlength=len(x))
    return np.flatnonzero(votes >= VOTES), votes


def fingerprints(texts: list[bytes], rank: np.ndarray) -> list[tuple[str, np.ndarray]]:
    """The fingerprint of each text as a string and as its chain of filters (filters x 32 words)."""
    out: list[tuple[str, np.ndarray]] = []
    for _, _, data, at in K.blocks(pa.array(texts, pa.large_binary()), 1 << 20):
        x, begin, valid = padded(data, at)
        pick, votes = selected(x, valid, rank)
        owner = np.searchsorted(begin, pick, side="right") - 1
        bare = np.setdiff1d(np.arange(len(begin)), owner)
        for i in bare:
            v = votes[begin[i] : begin[i] + at[i + 1] - at[i]]
            if len(v) and v.max() > 0:
                pick = np.append(pick, begin[i] + v.argmax())
        pick.sort()
        owner = np.searchsorted(begin, pick, side="right") - 1
        view = np.lib.stride_tricks.sliding_window_view(x, SIZE)[pick].copy().view(_U).reshape(-1, SIZE // 8)
        h = np.zeros(len(pick), _U)
        for column in view.T:
            h = K.mix(h ^ column) * K.BASE
        h = K.mix(h)
        edge = np.searchsorted(owner, np.arange(len(begin) + 1))
        for i in range(len(begin)):
            own = h[edge[i] : edge[i + 1]]
            if not len(own) and at[i + 1] > at[i]:
                own = K.digests(data, at[i : i + 1], at[i + 1 : i + 2], 1)[0]
            own = own[np.sort(np.unique(own, return_index=True)[1])]
            out.append(_digest(own))
    return out


def _digest(features: np.ndarray) -> tuple[str, np.ndarray]:
    n = -(-len(features) // FILTER_FEATURES)
    bits = np.zeros((n, FILTER_BITS), bool)
    at = np.arange(len(features)) // FILTER_FEATURES
    for k in range(HASHES):
        bits[at, ((features >> _U(11 * k)) & _U(FILTER_BITS - 1)).astype(np.int64)] = True
    packed = np.packbits(bits, axis=1)
    return (f"{len(features)}:{base64.b64encode(packed.tobytes()).decode()}" if n else ""), packed.view(_U).reshape(n, FILTER_BITS // 64)


def likeness(a: tuple[str, np.ndarray], b: tuple[str, np.ndarray]) -> float:
    if a[0] == b[0]:
        return 1.0
    x, y = (a[1], b[1]) if len(a[1]) <= len(b[1]) else (b[1], a[1])
    if not len(x):
        return 0.0
    nx, ny = np.bitwise_count(x).sum(1, dtype=np.int64), np.bitwise_count(y).sum(1, dtype=np.int64)
    total = 0.0
    step = max(1, 100_000 // len(y))
    for lo in range(0, len(x), step):
        both = np.bitwise_count(x[lo : lo + step, None, :] & y[None]).sum(2, dtype=np.int64)
        chance = nx[lo : lo + step, None] * ny[None] / FILTER_BITS
        most = np.minimum(nx[lo : lo + step, None], ny[None]) - chance
        score = np.where(most > 0.5, (both - chance) / np.maximum(most, 0.5), 0.0)
        total += float((np.clip(score.max(1), 0, 1) * nx[lo : lo + step]).sum())
    return total / float(nx.sum())


RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def with_next(docs: DataFrame) -> DataFrame:
    """(chunk, ahead, doc_id, text): documents by ranges of the id, and in each range the document that follows it.

    Following by descending id, what comes after a range is the largest id of the next lower range
    that has any, and after the last range the largest id of all.
    """
    cuts, _ = cut_points(docs, CHUNK_BYTES)
    rows = docs.select(chunk_of(F.col("doc_id"), cuts).alias("chunk"), F.col("doc_id").cast("long"), "text")
    tops = {r["chunk"]: r["top"] for r in rows.groupBy("chunk").agg(F.max("doc_id").alias("top")).collect() if r["top"] is not None}
    if not tops:
        return rows.withColumn("ahead", F.lit(False))
    used = sorted(tops)
    top = F.lit(np.array([tops.get(c, min(tops.values()) - 1) for c in range(len(cuts) + 1)], np.int64))
    after = dict(zip(used, used[1:] + used[:1], strict=True))
    target = F.lit(np.array([after.get(c, 0) for c in range(len(cuts) + 1)], np.int32))
    first = F.get(top, F.col("chunk")) == F.col("doc_id")
    places = F.array(F.struct("chunk", F.lit(False).alias("ahead")), F.struct(F.when(first, F.get(target, F.col("chunk"))).alias("chunk"), F.lit(True).alias("ahead")))
    return rows.withColumn("at", F.explode(places)).where("at.chunk is not null").select("at.chunk", "at.ahead", "doc_id", "text")


def compare_with_edits(docs: DataFrame) -> DataFrame:
    """The digest of each text and of its edit, with their likeness; see op2's contract."""
    rank = rarity(docs)

    def f(group: pa.Table) -> pa.Table:
        group = group.sort_by([("doc_id", "descending"), ("text", "ascending")])
        ahead = group["ahead"].to_numpy()
        ids, texts = group["doc_id"].to_pylist(), [t or "" for t in group["text"].to_pylist()]
        own = np.flatnonzero(~ahead)
        rows = []
        if len(own):
            follow = [texts[i] for i in own[1:]] + [texts[np.flatnonzero(ahead)[0]] if ahead.any() else texts[own[0]]]
            edits = []
            for i, nxt in zip(own, follow, strict=True):
                half = len(texts[i]) // 2
                edits.append((texts[i][: len(texts[i]) - half] + nxt[:half]).encode())
            prints = fingerprints([texts[i].encode() for i in own] + [follow[-1].encode()], rank)
            edited = fingerprints(edits, rank)
            rows = [(ids[i], len(texts[i]), hashlib.sha256(edits[k]).hexdigest(), prints[k][0], edited[k][0], likeness(prints[k], edited[k]), likeness(prints[k], prints[k + 1])) for k, i in enumerate(own)]
        columns = list(zip(*rows, strict=True)) or [()] * 7
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        return pa.table({c.split()[0]: pa.array(v, t) for c, v, t in zip(RESULT.split(", "), columns, kinds, strict=True)})

    placed = with_next(docs)
    return placed.repartition(4 * partitions(docs.sparkSession), "chunk").groupBy("chunk").applyInArrow(f, RESULT)


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_with_edits(table(spark, sf_dir, "documents"))
