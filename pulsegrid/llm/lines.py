"""Line dedup behind two Bloom filters.

1. Each chunk digests the keys of its lines and puts them into two Bloom filters: keys that one of its
   documents has (once-seen) and keys that several have (twice-seen). What it sends to a shard of the
   filters are the positions that it sets there.
2. Each shard merges: a bit is twice-seen where a chunk says so or where two chunks have it once-seen. So the
   merged twice-seen filter holds every key that two documents share; the answer to a chunk is that filter at
   the chunk's own positions.
3. Only keys whose positions all are twice-seen are suspected. Each chunk gives one row for each such key: in how many of
   its documents, and the largest id of these. They are summed and joined back by key, as plain tables, so that
   a line which every chunk has is summed in two steps and split in the join.
4. Each chunk drops the lines whose keys are confirmed, but for those of the document to keep.

A key is a line without blanks at both ends and with A-Z in lower case; keys are the same where all 128 bits of their
digests are. The filters grow with the text (see `SHARD_BYTES`) and are never in one place.

Defined results: null and empty texts are one empty line, which stays, as do all short lines; a key counts once for each row that has it, however
often, so repeated rows are documents of their own; rows that share the largest id all keep the line; rows without an id come
first, so they keep a line only where no row with an id has it; the length of a text or a line has no bound; an empty
table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels as K
from .chunks import MESSAGE, Chunked, message, split_by_shard
from .common import settled, stored, table

LEAST_POINTS, LEAST_DOCS = 40, 5
#: Bits of each filter of a shard, positions of a key, and the bytes of text that share a shard: at 40 bytes to a line at most three bits in ten are set.
BITS, HASHES, SHARD_BYTES = 1 << 24, 3, 64 << 20
U = K.U
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def lines(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all lines without their \\n, and for each text the index of its first line (with one more at the end)."""
    breaks = np.flatnonzero(data == 10)
    before = np.searchsorted(breaks, at)  # breaks ahead of each text
    first = before + np.arange(len(at))
    starts, ends = np.zeros(first[-1], np.int64), np.zeros(first[-1], np.int64)
    starts[first[:-1]] = at[:-1]
    ends[first[1:] - 1] = at[1:]
    place = np.arange(len(breaks)) + np.searchsorted(at[1:], breaks, side="right")
    ends[place] = breaks
    starts[place + 1] = breaks + 1
    return starts, ends, first


def keyed(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which lines have a key of `least` code points or more, and two digests of each of these keys."""
    full = np.flatnonzero(~K.separators("space")[data])
    a, b = np.searchsorted(full, starts), np.searchsorted(full, ends)
    some = np.flatnonzero(b > a)
    s, e = full[a[some]], full[b[some] - 1] + 1
    points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    long = points[e] - points[s] >= least
    return some[long], *K.digests(_LOWER[data], s[long], e[long])


class Keys:
    """The distinct keys of a chunk: their digests, in how many rows each is, and the largest id of these."""

    def __init__(self, docs: pa.Table, least: int):
        h, g, row = [np.zeros(0, U)], [np.zeros(0, U)], [np.zeros(0, np.int64)]
        for lo, _, data, at in K.blocks(docs["text"].combine_chunks()):
            starts, ends, first = lines(data, at)
            line, x, y = keyed(data, starts, ends, least)
            h.append(x)
            g.append(y)
            row.append(lo + np.searchsorted(first, line, side="right") - 1)
        h, g, row = np.concatenate(h), np.concatenate(g), np.concatenate(row)
        by = np.lexsort((row, g, h))
        h, g, row = h[by], g[by], row[by]
        new = K.fresh(h, g)
        each = np.flatnonzero(new | (np.diff(row, prepend=-1) != 0))  # a row counts once
        key = np.flatnonzero(new[each])
        some, ids = docs["doc_id"].is_valid().to_numpy(), docs["doc_id"].fill_null(np.iinfo(np.int64).min).to_numpy()
        at = row[each]
        self.h, self.g = h[each][key], g[each][key]
        self.rows = np.diff(np.concatenate([key, [len(each)]]))
        self.last = np.maximum.reduceat(ids[at], key) if len(key) else np.zeros(0, np.int64)
        self.has_id = np.maximum.reduceat(some[at], key) if len(key) else np.zeros(0, bool)

    def positions(self, s: slice, bits: int) -> np.ndarray:
        """(keys x HASHES) positions in filters of so many bits."""
        step = self.g[s] | U(1)
        return np.stack([((self.h[s] + U(k) * step) & U(bits - 1)).astype(np.int64) for k in range(HASHES)], 1)


def packed_bits(at: np.ndarray) -> bytes:
    """Sorted positions as gaps in planes of bytes, which shuffles compress."""
    return np.uint32(len(at)).tobytes() + np.diff(at, prepend=0).astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def unpacked_bits(data: bytes) -> tuple[np.ndarray, bytes]:
    """Positions, and what follows."""
    n = int(np.frombuffer(data[:4], np.uint32)[0])
    gaps = np.frombuffer(data[4 : 4 + 4 * n], np.uint8).reshape(4, n).T.copy().view("<u4")[:, 0]
    return np.cumsum(gaps, dtype=np.int64), data[4 + 4 * n :]


def filters_sent(chunked: Chunked, least: int, n_shards: int, bits: int) -> DataFrame:
    """Step 1. A message: the positions set in the once-seen filter, then those in the twice-seen one."""

    def f(docs: pa.Table) -> pa.Table:
        keys, chunk = Keys(docs, least), docs["chunk"][0].as_py()
        parts = []
        for shard, s in split_by_shard(keys.h, n_shards):
            at = keys.positions(s, bits)
            parts.append((chunk, shard, packed_bits(np.unique(at)) + packed_bits(np.unique(at[keys.rows[s] > 1]))))
        return message(parts)

    return chunked.each(f, MESSAGE)


def merged(sent: DataFrame, bits: int) -> DataFrame:
    """Step 2. The answer: the merged twice-seen filter at a message's once-seen positions, a bit for each."""

    def f(parts: pa.Table) -> pa.Table:
        once, twice, own = np.zeros(bits, bool), np.zeros(bits, bool), []
        for blob in parts["data"]:
            a, rest = unpacked_bits(blob.as_py())
            twice[a[once[a]]] = True
            once[a] = True
            twice[unpacked_bits(rest)[0]] = True
            own.append(a)
        return pa.table({"chunk": parts["chunk"], "shard": parts["shard"], "data": pa.array([np.packbits(twice[a]).tobytes() for a in own], pa.binary())})

    return sent.groupBy("shard").applyInArrow(f, MESSAGE)


KEYS = "chunk int, h long, g long, rows long, last long"


def suspects(chunked: Chunked, answers: DataFrame, least: int, n_shards: int, bits: int) -> DataFrame:
    """Step 3, a chunk's part: its keys whose positions all are twice-seen."""

    def f(docs: pa.Table, answers: pa.Table) -> pa.Table:
        out = {"h": [np.zeros(0, U)], "g": [np.zeros(0, U)], "rows": [np.zeros(0, np.int64)], "last": [np.zeros(0, np.int64)], "has_id": [np.zeros(0, bool)]}
        if docs.num_rows:
            keys = Keys(docs, least)
            by_shard = dict(zip(answers["shard"].to_pylist(), answers["data"], strict=True))
            for shard, s in split_by_shard(keys.h, n_shards):
                at = keys.positions(s, bits)
                set_ = np.unique(at)
                twice = np.unpackbits(np.frombuffer(by_shard[shard].as_buffer(), np.uint8))[: len(set_)].astype(bool)
                hit = twice[np.searchsorted(set_, at)].all(1)
                for name, parts in out.items():
                    parts.append(getattr(keys, name)[s][hit])
        h, g, rows, last, has_id = (np.concatenate(p) for p in out.values())
        chunk = docs["chunk"][0].as_py() if docs.num_rows else 0
        return pa.table({"chunk": pa.array(np.full(len(h), chunk), pa.int32()), "h": h.view(np.int64), "g": g.view(np.int64), "rows": rows, "last": pa.array(last, mask=~has_id)})

    return chunked.with_answers(answers, f, KEYS)


def confirmed(found: DataFrame, docs: int) -> DataFrame:
    """Step 3, over all chunks: (chunk, h, g, last) of the keys that `docs` rows or more have."""
    whole = found.groupBy("h", "g").agg(F.sum("rows").alias("_n"), F.max("last").alias("_keep")).where(F.col("_n") >= docs)
    whole = stored(whole.select(F.col("h").alias("_h"), F.col("g").alias("_g"), "_keep"))  # a plain join follows, which Spark can split where many chunks have a key
    return found.join(whole, (found["h"] == whole["_h"]) & (found["g"] == whole["_g"])).select("chunk", "h", "g", F.col("_keep").alias("last"))


RESULT = "doc_id long, n_lines long, n_dropped long, kept_sha256 string"


def dedup(docs: DataFrame, least: int = LEAST_POINTS, least_docs: int = LEAST_DOCS, with_text: bool = False, bits: int = BITS) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept_sha256) of each row; with_text adds the kept lines, joined, as `text`.

    Keys of `least` code points that `least_docs` rows have stay in the largest doc_id that has them only. `bits` is the size of a shard's filters.
    """
    return settled(lambda: _deduped(docs, least, least_docs, with_text, bits))


def _deduped(docs: DataFrame, least: int, least_docs: int, with_text: bool, bits: int) -> DataFrame:
    chunked = Chunked(docs)
    n_shards = chunked.n_shards(SHARD_BYTES)
    answers = merged(filters_sent(chunked, least, n_shards, bits), bits)
    drops = confirmed(stored(suspects(chunked, answers, least, n_shards, bits)), least_docs)

    def f(docs: pa.Table, answers: pa.Table) -> pa.Table:
        known = [answers[c].to_numpy().view(U) for c in ("h", "g")]
        by = np.lexsort((known[1], known[0]))
        known_h, known_g = known[0][by], known[1][by]
        keep_some = answers["last"].is_valid().to_numpy()[by]
        keep = answers["last"].fill_null(0).to_numpy()[by]
        some, ids = docs["doc_id"].is_valid().to_numpy(), docs["doc_id"].fill_null(0).to_numpy()
        n_lines, n_dropped, digest, texts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [], []
        for lo, hi, data, at in K.blocks(docs["text"].combine_chunks()):
            starts, ends, first = lines(data, at)
            gone = np.zeros(len(starts), bool)
            line, h, g = keyed(data, starts, ends, least)
            place = found_at(known_h, known_g, h, g)
            line, place = line[place >= 0], place[place >= 0]
            row = lo + np.searchsorted(first, line, side="right") - 1
            gone[line] = (some[row] != keep_some[place]) | (ids[row] != keep[place])
            dropped = np.diff(np.concatenate([[0], np.cumsum(gone)])[first])
            n_lines.append(np.diff(first))
            n_dropped.append(dropped)
            blob = data.tobytes()
            for i in range(hi - lo):
                kept = blob[at[i] : at[i + 1]]
                if dropped[i]:
                    own = np.arange(first[i], first[i + 1])[~gone[first[i] : first[i + 1]]]
                    kept = b"\n".join([blob[starts[k] : ends[k]] for k in own])
                digest.append(hashlib.sha256(kept).hexdigest())
                if with_text:
                    texts.append(kept.decode("utf-8", "replace"))
        out = {"doc_id": docs["doc_id"], "n_lines": pa.array(np.concatenate(n_lines), pa.int64()), "n_dropped": pa.array(np.concatenate(n_dropped), pa.int64()), "kept_sha256": pa.array(digest, pa.string())}
        return pa.table(out | ({"text": pa.array(texts, pa.string())} if with_text else {}))

    return chunked.with_answers(drops, f, RESULT + (", text string" if with_text else ""))


def found_at(known_h: np.ndarray, known_g: np.ndarray, h: np.ndarray, g: np.ndarray) -> np.ndarray:
    """Where each 128-bit value stands among ordered distinct ones, -1 where it doesn't."""
    out = np.full(len(h), -1, np.int64)
    if not len(known_h):
        return out
    at, left = np.searchsorted(known_h, h), np.arange(len(h))
    while len(left):  # values that share their first half stand in a row
        near = np.minimum(at[left], len(known_h) - 1)
        same = (at[left] < len(known_h)) & (known_h[near] == h[left])
        left, near = left[same], near[same]
        hit = known_g[near] == g[left]
        out[left[hit]] = near[hit]
        left = left[~hit]
        at[left] += 1
    return out


def op11_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents"))
