"""Substring dedup of word windows behind a count-min prefilter.

1. Each chunk hashes all its windows and sends its sketch: for each of two rows, the cells that
   its distinct windows hit, with saturated counts.
2. Each shard of the sketch adds up the chunks' parts and answers which cells reached two.  Counts
   are only ever too high, so a window with a cell below two in either row is truly single.
3. Each chunk sends the 128-bit keys of the windows that both rows estimate as repeated, with the rank
   of the first document that has them; a shard groups them exactly and answers, for each chunk,
   which of its keys a document of another chunk has before all of its own.
4. Each chunk removes the words under windows that start earlier elsewhere or in the chunk.

The sketch's width grows with the text (see `SHARD_BYTES`), and it is never in one place.  Windows
are the same where all 128 bits of their keys are, in chunks, shards and answers alike: words are
digested by eight bytes at a time, windows by pairs of words, with a scramble at every step.

Defined results: null and empty texts have no words and the digest of the empty string; a text
shorter than a window keeps all words; rows with the same id count as one after the other, by a
hash of id and text; rows without an id come first; the length of a text has no bound; an empty table
gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import kernels as K
from .chunks import MESSAGE, Chunked, in_order, message, ranks, split_by_shard
from .common import settled, table

WINDOW = 20
#: Cells in each row of a shard's sketch, and the bytes of text that share a shard: about six cells for a window.
CELLS, SHARD_BYTES = 1 << 24, 16 << 20
U = K.U


def windows(data: np.ndarray, at: np.ndarray, size: int) -> tuple:
    """Words of the texts, and of every window its first word and two independent hashes."""
    starts, ends, first = K.words(data, at)
    count = np.maximum(np.diff(first) - size + 1, 0)
    begin = np.repeat(first[:-1] - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
    keys = [K.run_hash(word, size, half)[begin] for half, word in enumerate(K.digests(data, starts, ends))]
    return starts, ends, first, begin, *keys


def distinct(texts: pa.ChunkedArray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct keys of a chunk's windows in two halves, how often each occurs, and the first row that has it."""
    a, b, rows = [np.zeros(0, U)], [np.zeros(0, U)], [np.zeros(0, np.int64)]
    for lo, _, data, at in K.blocks(texts.combine_chunks()):
        _, _, first, begin, h, g = windows(data, at, size)
        a.append(h)
        b.append(g)
        rows.append(lo + np.searchsorted(first, begin, side="right") - 1)
    h, g, row = np.concatenate(a), np.concatenate(b), np.concatenate(rows)
    order = K.order(h, g)
    h, g, row = h[order], g[order], row[order]
    new = np.flatnonzero(K.fresh(h, g))
    return h[new], g[new], np.diff(np.concatenate([new, [len(h)]])), row[new]


def cells(h: np.ndarray, g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (h & U(CELLS - 1)).astype(np.uint32), (g & U(CELLS - 1)).astype(np.uint32)


def sketch_rows(h: np.ndarray, g: np.ndarray, count: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For both rows: the cells hit, each once, and their counts, at most 2."""
    out = []
    for c in cells(h, g):
        order = np.argsort(c)
        c, n = c[order], np.minimum(count[order], 2)
        new = np.flatnonzero(np.concatenate([[True], c[1:] != c[:-1]])) if len(c) else np.zeros(0, int)
        out.append((c[new], np.minimum(np.add.reduceat(n, new), 2) if len(new) else n))
    return out


def dense(cells: np.ndarray, full: np.ndarray) -> bytes:
    """Sorted cells and one bit for each, in a form that shuffles compress: gaps, split into planes of bytes."""
    gaps = np.diff(cells, prepend=np.uint32(0)).astype("<u4")
    return np.uint32(len(cells)).tobytes() + gaps.view(np.uint8).reshape(-1, 4).T.tobytes() + np.packbits(full).tobytes()


def undense(data: bytes) -> tuple[np.ndarray, np.ndarray, bytes]:
    """Cells, bits, and what follows."""
    n = int(np.frombuffer(data[:4], np.uint32)[0])
    gaps = np.frombuffer(data[4 : 4 + 4 * n], np.uint8).reshape(4, n).T.copy().view("<u4")[:, 0]
    end = 4 + 4 * n + -(-n // 8)
    return np.cumsum(gaps, dtype=np.uint32), np.unpackbits(np.frombuffer(data[4 + 4 * n : end], np.uint8))[:n], data[end:]


def candidates_sketched(chunked: Chunked, size: int, n_shards: int) -> DataFrame:
    """Step 1. A message: for both rows the cells hit and which of them have a count of 2."""

    def f(docs: pa.Table) -> pa.Table:
        h, g, count, _ = distinct(docs["text"], size)
        parts, chunk = [], docs["chunk"][0].as_py()
        for shard, s in split_by_shard(h, n_shards):
            parts.append((chunk, shard, b"".join(dense(c, n == 2) for c, n in sketch_rows(h[s], g[s], count[s]))))
        return message(parts)

    return chunked.each(f, MESSAGE)


def merged(sketches: DataFrame) -> DataFrame:
    """Step 2. The answer: one bit for each cell of the message."""

    def f(parts: pa.Table) -> pa.Table:
        total = np.zeros((2, CELLS), np.uint8)
        sent = []
        for blob in parts["data"]:
            rest, own = blob.as_py(), []
            for row in (0, 1):
                c, more, rest = undense(rest)
                total[row, c] = np.minimum(total[row, c] + 1 + more, 2)
                own.append(c)
            sent.append(own)
        flags = [np.packbits(np.concatenate([total[row, c] for row, c in enumerate(own)]) > 1).tobytes() for own in sent]
        return pa.table({"chunk": parts["chunk"], "shard": parts["shard"], "data": pa.array(flags, pa.binary())})

    return sketches.groupBy("shard").applyInArrow(f, MESSAGE)


def candidates_sent(chunked: Chunked, flags: DataFrame, size: int, n_shards: int) -> DataFrame:
    """Step 3, a chunk's part: keys that both rows of the sketch estimate as repeated."""

    def f(docs: pa.Table, answers: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return message([])
        docs = in_order(docs)
        h, g, count, row = distinct(docs["text"], size)
        rank = ranks(docs)
        by_shard = dict(zip(answers["shard"].to_pylist(), answers["data"], strict=True))
        parts, chunk = [], docs["chunk"][0].as_py()
        for shard, s in split_by_shard(h, n_shards):
            (c0, _), (c1, _) = sketch_rows(h[s], g[s], count[s])
            bits = np.unpackbits(np.frombuffer(by_shard[shard].as_buffer(), np.uint8)).astype(bool)
            own0, own1 = cells(h[s], g[s])
            hit = bits[: len(c0)][np.searchsorted(c0, own0)] & bits[len(c0) : len(c0) + len(c1)][np.searchsorted(c1, own1)]
            if hit.any():
                some, ids, order = (r[row[s][hit]] for r in rank)
                parts.append((chunk, shard, b"".join(x.tobytes() for x in (h[s][hit], g[s][hit], ids, order, some))))
        return message(parts)

    return chunked.with_answers(flags, f, MESSAGE)


def seen_earlier(keys: DataFrame) -> DataFrame:
    """Step 3, a shard's part: the exact groups; the answer is a chunk's keys of which another chunk has an earlier one."""

    def f(parts: pa.Table) -> pa.Table:
        columns, where = [[] for _ in range(5)], []
        for k, blob in enumerate(parts["data"]):
            raw = np.frombuffer(blob.as_buffer(), np.uint8)
            n = len(raw) // 29
            for j, kind in enumerate((U, U, np.int64)):
                columns[j].append(raw[8 * n * j : 8 * n * (j + 1)].view(kind))
            columns[3].append(raw[24 * n : 28 * n].view(np.int32))
            columns[4].append(raw[28 * n :])
            where.append(np.full(n, k))
        h, g, ids, order, some = (np.concatenate(c) for c in columns)
        k, chunk = np.concatenate(where), parts["chunk"].to_numpy()
        by = np.lexsort((chunk[k], order, ids, some, g, h))
        late = np.flatnonzero(~K.fresh(h[by], g[by]))
        late = by[late][np.argsort(k[by[late]], kind="stable")]
        edge = np.searchsorted(k[late], np.arange(len(chunk) + 1))
        return message([(int(chunk[i]), 0, h[late[a:b]].tobytes() + g[late[a:b]].tobytes()) for i, (a, b) in enumerate(zip(edge[:-1], edge[1:], strict=True)) if b > a])

    return keys.groupBy("shard").applyInArrow(f, MESSAGE)


RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string"


def kept_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, keep: np.ndarray, first: np.ndarray) -> list[bytes]:
    """The kept words of each text, joined by one space."""
    s, e = starts[keep], ends[keep]
    length = e - s + 1
    out_at = np.concatenate([[0], np.cumsum(length)])
    index = np.arange(out_at[-1]) + np.repeat(s - out_at[:-1], length)
    out = data[np.minimum(index, max(len(data) - 1, 0))] if len(data) else np.zeros(0, np.uint8)
    out[out_at[1:] - 1] = 32
    kept_first = np.concatenate([[0], np.cumsum(keep)])[first]
    edge = out_at[kept_first]
    blob = out.tobytes()
    return [blob[a : max(a, b - 1)] for a, b in zip(edge[:-1], edge[1:], strict=True)]


def removed_words(begin: np.ndarray, late: np.ndarray, n_words: int, size: int) -> np.ndarray:
    """Marks the words under the windows that are late."""
    delta = np.zeros(n_words + 1, np.int64)
    np.add.at(delta, begin[late], 1)
    np.add.at(delta, np.minimum(begin[late] + size, n_words), -1)
    return np.cumsum(delta)[:-1] > 0


def dedup(docs: DataFrame, size: int = WINDOW, with_text: bool = False) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of each row; with_text adds the kept words as `text`."""
    return settled(lambda: _deduped(docs, size, with_text))


def _deduped(docs: DataFrame, size: int, with_text: bool) -> DataFrame:
    chunked = Chunked(docs)
    n_shards = chunked.n_shards(SHARD_BYTES)
    flags = merged(candidates_sketched(chunked, size, n_shards))
    late_keys = seen_earlier(candidates_sent(chunked, flags, size, n_shards))

    def f(docs: pa.Table, answers: pa.Table) -> pa.Table:
        docs = in_order(docs)
        earlier = [np.zeros(0, U)], [np.zeros(0, U)]
        for blob in answers["data"]:
            both = np.frombuffer(blob.as_buffer(), U).reshape(2, -1)
            earlier[0].append(both[0])
            earlier[1].append(both[1])
        work = [windows(data, at, size) + (data,) for _, _, data, at in K.blocks(docs["text"].combine_chunks())]
        h, g = (np.concatenate([np.zeros(0, U), *[w[k] for w in work]]) for k in (4, 5))
        order = K.order(h, g)
        again = np.zeros(len(h), bool)
        again[order] = ~K.fresh(h[order], g[order])
        again |= K.among(h, g, np.concatenate(earlier[0]), np.concatenate(earlier[1]))
        n_words, n_removed, digest, texts, done = [], [], [], [], 0
        for starts, ends, first, begin, _, _, data in work:
            gone = removed_words(begin, again[done : done + len(begin)], len(starts), size)
            done += len(begin)
            total = np.concatenate([[0], np.cumsum(gone)])[first]
            n_words.append(np.diff(first))
            n_removed.append(np.diff(total))
            kept = kept_words(data, starts, ends, ~gone, first)
            digest += [hashlib.sha256(t).hexdigest() for t in kept]
            texts += [t.decode("utf-8", "replace") for t in kept] if with_text else []
        none = [np.zeros(0, np.int64)]
        out = {"doc_id": docs["doc_id"], "n_words": pa.array(np.concatenate(none + n_words), pa.int64()), "n_removed": pa.array(np.concatenate(none + n_removed), pa.int64()), "kept_sha256": pa.array(digest, pa.string())}
        return pa.table(out | ({"text": pa.array(texts, pa.string())} if with_text else {}))

    return chunked.with_answers(late_keys, f, RESULT + (", text string" if with_text else ""))


def op4_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents"))
