"""Suffix-array dedup: bytes under strings of 200 bytes that start at more than one place.

Placing.  Every 200-byte window has an anchor: its 32-byte gram of least hash, the leftmost of
ties.  The windows of one anchor are neighbours, and the bytes they span are its segment.
Equal windows have equal anchors at equal offsets, so only segments of one anchor hash need to be
held against each other, and no window stands in two segments.
  1. Each chunk sends the 128-bit keys of its distinct segments to shards, which answer whether one
     repeats and which chunk is to show it; and its distinct anchors with the key of the segment (or that
     it has several), to shards that answer whether an anchor's segments differ anywhere.  Both are
     counted in the chunk first, so an anchor or a segment of all documents is one entry for a chunk.
     Of a segment whose anchor has no other nothing repeats in part: it repeats whole, or not at all.
  2. The chunks send the bytes of segments whose anchor has different ones, of repeated ones once.
Comparing.  Segments are gathered in blocks.  A block is sorted by suffixes to the depth of 200,
its Burrows-Wheeler transform taken, and intervals are expanded breadth first by backward extension: an
interval of depth d that ends where no common prefix is known yet gives the value d there, so
values come in increasing order and the search stops at 200.  Neighbouring suffixes still without
a value share 200 bytes or more; where both begin inside segments, the windows repeat.
  An anchor with more than `MOST` differing segments (the brink of a passage that many texts
share) is halved by the windows' offsets, each half keyed by the very bytes that all its windows
have in common, until the parts are small, or single windows, which are equal where those bytes are.
  3. The answers go back to the chunks, which remove what the windows cover.

Defined results: null and empty texts keep nothing and have the digest of the empty string; a text
under 200 bytes keeps all; repeated rows repeat each other and are removed whole; the length of a text
has no bound; an empty table gives no rows; other columns are ignored, whatever their names.
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

WIDTH, GRAM = 200, 32
#: Text that shares a shard, bytes of segments that share a block, and segments of one key compared in one block.
SHARD_BYTES, BLOCK_BYTES, MOST = 64 << 20, 2 << 20, 2000
#: Text scanned at once; the arrays stay in cache.
SCAN = 1 << 18
U = K.U
SINGLE, WHOLE, ASK, SHOW = 0, 1, 2, 3


def segments(data: np.ndarray, at: np.ndarray, width: int) -> tuple[np.ndarray, ...]:
    """Start and end byte of each segment, its anchor's offset in it, the anchor's hash, and two halves of a key of segment and offset."""
    none = np.zeros(0, np.int64)
    n = len(data)
    if n < width:
        return none, none, none, *[none.astype(U)] * 3
    lanes = np.lib.stride_tricks.sliding_window_view(data, 8)[: n - GRAM + 1 + 24].view(U)[:, 0] if n >= GRAM else none.astype(U)
    grams = n - GRAM + 1
    h = np.zeros(grams, U)
    for k in range(GRAM // 8):
        h = (h ^ lanes[8 * k : 8 * k + grams]) * K.BASE
        h ^= h >> U(29)
    h = K.mix(h)
    shift = U(max(1, int(grams).bit_length()))
    low = ((h >> shift) << shift) | np.arange(grams, dtype=U)
    span, done = width - GRAM + 1, 1
    while done < span:  # least key of `span` grams from each place on
        step = min(done, span - done)
        low = np.minimum(low[: len(low) - step], low[step:])
        done += step
    anchor = (low & ((U(1) << shift) - U(1))).astype(np.int64)
    ok = np.zeros(len(anchor) + 1, np.int64)
    whole = np.diff(at) >= width
    np.add.at(ok, at[:-1][whole], 1)
    np.add.at(ok, at[1:][whole] - width + 1, -1)
    valid = np.cumsum(ok)[:-1] > 0
    new = valid.copy()
    new[1:] &= ~valid[:-1] | (anchor[1:] != anchor[:-1])
    new[at[:-1][whole]] = True
    starts = np.flatnonzero(new)
    stop = valid.copy()
    stop[:-1] &= ~valid[1:] | new[1:]
    ends = np.flatnonzero(stop) + width
    at_anchor = anchor[starts]
    offset = at_anchor - starts
    x, y = K.digests(data, starts, ends)
    return starts, ends, offset, K.mix(h[at_anchor] ^ U(0xA0761D6478BD642F)), K.mix(x + offset.astype(U)), y  # a least hash lies near 0; shards are cut by value


def all_segments(texts: pa.ChunkedArray, width: int) -> list[tuple]:
    return [(data, at, *segments(data, at, width)) for _, _, data, at in K.blocks(texts.combine_chunks(), SCAN)]


class Keyed:
    """A chunk's distinct segments and distinct anchors, each in the order in which they are sent.

    x, y, twice: a segment's key and whether the chunk has it more than once; place: one place of it; number: the segment
    at each place.  anchors, sole: an anchor's hash and one of its segments; many: whether it has several; anchor: each segment's.
    """

    def __init__(self, work: list[tuple]):
        a, x, y = (np.concatenate([np.zeros(0, U), *[w[k] for w in work]]) for k in (5, 6, 7))
        order = K.order(x, y)
        new = K.fresh(x[order], y[order])
        self.number = np.empty(len(a), np.int64)
        self.number[order] = np.cumsum(new) - 1
        first = np.flatnonzero(new)
        self.place = order[first]
        self.x, self.y = x[self.place], y[self.place]
        self.twice = np.diff(np.concatenate([first, [len(order)]])) > 1
        self.anchors, self.sole, self.anchor, count = np.unique(a[self.place], return_index=True, return_inverse=True, return_counts=True)
        self.many = count > 1


def keys_sent(chunked: Chunked, width: int, n_shards: int) -> DataFrame:
    """Messages of segments to the shards from 0 on, of anchors to those from n_shards on."""

    def f(docs: pa.Table) -> pa.Table:
        k, chunk = Keyed(all_segments(docs["text"], width)), docs["chunk"][0].as_py()
        parts = [(chunk, s, k.x[at].tobytes() + k.y[at].tobytes() + k.twice[at].tobytes()) for s, at in split_by_shard(k.x, n_shards)]
        parts += [(chunk, n_shards + s, b"".join(v[at].tobytes() for v in (k.anchors, k.x[k.sole], k.y[k.sole], k.many))) for s, at in split_by_shard(k.anchors, n_shards)]
        return message(parts)

    return chunked.each(f, MESSAGE)


def unpacked(parts: pa.Table, halves: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Columns of all messages (64-bit ones, and one of bytes), and the message of each row."""
    out, where = [[] for _ in range(halves + 1)], []
    for k, blob in enumerate(parts["data"]):
        raw = np.frombuffer(blob.as_buffer(), np.uint8)
        n = len(raw) // (8 * halves + 1)
        for j in range(halves):
            out[j].append(raw[8 * n * j : 8 * n * (j + 1)].view(U))
        out[halves].append(raw[8 * n * halves :])
        where.append(np.full(n, k))
    return [np.concatenate(c) for c in out], np.concatenate(where)


def judged(keys: DataFrame, n_shards: int) -> DataFrame:
    """A byte for each key of each chunk, in the order sent: of segments 0, 1 (repeats) or 2 (repeats and is to be shown by this chunk), of anchors 1 where segments differ."""

    def segments_of(parts: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        (x, y, twice), part = unpacked(parts, 2)
        order = np.lexsort((parts["chunk"].to_numpy()[part], y, x))
        new = K.fresh(x[order], y[order])
        group = np.cumsum(new) - 1
        repeats = (np.bincount(group) > 1) | (np.bincount(group, twice[order]) > 0)
        back = np.empty(len(x), np.uint8)
        back[order] = repeats[group] * (1 + new)
        return back, part

    def anchors_of(parts: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        (a, x, y, many), part = unpacked(parts, 3)
        order = np.argsort(a, kind="stable")
        a, x, y = a[order], x[order], y[order]
        new = np.ones(len(a), bool)
        new[1:] = a[1:] != a[:-1]
        group = np.cumsum(new) - 1
        other = ~new & K.fresh(x, y)
        back = np.empty(len(a), np.uint8)
        back[order] = (np.bincount(group, other | (many[order] > 0)) > 0)[group]
        return back, part

    def f(parts: pa.Table) -> pa.Table:
        shard = parts["shard"][0].as_py()
        back, part = (segments_of if shard < n_shards else anchors_of)(parts)
        edge = np.concatenate([[0], np.cumsum(np.bincount(part, minlength=parts.num_rows))])
        return message([(c, shard, back[edge[k] : edge[k + 1]].tobytes()) for k, c in enumerate(parts["chunk"].to_pylist())])

    return keys.groupBy("shard").applyInArrow(f, MESSAGE)


def codes_of(k: Keyed, answers: pa.Table, n_shards: int) -> np.ndarray:
    """SINGLE, WHOLE, ASK or SHOW for each distinct segment of the chunk."""
    rows = sorted(zip(answers["shard"].to_pylist(), answers["data"].to_pylist(), strict=True))
    repeats, mixed = (np.concatenate([np.zeros(0, np.uint8), *[np.frombuffer(b, np.uint8) for s, b in rows if (s >= n_shards) == up]]) for up in (False, True))
    mixed = mixed[k.anchor] > 0
    return np.where(repeats > 0, np.where(mixed & (repeats == 2), SHOW, WHOLE), np.where(mixed, ASK, SINGLE)).astype(np.uint8)


SHOWN = "chunk int, anchor long, segment int, offset int, repeats boolean, data binary"


def shown(chunked: Chunked, answers: DataFrame, width: int, n_shards: int) -> DataFrame:
    """The bytes of segments to compare; a segment goes by its number in the chunk."""

    def f(docs: pa.Table, answers: pa.Table) -> pa.Table:
        work = all_segments(docs["text"], width) if docs.num_rows else []
        k = Keyed(work)
        code = codes_of(k, answers, n_shards)
        ask = np.flatnonzero(code >= ASK)
        start = np.concatenate([[0], np.cumsum([len(w[2]) for w in work])]).astype(np.int64)
        block = np.searchsorted(start, k.place[ask], side="right") - 1
        local = k.place[ask] - start[block]
        bodies = [work[b][0][work[b][2][i] : work[b][3][i]].tobytes() for b, i in zip(block, local, strict=True)]
        offset = [int(work[b][4][i]) for b, i in zip(block, local, strict=True)]
        chunk = docs["chunk"][0].as_py() if docs.num_rows else 0
        return pa.table({"chunk": pa.array([chunk] * len(ask), pa.int32()), "anchor": pa.array(k.anchors[k.anchor[ask]].view(np.int64)), "segment": pa.array(ask, pa.int32()), "offset": pa.array(offset, pa.int32()), "repeats": pa.array(code[ask] == SHOW), "data": pa.array(bodies, pa.binary())})

    return chunked.with_answers(answers, f, SHOWN)


def suffix_order(s: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes of symbols (at most 511) in order of their first `depth` symbols at least: by seven symbols, then by doubling."""
    n = len(s)
    wide = np.concatenate([s, np.zeros(7, s.dtype)]).astype(np.int64)
    key = np.zeros(n, np.int64)
    for j in range(7):
        key = (key << 9) | wide[j : j + n]
    sa = np.argsort(key)
    k = key[sa]
    new = np.concatenate([[True], k[1:] != k[:-1]])
    rank = np.empty(n + 1, np.int64)
    rank[n] = -1
    head = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank[sa] = head
    h = 7
    while h < depth:
        size = np.diff(np.concatenate([np.flatnonzero(new), [n]]))
        open_at = np.flatnonzero(np.repeat(size > 1, size))
        if not len(open_at):
            break
        own = sa[open_at]
        second = rank[np.minimum(own + h, n)]
        first = rank[own]
        order = np.argsort(first * (n + 1) + second + 1)
        own, first, second = own[order], first[order], second[order]
        sa[open_at] = own
        split = np.ones(len(own), bool)
        split[1:] = (first[1:] != first[:-1]) | (second[1:] != second[:-1])
        new[open_at] = split
        head = np.maximum.accumulate(np.where(split, open_at, 0))
        rank[own] = head
        h *= 2
    return sa


def common_prefixes(s: np.ndarray, sa: np.ndarray, depth: int) -> np.ndarray:
    """For each pair of neighbours in the order, whether they share `depth` symbols: index j is for sa[j-1], sa[j].

    Breadth-first backward extension on the Burrows-Wheeler transform. Of each interval the distinct
    symbols before it are taken; the suffixes that begin with one of them and go on with the interval's string
    are again an interval, found through the last-to-first mapping.
    """
    n = len(s)
    bwt = s[sa - 1].astype(np.int16)
    bwt[sa == 0] = 0
    lf = np.empty(n, np.int64)
    lf[np.argsort(bwt, kind="stable")] = np.arange(n)
    bwt = bwt.astype(np.int64)
    bits = int(n).bit_length()
    known = np.zeros(n + 1, bool)
    known[0] = known[n] = True
    lo, hi = np.array([0]), np.array([n])
    for _ in range(depth):
        size = hi - lo
        one = size == 1
        start, end = lf[lo[one]], lf[lo[one]] + 1
        if not one.all():
            m_lo, m_size = lo[~one], size[~one]
            owner = np.repeat(np.arange(len(m_lo)), m_size)
            place = np.repeat(m_lo - np.concatenate([[0], np.cumsum(m_size)[:-1]]), m_size) + np.arange(m_size.sum())
            order = np.sort(((owner << 9 | bwt[place]) << bits) | place)  # by interval, symbol and place
            pair = order >> bits
            head = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]]))
            more = lf[order[head] & ((1 << bits) - 1)]
            start = np.concatenate([start, more])
            end = np.concatenate([end, more + np.diff(np.concatenate([head, [len(pair)]]))])
        fresh = ~known[end]
        lo, hi = start[fresh], end[fresh]
        known[hi] = True
        if not len(lo):
            break
    return ~known


def repeated_starts(bodies: list[bytes], repeats: np.ndarray, width: int) -> list[np.ndarray]:
    """For each segment, which of its windows also starts elsewhere in the block or, by `repeats`, beyond it."""
    length = np.array([len(b) for b in bodies])
    s = np.frombuffer(b"".join(bodies), np.uint8).astype(np.int16) + 1
    begin = np.concatenate([[0], np.cumsum(length)[:-1]]) + np.arange(len(bodies))
    text = np.zeros(len(s) + len(bodies), np.int16)  # a 0 ends each segment
    text[np.arange(len(s)) + np.repeat(np.arange(len(bodies)), length)] = s
    sa = suffix_order(text, width)
    same = common_prefixes(text, sa, width)
    hit = np.zeros(len(text), bool)
    hit[sa] = same[:-1] | same[1:]
    return [hit[b : b + n - width + 1] | bool(r) for b, n, r in zip(begin, length, repeats, strict=True)]


FOUND = "chunk int, segment int, first int, hits binary"
PART = ("key", "low", "high", "chunk", "anchor", "segment", "offset", "first", "repeats", "data")


def compared(rows: DataFrame, width: int) -> DataFrame:
    """Which windows of each asking segment repeat: `hits`, a byte for each window from the `first` on."""
    top = width - GRAM
    parts = rows.withColumns({"low": F.lit(0), "high": F.lit(top), "first": F.lit(0), "key": F.col("anchor").cast("string").cast("binary")}).select(*PART)
    small, big, single = parts, None, None
    done = []
    for _ in range(top.bit_length() + 1):
        hot = stored(small.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > MOST).select(F.col("key").alias("_key")))
        if hot.isEmpty():
            break
        done.append(small.join(hot, small["key"] == hot["_key"], "left_anti"))
        small = stored(_halved(small.join(hot, small["key"] == hot["_key"], "left_semi"), width))
        count = small.groupBy("key").agg(F.count("*").alias("_n"), F.max("repeats").alias("_r")).where((F.col("_n") > 1) | F.col("_r")).select(F.col("key").alias("_key"), "_n")
        alive = small.join(count, small["key"] == count["_key"]).drop("_key")
        at_one = (F.col("low") == F.col("high")) & ~F.col("repeats") & (F.col("_n") > 1)
        only = alive.where(at_one).select("chunk", "segment", "first", F.lit(bytearray(b"\x01")).alias("hits"))
        single = only if single is None else single.unionByName(only)
        small = stored(alive.where("low < high").select(*PART))
    for d in done:
        big = d if big is None else big.unionByName(d)
    rest = small if big is None else big.unionByName(small)
    size = rows.agg(F.sum(F.length("data"))).first()[0] or 0
    n_blocks = max(1, -(-size // BLOCK_BYTES))

    def f(group: pa.Table) -> pa.Table:
        bodies, repeats = group["data"].to_pylist(), group["repeats"].to_numpy()
        hits = repeated_starts(bodies, repeats, width)
        some = np.array([not r and h.any() for r, h in zip(repeats, hits, strict=True)], bool)
        kept = group.filter(pa.array(some))
        return pa.table({"chunk": kept["chunk"], "segment": kept["segment"], "first": kept["first"], "hits": pa.array([h.astype(np.uint8).tobytes() for h, k in zip(hits, some, strict=True) if k], pa.binary())})

    found = rest.withColumn("block", F.pmod(F.xxhash64("key", F.lit(1)), F.lit(n_blocks))).groupBy("block").applyInArrow(f, FOUND)
    return found if single is None else found.unionByName(single)


def _halved(parts: DataFrame, width: int) -> DataFrame:
    """Two parts of each: windows whose anchor stands in the lower or the upper half of the offsets.

    Windows are named by the offset of the anchor in them: o = offset - start. The bytes common to all windows
    with o in [low, high] are [offset - low, offset - high + width); any one of the windows holds them.
    """
    middle = F.floor((F.col("low") + F.col("high")) / 2).cast("int")
    both = F.array(F.struct(F.col("low").alias("l"), middle.alias("h")), F.struct((middle + 1).alias("l"), F.col("high").alias("h")))
    out = parts.withColumn("half", F.explode(F.when(F.col("low") == F.col("high"), F.array(F.struct(F.col("low").alias("l"), F.col("high").alias("h")))).otherwise(both)))
    begin = F.greatest(F.col("offset") - F.col("half.h"), F.lit(0))
    end = F.least(F.col("offset") - F.col("half.l") + width, F.length("data"))
    out = out.withColumns({"_b": begin, "_e": end}).where(F.col("_e") - F.col("_b") >= width)
    common = F.expr(f"substring(data, offset - half.l + 1, {width} - (half.h - half.l))")
    where = F.concat_ws(":", "anchor", "half.l", "half.h").cast("binary")  # the bytes, not a hash of them: parts that differ never meet
    return out.select(F.concat(where, common).alias("key"), F.col("half.l").alias("low"), F.col("half.h").alias("high"), "chunk", "anchor", "segment", (F.col("offset") - F.col("_b")).alias("offset"), (F.col("first") + F.col("_b")).alias("first"), "repeats", F.expr("substring(data, _b + 1, _e - _b)").alias("data"))


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def remove_repeats(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of each row."""
    return settled(lambda: _without_repeats(docs, width))


def _without_repeats(docs: DataFrame, width: int) -> DataFrame:
    chunked = Chunked(docs)
    n_shards = chunked.n_shards(SHARD_BYTES)
    codes = stored(judged(keys_sent(chunked, width, n_shards), n_shards))
    hits = compared(stored(shown(chunked, codes, width, n_shards)), width)
    answers = codes.select("chunk", "shard", "data", F.lit(None).cast("int").alias("segment"), F.lit(None).cast("int").alias("first"))
    answers = answers.unionByName(hits.select("chunk", F.lit(-1).alias("shard"), F.col("hits").alias("data"), "segment", "first"))

    def f(docs: pa.Table, answers: pa.Table) -> pa.Table:
        work = all_segments(docs["text"], width)
        k = Keyed(work)
        mask = answers["shard"].to_numpy() >= 0
        whole = codes_of(k, answers.filter(pa.array(mask)), n_shards)
        part = answers.filter(pa.array(~mask))
        asked = {}
        for se, first, blob in zip(part["segment"].to_pylist(), part["first"].to_pylist(), part["data"].to_pylist(), strict=True):
            asked.setdefault(se, []).append((first, np.frombuffer(blob, np.uint8)))
        n_bytes, n_removed, n_spans, digest, done = [], [], [], [], 0
        for data, at, starts, ends, *_ in work:
            delta = np.zeros(len(data) + 1, np.int64)
            own = k.number[done : done + len(starts)]
            done += len(starts)
            full = (whole[own] == WHOLE) | (whole[own] == SHOW) if len(own) else np.zeros(0, bool)
            np.add.at(delta, starts[full], 1)
            np.add.at(delta, ends[full], -1)
            for i in np.flatnonzero(whole[own] == ASK) if len(own) else ():
                for first, bits in asked.get(int(own[i]), ()):
                    at_hits = starts[i] + first + np.flatnonzero(bits)
                    np.add.at(delta, at_hits, 1)
                    np.add.at(delta, at_hits + width, -1)
            gone = np.cumsum(delta)[:-1] > 0
            begins = gone.copy()
            begins[1:] &= ~gone[:-1]
            edge = at[:-1][at[:-1] < len(data)]
            begins[edge] = gone[edge]
            for i, j in zip(at[:-1], at[1:], strict=True):
                lost = gone[i:j]
                n_bytes.append(int(j - i))
                n_removed.append(int(lost.sum()))
                n_spans.append(int(begins[i:j].sum()))
                digest.append(hashlib.sha256(data[i:j][~lost].tobytes()).hexdigest())
        return pa.table({"doc_id": docs["doc_id"], "n_bytes": pa.array(n_bytes, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()), "n_spans": pa.array(n_spans, pa.int64()), "kept_sha256": pa.array(digest, pa.string())})

    return chunked.with_answers(answers, f, RESULT)


def op3_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))
