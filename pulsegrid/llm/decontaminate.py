"""Benchmark decontamination by pigeonhole edit matching.

Texts and items are compared in lower case with blanks collapsed.  An item of m characters may
differ from a passage by e = floor(rate * m) edits, but so few that its pieces keep eight
characters.  Cut into e + 1 pieces, at least one piece of it stands unchanged in any such passage.
One automaton finds all pieces in a text.  A piece that many items share (a prompt's phrase) makes all of them
candidates at each of its hits, so candidates are sieved first: of an item's runs of four characters, of which an edit
spoils one at most, all but e must stand in the text around the hit.  For what is left Myers' bit-parallel
recurrence, run over many windows at once, gives the least edit distance of the whole item.

The items are taken in blocks of at most `BLOCK_BYTES`. One pass over the documents searches every text whole for all of
them: a worker holds `BATCH_BYTES` of texts and one block's automaton at a time.

Defined results: null and empty texts have no leaks, null and empty items match nothing; an item without an id is found
as any other and has a null item_id, each of its texts counting for itself; repeated items count by id, the best of their
texts; repeated rows give repeated rows; ties go to the earliest end; the length of a text or an item has no bound; an empty table gives no
rows; other columns stay as they are, and where one is called `leaks` the result is `leaks_2`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import columns, free, mapped, table

BLOCK_BYTES, BATCH_BYTES = 4 << 20, 64 << 20
RATE = 0.1
LEAST_PIECE = 8
LEAK = T.ArrayType(T.StructType([T.StructField("item_id", T.LongType()), T.StructField("distance", T.IntegerType()), T.StructField("end", T.IntegerType())]))
CHUNK, SYMBOLS = 1 << 14, 1 << 24  # windows verified at once, and characters in them
ROWS_KEPT = 1 << 24
#: Code points of text whose runs of four are looked up together, and items sieved at once.
REGION, SIEVED = 1024, 20_000
_FOUR = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F], np.uint32)


def normal(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"[\s\x{a0}]+", " "))


def budget(m: int, rate: float) -> int:
    return max(0, min(int(rate * m), m // LEAST_PIECE - 1))


NONE = np.zeros((0, 2), np.int64)


def fours(codes: np.ndarray) -> np.ndarray:
    """16 bits of every run of four codes."""
    c = codes.astype(np.uint32)
    n = len(c) - 3
    return (sum(c[k : n + k] * _FOUR[k] for k in range(4)) >> np.uint32(16)).astype(np.uint16) if n > 0 else np.zeros(0, np.uint16)


class Items:
    """A block of items: the pieces, and each item's match masks by its own characters."""

    def __init__(self, ids: list[int | None], texts: list[str], rate: float):
        self.ids, self.texts = ids, texts
        self.length = np.array([len(t) for t in texts], np.int64)
        self.errors = np.array([budget(len(t), rate) for t in texts], np.int64)
        self.pieces: dict[str, list[tuple[int, int]]] = {}
        for i, t in enumerate(texts):
            k = int(self.errors[i]) + 1
            for j in range(k):
                s = j * len(t) // k
                self.pieces.setdefault(t[s : (j + 1) * len(t) // k], []).append((i, s))

    def prepare(self) -> None:
        """Builds what is not sent over the wire; once in each worker."""
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for piece, where in self.pieces.items():
            own = np.array(where, np.int64)
            self.automaton.add_word(piece, (len(piece), own[:, 0], own[:, 1]))
        self.automaton.make_automaton()
        letters = sorted(set("".join(self.texts)))
        self.top = ord(letters[-1]) + 2
        self.code = np.zeros(self.top, np.int32)
        self.code[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        self.n_words = -(-self.length // 64)
        points = [self.code[np.frombuffer(t.encode("utf-32-le"), np.uint32)] for t in self.texts]
        self.own = [np.unique(p) for p in points]
        size = (np.array([len(o) for o in self.own], np.int64) + 1) * self.n_words  # a row of words for each of the item's own letters, as long as the item needs
        self.start = np.cumsum(size) - size
        self.masks = np.zeros(int(size.sum()), np.uint64)
        self.rows: dict[int, np.ndarray] = {}
        for i, p in enumerate(points):
            at = np.arange(len(p))
            row = (np.searchsorted(self.own[i], p) + 1) * self.n_words[i]
            np.bitwise_or.at(self.masks, self.start[i] + row + (at >> 6), np.uint64(1) << (at & 63).astype(np.uint64))
        runs = [fours(p)[::4] for p in points]
        self.fours = np.concatenate([np.zeros(0, np.uint16), *runs])
        self.four_at = np.concatenate([[0], np.cumsum([len(r) for r in runs])]).astype(np.int64)
        self.there = np.zeros(1 << 16, np.uint8)  # which runs of four are around, emptied after each use
        self.groups = {}
        self.group = np.array([self.groups.setdefault((True, v) if v is not None else (False, i), len(self.groups)) for i, v in enumerate(self.ids)], np.int64)

    def rows_of(self, item: int) -> np.ndarray:
        """The item's row of masks for each letter of the block, 0 where the item hasn't the letter; as many are kept as fit `ROWS_KEPT` numbers."""
        if item not in self.rows:
            if len(self.rows) * (int(self.code.max()) + 1) > ROWS_KEPT:
                self.rows.clear()
            rows = np.zeros(int(self.code.max()) + 1, np.int32)
            rows[self.own[item]] = np.arange(1, len(self.own[item]) + 1)
            self.rows[item] = rows
        return self.rows[item]

    def candidates(self, text: str) -> np.ndarray:
        """(item, slot) of all piece hits, each once; a slot is a run of errors + 1 starts of the item."""
        hits = [(end + 1 - n, items, starts) for end, (n, items, starts) in self.automaton.iter(text)]
        if not hits:
            return NONE
        i = np.concatenate([h[1] for h in hits])
        at = np.repeat(np.array([h[0] for h in hits], np.int64), [len(h[1]) for h in hits]) - np.concatenate([h[2] for h in hits])
        slot = at // (self.errors[i] + 1)
        order = np.lexsort((slot, i))
        i, slot = i[order], slot[order]
        new = np.ones(len(i), bool)
        new[1:] = (i[1:] != i[:-1]) | (slot[1:] != slot[:-1])
        return np.stack([i[new], slot[new]], 1)

    def around(self, item: np.ndarray, slot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each candidate's window begins, and its width."""
        e = self.errors[item]
        return np.maximum(slot * (e + 1) - e, 0), self.length[item] + 3 * e + 1

    def plausible(self, text: np.ndarray, item: np.ndarray, slot: np.ndarray) -> np.ndarray:
        """Which candidates of a text have as many of their runs of four around as their errors must leave; others can't match."""
        lo, width = self.around(item, slot)
        good, there = np.zeros(len(item), bool), self.there
        region = lo // REGION
        order = np.argsort(region, kind="stable")
        edge = np.flatnonzero(np.diff(region[order], prepend=-1))
        for a, b in zip(edge, [*edge[1:], len(order)], strict=True):
            for k in range(a, b, SIEVED):
                own = order[k : min(b, k + SIEVED)]
                around = fours(text[int(lo[own].min()) : int((lo[own] + width[own]).max())])
                there[around] = 1
                first = self.four_at[item[own]]
                n = self.four_at[item[own] + 1] - first
                flat = np.repeat(first - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
                seen = np.concatenate([[0], np.cumsum(there[self.fours[flat]], dtype=np.int64)])
                at = np.concatenate([[0], np.cumsum(n)])
                good[own] = seen[at[1:]] - seen[at[:-1]] >= n - self.errors[item[own]]
                there[around] = 0
        return good

    def verify(self, texts: list[np.ndarray], doc: np.ndarray, item: np.ndarray, slot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least distance of each candidate's item in its window, and where the first such passage ends."""
        lo, width = self.around(item, slot)
        best, where = np.full(len(item), np.iinfo(np.int32).max, np.int64), np.zeros(len(item), np.int64)
        order = np.lexsort((width, self.n_words[item]))
        for a in range(0, len(order), CHUNK):
            part = order[a : a + CHUNK]
            for w in np.unique(self.n_words[item[part]]):
                same = part[self.n_words[item[part]] == w]
                if len(same) < 4 * w:
                    for c in same:
                        best[c], where[c] = self._myers_alone(self.rows_of(int(item[c]))[texts[doc[c]][lo[c] : lo[c] + width[c]]], int(item[c]))
                    continue
                step = max(1, SYMBOLS // int(width[same].max()))
                for b in range(0, len(same), step):
                    own = same[b : b + step]
                    window = np.zeros((int(width[own].max()), len(own)), np.int32)
                    for k, c in enumerate(own):
                        piece = texts[doc[c]][lo[c] : lo[c] + width[c]]
                        window[: len(piece), k] = self.rows_of(int(item[c]))[piece]
                        window[len(piece) :, k] = -1
                    best[own], where[own] = self._myers(window, item[own], int(w))
        return best, lo + where

    def _myers(self, window: np.ndarray, item: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
        one, zero, full = np.uint64(1), np.uint64(0), np.uint64(0xFFFFFFFFFFFFFFFF)
        n = len(item)
        up, down = np.full((words, n), full), np.full((words, n), zero)
        last = ((self.length[item] - 1) & 63).astype(np.uint64)
        score = self.length[item].copy()
        best, where = score.copy(), np.zeros(n, np.int64)
        start = self.start[item]
        for step, codes in enumerate(window):
            row = start + np.maximum(codes, 0).astype(np.int64) * words
            plus, minus = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
            for b in range(words):
                eq, pv, mv = self.masks[row + b], up[b], down[b]
                xv = eq | mv
                eq = eq | minus
                xh = (((eq & pv) + pv) ^ pv) | eq
                ph, mh = mv | ~(xh | pv), pv & xh
                bit = last if b == words - 1 else np.uint64(63)
                out_plus, out_minus = (ph >> bit) & one, (mh >> bit) & one
                ph, mh = (ph << one) | plus, (mh << one) | minus
                up[b], down[b] = mh | ~(xv | ph), ph & xv
                plus, minus = out_plus, out_minus
            score += plus.astype(np.int64) - minus.astype(np.int64)
            better = (score < best) & (codes >= 0)
            best[better], where[better] = score[better], step + 1
        return best, where

    def _myers_alone(self, window: np.ndarray, item: int) -> tuple[int, int]:
        """The same recurrence over one window, each of its vectors one long integer: for few windows of a long item."""
        m, words = int(self.length[item]), int(self.n_words[item])
        rows = self.masks[self.start[item] :][: (len(self.own[item]) + 1) * words].reshape(-1, words)
        letters = {int(r): int.from_bytes(rows[r].tobytes(), "little") for r in np.unique(window)}
        full, top = (1 << m) - 1, 1 << (m - 1)
        up, down, score, best, where = full, 0, m, m, 0
        for step, r in enumerate(window.tolist(), 1):
            eq = letters[r]
            xv = eq | down
            xh = ((((eq & up) + up) ^ up) | eq) & full
            plus, minus = down | (full ^ (xh | up)), up & xh
            score += bool(plus & top) - bool(minus & top)
            plus, minus = (plus << 1) & full, (minus << 1) & full
            up, down = minus | (full ^ (xv | plus)), plus & xv
            if score < best:
                best, where = score, step
        return best, where

    def encoded(self, text: str) -> np.ndarray:
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        return self.code[np.minimum(points, self.top - 1)]


def leaks(items: Items, texts: list[str | None]) -> list[list[tuple[int | None, int, int]]]:
    """(item id, distance, end) of each item within its budget, for each text."""
    doc, item, slot, codes = [], [], [], {}
    for d, text in enumerate(texts):
        found = items.candidates(text) if text else ()
        if len(found):
            code = items.encoded(text)
            good = items.plausible(code, found[:, 0], found[:, 1])
            if good.any():
                codes[d] = code
                doc.append(np.full(int(good.sum()), d))
                item.append(found[good, 0])
                slot.append(found[good, 1])
    out: list[list[tuple[int | None, int, int]]] = [[] for _ in texts]
    if not doc:
        return out
    doc, item, slot = np.concatenate(doc), np.concatenate(item), np.concatenate(slot)
    best, end = items.verify(codes, doc, item, slot)
    good = np.flatnonzero(best <= items.errors[item])
    group = items.group[item]
    last = (-1, -1)
    for k in good[np.lexsort((end[good], best[good], group[good], doc[good]))]:
        if last != (doc[k], group[k]):
            last = (doc[k], group[k])
            out[doc[k]].append((items.ids[item[k]], int(best[k]), int(end[k])))
    return [sorted(row, key=_by_item) for row in out]


def _by_item(leak: tuple[int | None, int, int]) -> tuple:
    return leak[0] is None, leak[0] or 0, leak[1], leak[2]


def joined(parts: list[list[tuple[int | None, int, int]]]) -> list[tuple[int | None, int, int]]:
    """The leaks of one text over all blocks: the best of each id; leaks without an id stay for themselves."""
    out: list[tuple[int | None, int, int]] = []
    for leak in sorted((x for p in parts for x in p), key=_by_item):
        if leak[0] is None or not out or out[-1][0] != leak[0]:
            out.append(leak)
    return out


def find_leaks(docs: DataFrame, benchmark: DataFrame, rate: float = RATE) -> DataFrame:
    """docs with `leaks`: (item_id, distance, end in the compared text) of every item found, by item, those without an id last."""
    spark = docs.sparkSession
    items = benchmark.select("item_id", normal(F.col("text")).alias("text")).where(F.length("text") > 0).distinct()
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_blocks = -(-size // BLOCK_BYTES)
    shared = []
    for b in range(n_blocks):
        rows = sorted(map(tuple, items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks)) == b).collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
        if rows:
            shared.append(spark.sparkContext.broadcast(Items([r[0] for r in rows], [r[1] for r in rows], rate)))  # BLOCK_BYTES of texts
    names, found = docs.columns, free(docs, "leaks")
    schema = docs.select(*columns(names), F.array().cast(LEAK).alias(found)).schema
    return mapped(docs.select(*columns(names), normal(F.col("text")).alias(found)), _search(shared, schema.names), schema)


def _search(shared: list, names: list[str]):
    """The leaks of batches whose last column is the compared text."""
    kind = pa.list_(pa.struct([("item_id", pa.int64()), ("distance", pa.int32()), ("end", pa.int32())]))

    def of(texts: pa.Array) -> pa.Array:
        rows: dict[int, list] = {}
        for block in shared:
            items = block.value
            if not hasattr(items, "automaton"):
                items.prepare()
            for lo in range(0, len(texts), 1000):
                for i, found in enumerate(leaks(items, texts.slice(lo, 1000).to_pylist()), lo):
                    if found:
                        rows.setdefault(i, []).append(found)
            if len(shared) > 1:  # one block is held at a time; it is read again from the executor's copy
                vars(block).pop("_value", None)
        size = np.zeros(len(texts) + 1, np.int32)
        all_ = []
        for i in sorted(rows):
            own = joined(rows[i])
            size[i + 1] = len(own)
            all_ += own
        values = pa.StructArray.from_arrays([pa.array([x[k] for x in all_], t) for k, t in enumerate((pa.int64(), pa.int32(), pa.int32()))], fields=list(kind.value_type))
        return pa.ListArray.from_arrays(pa.array(np.cumsum(size), pa.int32()), values)

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Batches as they come, or for several blocks as many at once as BATCH_BYTES hold."""
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.column(batch.num_columns - 1).nbytes
            if len(shared) < 2 or size > BATCH_BYTES:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held, size = [], 0
        if held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()

    def run(batches):
        for batch in gathered(batches):
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], of(batch.column(batch.num_columns - 1))], names=names)

    return run


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_leaks(docs, table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", (F.size("leaks") > 0).alias("contaminated"), F.transform("leaks", lambda x: x["item_id"]).alias("item_ids"), F.array_min(F.transform("leaks", lambda x: x["distance"])).alias("least_distance"))
