"""Spelling variant grouping by a dictionary of trie-node pairs.

1. Words are counted: runs of letters, lower-cased, some with one code point taken out (see `deleted`), summed in each
   task first.
2. The nodes of the trie of all words are numbered without building it in one place: words are dealt into ranges and sorted, and a
   node is the first word of its range that has the prefix, with the prefix's length.  Prefixes that cross
   from one range into the next are numbered by the range in which they begin, which follows from the ranges' first and last words.
   The same is done for the reversed words.  Nodes that only one word passes are left out: no neighbour shares them.
3. A word gives one pair (prefix node, suffix node) for each place where it is cut, and one for each letter that is skipped.  Words that
   differ by a replaced letter share a pair of the second kind; a word and the one with an inserted letter share a pair
   of the first kind and one of the second.  So pairs are grouped, and each word learns the number of its neighbours
   there and the most frequent of them: a group has one word for each letter of the alphabet at most, and no pair of words becomes a row.
4. A word's form is its best neighbour over all pairs, if frequent enough; roots follow by doubling the steps along forms.

Defined results: null and empty texts have no runs; rows without an id take the empty string for it; repeated rows count again, as
every row does; among neighbours of one n the one first in code-point order is the form; the length of a text or a run has
no bound; an empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import kernels as K
from .common import settled, stored, table

LEAST_POINTS, LEAST_COUNT, EVERY, RATIO = 5, 3, 97, 2
#: Words of a range of the sorted vocabulary; distinct words a task holds before it sends their counts.
RANGE_WORDS, HELD_WORDS = 100_000, 300_000
#: A node's number: the range (19 bits), the place of its first word in it plus one (20), 0 for a node that begins in this range and crosses into the next, and its depth (24).
DEPTH_BITS, PLACE_BITS = 24, 20
U = K.U


@lru_cache(maxsize=1)
def crc_table() -> np.ndarray:
    """The byte table of CRC-32 from its polynomial."""
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, (c >> 1) ^ np.uint32(0xEDB88320), c >> 1)
    return c


def runs(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs of A-Z, a-z and U+00C0 to U+00FF (in UTF-8 0xC3 and one byte), and the text of each."""
    inside = np.zeros(len(data) + 2, bool)
    own = inside[1:-1]
    own[:] = ((data | 32) >= 97) & ((data | 32) <= 122) & (data < 128)
    lead = data == 0xC3
    own |= lead
    own[1:] |= lead[:-1]
    first, last = own & ~inside[:-2], own & ~inside[2:]
    edge = at[1:-1][(at[1:-1] > 0) & (at[1:-1] < len(data))]
    first[edge] = own[edge]
    last[edge - 1] = own[edge - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(at, starts, side="right") - 1


def crc_of_runs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, begun: np.ndarray) -> np.ndarray:
    """CRC-32 of each run, carried on from `begun`, that of what stands before it."""
    size, step = ends - starts, crc_table()
    state = begun ^ np.uint32(0xFFFFFFFF)
    order = np.argsort(-np.minimum(size, 65), kind="stable")
    s, c = starts[order], state[order]
    active = np.searchsorted(-np.minimum(size, 65)[order], -np.arange(65), side="left")  # how many have more than k bytes
    for k in range(64):
        m = int(active[k])
        if not m:
            break
        c[:m] = step[(c[:m] ^ data[s[:m] + k]) & 255] ^ (c[:m] >> 8)
    out = np.empty(len(c), np.uint32)
    out[order] = c ^ np.uint32(0xFFFFFFFF)
    for i in np.flatnonzero(size > 64):
        out[i] = zlib.crc32(data[starts[i] : ends[i]].tobytes(), int(begun[i]))
    return out


def deleted(run: str, h: int) -> str:
    """The run without its code point h % length."""
    k = h % len(run)
    return run[:k] + run[k + 1 :]


def counted(data: np.ndarray, at: np.ndarray, ids: list[str], least: int, every: int) -> Iterator[tuple[bytes, int]]:
    """(word, n) of a block of texts, several times for a word perhaps; words shorter than `least` code points are left out."""
    starts, ends, row = runs(data, at)
    points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    long = points[ends] - points[starts] >= least
    starts, ends, row = starts[long], ends[long], row[long]
    if not len(starts):
        return
    lower = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
    begun = np.array([zlib.crc32(f"{i}:".encode()) for i in ids], np.uint32)[row]
    h = crc_of_runs(lower, starts, ends, begun)
    hit = h % np.uint32(every) == 0
    text = lower.tobytes()
    for i in np.flatnonzero(hit):
        word = deleted(text[starts[i] : ends[i]].decode(), int(h[i]))
        if len(word) >= least:
            yield word.encode(), 1
    starts, ends = starts[~hit], ends[~hit]
    x, y = K.digests(lower, starts, ends)
    by = K.order(x, y)
    new = np.flatnonzero(K.fresh(x[by], y[by]))
    for k, n in zip(by[new].tolist(), np.diff(np.concatenate([new, [len(by)]])).tolist(), strict=True):
        yield text[starts[k] : ends[k]], n


def vocabulary(docs: DataFrame, least: int = LEAST_POINTS, least_n: int = LEAST_COUNT, every: int = EVERY) -> DataFrame:
    """(word, n) of all words with `least` code points that occur `least_n` times."""

    def sent(held: dict[bytes, int]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()).cast(pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])

    def run(batches):
        held: dict[bytes, int] = {}
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            for lo, hi, data, at in K.blocks(batch.column("text")):
                for word, n in counted(data, at, ["" if i is None else str(i) for i in ids[lo:hi]], least, every):
                    held[word] = held.get(word, 0) + n
                if len(held) > HELD_WORDS:
                    yield sent(held)
                    held = {}
        yield sent(held)

    each = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "word string, n long")
    return each.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_n)


def common_length(a: str, b: str) -> int:
    return len(os.path.commonprefix((a, b)))


def crossing(ends: list[tuple[int, str, str]]) -> dict[int, tuple[list[int], int]]:
    """For each range by number: where its left-crossing prefixes begin, by depth, and how many depths cross to the right.

    ends: (range, first word, last word) in order. Prefix i of a range's first word begins in the range before, or where it
    begins for that one's first word if the whole range before has it.
    """
    left: list[tuple[int, list[int]]] = []
    for k, (part, first, last) in enumerate(ends):
        if not k:
            left.append((part, []))
            continue
        before, head, tail = ends[k - 1]
        own, through = common_length(tail, first), common_length(head, tail)
        old = left[k - 1][1]
        left.append((part, [old[i] if i < len(old) and i <= through else before for i in range(own + 1)]))
    return {part: (begin, len(left[k + 1][1]) if k + 1 < len(left) else 0) for k, (part, begin) in enumerate(left)}


def numbered(words: list[str], part: int, begin: list[int], ahead: int) -> Iterator[list[int]]:
    """For each of a range's sorted words the numbers of its nodes from the root down, as deep as another word shares them.

    begin: where the prefixes of the first word begin that earlier ranges share, by depth; ahead: depths of the last word
    that the next range shares.
    """
    base = part << (DEPTH_BITS + PLACE_BITS)
    shared = [len(begin) - 1, *[common_length(a, b) for a, b in zip(words, words[1:], strict=False)], ahead - 1]
    tail = words[-1]
    now: list[int] = []
    for j, word in enumerate(words):
        if j:
            del now[shared[j] + 1 :]
        else:
            now = [(p << (DEPTH_BITS + PLACE_BITS)) | i for i, p in enumerate(begin)]
        cross = min(common_length(word, tail), ahead - 1) if ahead else -1
        for i in range(len(now), len(word) + 1):
            now.append(base | i if i <= cross else base | (j + 1) << DEPTH_BITS | i)
        yield now[: max(shared[j], shared[j + 1]) + 1]


def in_ranges(rows: DataFrame, key: Column, n: int) -> DataFrame:
    """rows by range of the key, written once with the range's number and sorted inside it: `part`, `key`."""
    parts = max(1, -(-n // RANGE_WORDS))
    keyed = rows.withColumn("key", key)
    ranged = keyed.repartitionByRange(parts, "key") if parts > 1 else keyed.coalesce(1)
    return stored(ranged.withColumn("part", F.spark_partition_id()))


def ranges_of(rows: DataFrame) -> dict[int, tuple[list[int], int]]:
    """What crossing() says of each range; two words of each come to the driver."""
    ends = rows.groupBy("part").agg(F.min("key").alias("a"), F.max("key").alias("b")).collect()
    return crossing(sorted((r["part"], r["a"], r["b"]) for r in ends))


PAIRS = "p long, s long, cut boolean, id long, n long, once boolean"


def node_pairs(vocab: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id, word, n) of each word, ids in the words' order; and its pairs (p, s): `cut` where the two make the word, else a letter is skipped between them.

    `once` is whether the letter skipped is the first of a run of equal ones, so a shorter neighbour is met once.
    """
    n = vocab.count()
    ahead = in_ranges(vocab, F.col("word"), n)
    known = ranges_of(ahead)

    def forward(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("key")
        part, words = rows["part"][0].as_py(), rows["key"].to_pylist()
        ids = np.arange(len(words)) + (part << 32)
        return pa.table({"id": pa.array(ids, pa.int64()), "word": rows["key"], "n": rows["n"], "p": pa.array(list(numbered(words, part, *known[part])), pa.list_(pa.int64()))})

    placed = stored(ahead.groupBy("part").applyInArrow(forward, "id long, word string, n long, p array<long>"))
    back = in_ranges(placed, F.reverse("word"), n)
    known_back = ranges_of(back)

    def backward(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("key")
        part, words = rows["part"][0].as_py(), rows["word"].to_pylist()
        suffixes = numbered(rows["key"].to_pylist(), part, *known_back[part])
        p_, s_, cut, id_, n_, once = [], [], [], [], [], []
        for word, i, n, p, s in zip(words, rows["id"].to_pylist(), rows["n"].to_pylist(), rows["p"].to_pylist(), suffixes, strict=True):
            size = len(word)
            whole = range(max(0, size + 1 - len(s)), min(size, len(p) - 1) + 1)
            less = range(max(0, size - len(s)), min(size - 1, len(p) - 1) + 1)
            p_ += [p[k] for k in whole] + [p[k] for k in less]
            s_ += [s[size - k] for k in whole] + [s[size - 1 - k] for k in less]
            cut += [True] * len(whole) + [False] * len(less)
            once += [False] * len(whole) + [not k or word[k] != word[k - 1] for k in less]
            id_ += [i] * (len(whole) + len(less))
            n_ += [n] * (len(whole) + len(less))
        return pa.table({"p": pa.array(p_, pa.int64()), "s": pa.array(s_, pa.int64()), "cut": pa.array(cut, pa.bool_()), "id": pa.array(id_, pa.int64()), "n": pa.array(n_, pa.int64()), "once": pa.array(once, pa.bool_())})

    return placed.drop("p"), back.groupBy("part").applyInArrow(backward, PAIRS)


def neighbours(pairs: DataFrame) -> DataFrame:
    """(id, n_near, best) of the words that have a neighbour; best: (n, -id) of the most frequent one, the first by order."""
    me = F.struct("n", (-F.col("id")).alias("id"))
    group = Window.partitionBy("p", "s")
    kin = Window.partitionBy("p", "s", "cut")
    ranked = kin.orderBy(F.col("n").desc(), "id")
    first = F.first(me).over(ranked.rowsBetween(Window.unboundedPreceding, 0))
    met = pairs.repartition("p", "s").withColumns({
        "_kin": F.count("*").over(kin),
        "_rank": F.row_number().over(ranked),
        "_first": first,
        "_second": F.lead(me).over(ranked),
        "_whole": F.max(F.when(F.col("cut"), me)).over(group),
        "_longer": F.count(F.when(F.col("once"), 1)).over(group),
        "_best_longer": F.max(F.when(F.col("once"), me)).over(group),
    })
    shorter = F.when(F.col("once"), F.col("_whole"))
    count = F.when(F.col("cut"), F.col("_longer")).otherwise(F.col("_kin") - 1 + F.when(shorter.isNotNull(), 1).otherwise(0))
    other = F.when(F.col("_rank") == 1, F.col("_second")).otherwise(F.col("_first"))
    best = F.when(F.col("cut"), F.col("_best_longer")).otherwise(F.greatest(other, shorter))
    each = met.select("id", count.alias("k"), best.alias("b")).where(F.col("k") > 0)
    return each.groupBy("id").agg(F.sum("k").alias("n_near"), F.max("b").alias("best"))


def last_of(steps: DataFrame) -> DataFrame:
    """(id, root) from (id, to): where the steps end; every step is to a word with twice the n, so few doublings do."""
    now = stored(steps.select("id", F.col("to").alias("root")))
    while True:
        ahead = now.select(F.col("id").alias("_id"), F.col("root").alias("_root"))
        moved = stored(now.join(ahead, now["root"] == ahead["_id"], "left").select("id", F.coalesce("_root", "root").alias("root"), F.col("_root").isNotNull().alias("_on")))
        now = moved.select("id", "root")
        if moved.where("_on").isEmpty():
            return now


def variants(docs: DataFrame, least: int = LEAST_POINTS, least_n: int = LEAST_COUNT, every: int = EVERY, ratio: float = RATIO) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of each word of the corpus."""
    return settled(lambda: _variants(docs, least, least_n, every, ratio))


def _variants(docs: DataFrame, least: int, least_n: int, every: int, ratio: float) -> DataFrame:
    words, pairs = node_pairs(stored(vocabulary(docs, least, least_n, every)))
    words = words.select("id", "word", "n")
    near = neighbours(pairs).select(F.col("id").alias("_id"), "n_near", "best")
    full = stored(words.join(near, words["id"] == near["_id"], "left").select("id", "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(F.col("best.n") >= ratio * F.col("n"), -F.col("best.id")).alias("to")))
    ends = last_of(full.where("to is not null").select("id", "to"))
    name = lambda c: full.select(F.col("id").alias(f"_{c}"), F.col("word").alias(c), F.col("n").alias(f"{c}_n"))
    out = full.join(ends.select(F.col("id").alias("_at"), F.col("root").alias("_end")), F.col("id") == F.col("_at"), "left")
    out = out.join(name("form"), F.col("to") == F.col("_form"), "left").join(name("root"), F.col("_end") == F.col("_root"), "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(table(spark, sf_dir, "documents"))
