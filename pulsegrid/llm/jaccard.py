"""N-gram Jaccard join by MinHash banding.

Documents are sets of five-word shingles.  Texts with equal sets form one node, so copies cost
nothing further.  A node's MinHash signature is cut into bands; their number follows from the
target recall at the threshold.  Band hashes are shuffled; nodes that share one are candidates.
A link is a pair that shares a band and whose full sets reach the threshold.

Candidates that are connected through bands and fit a block are verified together in one task.
Where they don't fit, as with texts on one template that are alike but below the threshold, they are parted first, before any text
is moved: two sets at the threshold share one of the rarest shingles of each (the prefix filter), so only candidates connected
through those stay together. Rarity comes from counts in a sketch of bounded size; any order would do, and the better it
is the smaller the parts. Where a part doesn't fit either, each band's bucket of it is a task of its own, and a bucket that doesn't fit is cut
into blocks, each pair of blocks a task; a pair counts in the first band that it shares.  So no task
holds a whole group, no text is held against what it shares no bucket with beyond a block, and pairs
are counted there and never become rows.

Defined results: a text of one to four words has one shingle, all its words; texts without words
and null texts have no links and are a class of their own id; a row without an id names
no class but links as any other; repeated rows are copies, rows that repeat an id with another text are documents
of their own that share the id; the length of a text has no bound; an empty table gives no rows.
Columns of the input other than doc_id and text may have any names: `representatives` returns them as they are.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import kernels as K
from .common import columns, settled, stored, table
from .graph import components

N, THRESHOLD, RECALL, ROWS = 5, 0.8, 0.9995, 5
#: Connected candidates that are verified whole have at most so many shingles and nodes; a block of a bucket has about so many.
BLOCK_SHINGLES, BLOCK_NODES, PART_NODES = 500_000, 400, 100
#: Shingles in at least so many nodes of a task are multiplied as dense columns, others pair by pair.
DENSE = 32
#: Rarity of shingles is counted in 2 to this power counters at most.
MOST_COUNTERS = 22


def n_bands(threshold: float = THRESHOLD, recall: float = RECALL, rows: int = ROWS) -> int:
    """Bands of `rows` rows such that a pair at the threshold shares one with the probability `recall`."""
    return math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows))


def shingles(data: np.ndarray, at: np.ndarray, n: int = N) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, sorted within it, and where each text's begin."""
    starts, ends, first = K.words(data, at)
    (word,) = K.digests(data, starts, ends, 1)
    count = np.diff(first)
    per = np.where(count >= n, count - n + 1, np.minimum(count, 1))
    row = np.repeat(np.arange(len(count)), per)
    begin = np.repeat(first[:-1] - np.concatenate([[0], np.cumsum(per)[:-1]]), per) + np.arange(per.sum())
    width = np.minimum(count, n)[row]
    h = np.zeros(len(row), K.U)
    for w in np.unique(width):
        h[width == w] = K.mix(K.run_hash(word, int(w))[begin[width == w]] + K.U(w))
    order = np.lexsort((h, row))
    row, h = row[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    return h[new], np.searchsorted(row[new], np.arange(len(count) + 1))


def set_keys(sets: np.ndarray, first: np.ndarray) -> list[bytes]:
    """16 bytes for each set: two independent sums of scrambled members."""
    a = K.by_row(np.add, K.mix(sets ^ K.U(0x5851F42D4C957F2D)), first, K.U(0))
    b = K.by_row(np.add, K.mix(sets * K.U(0xDA942042E4DD58B5)), first, K.U(0))
    both = np.stack([a, b], 1).astype(">u8").tobytes()
    return [both[i : i + 16] for i in range(0, len(both), 16)]


def band_keys(sets: np.ndarray, first: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """(texts x bands) hashes of the signature's bands."""
    x = (sets >> K.U(32)).astype(np.uint32)
    seeds = K.mix(np.arange(1, 2 * bands * rows + 1, dtype=K.U)).astype(np.uint32)
    out = np.zeros((len(first) - 1, bands), K.U)
    for b in range(bands):
        key = np.full(len(first) - 1, b + 1, K.U)
        for r in range(rows):
            k = b * rows + r
            low = K.by_row(np.minimum, x * (seeds[2 * k] | np.uint32(1)) + seeds[2 * k + 1], first, np.uint32(0))
            key = K.mix(key * K.U(0x9E3779B97F4A7C15) + low)
        out[:, b] = key
    return out


def node_keys(ids: pa.Array, sets: np.ndarray, first: np.ndarray) -> list[bytes]:
    """The node of each text: its set's key, and for a text without words its id."""
    keys = set_keys(sets, first)
    for i in np.flatnonzero(np.diff(first) == 0):
        keys[i] = b"-" + str(ids[int(i)]).encode()
    return keys


def signatures(docs: DataFrame, n: int, bands: int, rows: int) -> DataFrame:
    """(doc_id, node, n_shingles, bands) of each row."""

    def run(batches):
        for batch in batches:
            ids = batch.column("doc_id")
            for lo, hi, data, at in K.blocks(batch.column("text")):
                sets, first = shingles(data, at, n)
                own = ids.slice(lo, hi - lo)
                size, keys = np.diff(first), node_keys(own, sets, first)
                flat = band_keys(sets, first, bands, rows)
                lists = [flat[i].view(np.int64) if size[i] else flat[i][:0].view(np.int64) for i in range(len(size))]
                yield pa.RecordBatch.from_arrays([own.cast(pa.int64()), pa.array(keys, pa.binary()), pa.array(size, pa.int64()), pa.array(lists, pa.list_(pa.int64()))], names=["doc_id", "node", "n_shingles", "bands"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, node binary, n_shingles long, bands array<long>")


def node_rows(docs: DataFrame, n: int = N) -> DataFrame:
    """(node, row): the first row of each node by id (null last), text and the other columns.

    Rows are reduced before they are dealt out, so a node with many copies sends one row from each task.
    """
    names = ["doc_id", "text", *[c for c in docs.columns if c not in ("doc_id", "text")]]
    row = F.struct(F.col("doc_id").isNull(), *columns(names))  # fields by place: a column may have any name
    packed = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text"), row.alias("row"))

    def run(batches):
        for batch in batches:
            ids, keys = batch.column(0), []
            for lo, hi, data, at in K.blocks(batch.column(1)):
                keys += node_keys(ids.slice(lo, hi - lo), *shingles(data, at, n))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), batch.column(2)], names=["node", "row"])

    kind = T.StructType([T.StructField("no_id", T.BooleanType()), *[T.StructField(f"c{i}", docs.schema[c].dataType) for i, c in enumerate(names)]])
    named = packed.withColumn("row", F.col("row").cast(kind))
    keyed = named.mapInArrow(run, T.StructType([T.StructField("node", T.BinaryType()), T.StructField("row", kind)]))
    return keyed.groupBy("node").agg(F.min("row").alias("row"))


def linked_pairs(sets: np.ndarray, owner: np.ndarray, size: np.ndarray, side: np.ndarray, within: bool, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of owners whose sets reach the threshold; pairs of different sides only, unless `within`."""
    m = len(size)
    order = np.argsort(sets, kind="stable")
    h, o = sets[order], owner[order]
    edge = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
    df = np.diff(np.concatenate([edge, [len(h)]]))
    common = np.zeros((m, m), np.float32)
    dense = edge[df >= DENSE], df[df >= DENSE]
    step = max(1, (4 << 20) // max(m, 1))
    for lo in range(0, len(dense[0]), step):
        e, d = dense[0][lo : lo + step], dense[1][lo : lo + step]
        x = np.zeros((m, len(e)), np.float32)
        at = np.repeat(e - np.concatenate([[0], np.cumsum(d)[:-1]]), d) + np.arange(d.sum())
        x[o[at], np.repeat(np.arange(len(e)), d)] = 1
        common += x @ x.T
    for d in np.unique(df[(df > 1) & (df < DENSE)]):
        e = edge[df == d]
        members = o[e[:, None] + np.arange(d)]
        i, j = np.triu_indices(d, 1)
        for lo in range(0, len(e), max(1, (2 << 20) // len(i))):
            part = members[lo : lo + max(1, (2 << 20) // len(i))]
            a, b = part[:, i].ravel(), part[:, j].ravel()
            np.add.at(common, (np.minimum(a, b), np.maximum(a, b)), 1)
    common = np.triu(common, 1)
    a, b = np.nonzero(common)
    inter = common[a, b]
    good = (inter >= threshold * (size[a] + size[b] - inter) - 1e-6) & (within | (side[a] != side[b]))
    return a[good], b[good]


def roots(m: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least member of each one's component."""
    root = np.arange(m)
    while True:
        low = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        root = root[root]
        if (root == before).all():
            return root


def first_shared(bands: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each pair of rows shares a band, and the key of the first one."""
    some, key = np.zeros(len(a), bool), np.zeros(len(a), np.int64)
    for lo in range(0, len(a), 1 << 16):
        x, y = bands[a[lo : lo + (1 << 16)]], bands[b[lo : lo + (1 << 16)]]
        same = x == y
        some[lo : lo + len(x)] = same.any(1)
        key[lo : lo + len(x)] = x[np.arange(len(x)), same.argmax(1)]
    return some, key


def verify(candidates: DataFrame, n: int, threshold: float) -> DataFrame:
    """(id, root, links, split) by task; candidates: grp, comp, bucket (null where connected candidates fit), side, within, id, copies, bands, text."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        found = []
        for _, part in pdf.groupby("comp", sort=False):
            part = part.sort_values("id")
            sets, first = shingles(*K.packed(pa.array(part["text"], pa.string())), n)
            size, split = np.diff(first), bool(part["split"].iloc[0])
            a, b = linked_pairs(sets, np.repeat(np.arange(len(size)), size), size, part["side"].to_numpy(), bool(part["within"].all()), threshold)
            some, key = first_shared(np.stack(part["bands"].to_list()), a, b)
            own = some & (key == part["bucket"].iloc[0]) if split else some
            a, b = a[own], b[own]
            copies, ids = part["copies"].to_numpy(), part["id"].to_numpy()
            links = np.bincount(a, copies[b], len(size)) + np.bincount(b, copies[a], len(size))
            if len(a):
                found.append(pd.DataFrame({"id": ids, "root": ids[roots(len(size), a, b)], "links": links.astype(np.int64), "split": split}))
        return pd.concat(found) if found else pd.DataFrame({"id": [], "root": [], "links": [], "split": []})

    return candidates.groupBy("grp").applyInPandas(one, "id long, root long, links long, split boolean")


def fits(shingles: str, nodes: str) -> Column:
    return (F.col(shingles) <= BLOCK_SHINGLES) & (F.col(nodes) <= BLOCK_NODES)


def prefix_length(size: np.ndarray, threshold: float) -> np.ndarray:
    """Of how many of its shingles, in an order that all sets have in common, a set at the threshold shares one at least."""
    return size - np.ceil(threshold * size - 1e-6).astype(np.int64) + 1


def counter_of(sets: np.ndarray, component: np.ndarray, counters: int) -> np.ndarray:
    """Where a component's shingle is counted."""
    return (K.mix(sets ^ K.mix(component.astype(K.U))) & K.U(counters - 1)).astype(np.int64)


def shingle_counts(members: DataFrame, n: int, counters: int) -> np.ndarray:
    """In how many sets of a component a shingle is, or more, by its counter; 64 and above in steps of a 16th of a doubling."""
    width = max(1, counters // 64)

    def run(batches):
        total = np.zeros(counters, np.uint32)
        for batch in batches:
            component = batch.column("component").to_numpy()
            for lo, _, data, at in K.blocks(batch.column("text")):
                sets, first = shingles(data, at, n)
                np.add.at(total, counter_of(sets, np.repeat(component[lo : lo + len(first) - 1], np.diff(first)), counters), 1)
        at = np.flatnonzero(total)
        edge = np.searchsorted(at, np.arange(0, counters + width, width))
        parts = [(k, at[a:b].astype("<u4").tobytes() + total[at[a:b]].tobytes()) for k, (a, b) in enumerate(zip(edge[:-1], edge[1:], strict=True)) if b > a]
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in parts], pa.int32()), pa.array([d for _, d in parts], pa.binary())], names=["part", "data"])

    def add(parts: pa.Table) -> pa.Table:
        k, total = parts["part"][0].as_py(), np.zeros(width, np.int64)
        for blob in parts["data"]:
            at, count = np.frombuffer(blob.as_buffer(), "<u4").reshape(2, -1)
            total[at.astype(np.int64) - k * width] += count
        steps = np.where(total < 64, total, 64 + 16 * np.log2(np.maximum(total, 64) / 64)).astype(np.int64)
        return pa.table({"part": pa.array([k], pa.int32()), "data": pa.array([np.minimum(steps, 255).astype(np.uint8).tobytes()], pa.binary())})

    out = np.zeros(counters, np.uint8)
    for r in members.select("component", "text").mapInArrow(run, "part int, data binary").groupBy("part").applyInArrow(add, "part int, data binary").collect():  # `counters` bytes
        out[r["part"] * width : (r["part"] + 1) * width] = np.frombuffer(r["data"], np.uint8)
    return out


def parted(members: DataFrame, n: int, threshold: float) -> DataFrame:
    """(id, part) of the members that share a rare shingle with another of their component; parts are connected through such shingles."""
    total = members.agg(F.sum("n_shingles")).first()[0] or 0
    counters = 1 << min(MOST_COUNTERS, max(16, int(total).bit_length()))
    shared = members.sparkSession.sparkContext.broadcast(shingle_counts(members, n, counters))  # 1 << MOST_COUNTERS bytes at most

    def run(batches):
        for batch in batches:
            component, ids = batch.column("component").to_numpy(), batch.column("id").to_numpy()
            for lo, _, data, at in K.blocks(batch.column("text")):
                sets, first = shingles(data, at, n)
                size = np.diff(first)
                row = np.repeat(np.arange(len(size)), size)
                count = shared.value[counter_of(sets, component[lo + row], counters)]
                order = np.lexsort((sets, count, row))
                place = np.arange(len(row)) - np.repeat(first[:-1], size)
                own = order[(place < prefix_length(size, threshold)[row]) & (count[order] > 1)]  # what is counted once is shared by none
                yield pa.RecordBatch.from_arrays([pa.array(component[lo + row[own]]), pa.array(sets[own].view(np.int64)), pa.array(ids[lo + row[own]])], names=["component", "shingle", "id"])

    rare = stored(members.select("component", "id", "text").mapInArrow(run, "component long, shingle long, id long"))
    heads = stored(rare.groupBy("component", "shingle").agg(F.min("id").alias("least"), F.count("*").alias("k")).where("k > 1").select(F.col("component").alias("_component"), F.col("shingle").alias("_shingle"), "least"))
    edges = rare.join(heads, (rare["component"] == heads["_component"]) & (rare["shingle"] == heads["_shingle"])).select(F.col("id").alias("u"), F.col("least").alias("v"))
    return components(edges).select(F.col("node").alias("id"), F.col("component").alias("part"))


def tasks(members: DataFrame, n: int, threshold: float) -> DataFrame:
    """What each task verifies; members: component, id, copies, n_shingles, bands, text.

    Sizes are summed and written before they are joined, so a large component or bucket is split in the join.
    """
    sums = (F.sum("n_shingles").alias("s"), F.count("*").alias("m"))
    rest = ["id", "copies", "bands", "text"]
    total = members.agg(F.sum("n_shingles")).first()[0] or 0
    grp = F.concat(F.lit("s"), F.pmod(F.xxhash64("component"), F.lit(max(1, total // 400_000))).cast("string"))

    def whole(rows: DataFrame) -> DataFrame:
        return rows.select(grp.alias("grp"), F.col("component").alias("comp"), F.lit(None).cast("long").alias("bucket"), F.lit(0).alias("side"), F.lit(True).alias("within"), F.lit(False).alias("split"), *rest)

    def large_of(sizes: DataFrame) -> DataFrame:
        return stored(sizes.agg(*sums).where(~fits("s", "m")).select("component"))

    large = large_of(members.groupBy("component"))
    if large.isEmpty():
        return whole(members)
    alone, crowd = members.join(large, "component", "left_anti"), members.join(large, "component", "left_semi")
    parts = stored(parted(crowd, n, threshold))
    named = stored(parts.join(members.select(F.col("id").alias("_id"), "n_shingles"), F.col("id") == F.col("_id")).select("id", F.col("part").alias("component"), "n_shingles"))
    large = large_of(named.groupBy("component"))
    crowd = crowd.drop("component").join(named.select(F.col("id").alias("_id"), "component"), F.col("id") == F.col("_id")).drop("_id")
    small = crowd.join(large, "component", "left_anti")

    by_bucket = crowd.join(large, "component", "left_semi").withColumn("bucket", F.explode("bands"))
    counted = by_bucket.groupBy("component", "bucket").agg(*sums).where("m > 1")
    blocks = stored(counted.select(F.col("component").alias("_component"), F.col("bucket").alias("_bucket"), F.greatest(F.ceil(F.col("s") / BLOCK_SHINGLES), F.ceil(F.col("m") / PART_NODES)).cast("int").alias("n_blocks")))
    placed = by_bucket.join(blocks, (by_bucket["bucket"] == blocks["_bucket"]) & (by_bucket["component"] == blocks["_component"])).withColumn("side", F.pmod(F.xxhash64("id"), F.col("n_blocks")).cast("int"))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)))
    of = F.concat_ws(":", "component", "bucket", F.least("side", "other"), F.greatest("side", "other"))
    split = placed.select(of.alias("grp"), F.col("bucket").alias("comp"), "bucket", "side", (F.col("side") == F.col("other")).alias("within"), F.lit(True).alias("split"), *rest)
    return whole(alone).unionByName(whole(small)).unionByName(split)


def linked_nodes(docs: DataFrame, texts: DataFrame, n: int, threshold: float, recall: float, rows: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(doc_id, node, ..) of each row; (id, node, rep, copies, ..) of each node; (id, root, node, rep) of the linked nodes; (id, links, ..) by task.

    `texts` has one text of each node. Nodes are numbered for this run, and results don't depend on the numbers.
    """
    signed = stored(signatures(docs, n, n_bands(threshold, recall, rows), rows))
    grouped = signed.groupBy("node").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.max("n_shingles").alias("n_shingles"), F.first("bands").alias("bands"))
    nodes = stored(grouped.withColumn("id", F.monotonically_increasing_id()))
    banded = nodes.select("id", F.explode("bands").alias("key"))
    buckets = stored(banded.groupBy("key").agg(F.min("id").alias("least"), F.count("*").alias("n")).where("n > 1").select(F.col("key").alias("_key"), "least"))
    edges = banded.join(buckets, banded["key"] == buckets["_key"]).select(F.col("id").alias("u"), F.col("least").alias("v"))
    groups = stored(components(edges))

    members = nodes.join(groups, nodes["id"] == groups["node"]).select(nodes["node"], "id", "copies", "n_shingles", "bands", "component")
    checked = stored(verify(tasks(stored(members.join(texts, "node").drop("node")), n, threshold), n, threshold))
    across = components(checked.where("split").select(F.col("id").alias("u"), F.col("root").alias("v"))).select(F.col("node").alias("id"), F.col("component").alias("root"))
    named = checked.where("not split").select("id", "root").unionByName(across)
    return signed, nodes, named.join(nodes.select("id", "node", "rep"), "id"), checked


def jaccard_classes(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, recall: float = RECALL, rows: int = ROWS) -> DataFrame:
    """(doc_id, class_id, n_links) of each row: the least id linked directly or through others, and how many rows are at the threshold or above."""
    return settled(lambda: _classes(docs, n, threshold, recall, rows))


def _classes(docs: DataFrame, n: int, threshold: float, recall: float, rows: int) -> DataFrame:
    texts = node_rows(docs.select("doc_id", "text"), n).select("node", F.col("row.c1").alias("text"))
    signed, nodes, named, checked = linked_nodes(docs, texts, n, threshold, recall, rows)
    least = named.groupBy("root").agg(F.min("rep").alias("class_id"))
    links = checked.groupBy("id").agg(F.sum("links").alias("links"))
    info = nodes.select("id", "node", "rep", "copies").join(named.select("id", "root").join(stored(least), "root"), "id", "left").join(links, "id", "left")
    info = stored(info.select("node", F.coalesce("class_id", "rep").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")))  # a plain join follows, which Spark can split where a text has many copies
    return signed.select("doc_id", "node").join(info, "node").select("doc_id", "class_id", "n_links")


def representatives(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, recall: float = RECALL, rows: int = ROWS) -> DataFrame:
    """Exactly one row of each class: of the node with the least id (null last), its first row.

    Classes are of texts, not of ids: another text under a dropped row's id stays. Texts without words are a class by
    id, in which null counts as an id.
    """
    first = stored(node_rows(docs, n))
    named = linked_nodes(docs, first.select("node", F.col("row.c1").alias("text")), n, threshold, recall, rows)[2]
    best = stored(named.groupBy("root").agg(F.min(F.struct(F.col("rep").isNull().alias("no_id"), "rep", "node")).alias("best")))
    gone = named.join(best, "root").where(F.col("node") != F.col("best.node")).select("node")
    place = {c: i for i, c in enumerate(["doc_id", "text", *[c for c in docs.columns if c not in ("doc_id", "text")]])}
    return first.join(gone, "node", "left_anti").select(*[F.col("row")[f"c{place[c]}"].alias(c) for c in docs.columns])


def op6_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_classes(table(spark, sf_dir, "documents"))
