"""Documents dealt into chunks, and packed messages between chunks and shards.

Several operators compare strings far smaller than documents.  A row for each would cost many
times the input, so a chunk (a few MB of documents) sends one packed array to each shard (a range
of hash values) that it has something for, and the shard's answer comes back as one packed array:
never more messages than there are strings.  Every hash stands once in a chunk's message however
often the chunk repeats it, and shards are cut by hash, so neither a frequent string nor a frequent
source makes a task large.

Rows are dealt by a hash of id, text and the place they are read from, so that no id, null included,
and no text that repeats under one id meets in a chunk; a chunk holds a document whole.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import gone_at_the_end
from .common import made, partitions, shared_dir, shuffle_files_let_go

CHUNK_BYTES = 4 << 20
#: Ranges of ids have cut points on the driver: eight bytes for each, at most so many.
MOST_CHUNKS = 100_000


def row_place(docs: DataFrame) -> Column | None:
    """A hash of each row's file and its place in it, the same however the scan is split; None where docs isn't read straight from files."""
    place = F.xxhash64("_metadata.file_path", "_metadata.row_index")
    try:
        docs.select(place)
    except AnalysisException:
        return None
    return place


class Chunked:
    """A table by chunk: (chunk, doc_id, order, text, ..); `order` is a hash of id and text.

    Written in buckets by chunk, it is read again and again without a shuffle; else each pass shuffles, and less is
    on disk at once. Passes must find the same chunks, so for that rows need places in files; where they have none the table is written.
    """

    def __init__(self, docs: DataFrame, extra: Sequence[str] = (), chunk_bytes: int = CHUNK_BYTES, bucketed: bool = True):
        spark = docs.sparkSession
        self.bytes = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        self.n_chunks = max(1, -(-self.bytes // chunk_bytes))
        most = int(spark.conf.get("spark.sql.sources.bucketing.maxBuckets"))
        n = min(most, self.n_chunks, max(partitions(spark), self.n_chunks // 4))
        self.name = f"chunks_{uuid.uuid4().hex}"
        order = F.xxhash64("doc_id", "text")
        place = None if bucketed else row_place(docs)
        bucketed = place is None
        chunk = F.pmod(F.xxhash64(order, F.spark_partition_id() if bucketed else place), F.lit(self.n_chunks)).cast("int")
        rows = docs.select(chunk.alias("chunk"), F.col("doc_id").cast("long"), order.alias("order"), "text", *extra)
        if not bucketed:
            self.table = rows
            return
        path = f"{shared_dir(spark)}/{self.name}"
        with shuffle_files_let_go(spark):
            rows.repartition(n, "chunk").write.bucketBy(n, "chunk").option("compression", "zstd").option("path", path).saveAsTable(self.name)
        made(gone_at_the_end(spark, path), self.name)
        self.table = spark.table(self.name)

    def each(self, f: Callable[[pa.Table], pa.Table], schema: str) -> DataFrame:
        return self.table.groupBy("chunk").applyInArrow(f, schema)

    def with_answers(self, answers: DataFrame, f: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
        """f(a chunk's documents, the answers to it); a chunk without answers gets none of their rows."""
        return self.table.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(f, schema)

    def n_shards(self, unit: int) -> int:
        """Shards such that each gets what about `unit` bytes of text send."""
        return max(1, -(-self.bytes // unit))


MESSAGE = "chunk int, shard int, data binary"


def message(parts: list[tuple[int, int, bytes]]) -> pa.Table:
    chunk, shard, data = zip(*parts, strict=True) if parts else ((), (), ())
    return pa.table({"chunk": pa.array(chunk, pa.int32()), "shard": pa.array(shard, pa.int32()), "data": pa.array(data, pa.binary())})


def cut_points(docs: DataFrame, chunk_bytes: int) -> tuple[list[int], int]:
    """Ids at which chunks begin, by quantiles over all rows; and the bytes of all texts."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = min(MOST_CHUNKS, max(1, -(-size // chunk_bytes)))
    if n == 1:
        return [], size
    marks = [k / n for k in range(1, n)]
    found = docs.agg(F.percentile_approx(F.col("doc_id").cast("long"), marks, max(10_000, 20 * n))).first()[0]
    return sorted(set(found or [])), size


def chunk_of(doc_id: Column, cuts: list[int]) -> Column:
    """How many cuts are at or below the id; two short scans instead of a long one. Null ids fall into chunk 0."""
    if not cuts:
        return F.lit(0)
    step = max(1, int(len(cuts) ** 0.5))
    fine = F.lit(np.array(cuts, dtype=np.int64))
    coarse = F.lit(np.array(cuts[::step], dtype=np.int64))
    over = F.size(F.filter(coarse, lambda c: c <= doc_id))
    before = F.greatest(over - 1, F.lit(0)) * step
    return F.coalesce(before + F.size(F.filter(F.slice(fine, before + 1, F.lit(step)), lambda c: c <= doc_id)), F.lit(0)).cast("int")


def ranks(docs: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What a chunk's rows are ordered by, among all rows: whether there is an id (without one first), the id, half of the hash of id and text."""
    ids = docs["doc_id"]
    return ids.is_valid().to_numpy().astype(np.uint8), ids.fill_null(0).to_numpy().astype(np.int64), (docs["order"].to_numpy().astype(np.int64) >> 32).astype(np.int32)


def in_order(docs: pa.Table) -> pa.Table:
    """A chunk's rows by rank."""
    some, ids, order = ranks(docs)
    return docs.take(pa.array(np.lexsort((docs["order"].to_numpy(), order, ids, some))))


def shard_of(h: np.ndarray, n: int) -> np.ndarray:
    return ((h >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def split_by_shard(h: np.ndarray, n: int) -> list[tuple[int, slice]]:
    """Slices of sorted hashes, one for each shard that has any."""
    shard = shard_of(h, n)
    edge = np.flatnonzero(np.diff(shard, prepend=-1))
    return [] if not len(h) else [(int(shard[a]), slice(int(a), int(b))) for a, b in zip(edge, [*edge[1:], len(h)], strict=True)]
