"""Helpers that several corpus operators share."""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Callable, Iterable
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import file_system, gone_at_the_end, shared_dir, table

__all__ = ["bounded", "columns", "fitted", "fold", "free", "let_go", "n_words", "made", "mapped", "partitions", "settled", "shared_dir", "shuffle_files_let_go", "stored", "table"]

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
WORD = r"[^\x20\x09-\x0D]+"


#: Folders and tables made inside temporary(), innermost last.
_MADE: list[list[tuple[str, str | None]]] = []


def made(path: str, name: str | None = None) -> None:
    if _MADE:
        _MADE[-1].append((path, name))


@contextmanager
def shuffle_files_let_go(spark: SparkSession):
    """The shuffle files of the writes inside are let go when they are done, as nothing reads them again."""
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


def stored(df: DataFrame) -> DataFrame:
    """df written once to the shared folder and read back: cuts lineage, survives lost executors; it goes when the driver ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/stored-{uuid.uuid4().hex}"
    with shuffle_files_let_go(spark):
        df.write.option("compression", "zstd").parquet(path)
    made(gone_at_the_end(spark, path))
    return spark.read.schema(df.schema).parquet(path)


def settled(plan: Callable[[], DataFrame]) -> DataFrame:
    """The rows of plan(), stored; what it stored on the way is deleted when they are."""
    _MADE.append([])
    try:
        out = plan()
        spark = out.sparkSession
        own = _MADE[-1]
        _MADE.append([])
        out = stored(out)
        kept = _MADE.pop()
    finally:
        _MADE.pop()
    for path, name in own:
        _drop(spark, path, name)
    if _MADE:
        _MADE[-1] += kept
    return out


@contextmanager
def let_go(spark: SparkSession):
    """What is stored inside is deleted when it is over; nothing that is read later may rest on it."""
    _MADE.append([])
    try:
        yield
    finally:
        for path, name in _MADE.pop():
            _drop(spark, path, name)


def _drop(spark: SparkSession, path: str, name: str | None) -> None:
    if name:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    store, where = file_system(spark, path)
    store.delete(where, True)


def columns(names: Iterable[str]) -> list[Column]:
    """Columns by their exact names, dots and backticks included."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in names]


def free(docs: DataFrame | Iterable[str], name: str) -> str:
    """`name`, or where docs has it `name_2` and so on: what an operator adds never replaces a column of its input."""
    taken, k, out = {c.lower() for c in (docs.columns if isinstance(docs, DataFrame) else docs)}, 1, name
    while out.lower() in taken:
        k += 1
        out = f"{name}_{k}"
    return out


def mapped(df: DataFrame, run: Callable, schema) -> DataFrame:
    """df.mapInArrow(run, schema) for columns of any name; run sees them by place."""
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))]).mapInArrow(run, schema)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def fold(doc_id: str | Column = "doc_id") -> Column:
    """crc32 of the id as text, modulo 3; 1 is the held-out fold (a null id is held out)."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(c.cast("string").cast("binary")) % 3, F.lit(1))


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def bounded(rows: DataFrame, by: str, most_bytes: int) -> DataFrame:
    """Of a sample (doc_id, text, `by`, ..) one row for each id, and for each value of `by` as many, by hash of the id, as `most_bytes` of text hold; the first one always."""
    rest = [c for c in rows.columns if c != "doc_id"]
    one = rows.groupBy("doc_id").agg(F.min(F.struct(*rest)).alias("row")).select("doc_id", *[F.col(f"row.{c}").alias(c) for c in rest])
    w = Window.partitionBy(by).orderBy(F.xxhash64("doc_id", F.lit(9)), "doc_id")
    size = F.sum(F.octet_length("text")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    placed = one.withColumns({"_nth": F.row_number().over(w), "_bytes": size})
    return placed.where((F.col("_nth") == 1) | (F.col("_bytes") <= most_bytes)).drop("_nth", "_bytes")


def fitted(rows: DataFrame, fit: Callable[[pa.Table], object]) -> object | None:
    """A model fitted on a bounded sample, in one task; only the model comes to the driver. None without rows."""

    def run(batches):
        parts = [b for b in batches if b.num_rows]
        if parts:
            sample = pa.Table.from_batches(parts)
            model = fit(sample.sort_by([(c, "ascending") for c in ("doc_id", "text")]))
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], names=["model"])

    got = rows.repartition(1).mapInArrow(run, "model binary").collect()
    return pickle.loads(got[0]["model"]) if got else None
