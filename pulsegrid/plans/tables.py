"""The given tables as colour traces, frames and boxes.

There are no videos here, so supplier keys stand for subjects and users for faces; values are whole
numbers so that sums don't depend on their order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import windows
from ..session import table

SIZE = 180
#: Rows of a task, about.
ROWS = 1 << 18


def parts(spark: SparkSession, sf_dir: str, name: str) -> int:
    """Into how many tasks a table's rows are dealt, so that a task's rows don't grow with the table; the count is in the files' footers."""
    return max(spark.sparkContext.defaultParallelism, -(-table(spark, sf_dir, name).count() // ROWS))


def traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(face_id, pos, r, g, b) from line items, by supplier and date."""
    item = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", "l_tax")
    placed = windows.positions(item, "l_suppkey", ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"], coarse=F.date_trunc("month", "l_shipdate"), parts=parts(spark, sf_dir, "lineitem"))
    return placed.select(F.col("l_suppkey").alias("face_id"), "pos", F.col("l_quantity").alias("r"), F.round("l_extendedprice").alias("g"), (F.round(F.col("l_tax") * 100) + 1).alias("b"))


def trace_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.tumbling(traces(spark, sf_dir), "face_id", SIZE, parts(spark, sf_dir, "lineitem"))


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(face_id, pos, ts, v) from events, by user and time."""
    placed = windows.positions(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], coarse=F.date_trunc("day", "ts"), parts=parts(spark, sf_dir, "events"))
    return placed.select(F.col("user_id").alias("face_id"), "pos", "ts", "event_id", "event_type", F.round(F.col("value") * 100).alias("v"))


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(frame_idx, det, x1, y1, x2, y2, score) from parts: forty frames to every thousand parts."""
    p = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    return p.select(F.floor(k / 25).alias("frame_idx"), (k % 25).alias("det"), ((k * 37) % 500).cast("int").alias("x1"), ((k * 53) % 300).cast("int").alias("y1"), ((k * 37) % 500 + F.col("p_size") * 4 + 10).cast("int").alias("x2"), ((k * 53) % 300 + (k % 50) * 3 + 10).cast("int").alias("y2"), F.round(F.pmod(k * 7919, F.lit(1000)) / 1000.0, 3).alias("score"))
