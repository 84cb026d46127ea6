"""Run reports: rates of frames, stage times, gates and the latest heart rates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Rows of the metrics report, in order.
METRICS = ("Processing Count", "Total Processing Time", "Face Detection Time", "Face Tracking Time", "ROI Selection Time", "Core Time", "Skipped Frames", "Start Time", "End Time", "Average FPS")


def frames_per_second(df: DataFrame, ts: str = "ts") -> DataFrame:
    """Frames in each whole second of event time."""
    return df.groupBy(F.floor(F.unix_micros(F.col(ts).cast("timestamp")) / 1_000_000).alias("second")).agg(F.count("*").alias("frames"))


def mean_rates(df: DataFrame, folder: str, value: str) -> DataFrame:
    """Mean by folder without NaN and null, 0 if nothing is left."""
    return df.groupBy(folder).agg(F.coalesce(F.avg(F.nanvl(value, F.lit(None).cast("double"))), F.lit(0.0)).alias("average_fps"))


def rate_extremes(means: DataFrame, folder: str) -> DataFrame:
    """The mean of the folders' means, the highest and the lowest with their folders."""
    return means.agg(F.avg("average_fps").alias("mean_fps"), F.max("average_fps").alias("max_fps"), F.max_by(folder, F.struct("average_fps", folder)).alias("max_folder"), F.min("average_fps").alias("min_fps"), F.min_by(folder, F.struct("average_fps", folder)).alias("min_folder"))


def numeric_order(df: DataFrame, folder: str) -> DataFrame:
    """Sorted by number where the name is one; other names follow."""
    return df.orderBy(F.expr(f"try_cast({folder} as bigint)").asc_nulls_last(), folder)


def as_metrics(df: DataFrame, keys: Sequence[str], columns: dict[str, str]) -> DataFrame:
    """Wide totals as rows (keys, ord, metric, value) in the report's order."""
    rows = [F.struct(F.lit(METRICS.index(m)).alias("ord"), F.lit(m).alias("metric"), F.col(c).cast("double").alias("value")) for m, c in columns.items()]
    return df.select(*keys, F.explode(F.array(*rows)).alias("_m")).select(*keys, "_m.ord", "_m.metric", "_m.value")


def complete_runs(metrics: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Runs that skipped no frame."""
    return metrics.where((F.col("metric") == "Skipped Frames") & (F.col("value") == 0)).select(*keys)


def dropped_frames(df: DataFrame, keys: Sequence[str], number: str) -> DataFrame:
    """Frames of each key that load shedding left out: numbers missing between the first and the last."""
    span = F.max(number) - F.min(number) + 1
    return df.groupBy(*keys).agg(F.count_distinct(number).alias("frames"), (span - F.count_distinct(number)).cast("long").alias("dropped"))


def latest(df: DataFrame, key: str, value: str, order: Sequence[str]) -> DataFrame:
    return df.groupBy(key).agg(F.max_by(value, F.struct(*order)).alias(value))


def as_of(frames: DataFrame, rates: DataFrame, key: str, value: str, ts: str, tie: str, coarse: Column | None = None) -> DataFrame:
    """Each row of frames with the value of the key's last rate that isn't later than it; of rates of one time the one with the highest tie.

    Both are brought together by time and the last rate is carried on. With `coarse`, time cut to hours say, it is carried
    inside each (key, coarse) and from there on to the later ones, so a key is dealt to many tasks.
    """
    of = coarse if coarse is not None else F.lit(0)
    own = frames.select(F.col(key).alias("_key"), of.alias("_of"), F.col(ts).alias("_ts"), F.lit(1).alias("_kind"), F.lit(None).cast("long").alias("_tie"), F.lit(None).cast(rates.schema[value].dataType).alias("_v"), F.struct(*frames.columns).alias("_row"))
    their = rates.select(F.col(key).alias("_key"), of.alias("_of"), F.col(ts).alias("_ts"), F.lit(0).alias("_kind"), F.col(tie).cast("long").alias("_tie"), F.col(value).alias("_v"), F.lit(None).cast(own.schema["_row"].dataType).alias("_row"))
    mark = F.when(F.col("_kind") == 0, F.struct(F.col("_v").alias("v")))
    w = Window.partitionBy("_key", "_of").orderBy("_ts", "_kind", "_tie").rowsBetween(Window.unboundedPreceding, 0)
    carried = own.unionByName(their).withColumn("_last", F.last(mark, ignorenulls=True).over(w)).where("_kind = 1")
    end = F.max_by(mark, F.when(F.col("_kind") == 0, F.struct("_ts", "_tie")))
    parts = own.drop("_row").unionByName(their.drop("_row")).groupBy("_key", "_of").agg(end.alias("_end"))
    ahead = Window.partitionBy("_key").orderBy("_of").rowsBetween(Window.unboundedPreceding, -1)
    before = parts.select(F.col("_key").alias("_k"), F.col("_of").alias("_o"), F.last("_end", ignorenulls=True).over(ahead).alias("_before"))
    both = carried.join(before, F.col("_key").eqNullSafe(F.col("_k")) & F.col("_of").eqNullSafe(F.col("_o")), "left")
    known = F.when(F.col("_last").isNotNull(), F.col("_last.v")).otherwise(F.col("_before.v"))
    return both.select("_row.*", known.alias(value))


def shown_text(face: Column, rate: Column) -> Column:
    """The text beside a face."""
    return F.concat(face.cast("string"), F.lit(" | "), F.when(rate.isNotNull(), F.format_string("%.1f", rate)).otherwise(F.lit("--")))


def displayed(tracks: DataFrame, regions: DataFrame, rates: DataFrame, keys: Sequence[str], rate_keys: Sequence[str]) -> DataFrame:
    """Tracks with their region and latest heart rate, where there are any."""
    return tracks.join(regions, list(keys), "left").join(rates, list(rate_keys), "left")


def update_rate(df: DataFrame, key: str, seconds: int, ts: str = "ts") -> DataFrame:
    """Rows of the key in the last `seconds`, by second."""
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    w = Window.partitionBy(key).orderBy("_t").rangeBetween(-seconds * 1_000_000, 0)
    return df.withColumn("_t", micros).withColumn("rate", F.count("*").over(w) / F.lit(float(seconds))).drop("_t")


def recent_mean(df: DataFrame, key: str, value: str, order: Sequence[str], rows: int = 10) -> DataFrame:
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(-(rows - 1), 0)
    return df.withColumn("recent_mean", F.avg(value).over(w))


def expired(df: DataFrame, key: str, timeout: float, ts: str = "ts") -> DataFrame:
    """Keys whose last row is more than `timeout` seconds older than the table's last, and by how much."""
    seen = df.groupBy(key).agg(F.max(F.unix_micros(F.col(ts).cast("timestamp"))).alias("_seen"))
    now = seen.agg(F.max("_seen").alias("_now"))
    idle = (F.col("_now") - F.col("_seen")) / 1e6
    return seen.join(F.broadcast(now)).where(idle > timeout).select(key, idle.alias("idle_seconds"))  # one row


def root_mean_square_error(df: DataFrame, keys: Sequence[str], a: str, b: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.sqrt(F.avg((F.col(a) - F.col(b)) * (F.col(a) - F.col(b)))).alias("rmse"))
