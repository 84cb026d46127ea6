"""Readers and writers of the formats that runs leave behind."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.detections import Detector
from ..operators.reports import METRICS
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class NpyRange(InputPartition):
    def __init__(self, lo: int, hi: int):
        self.lo, self.hi = lo, hi


class NpyReader(DataSourceReader):
    """Frames of a memory-mapped array; every partition maps the file and reads its own range."""

    def __init__(self, options: dict):
        self.path, self.step, self.flip = options["path"], int(options.get("framesPerPartition", 256)), options.get("flip", "true") == "true"

    def partitions(self) -> list[InputPartition]:
        import numpy as np

        n = len(np.load(self.path, mmap_mode="r"))
        return [NpyRange(lo, min(n, lo + self.step)) for lo in range(0, n, self.step)]

    def read(self, partition: NpyRange) -> Iterator[tuple]:
        import numpy as np

        frames = np.load(self.path, mmap_mode="r")
        for i in range(partition.lo, partition.hi):
            frame = np.ascontiguousarray(frames[i][..., ::-1] if self.flip else frames[i], dtype=np.uint8)
            yield i, frame.shape[1], frame.shape[0], frame.tobytes()


class NpyFrames(DataSource):
    """spark.read.format("npy_frames").load(path): an array (frames, height, width, channels), channels reversed on load."""

    @classmethod
    def name(cls) -> str:
        return "npy_frames"

    def schema(self) -> str:
        return "frame_idx long, width int, height int, pixels binary"

    def reader(self, schema) -> DataSourceReader:
        return NpyReader(self.options)


def read_frames(spark: SparkSession, path: str, **options) -> DataFrame:
    """Frames of a saved array; other kinds of video need a decoder, which this package doesn't bring."""
    if not path.endswith(".npy"):
        raise ValueError(f"no decoder for {path}: convert it to .npy")
    spark.dataSource.register(NpyFrames)
    return spark.read.format("npy_frames").options(**options).load(path)


def replayed(frames: DataFrame, start: str, fps: float) -> DataFrame:
    """Event times of frames that are replayed from `start` at `fps`."""
    return frames.withColumn("ts", F.timestamp_micros(F.unix_micros(F.lit(start).cast("timestamp")) + F.round(F.col("frame_idx") * (1e6 / fps)).cast("long")))


def read_run_logs(spark: SparkSession, folder: str, name: str = "fps.csv", schema: str = "timestamp double, fps double") -> DataFrame:
    """One log of every run below a folder; the sub-folder's name becomes a column."""
    logs = spark.read.csv(f"{folder}/*/{name}", header=True, schema=schema)
    return logs.withColumn("folder", F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/[^/]+$", 1))


def read_config(spark: SparkSession, path: str) -> DataFrame:
    """A detector's JSON configuration with the thresholds' defaults."""
    raw = spark.read.json(path, multiLine=True)
    post = F.col("POST_PROCESS")[0]
    return raw.select(F.coalesce(post["OutputNMSThreshold"], F.lit(0.4)).alias("nms_threshold"), F.coalesce(post["OutputConfThreshold"], F.lit(0.5)).alias("score_threshold"), post["AnchorConfig"].alias("anchors"))


def read_detector(spark: SparkSession, path: str, kind: str, layers: Sequence[str]) -> Detector:
    """A detector as its JSON configuration says: input size, strides, anchors, thresholds and the labels in the file beside it."""
    raw = spark.read.json(path, multiLine=True)
    pre, post = F.col("PRE_PROCESS")[0], F.col("POST_PROCESS")[0]
    has = {f.name for f in raw.schema["POST_PROCESS"].dataType.elementType.fields}
    if "LabelsPath" not in has or "AnchorConfig" not in has:
        raise ValueError(f"{path} names no labels or no anchors")
    limit = lambda name, otherwise: F.coalesce(post[name], F.lit(otherwise)) if name in has else F.lit(otherwise)
    anchors = post["AnchorConfig"]
    one = raw.select(pre["InputW"].cast("int").alias("w"), pre["InputH"].cast("int").alias("h"), anchors["Steps"].alias("steps"), anchors["MinSizes"].alias("sizes"), limit("OutputConfThreshold", 0.5).alias("least"), limit("OutputNMSThreshold", 0.4).alias("most"), post["LabelsPath"].alias("labels")).first()  # one file
    labels = spark.read.text(f"{path.rpartition('/')[0]}/{one['labels']}", wholetext=True).select(F.from_json("value", "map<string,string>").alias("m")).first()["m"]
    return Detector(kind, tuple(layers), one["w"], one["h"], tuple(one["steps"]), tuple(map(tuple, one["sizes"])), one["least"], one["most"], labels)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def write_fps_summary(means: DataFrame, path: str, folder: str = "folder") -> None:
    """One file (folder, average_fps) of all folders, those named by numbers first and in their order."""
    rows = means.select(F.col(folder).cast("string").alias("folder"), "average_fps")  # one row for each folder
    write_csv(rows.repartition(1).sortWithinPartitions(F.expr("try_cast(folder as bigint)").asc_nulls_last(), "folder"), path)


# Columns of the statistics by step, in order, and what they are called in the table.
STEP_STATS = {"step_number": "step", "start_idx": "start_idx", "end_idx": "end_idx", "gt_mean": "gt_mean", "gt_std": "gt_std", "gt_diffnorm_std": "gt_diff_std", "rolling_mean": "sums_mean", "rolling_std": "sums_std", "rolling_diffnorm_std": "diff_std"}


def write_step_stats(stats: DataFrame, folder: str, video: str, step: int = 30, size: int = 180) -> str:
    """One video's statistics by step in one file, ordered; its name says video, step and window. Returns the path.

    A step whose rolling statistics aren't ready has the word ERROR there.
    """
    path = f"{folder}/{video}_preprocess_stats_rolling_step{step}_windowsize{size}.csv"
    late = ("rolling_mean", "rolling_std", "rolling_diffnorm_std")
    cells = [F.when(F.col("ready"), F.col(c).cast("string")).otherwise(F.lit("ERROR")).alias(n) if n in late else F.col(c).alias(n) for n, c in STEP_STATS.items()]
    write_csv(stats.select(*cells).repartition(1).sortWithinPartitions("step_number"), path)  # a row for each second of video
    return path


def write_if_any(df: DataFrame, path: str) -> bool:
    """Writes nothing for an empty table."""
    if df.isEmpty():
        return False
    write_csv(df, path)
    return True


def write_metrics(metrics: DataFrame, path: str) -> None:
    """One run's metrics (ord, metric, value), a row for each in the report's order, in one file."""
    write_csv(metrics.orderBy("ord").select(F.col("metric").alias("Metric"), F.col("value").alias("Value")).coalesce(1), path)  # ten rows by construction


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    """A run's metrics as (ord, metric, value); fails where the report has another metric or lacks one of the ten."""
    known = spark.createDataFrame(list(enumerate(METRICS)), "ord int, known string")
    rows = spark.read.csv(path, header=True, schema="Metric string, Value double")
    both = known.join(rows, known["known"] == rows["Metric"], "full")
    whole = F.assert_true(F.col("known").isNotNull() & F.col("Metric").isNotNull(), F.concat_ws(" ", F.lit("not a metrics report:"), F.coalesce("Metric", "known")))
    return both.withColumn("_ok", whole).where("_ok is null").select("ord", F.col("Metric").alias("metric"), F.col("Value").alias("value"))


def write_logs(folder: str, fps: DataFrame, heart_rates: DataFrame, metrics: DataFrame) -> None:
    """All logs of a run at its end: fps.csv, heart_rate.csv where there is any rate, processing_metrics.csv."""
    write_csv(fps, f"{folder}/fps.csv")
    write_if_any(heart_rates, f"{folder}/heart_rate.csv")
    write_metrics(metrics, f"{folder}/processing_metrics.csv")


def write_by_run(df: DataFrame, path: str, *parts: str) -> None:
    df.write.mode("overwrite").partitionBy(*parts).parquet(path)


# The subjects that the public recordings exclude.
EXCLUDED = (2, 6, 7, 19, 21, 28, 29)


def subjects(spark: SparkSession, last: int = 49, without=EXCLUDED) -> DataFrame:
    """Subject numbers of the public recordings, without those that are excluded."""
    gone = spark.createDataFrame([(i,) for i in without], "idx long")
    return spark.range(1, last + 1).withColumnRenamed("id", "idx").join(gone, "idx", "left_anti")
