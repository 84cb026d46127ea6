"""All queries over the given tables, and the SQL that gives the same rows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import filters, scalar
from ..operators import detections, faces, geometry, pixels, pulse, reports, tracking, windows
from ..session import gone_at_the_end, shared_dir, table
from ..sources import frames
from ..streaming import chunks, display, heart_rate
from .oracles import SQL
from .tables import SIZE, boxes, parts, samples, trace_windows, traces

QUERIES = {}
WIN = ["face_id", "win_id"]


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def rgb_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traces(spark, sf_dir)


@query
def tumbling_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trace_windows(spark, sf_dir).groupBy(*WIN).agg(F.count("*").alias("n"), F.round(F.sum("r") / F.count("*"), 6).alias("mean_r"), F.round(F.sum("g") / F.count("*"), 6).alias("mean_g"))


@query
def sliding_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.sliding(traces(spark, sf_dir), "face_id", SIZE, 30).groupBy(*WIN).agg(F.count("*").alias("n"), F.round(F.sum("g") / F.count("*"), 6).alias("mean_g"))


@query
def chunk_close(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.chunk_ends(traces(spark, sf_dir)).select("face_id", "chunk_id", F.col("pos").alias("closing_pos"))


@query
def rolling_mean_std(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = windows.rolling_stats(traces(spark, sf_dir), "face_id", "r", SIZE, parts=parts(spark, sf_dir, "lineitem"))
    return rows.select("face_id", "pos", F.col("n").cast("long"), F.round("roll_mean", 6).alias("roll_mean"), F.round("roll_std", 6).alias("roll_std"))


@query
def rolling_diff_std(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = windows.rolling_diff_std(traces(spark, sf_dir), "face_id", "r", SIZE, parts=parts(spark, sf_dir, "lineitem"))
    return rows.select("face_id", "pos", F.round("diff_std", 5).alias("diff_std"))


@query
def chunk_standardized(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = windows.standardised_chunks(traces(spark, sf_dir), "face_id", "r", SIZE, parts=parts(spark, sf_dir, "lineitem"))
    return rows.select("face_id", "pos", "chunk_id", F.round("std_value", 5).alias("std_value"), F.round("diff_value", 4).alias("diff_value"))


@query
def six_channel_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closed chunks as a network's input: differences of three channels, then the standardised channels."""
    rows = windows.six_channel_chunks(traces(spark, sf_dir), "face_id", ["r", "g", "b"], SIZE, parts=parts(spark, sf_dir, "lineitem"))
    return rows.select("face_id", "pos", "chunk_id", *[F.round(F.get("input", F.lit(i)), 4).alias(f"c{i}") for i in range(6)])


@query
def clip_zscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = windows.z_scored(trace_windows(spark, sf_dir), WIN, "r")
    return rows.select("face_id", "win_id", "at", F.round("z", 5).alias("z"))


@query
def diff_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = windows.diff_normalised(trace_windows(spark, sf_dir), WIN, "r")
    return rows.select("face_id", "win_id", "at", F.round("dn", 5).alias("dn"))


@query
def window_truth_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean and deviation of the growing, then sliding windows that rolling statistics are held against."""
    rows = windows.step_stats(traces(spark, sf_dir), "face_id", "r", parts=parts(spark, sf_dir, "lineitem"))
    return rows.select("face_id", "step", "n", F.round("mean", 6).alias("mean_r"), F.round("std", 6).alias("std_r"))


@query
def variance_formulas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three formulas of the variance of each window, which must agree."""
    w = trace_windows(spark, sf_dir)
    mean = F.sum("r") / F.count("*")
    return w.groupBy(*WIN).agg(F.round(F.sum(F.col("r") * F.col("r")) / F.count("*") - mean * mean, 4).alias("by_moments"), F.round(F.var_pop("r"), 4).alias("by_deviations"), F.round(F.pow(F.stddev_pop("r"), F.lit(2.0)), 4).alias("by_std"))


@query
def cumsum_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pulse.integrated(trace_windows(spark, sf_dir), WIN, "g").select("face_id", "win_id", "at", "total")


@query
def pos_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pulse.plane_orthogonal(trace_windows(spark, sf_dir), WIN, SIZE)
    return rows.select("face_id", "win_id", "at", F.round("h", 4).alias("h"))


@query
def pos_heart_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plane-orthogonal pulse, its own detrending and band-pass, then the rate's detrending, band-pass and periodogram, as one weighted sum."""
    rows = pulse.plane_orthogonal(trace_windows(spark, sf_dir), WIN, SIZE)
    return pulse.spectral_rate(rows, WIN, "h", SIZE, detrended=True, filtered=True, own_band=pulse.PLANE_BAND)


@query
def chrom_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chrominance overlap-add without the stretches' filter."""
    rows = pulse.chrominance(trace_windows(spark, sf_dir), WIN, SIZE, filtered=False)
    return rows.select("face_id", "win_id", "at", F.round("s", 4).alias("s"))


@query
def chrom_heart_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pulse.chrominance(trace_windows(spark, sf_dir), WIN, SIZE)
    return pulse.spectral_rate(rows, WIN, "s", 168, detrended=True, filtered=True)


@query
def ica_heart_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pulse.independent_component(trace_windows(spark, sf_dir), WIN, "face_id long, win_id long", SIZE)
    long = rows.select(*WIN, F.posexplode("pulse").alias("at", "v"))
    return pulse.spectral_rate(long, WIN, "v", SIZE, detrended=True, filtered=True)


@query
def guided_ica_heart_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pulse.guided_component(trace_windows(spark, sf_dir), WIN, "face_id long, win_id long", SIZE)
    long = rows.select(*WIN, F.posexplode("pulse").alias("at", "v"))
    return pulse.spectral_rate(long, WIN, "v", SIZE, detrended=True, filtered=True)


@query
def moving_average_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pulse.moving_average(trace_windows(spark, sf_dir), WIN, "r", 60)
    return rows.select("face_id", "win_id", "at", F.round("smooth", 6).alias("smooth"))


@query
def clip_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole clips of the rows that fill them, checked."""
    t = trace_windows(spark, sf_dir)
    return pulse.whole_clips(t, "face_id", SIZE).select("face_id", "pos", "clip_id")


@query
def hr_fft_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: the periodogram's strongest in-band bin of each subject's windows."""
    return pulse.spectral_rate(trace_windows(spark, sf_dir), WIN, "g", SIZE)


@query
def hr_full_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Integration, detrending, zero-phase band-pass and periodogram."""
    return pulse.spectral_rate(trace_windows(spark, sf_dir), WIN, "r", SIZE, cumulative=True, detrended=True, filtered=True)


@query
def hr_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pulse.peak_rate(trace_windows(spark, sf_dir), WIN, "r")
    return rows.select("face_id", "win_id", "n_peaks", F.round("heart_rate", 6).alias("heart_rate"))


@query
def detrend_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Smoothness-prior detrending of 24-sample windows."""
    w = windows.tumbling(samples(spark, sf_dir), "face_id", 24)
    return pulse.matrix_applied(w, WIN, "v", filters.detrend_matrix(24)).select(*WIN, "at", F.round("y", 4).alias("y"))


@query
def bandpass_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Zero-phase band-pass of 24-sample windows."""
    w = windows.tumbling(samples(spark, sf_dir), "face_id", 24)
    return pulse.matrix_applied(w, WIN, "v", filters.filtfilt_matrix(24, 1, 0.75, 2.5, 30.0)).select(*WIN, "at", F.round("y", 4).alias("y"))


@query
def chunk_hr_emission(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heart rates from the last six chunks' signals, once in six chunks."""
    t = traces(spark, sf_dir).withColumn("chunk_id", F.floor(F.col("pos") / 30))
    closed = windows.chunk_ends(traces(spark, sf_dir)).select("face_id", "chunk_id")
    chunks = t.groupBy("face_id", "chunk_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "r"))), lambda s: s["r"]).alias("bvp")).join(closed, ["face_id", "chunk_id"])
    full = windows.chunk_buffers(chunks, "face_id", "bvp").select("face_id", F.col("chunk_id").alias("win_id"), F.posexplode("buffer").alias("at", "v"))
    return pulse.spectral_rate(full, WIN, "v", SIZE).withColumnRenamed("win_id", "chunk_id")


@query
def chunk_rates_held(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every closed chunk with the heart rate that is shown after it: the last one that was emitted."""
    closed = windows.chunk_ends(traces(spark, sf_dir)).select("face_id", "chunk_id")
    all_chunks = closed.join(chunk_hr_emission(spark, sf_dir).select("face_id", "chunk_id", "heart_rate"), ["face_id", "chunk_id"], "left")
    held = F.last("heart_rate", ignorenulls=True).over(Window.partitionBy("face_id").orderBy("chunk_id").rowsBetween(Window.unboundedPreceding, 0))
    return all_chunks.select("face_id", "chunk_id", held.alias("heart_rate"))


@query
def rolling_against_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rolling mean and deviation at the end of each step of 30 frames, those of the truth's window, and the difference by subject."""
    rolled = windows.rolling_stats(traces(spark, sf_dir), "face_id", "r", SIZE, parts=parts(spark, sf_dir, "lineitem")).where("pos % 30 = 29")
    both = rolled.select("face_id", F.floor(F.col("pos") / 30).alias("step"), "roll_mean", "roll_std").join(window_truth_stats(spark, sf_dir), ["face_id", "step"])
    rmse = F.sqrt(F.avg((F.col("roll_mean") - F.col("mean_r")) * (F.col("roll_mean") - F.col("mean_r"))))
    return both.groupBy("face_id").agg(F.count("*").alias("steps"), F.round(rmse, 5).alias("rmse_mean"), F.round(F.max(F.abs(F.col("roll_std") - F.col("std_r"))), 5).alias("most_std"))


@query
def rolling_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three rolling forms at the end of each step beside the truth of the step's window, with both deviations of differences and the ready flag."""
    rows = windows.rolling_forms(traces(spark, sf_dir), "face_id", "r", SIZE, parts=parts(spark, sf_dir, "lineitem"))
    both = rows.withColumn("step", F.floor(F.col("pos") / 30))
    named = [c for c in both.columns if c.endswith(("_mean", "_std"))]
    return both.select("face_id", "step", "start_idx", "end_idx", "ready", *[F.round(c, 5).alias(c) for c in named])


@query
def square_roi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geometry.square_region(boxes(spark, sf_dir), 640, 360, 1.5).select("frame_idx", "det", "rx1", "ry1", "rx2", "ry2")


@query
def full_roi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes with an area after clipping to a small frame."""
    b = boxes(spark, sf_dir).withColumns({c: F.least(F.col(c), F.lit(200)) for c in ("x1", "x2", "y1", "y2")})
    return geometry.full_region(b).select("frame_idx", "det", "x1", "y1", "x2", "y2")


@query
def rescaled_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boxes(spark, sf_dir).select("frame_idx", "det", *[(F.col(c) * 0.5).cast("int").alias(c) for c in ("x1", "y1", "x2", "y2")])


def _images(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boxes(spark, sf_dir).select("frame_idx", "det", ((F.col("x2") % 5 + 3) * 160).alias("iw"), ((F.col("y2") % 4 + 3) * 160).alias("ih"), F.col("x1").cast("double").alias("x"), F.col("y1").cast("double").alias("y"))


@query
def letterbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geometry.letterbox(_images(spark, sf_dir), 640, 640).select("frame_idx", "det", "nw", "nh", "dx", "dy", F.round("gain", 6).alias("gain"))


@query
def unletterbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = geometry.unletterbox(geometry.letterbox(_images(spark, sf_dir), 640, 640), "x", "y", 640, 640)
    return rows.select("frame_idx", "det", F.round("ox", 4).alias("ox"), F.round("oy", 4).alias("oy"))


def _raw(spark: SparkSession, sf_dir: str, anchors: int) -> DataFrame:
    k = F.col("l_orderkey") * 7 + F.col("l_linenumber")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.pmod(k * 31 + F.col("l_partkey"), F.lit(anchors)).alias("anchor_id"), (F.col("l_quantity") / 10).alias("d0"), (F.col("l_discount") * 20).alias("d1"), (F.col("l_quantity") / 25).alias("d2"), (F.col("l_tax") * 25 + 0.0).alias("d3"))


_KEYS = ["l_orderkey", "l_linenumber", "l_partkey", "anchor_id"]


def _rounded(df: DataFrame, names, digits: int = 4) -> DataFrame:
    return df.select(*_KEYS, *[F.round(F.col(c) + 0.0, digits).alias(c) for c in names])


@query
def decode_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distance form, on the 16800 corner anchors of a 640 x 640 detector."""
    rows = _raw(spark, sf_dir, 16800).join(F.broadcast(geometry.grid_anchors(spark)), "anchor_id")  # 16800 rows by construction
    return _rounded(geometry.distance_boxes(rows, 640, 640), ["x1", "y1", "x2", "y2"])


@query
def decode_landmarks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _raw(spark, sf_dir, 16800).join(F.broadcast(geometry.grid_anchors(spark)), "anchor_id")
    return _rounded(geometry.distance_points(rows, 640, 640, [("d0", "d1"), ("d2", "d3")]), ["p0x", "p0y", "p1x", "p1y"])


@query
def decode_priors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variance form, on the 38640 priors of a 736 x 1280 detector."""
    rows = _raw(spark, sf_dir, 38640).join(F.broadcast(geometry.prior_boxes(spark)), "anchor_id")  # 38640 rows by construction
    return _rounded(geometry.variance_boxes(rows), ["x1", "y1", "x2", "y2"])


@query
def decode_prior_landmarks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _raw(spark, sf_dir, 38640).join(F.broadcast(geometry.prior_boxes(spark)), "anchor_id")
    return _rounded(geometry.variance_points(rows, [("d0", "d1"), ("d2", "d3")]), ["p0x", "p0y", "p1x", "p1y"], 6)


@query
def softmax_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _raw(spark, sf_dir, 38640)
    face = scalar.softmax([F.col("d0"), F.col("d1")])[1]
    return rows.select(*_KEYS, F.round(face, 6).alias("face_score"))


@query
def score_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At least the threshold for one detector, above it for the other."""
    b = boxes(spark, sf_dir)
    return b.select("frame_idx", "det", "score", (F.col("score") >= 0.6).alias("first_kind"), (F.col("score") > 0.3).alias("second_kind")).where("first_kind or second_kind")


@query
def dequantised_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boxes(spark, sf_dir).select("frame_idx", "det", F.round(scalar.dequantised(F.col("x1") % 256, 128.0, 0.0625), 6).alias("value"))


@query
def detection_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boxes(spark, sf_dir).select("frame_idx", "det", scalar.label_of({"0": "face", "1": "face"}, F.col("det") % 4).alias("label"))


@query
def first_face(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geometry.first_of_frame(boxes(spark, sf_dir).where("score >= 0.6"), ["frame_idx"], "det").select("frame_idx", "det", "x1", "y1", "x2", "y2")


@query
def pairwise_iou(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geometry.overlaps(boxes(spark, sf_dir), ["frame_idx"]).where("iou > 0").select("frame_idx", "det_a", "det_b", F.round("iou", 6).alias("iou"))


@query
def nms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geometry.suppressed(boxes(spark, sf_dir), ["frame_idx"], 0.3)


def _frame_keys(rows: DataFrame, tasks: int) -> DataFrame:
    """Raw outputs as detections of frames: eight orders to a frame, image sizes by frame, scores in thousandths; every frame in one of the tasks."""
    w = Window.partitionBy("frame_idx").orderBy("l_orderkey", "l_linenumber", "l_partkey", "d0", "d1", "d2", "d3")
    framed = rows.withColumn("frame_idx", F.floor(F.col("l_orderkey") / 8)).repartition(tasks, "frame_idx").withColumn("det", F.row_number().over(w))
    score = F.round(F.pmod(F.col("l_partkey") * 7919 + F.col("det") * 131, F.lit(1000)) / 1000.0, 3)
    return framed.withColumns({"score": score, "iw": ((F.col("frame_idx") % 5 + 3) * 160).cast("int"), "ih": ((F.col("frame_idx") % 4 + 3) * 160).cast("int")})


def _listed(faces: DataFrame) -> DataFrame:
    text = F.array_join(F.transform("faces", lambda f: F.concat_ws(":", f["x1"], f["y1"], f["x2"], f["y2"])), ",")
    return faces.select("frame_idx", F.size("faces").cast("long").alias("n_faces"), text.alias("faces"))


@query
def distance_detector(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anchors, distance decoding, score filter, suppression, undone letterbox and one array of faces for each frame."""
    raw = _frame_keys(_raw(spark, sf_dir, 800), parts(spark, sf_dir, "lineitem")).withColumn("anchor_id", F.col("anchor_id") + 16000)
    decoded = geometry.distance_boxes(raw.join(F.broadcast(geometry.grid_anchors(spark)), "anchor_id"), 640, 640)  # 16800 rows by construction
    return _listed(geometry.faces_by_frame(decoded, ["frame_idx"], 640, 640, 0.5, 0.4))


@query
def variance_detector(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same for priors and variances, whose boxes are relative to the 1280 x 736 input."""
    raw = _frame_keys(_raw(spark, sf_dir, 1840), parts(spark, sf_dir, "lineitem")).withColumn("anchor_id", F.col("anchor_id") + 36800)
    decoded = geometry.variance_boxes(raw.join(F.broadcast(geometry.prior_boxes(spark)), "anchor_id"))  # 38640 rows by construction
    pixels = decoded.withColumns({c: F.col(c) * size for c, size in (("x1", 1280), ("y1", 736), ("x2", 1280), ("y2", 736))})
    return _listed(geometry.faces_by_frame(pixels, ["frame_idx"], 1280, 736, 0.5, 0.4, strict=True))


def _planes(spark: SparkSession, sf_dir: str, layers, shapes, bytes_to_values) -> DataFrame:
    """Output planes of a frame for each vector: byte j of layer k is taken from entry 7j + 13k, in 256 steps of 1/4096."""
    level = F.transform("embedding", lambda v: F.pmod(F.floor(v.cast("double") * 4096), F.lit(256)))
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("frame_idx"), level.alias("level"))
    each = [F.struct(F.lit(name).alias("layer"), F.lit(k).alias("k"), F.lit(n).alias("cells"), F.lit(c).alias("channels"), F.lit(zero).alias("zero"), F.lit(scale).alias("scale")) for k, (name, (n, c), (zero, scale)) in enumerate(zip(layers, shapes, bytes_to_values, strict=True))]
    placed = rows.select("frame_idx", "level", F.explode(F.array(*each)).alias("p")).select("frame_idx", "level", "p.*")
    byte = lambda j: F.lpad(F.hex(F.get("level", F.pmod(j * 7 + F.col("k") * 13, F.lit(64)).cast("int"))), 2, "0")
    data = F.unhex(F.array_join(F.transform(F.sequence(F.lit(0), F.col("cells") * F.col("channels") - 1), byte), ""))
    return placed.select("frame_idx", "layer", "channels", data.alias("data"), "zero", "scale")


def _faces(spark: SparkSession, sf_dir: str, detector: detections.Detector, values) -> DataFrame:
    """One row for each face, from planes whose values are given for boxes, scores and landmarks."""
    logits = 1 if detector.kind == "distance" else 2
    shapes = [((detector.width // s) * (detector.height // s), c * len(own)) for s, own in zip(detector.steps, detector.sizes, strict=True) for c in (4, logits, 10)]
    planes = _planes(spark, sf_dir, detector.layers, shapes, values * len(detector.steps))
    frame = F.col("vec_id")
    sizes = table(spark, sf_dir, "embeddings").select(frame.alias("frame_idx"), ((frame % 5 + 3) * 160).cast("int").alias("iw"), ((frame % 4 + 3) * 160).cast("int").alias("ih"))
    found = detections.faces(planes, sizes, detector).select("frame_idx", F.posexplode("faces").alias("face", "f"))
    marks = F.array_join(F.transform("f.landmarks", lambda p: F.concat_ws(":", F.format_string("%.3f", F.round(p["x"], 3) + 0.0), F.format_string("%.3f", F.round(p["y"], 3) + 0.0))), ",")
    return found.select("frame_idx", "face", "f.category_id", "f.label", F.round("f.score", 6).alias("score"), "f.x1", "f.y1", "f.x2", "f.y2", marks.alias("landmarks"))


@query
def distance_faces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faces with label and landmarks from nine quantised planes of all three strides of a 64 x 64 detector."""
    detector = detections.Detector("distance", detections.SCRFD_2_5G, 64, 64, least=0.96875, most=0.4, labels={"0": "face"})
    return _faces(spark, sf_dir, detector, [(0.0, 1 / 64), (0.0, 1 / 256), (128.0, 1 / 64)])


@query
def variance_faces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same for priors, variances and two logits, of a 96 x 64 detector."""
    detector = detections.Detector("variance", detections.RETINA, 96, 64, least=0.95, most=0.4)
    return _faces(spark, sf_dir, detector, [(128.0, 1 / 32), (128.0, 1 / 64), (128.0, 1 / 64)])


@query
def corner_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes given by corner and size, and boxes given relative to a 640 x 360 frame, by their corners."""
    b = boxes(spark, sf_dir)
    w, h = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    by_size = geometry.corners(F.col("x1"), F.col("y1"), w, h)
    relative = geometry.absolute(F.col("x1") / 1000.0, F.col("y1") / 1000.0, w / 1000.0, h / 1000.0, 640, 360)
    return b.select("frame_idx", "det", *[c.alias(n) for c, n in zip(by_size, ("x1", "y1", "x2", "y2"), strict=True)], *[c.alias(n) for c, n in zip(relative, ("ax1", "ay1", "ax2", "ay2"), strict=True)])


@query
def greedy_assign_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes of a frame against those of the one before."""
    b = boxes(spark, sf_dir)
    cx, cy = F.floor((F.col("x1") + F.col("x2")) / 2), F.floor((F.col("y1") + F.col("y2")) / 2)
    objects = b.select((F.col("frame_idx") + 1).alias("frame_idx"), F.col("det").alias("obj"), cx.alias("cx"), cy.alias("cy"))
    found = geometry.nearest_matches(objects, b.select("frame_idx", "det", cx.alias("cx"), cy.alias("cy")), ["frame_idx"])
    return found.select("frame_idx", "obj", "det", F.round("dist", 6).alias("dist"))


def _videos(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = boxes(spark, sf_dir)
    return b.where("score >= 0.6").select(F.floor(F.col("frame_idx") / 8).alias("video_id"), F.col("frame_idx"), "det", "x1", "y1", "x2", "y2")


@query
def centroid_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tracking.tracked(_videos(spark, sf_dir), "video_id", "long", 2)


@query
def display_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faces of the boxes' frames with their region and latest value."""
    b = boxes(spark, sf_dir).withColumn("face_id", F.col("frame_idx"))
    region = geometry.square_region(b, 640, 360).select("face_id", "det", "rx1", "rx2")
    rate = reports.latest(samples(spark, sf_dir), "face_id", "v", ["ts", "event_id"])
    return reports.displayed(b.select("face_id", "det"), region, rate, ["face_id", "det"], ["face_id"])


def _frames_and_rates(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All events as frames of their user's face, clicks as rates."""
    frames = events.select("event_id", F.col("user_id").alias("face_id"), F.col("ts").cast("timestamp").alias("ts"))
    rates = events.where("event_type = 'click'").select(F.col("user_id").alias("face_id"), F.col("ts").cast("timestamp").alias("ts"), "event_id", F.round(F.col("value") * 100).alias("heart_rate"))
    return frames, rates


def _shown(rows: DataFrame) -> DataFrame:
    return rows.select("event_id", "face_id", "heart_rate", reports.shown_text(F.col("face_id"), F.col("heart_rate")).alias("shown"))


@query
def rates_at_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every frame with the rate that is known at its own time."""
    frames_, rates = _frames_and_rates(table(spark, sf_dir, "events"))
    return _shown(reports.as_of(frames_, rates, "face_id", "heart_rate", "ts", "event_id", coarse=F.date_trunc("day", "ts")))


@query
def stream_rates_at_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from streams of frames and rates."""
    schema = table(spark, sf_dir, "events").schema
    raw = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return _shown(heart_rate.run_to_end(display.shown(*_frames_and_rates(raw), "face_id", "heart_rate", "ts", "event_id", late="0 seconds", groups=64 * parts(spark, sf_dir, "events"))))


@query
def track_colours(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = scalar.track_colour(F.col("det"))
    return boxes(spark, sf_dir).select("frame_idx", "det", *[F.get(c, F.lit(i)).alias(n) for i, n in enumerate(("blue", "green", "red"))])


@query
def spatial_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Channel means of interleaved pixels."""
    e = table(spark, sf_dir, "embeddings")
    thousand = F.lit(1000.0).cast("float")  # of a whole number Spark would make the product a double, which is rounded differently near halves
    means = scalar.channel_means(F.transform("embedding", lambda v: F.round(v * thousand).cast("double")))
    return e.select("vec_id", *[F.round(m, 6).alias(n) for m, n in zip(means, ("mean_r", "mean_g", "mean_b"), strict=True)])


@query
def channels_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Channel-first order of 16 pixels of 4 channels, one row for each value."""
    e = table(spark, sf_dir, "embeddings")
    return e.select("vec_id", F.posexplode(scalar.channels_first(F.col("embedding"), 16, 4)).alias("at", "_v")).select("vec_id", "at", F.round(F.col("_v").cast("double"), 6).alias("v"))


@query
def last_frame_pad(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    padded = scalar.last_repeated(F.col("embedding"))
    return e.select("vec_id", F.size(padded).alias("n"), F.round(F.get(padded, F.lit(64)).cast("double"), 6).alias("last_v"))


@query
def resize_bilinear(spark: SparkSession, sf_dir: str) -> DataFrame:
    """8 x 8 planes to 12 x 12."""
    e = table(spark, sf_dir, "embeddings")
    plane = F.transform("embedding", lambda v: v.cast("double"))
    return e.select("vec_id", F.posexplode(scalar.resized(plane, 8, 8, 12, 12)).alias("at", "_v")).select("vec_id", "at", F.round("_v", 5).alias("v"))


@query
def resize_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    """8 x 8 planes to 4 x 4."""
    e = table(spark, sf_dir, "embeddings")
    plane = F.transform("embedding", lambda v: v.cast("double"))
    return e.select("vec_id", F.posexplode(scalar.area_means(plane, 8, 8, 2)).alias("at", "_v")).select("vec_id", "at", F.round("_v", 5).alias("v"))


def _byte_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as frames of 64 bytes and one channel, in four shapes."""
    level = F.transform("embedding", lambda v: F.pmod(F.floor(v.cast("double") * 4096), F.lit(256)))
    data = F.unhex(F.array_join(F.transform(level, lambda v: F.lpad(F.hex(v), 2, "0")), ""))
    height = F.get(F.array(*[F.lit(h) for h in (8, 4, 16, 2)]), F.pmod("vec_id", F.lit(4)).cast("int"))
    return table(spark, sf_dir, "embeddings").select("vec_id", height.alias("height"), (F.lit(64) / height).cast("int").alias("width"), data.alias("pixels"))


@query
def letterbox_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames scaled into 12 x 10 and padded with black."""
    out = pixels.letterboxed(_byte_frames(spark, sf_dir), 12, 10)
    return out.select("vec_id", "height", "width", "dx", "dy", F.round("gain", 6).alias("gain"), F.hex("pixels").alias("pixels"))


@query
def video_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as colour frames of 5 x 4, labels as videos: two boxes tracked, cut out, averaged and rated in windows of 24 frames."""
    level = F.transform(F.slice("embedding", 1, 60), lambda v: F.pmod(F.floor(v.cast("double") * 4096), F.lit(256)))
    data = F.unhex(F.array_join(F.transform(level, lambda v: F.lpad(F.hex(v), 2, "0")), ""))
    at = F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1
    frames_ = table(spark, sf_dir, "embeddings").select(F.col("label").cast("long").alias("video_id"), at.cast("long").alias("frame_idx"), F.lit(4).alias("height"), F.lit(5).alias("width"), data.alias("pixels"))
    corners = F.array(*[F.struct(F.lit(i).cast("long").alias("det"), *[F.lit(v).alias(c) for c, v in zip(faces.BOX, box, strict=True)]) for i, box in enumerate(((0, 0, 3, 2), (2, 1, 5, 4)))])
    found = frames_.select("video_id", "frame_idx", F.explode(corners).alias("b")).select("video_id", "frame_idx", "b.*")
    traces_ = faces.colour_traces(frames_, found, 5, 4, region="full")
    return faces.heart_rates(traces_, 24, extract="green").select("video_id", "object_id", "win_id", "heart_rate")


@query
def luma_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traces(spark, sf_dir).select("face_id", "pos", F.round(scalar.luma(F.col("r"), F.col("g"), F.col("b")), 4).alias("luma"))


@query
def powers_and_decibels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traces(spark, sf_dir).select("face_id", "pos", scalar.next_power_of_2(F.col("pos")).alias("pow2"), F.round(scalar.power_to_db(F.col("r")), 6).alias("db"))


@query
def signal_rmse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.root_mean_square_error(trace_windows(spark, sf_dir), WIN, "r", "b").select(*WIN, F.round("rmse", 6).alias("rmse"))


@query
def fps_per_second(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.frames_per_second(table(spark, sf_dir, "events"))


def _folder_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select((F.col("user_id") % 50).cast("string").alias("folder"), F.round(F.col("value") * 100).alias("fps"))
    return reports.mean_rates(e, "folder", "fps")


@query
def fps_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _folder_means(spark, sf_dir).select("folder", F.round("average_fps", 6).alias("average_fps"))
    return reports.numeric_order(m, "folder")


@query
def fps_extremes(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = reports.rate_extremes(_folder_means(spark, sf_dir), "folder")
    return m.select(*[F.round(c, 6).alias(c) for c in ("mean_fps", "max_fps", "min_fps")], "max_folder", "min_folder")


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.sum(F.round("o_totalprice")).alias("total"), F.sum((F.col("o_orderstatus") == "P").cast("long")).alias("skipped"))
    return o.withColumnRenamed("o_custkey", "run_id")


@query
def metrics_eav(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.as_metrics(_runs(spark, sf_dir), ["run_id"], {"Processing Count": "n", "Total Processing Time": "total", "Skipped Frames": "skipped"})


@query
def skipped_zero_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.complete_runs(metrics_eav(spark, sf_dir), ["run_id"])


@query
def dropped_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers missing among the parts of each supplier's items, as frames that were shed."""
    return reports.dropped_frames(table(spark, sf_dir, "lineitem"), ["l_suppkey"], "l_partkey")


@query
def stage_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames, total value and frames a second of each face's time span."""
    s = samples(spark, sf_dir)
    span = (F.max(F.unix_micros(F.col("ts").cast("timestamp"))) - F.min(F.unix_micros(F.col("ts").cast("timestamp")))) / 1e6
    return s.groupBy("face_id").agg(F.count("*").alias("n"), F.sum("v").alias("total"), F.round(F.try_divide(F.count("*"), span), 6).alias("average_fps"))


@query
def latest_hr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.latest(samples(spark, sf_dir), "face_id", "v", ["ts", "event_id"])


@query
def hr_update_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.update_rate(samples(spark, sf_dir), "face_id", 3600).select("event_id", "face_id", F.round("rate", 6).alias("rate"))


@query
def recent_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.recent_mean(samples(spark, sf_dir), "face_id", "v", ["ts", "event_id"]).select("event_id", "face_id", F.round("recent_mean", 5).alias("recent_mean"))


@query
def expired_faces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faces without a sample in the last hour of the table."""
    return reports.expired(samples(spark, sf_dir), "face_id", 3600.0)


@query
def missing_subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers without a pending order: a catalogue without its exclusions."""
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders").where("o_orderstatus = 'P'")
    return c.select("c_custkey").join(o, c["c_custkey"] == o["o_custkey"], "left_anti")


@query
def stream_hr_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heart rates from a stream of events, 16 samples to a window, the rest kept in each face's state."""
    schema = table(spark, sf_dir, "events").schema
    raw = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    samples_in = raw.select(F.col("user_id").alias("face_id"), F.col("event_id").alias("order"), F.round(F.col("value") * 100).alias("v"))
    return heart_rate.run_to_end(heart_rate.window_rates(samples_in, "face_id", "v", 16))


@query
def region_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Planes written as one array for each label, and read again as a stream of frames."""
    level = F.transform("embedding", lambda v: F.greatest(F.lit(0), F.least(F.lit(255), F.floor(v.cast("double") * 64) + 128)))
    pixels = F.unhex(F.array_join(F.transform(level, lambda v: F.lpad(F.hex(v), 2, "0")), ""))
    planes = table(spark, sf_dir, "embeddings").select(F.col("label").alias("run"), "vec_id", F.lit(8).alias("height"), F.lit(8).alias("width"), pixels.alias("pixels"))
    folder = f"{shared_dir(spark)}/regions-{uuid.uuid4().hex}"
    frames.write_regions(planes, folder, order=["vec_id"])
    gone_at_the_end(spark, folder)
    back = heart_rate.run_to_end(frames.read_frame_stream(spark, folder))
    return back.select(F.col("video").cast("int").alias("label"), "frame_idx", "width", "height", F.hex("pixels").alias("pixels"), "shed")


@query
def stream_chunk_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of a stream of line items as they close: prepared against the state's rolling statistics, with the rate that is shown after each."""
    raw = spark.readStream.schema(table(spark, sf_dir, "lineitem").schema).option("pathGlobFilter", "lineitem.parquet").parquet(sf_dir)
    order = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"]
    items = raw.select(F.col("l_suppkey").alias("face_id"), F.col("l_quantity").alias("r"), *order)
    out = heart_rate.run_to_end(chunks.chunk_rates(items, "face_id", "r", "l_shipdate", order, SIZE, SIZE))
    total = lambda c: F.round(F.aggregate(c, F.lit(0.0), lambda a, v: a + F.abs(v)), 3)
    return out.select("face_id", "chunk_id", F.size("std").alias("n"), total("std").alias("std_size"), total("diff").alias("diff_size"), "fresh", "heart_rate")
