"""Mixing sources to target weights along a time-varying curriculum (native).

A source has a weight schedule: knots (t, w) over training time 0..1, linear in
between.  Its cumulative demand after time t is target * A(t) / A(1), A being the
integral of the schedule.  The documents of a source stand in a fixed pseudo-random
order; the stream of a source runs through that order again and again until its
target is reached.  The word at offset c of the stream is due when the demand reaches
c, so a copy's training position is the inverse of the demand at the copy's middle.
All copies are range-sorted by position.

Defined results: null text has size 0 and is never taken; a null source is a source of
its own, ordered last; repeated rows are rows of their own; ties of the pseudo-random
order are broken by id, size and text hash; an empty table gives an empty mix; the length of a text
has no bound; a kept column with the name of a result stays as it is, and the result is called
`size_2` and so on (see `result_names`).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import columns, free, n_words, table

#: Offsets inside a source are prefix sums over this many slices of its pseudo-random order.
SLICES = 4096
#: Rising, level and falling weight over training time, dealt to sources in turn.
CURRICULUM = (((0.0, 0.5), (1.0, 1.5)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 1.5), (0.6, 1.0), (1.0, 0.25)))


def source_targets(sizes: DataFrame, weights: Sequence[float] = (3, 1, 2), budget: float = 1.5, cap: float = 2.0) -> DataFrame:
    """Targets by water filling: min(level * weight, cap * size), the level such that they sum to the budget.

    sizes has source, source_size (one row each). Resharing the excess by weight until no
    target is above its cap ends at this level, which the prefix sums below give directly:
    ordered by cap/weight, the capped sources are a prefix.
    """
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    ranked = sizes.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    ranked = ranked.withColumn("weight", w).withColumn("most", cap * F.col("source_size"))
    whole, filled = Window.partitionBy(), Window.orderBy(F.col("most") / F.col("weight"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    level = (budget * F.sum("source_size").over(whole) - F.coalesce(F.sum("most").over(filled), F.lit(0.0))) / (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(filled), F.lit(0.0)))
    levelled = ranked.withColumn("level", level)
    fits = F.min(F.when(F.col("level") * F.col("weight") <= F.col("most"), F.struct(F.col("most") / F.col("weight"), "rank", "level"))).over(whole)["level"]
    return levelled.withColumn("target", F.least(F.coalesce(fits * F.col("weight"), F.col("most")), F.col("most"))).select("source", "rank", "source_size", "target")


def with_schedule(targets: DataFrame, curriculum: Sequence = CURRICULUM) -> DataFrame:
    """Adds segments of the integrated schedule: (t, w, slope, area before), and the whole area."""
    rows = []
    for knots in curriculum:
        area, seg = 0.0, []
        for (t, a), (u, b) in zip(knots, knots[1:], strict=False):
            seg.append((t, a, (b - a) / (u - t), area))
            area += (a + b) / 2 * (u - t)
        rows.append(F.array(*[F.struct(F.lit(t).alias("t"), F.lit(a).alias("w"), F.lit(s).alias("slope"), F.lit(before / area).alias("before"), F.lit(area).alias("area")) for t, a, s, before in seg]))
    return targets.withColumn("segments", F.element_at(F.array(*rows), (F.col("rank") % len(curriculum) + 1).cast("int")))


def due(share: Column, segments: Column) -> Column:
    """The time at which a source's demand has reached this share of its target: the integral inverted."""
    at = F.try_element_at(F.filter(segments, lambda s: s["before"] <= share), F.lit(-1))
    rest = (share - at["before"]) * at["area"]
    root = F.sqrt(F.greatest(at["w"] * at["w"] + 2 * at["slope"] * rest, F.lit(0.0)))
    return F.least(F.lit(1.0), at["t"] + F.when(rest <= 0, F.lit(0.0)).otherwise(F.try_divide(2 * rest, at["w"] + root)))


RESULTS = ("size", "source_size", "target", "taken", "copies", "position")


def result_names(keep: Sequence[str] = ()) -> dict[str, str]:
    """What the results are called beside the kept columns."""
    return {name: free([*keep, "doc_id", "source"], name) for name in RESULTS}


def mix(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), budget: float = 1.5, cap: float = 2.0, curriculum: Sequence = CURRICULUM, seed: int = 11, keep: Sequence[str] = ()) -> DataFrame:
    """One row for each document: size, its source's size and target, words taken, and its copies.

    copies is an array of (epoch, words, position); the last copy of a source is cut where
    its demand ends, so a source's taken words are its target rounded to a word. Columns
    named in `keep` are carried along.
    """
    place = F.xxhash64(F.xxhash64("doc_id", "text"), F.lit(seed))  # of id and text: rows without an id, or of one id, spread over all slices
    own = docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), place.alias("_h"), F.xxhash64("text").alias("_t"), *[c.alias(f"_keep_{i}") for i, c in enumerate(columns(keep))])
    own = own.withColumn("_slice", F.pmod("_h", F.lit(SLICES)))
    slices = docs.select("source", n_words(F.col("text")).alias("size"), F.pmod(place, F.lit(SLICES)).alias("_slice")).groupBy("source", "_slice").agg(F.sum("size").alias("_words"))
    before = Window.partitionBy("source").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = slices.select("source", "_slice", F.coalesce(F.sum("_words").over(before), F.lit(0)).alias("_before"))
    targets = with_schedule(source_targets(slices.groupBy("source").agg(F.sum("_words").alias("source_size")), weights, budget, cap), curriculum)
    plan = offsets.join(targets, offsets["source"].eqNullSafe(targets["source"])).select(offsets["source"].alias("_source"), offsets["_slice"].alias("_of"), "_before", "source_size", "target", "segments")
    inside = Window.partitionBy("source", "_slice").orderBy("_h", "doc_id", "size", "_t").rowsBetween(Window.unboundedPreceding, -1)
    own = own.withColumn("_inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    both = own.join(plan, own["source"].eqNullSafe(plan["_source"]) & (own["_slice"] == plan["_of"])).withColumn("_at", F.col("_before") + F.col("_inside"))
    end = F.round("target").cast("long")
    def one(e: Column) -> Column:
        start = e * F.col("source_size") + F.col("_at")
        words = F.least(F.col("size"), end - start)
        return F.struct(e.alias("epoch"), words.alias("words"), due(F.try_divide(start + words / 2, F.col("target")), F.col("segments")).alias("position"))
    epochs = F.sequence(F.lit(0), F.ceil(F.lit(cap)).cast("int"))
    copies = F.filter(F.transform(epochs, one), lambda c: c["words"] > 0)
    out = both.withColumn("copies", F.when(F.col("size") > 0, copies).otherwise(F.filter(F.transform(epochs, one), lambda c: F.lit(False))))
    taken = F.aggregate("copies", F.lit(0).cast("long"), lambda a, c: a + c["words"])
    values = {"taken": taken, "position": F.get("copies", F.lit(0))["position"]}
    return out.select("doc_id", "source", *[values.get(n, F.col(n)).alias(name) for n, name in result_names(keep).items()], *[F.col(f"_keep_{i}").alias(c) for i, c in enumerate(keep)])


def in_training_order(mixed: DataFrame, position: str = "position") -> DataFrame:
    """Range-sorted by first position; documents that are not taken come last."""
    return mixed.orderBy(F.col(position).asc_nulls_last(), "doc_id")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = in_training_order(mix(table(spark, sf_dir, "documents")))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "position", F.size("copies").alias("n_copies"))
