"""Count windows, chunks and rolling statistics of keyed, ordered signals.

A key's rows are numbered once; from then on the number says where a row belongs, so no operator needs a key's whole
history in one task. Windows over neighbouring rows work on segments of a key, with the rows that reach over
a segment's edges copied into it. A sliding sum is the end of one block of the window's length and the
beginning of the next, so no sum runs on over the whole history. All windows of a step go by key, segment, block and row,
so that a task sorts its rows once; `parts` deals them to so many tasks, which a caller who knows the number of rows chooses.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a segment.
SEGMENT = 1 << 15


def positions(df: DataFrame, key: str, order: Sequence[str], name: str = "pos", coarse: Column | None = None, parts: int | None = None) -> DataFrame:
    """Numbers each key's rows from 0.

    With `coarse`, a function of the first order column that never falls while that one rises (a time cut to hours), rows are numbered in each
    (key, coarse) for itself and moved on by the rows before it, so that a key with many rows is dealt to many tasks. The number of those
    is a row ahead of them, so rows are dealt and sorted once; `parts` is into how many tasks.
    """
    if coarse is None:
        return df.withColumn(name, (F.row_number().over(Window.partitionBy(key).orderBy(*order)) - 1).cast("long"))
    pairs = df.select(F.col(key).alias("_key"), coarse.alias("_of"))
    sizes = (pairs.repartition(parts, "_key", "_of") if parts else pairs).groupBy("_key", "_of").agg(F.count("*").alias("_n"))
    ahead = Window.partitionBy("_key").orderBy("_of").rowsBetween(Window.unboundedPreceding, -1)
    before = (sizes.repartition(parts, "_key") if parts else sizes).select(F.col("_key").alias(key), F.col("_of").alias("_part"), F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_before"))
    rows = df.withColumns({"_part": coarse, "_before": F.lit(None).cast("long")}).unionByName(before, allowMissingColumns=True)
    inside = Window.partitionBy(key, "_part").orderBy(F.col("_before").isNull(), *order).rowsBetween(Window.unboundedPreceding, 0)
    both = dealt(rows, parts, key, "_part") if parts else rows
    numbered = both.withColumns({"_first": F.first("_before").over(inside), "_nth": F.row_number().over(inside)}).where("_before is null")
    return numbered.select(*df.columns, (F.col("_first") + F.col("_nth") - 2).cast("long").alias(name))


def with_size(df: DataFrame, key: str, name: str) -> DataFrame:
    """Adds the number of the key's rows."""
    sizes = df.groupBy(F.col(key).alias("_key")).agg(F.count("*").alias(name))
    return df.join(sizes, F.col(key).eqNullSafe(F.col("_key"))).drop("_key")


def dealt(df: DataFrame, parts: int | None, *by: str) -> DataFrame:
    """Rows by the given columns, in `parts` partitions if that is said."""
    return df.repartition(parts, *by) if parts else df.repartition(*by)


def tumbling(df: DataFrame, key: str, size: int, parts: int | None = None) -> DataFrame:
    """Rows of full windows, with the window's number and the position inside it; they lie in `parts` partitions by window, sorted by position."""
    placed = dealt(df.withColumns({"win_id": F.floor(F.col("pos") / size), "at": F.col("pos") % size}), parts, key, "win_id")
    whole = Window.partitionBy(key, "win_id").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return placed.withColumn("_n", F.count("*").over(whole)).where(F.col("_n") == size).drop("_n")


def sliding(df: DataFrame, key: str, size: int, step: int) -> DataFrame:
    """As tumbling, each row once for every full window that covers it."""
    first = F.greatest(F.lit(0), F.floor((F.col("pos") - size) / step) + 1)
    last = F.least(F.floor(F.col("pos") / step), F.floor((F.col("_n") - size) / step))
    placed = with_size(df, key, "_n").withColumns({"_a": first, "_b": last}).where("_a <= _b")
    return placed.withColumn("win_id", F.explode(F.sequence("_a", "_b"))).withColumn("at", F.col("pos") - F.col("win_id") * step).drop("_n", "_a", "_b")


def by_segment(df: DataFrame, key: str, before: int, after: int, op: Callable[[DataFrame, list[str]], DataFrame], size: int = SEGMENT, parts: int | None = None, block: int | None = None) -> DataFrame:
    """op over segments of each key: it gets the rows, with `before` rows ahead of each segment and `after` behind it, and the columns to partition by.

    With `block`, rows have the number of their block of so many rows in _block.
    """
    seg, at = F.floor(F.col("pos") / size), F.col("pos") % size
    if max(before, after) > size:
        raise ValueError(f"windows of {max(before, after)} rows don't fit segments of {size}")
    place = lambda s, own: F.struct(s.alias("seg"), F.lit(own).alias("own"))
    others = F.array(F.when(at >= size - before, place(seg + 1, False)), F.when((at < after) & (seg > 0), place(seg - 1, False)))
    edge = (at >= size - before) | ((at < after) & (seg > 0))
    places = F.when(edge, F.concat(F.array(place(seg, True)), F.filter(others, lambda p: p.isNotNull()))).otherwise(F.array(place(seg, True)))
    rows = df.withColumn("_place", F.explode(places)).select(*df.columns, F.col("_place.seg").alias("_seg"), F.col("_place.own").alias("_own"))
    rows = dealt(rows.withColumn("_block", F.floor(F.col("pos") / block)) if block else rows, parts, key, "_seg")  # once, for windows by segment and by block of a segment alike
    return op(rows, [key, "_seg"]).where("_own").drop("_seg", "_own", "_block")


def along(keys: Sequence[str]):
    """Rows of a segment by block and number, the one order of all windows inside by_segment."""
    return Window.partitionBy(*keys).orderBy("_block", "pos")


def over_last(df: DataFrame, keys: Sequence[str], size: int, sums: dict[str, Column], block: int) -> DataFrame:
    """Adds the sum of each expression over the last `size` rows; _block numbers blocks of `block` rows, size or size + 1."""
    rows = df.withColumns({f"_x{n}": x for n, x in sums.items()})
    inside, at = Window.partitionBy(*keys, "_block").orderBy("pos"), F.col("pos") % block
    ends = {f"_h{n}": F.sum(f"_x{n}").over(inside.rowsBetween(Window.unboundedPreceding, 0)) for n in sums}
    ends |= {f"_t{n}": F.sum(f"_x{n}").over(inside.rowsBetween(0, Window.unboundedFollowing)) for n in sums}
    early = {n: F.when(at == size - 1, F.lit(0.0)).otherwise(F.coalesce(F.lag(f"_t{n}", size - 1).over(along(keys)), F.lit(0.0))) for n in sums}
    out = rows.withColumns(ends).withColumns({n: F.when(at < size, F.col(f"_h{n}")).otherwise(F.lit(0.0)) + early[n] for n in sums})
    return out.drop(*[f"_{c}{n}" for n in sums for c in "xht"])


def merged(a: Column, b: Column) -> Column:
    """Moments (n, mean, m2) of two sets of numbers together, by the pairwise rule; m2 is the sum of squared deviations."""
    n, gap = a["n"] + b["n"], b["mean"] - a["mean"]
    mean = a["mean"] + gap * b["n"] / n
    m2 = a["m2"] + b["m2"] + gap * gap * a["n"] * b["n"] / n
    return F.when(b["n"] == 0, a).when(a["n"] == 0, b).otherwise(F.struct(n.alias("n"), mean.alias("mean"), m2.alias("m2")))


def moments(value: Column, frame=None) -> Column:
    """Moments of a group or a frame of rows."""
    over = (lambda c: c.over(frame)) if frame is not None else (lambda c: c)
    n = over(F.count(value))
    return F.struct(n.cast("double").alias("n"), F.coalesce(over(F.avg(value)), F.lit(0.0)).alias("mean"), F.coalesce(over(F.var_pop(value)) * n, F.lit(0.0)).alias("m2"))


def no_moments() -> Column:
    return F.struct(*[F.lit(0.0).alias(c) for c in ("n", "mean", "m2")])


def merged_all(sets: Column) -> Column:
    """Moments of an array of sets together, in order."""
    return F.aggregate(sets, no_moments(), merged)


def rolling_stats(df: DataFrame, key: str, value: str, size: int = 180, segment: int = SEGMENT, parts: int | None = None) -> DataFrame:
    """Mean and standard deviation over the last size + 1 rows; 0 for fewer than two."""
    return by_segment(df, key, size + 1, 0, lambda d, keys: _rolling_stats(d, keys, value, size), segment, parts, size + 1)


def _rolling_stats(df: DataFrame, keys: Sequence[str], value: str, size: int) -> DataFrame:
    x = F.col(value)
    back = over_last(df, keys, size + 1, {"_s": x, "_q": x * x}, size + 1).withColumn("n", F.least(F.col("pos") + 1, F.lit(size + 1)))
    mean = F.col("_s") / F.col("n")
    var = F.greatest(F.lit(0.0), F.col("_q") / F.col("n") - mean * mean)
    return back.withColumns({"roll_mean": mean, "roll_std": F.when(F.col("n") < 2, F.lit(0.0)).otherwise(F.sqrt(var))}).drop("_s", "_q")


def differences(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Normalised change from the row before; none for the first."""
    before = F.lag(value).over(along(keys))
    return df.withColumn("diff", (F.col(value) - before) / (F.col(value) + before + F.lit(1e-7)))


def rolling_diff_std(df: DataFrame, key: str, value: str, size: int = 180, segment: int = SEGMENT, parts: int | None = None) -> DataFrame:
    """Standard deviation of the last `size` differences: at least sqrt(1e-7), 1 for fewer than two."""
    return by_segment(df, key, size + 1, 0, lambda d, keys: _rolling_diff_std(d, keys, value, size), segment, parts, size + 1)


def _rolling_diff_std(df: DataFrame, keys: Sequence[str], value: str, size: int) -> DataFrame:
    d = F.coalesce("diff", F.lit(0.0))
    back = over_last(differences(df, keys, value), keys, size, {"_s": d, "_q": d * d}, size + 1).withColumn("n_diff", F.least(F.col("pos"), F.lit(size)))
    mean = F.col("_s") / F.col("n_diff")
    var = F.greatest(F.lit(1e-7), F.col("_q") / F.col("n_diff") - mean * mean)
    return back.withColumn("diff_std", F.when(F.col("n_diff") < 2, F.lit(1.0)).otherwise(F.sqrt(var))).drop("_s", "_q")


def chunk_ends(df: DataFrame, size: int = 30) -> DataFrame:
    """The row that closes each chunk: chunk c has rows c*size .. c*size+size-1 and closes when row (c+1)*size is seen."""
    return df.where((F.col("pos") > 0) & (F.col("pos") % size == 0)).withColumn("chunk_id", F.floor(F.col("pos") / size) - 1)


def standardised_chunks(df: DataFrame, key: str, value: str, size: int = 180, chunk: int = 30, segment: int = SEGMENT, parts: int | None = None) -> DataFrame:
    """Rows of closed chunks against the rolling statistics at closing time, beside their normalised differences."""
    return by_segment(df, key, size + 1, chunk, lambda d, keys: _standardised_chunks(d, keys, value, size, chunk), segment, parts, size + 1)


def _standardised_chunks(df: DataFrame, keys: Sequence[str], value: str, size: int, chunk: int) -> DataFrame:
    stats = _rolling_diff_std(_rolling_stats(df, keys, value, size), keys, value, size)
    ahead = along(keys)
    closing = F.struct("roll_mean", "roll_std", "diff_std")
    at_close = F.first(F.when(F.col("pos") % chunk == 0, closing), ignorenulls=True).over(ahead.rowsBetween(1, chunk))  # the next row that begins a chunk closes this one
    rows = stats.withColumns({"chunk_id": F.floor(F.col("pos") / chunk), "_next": F.lead(value).over(ahead), "_close": at_close}).where("_close is not null")
    joined = rows.select(*df.columns, "chunk_id", "_next", "_close.*")
    d = (F.col("_next") - F.col(value)) / (F.col("_next") + F.col(value) + F.lit(1e-7))
    return joined.withColumns({"std_value": (F.col(value) - F.col("roll_mean")) / (F.col("roll_std") + F.lit(1e-7)), "diff_value": F.coalesce(d / F.col("diff_std"), F.lit(0.0))}).drop("_next")


def six_channel_chunks(df: DataFrame, key: str, channels: Sequence[str], size: int = 180, chunk: int = 30, segment: int = SEGMENT, parts: int | None = None) -> DataFrame:
    """(key, pos, chunk_id, input): what a network gets for each row of a closed chunk, the normalised differences of all channels and then the standardised values.

    Statistics are those at closing time, over all channels of the last size + 1 rows and the last `size` differences together.
    """
    total = lambda columns: sum(columns[1:], columns[0])

    def op(d: DataFrame, keys: list[str]) -> DataFrame:
        back = along(keys)
        change = lambda a, b: (b - a) / (b + a + F.lit(1e-7))
        moves = d.withColumns({f"_d{i}": F.coalesce(change(F.lag(c).over(back), F.col(c)), F.lit(0.0)) for i, c in enumerate(channels)})
        own, diff = [F.col(c) for c in channels], [F.col(f"_d{i}") for i in range(len(channels))]
        rolled = over_last(moves, keys, size + 1, {"_s": total(own), "_q": total([c * c for c in own])}, size + 1)
        rolled = over_last(rolled, keys, size, {"_ds": total(diff), "_dq": total([c * c for c in diff])}, size + 1)
        n, m = F.least(F.col("pos") + 1, F.lit(size + 1)) * len(channels), F.least(F.col("pos"), F.lit(size)) * len(channels)
        mean, gone = F.col("_s") / n, F.col("_ds") / F.nullif(m, F.lit(0))
        closing = F.struct(mean.alias("mean"), F.sqrt(F.greatest(F.lit(0.0), F.col("_q") / n - mean * mean)).alias("std"), F.sqrt(F.greatest(F.lit(1e-7), F.col("_dq") / F.nullif(m, F.lit(0)) - gone * gone)).alias("diff_std"))
        at_close = F.first(F.when(F.col("pos") % chunk == 0, closing), ignorenulls=True).over(back.rowsBetween(1, chunk))
        rows = rolled.withColumns({"_close": at_close, **{f"_n{i}": F.lead(c).over(back) for i, c in enumerate(channels)}}).where("_close is not null")
        values = [change(F.col(c), F.col(f"_n{i}")) / F.col("_close.diff_std") for i, c in enumerate(channels)] + [(F.col(c) - F.col("_close.mean")) / (F.col("_close.std") + F.lit(1e-7)) for c in channels]
        return rows.withColumns({"chunk_id": F.floor(F.col("pos") / chunk), "input": F.array(*values)})

    return by_segment(df, key, size + 1, chunk, op, segment, parts, size + 1).select(key, "pos", "chunk_id", "input")


def rolling_forms(df: DataFrame, key: str, value: str, size: int = 180, step: int = 30, segment: int = SEGMENT, parts: int | None = None) -> DataFrame:
    """(key, pos, ..) at the end of each full step: mean and deviation of the last size + 1 rows in three forms, the deviation of the last `size` differences, and whether
    enough rows are there; beside them the window of whole steps, `size` rows at most, with its start_idx, end_idx, gt_mean, gt_std and gt_diff_std (of differences inside the window).

    `sums` from steps' sums and sums of squares, `direct` from each window's own rows, `merged` from merged moments of steps. The rows become one row for
    each step at once, and windows are over those: a window is some whole steps and the end of the one before.
    """
    at, x, d = F.col("pos") % step, F.col(value), F.col("diff")

    def last(rows: int, keys: list[str]):
        """How a sum and an array of moments over the last so many rows come from steps: (whole steps, place of the first row of an end, sum, sets)."""
        whole, end = rows // step, rows % step
        over = along(keys).rowsBetween(-(whole - 1), 0)
        zero, back = F.lit(0.0), along(keys)
        add = lambda c: (F.coalesce(F.sum(c).over(over), zero) if whole else zero) + (F.coalesce(F.lag(f"{c}_end", whole).over(back) if whole else F.col(f"{c}_end"), zero) if end else zero)
        sets = lambda c: F.concat(F.array(F.coalesce(F.lag(f"{c}_end", whole).over(back) if whole else F.col(f"{c}_end"), no_moments()) if end else no_moments()), F.collect_list(c).over(over) if whole else F.array())
        return whole, step - end, add, sets

    def op(rows: DataFrame, keys: list[str]) -> DataFrame:
        (whole, first, add, sets), (_, first_d, add_d, _), per = last(size + 1, keys), last(size, keys), size // step
        own, move = F.when(at >= first, x), F.coalesce(d, F.lit(0.0))
        moved = F.when(at >= first_d, move)
        steps = differences(rows, keys, value).groupBy(*keys, "_own", F.floor(F.col("pos") / step).alias("step")).agg(
            F.count("*").alias("_rows"), F.min("pos").alias("start_idx"), F.max("pos").alias("pos"),
            F.sum(x).alias("s"), F.sum(x * x).alias("q"), F.sum(own).alias("s_end"), F.sum(own * own).alias("q_end"),
            F.sum(move).alias("ds"), F.sum(move * move).alias("dq"), F.sum(moved).alias("ds_end"), F.sum(moved * moved).alias("dq_end"),
            moments(x).alias("m"), moments(own).alias("m_end"), moments(d).alias("dm"), moments(F.when(at > 0, d)).alias("dm_inside"),
            F.transform(F.array_sort(F.collect_list(F.struct("pos", x.alias("v")))), lambda p: p["v"]).alias("v"),
        ).withColumn("_block", F.lit(0))
        near = along(keys).rowsBetween(-max(per - 1, 0), 0)
        every = F.flatten(F.collect_list("v").over(along(keys).rowsBetween(-whole, 0)))
        truth, moves = F.collect_list("m").over(near), F.collect_list(F.struct("dm", "dm_inside")).over(near)
        wide = steps.withColumns({"_s": add("s"), "_q": add("q"), "_ds": add_d("ds"), "_dq": add_d("dq"), "_m": sets("m"), "_v": every, "_truth": truth, "_moves": moves, "start_idx": F.min("start_idx").over(near)})
        full = wide.where(F.col("_rows") == step).withColumn("_v", F.filter(F.when(F.size("_v") > size + 1, F.slice("_v", F.size("_v") - size, size + 1)).otherwise(F.col("_v")), lambda v: v.isNotNull()))
        within = F.concat(F.array(F.get("_moves", F.lit(0))["dm_inside"]), F.transform(F.slice("_moves", 2, max(per, 1)), lambda p: p["dm"]))
        full = full.withColumns({"_m": merged_all(F.col("_m")), "_truth": merged_all(F.col("_truth")), "_moves": merged_all(within), "direct_mean": F.try_divide(F.aggregate("_v", F.lit(0.0), lambda a, v: a + v), F.size("_v"))})
        n, moved_n = F.least(F.col("pos") + 1, F.lit(size + 1)), F.least(F.col("pos"), F.lit(size))
        mean, move_mean = F.col("_s") / n, F.col("_ds") / F.nullif(moved_n, F.lit(0))
        spread = lambda c: F.sqrt(F.try_divide(F.col(f"{c}.m2"), F.col(f"{c}.n")))
        mean_of = lambda c: F.when(F.col(f"{c}.n") > 0, F.col(f"{c}.mean"))
        return full.select(
            *keys, "_own", "_block", "pos", "start_idx", (F.col("pos") + 1).alias("end_idx"), mean.alias("sums_mean"),
            F.when(n < 2, F.lit(0.0)).otherwise(F.sqrt(F.greatest(F.lit(0.0), F.col("_q") / n - mean * mean))).alias("sums_std"), "direct_mean",
            F.sqrt(F.try_divide(F.aggregate("_v", F.lit(0.0), lambda a, v: a + (v - F.col("direct_mean")) * (v - F.col("direct_mean"))), F.size("_v"))).alias("direct_std"),
            mean_of("_m").alias("merged_mean"), spread("_m").alias("merged_std"),
            F.when(moved_n < 2, F.lit(1.0)).otherwise(F.sqrt(F.greatest(F.lit(1e-7), F.col("_dq") / moved_n - move_mean * move_mean))).alias("diff_std"),
            (F.col("pos") >= step).alias("ready"), mean_of("_truth").alias("gt_mean"), spread("_truth").alias("gt_std"), spread("_moves").alias("gt_diff_std"),
        )

    return by_segment(df, key, size + step, 0, op, -(-segment // step) * step, parts, size + 1)


def step_stats(df: DataFrame, key: str, value: str, per: int = 6, step: int = 30, segment: int = SEGMENT, parts: int | None = None) -> DataFrame:
    """(key, step, n, mean, std) of the rows of each full step and the `per` - 1 before it, or as many as there are: from the steps' sums."""
    x = F.col(value)
    steps = df.groupBy(key, F.floor(F.col("pos") / step).alias("pos")).agg(F.count("*").alias("_rows"), F.sum(x).alias("_s"), F.sum(x * x).alias("_q"))

    def op(rows: DataFrame, keys: list[str]) -> DataFrame:
        near = along(keys).rowsBetween(-(per - 1), 0)
        return rows.withColumns({"n": F.sum("_rows").over(near), "_s": F.sum("_s").over(near), "_q": F.sum("_q").over(near)})

    rows = by_segment(steps, key, per - 1, 0, op, max(segment, per), parts, max(segment, per)).where(F.col("_rows") == step)
    mean = F.col("_s") / F.col("n")
    return rows.select(key, F.col("pos").alias("step"), "n", mean.alias("mean"), F.sqrt(F.col("_q") / F.col("n") - mean * mean).alias("std"))


def z_scored(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Against the mean and population deviation of the whole clip; 0 where there is no deviation."""
    w = Window.partitionBy(*keys)
    n, s, q = F.count(value).over(w), F.sum(value).over(w), F.sum(F.col(value) * F.col(value)).over(w)
    with_sums = df.withColumns({"_n": n, "_s": s, "_q": q})
    mean = F.col("_s") / F.col("_n")
    std = F.sqrt(F.greatest(F.lit(0.0), F.col("_q") / F.col("_n") - mean * mean))
    return with_sums.withColumn("z", F.coalesce((F.col(value) - mean) / F.nullif(std, F.lit(0.0)), F.lit(0.0))).drop("_n", "_s", "_q")


def diff_normalised(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Change to the next row over the deviation of all changes of the clip; 0 for the last row."""
    w = Window.partitionBy(*keys).orderBy("pos")
    whole = Window.partitionBy(*keys)
    after = F.lead(value).over(w)
    rows = df.withColumn("_d", (after - F.col(value)) / (after + F.col(value) + F.lit(1e-7)))
    rows = rows.withColumns({"_n": F.count("_d").over(whole), "_s": F.sum("_d").over(whole), "_q": F.sum(F.col("_d") * F.col("_d")).over(whole)})
    mean = F.col("_s") / F.col("_n")
    std = F.sqrt(F.greatest(F.lit(0.0), F.col("_q") / F.col("_n") - mean * mean))
    return rows.withColumn("dn", F.coalesce(F.col("_d") / F.nullif(std, F.lit(0.0)), F.lit(0.0))).drop("_d", "_n", "_s", "_q")


def chunk_buffers(chunks: DataFrame, key: str, value: str, per_window: int = 6, every: int = 6) -> DataFrame:
    """The last `per_window` chunks' values, one after the other, for every `every`-th chunk once the buffer is full."""
    w = Window.partitionBy(key).orderBy("chunk_id").rowsBetween(-(per_window - 1), 0)
    full = chunks.withColumns({"_b": F.collect_list(value).over(w), "_n": F.count(value).over(w)})
    due = (F.col("_n") == per_window) & ((F.col("chunk_id") - (per_window - 1)) % every == 0)
    return full.where(due).withColumn("buffer", F.flatten("_b")).drop("_b", "_n")
