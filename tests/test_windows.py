"""Numbering in parts, segments with edges, merged moments."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsegrid.operators import windows


def signal(spark, n, base=0.0, seed=1, keys=(1, 2)):
    rng = np.random.default_rng(seed)
    rows = [(k, i, base + float(rng.integers(1, 100))) for k in keys for i in range(n)]
    return spark.createDataFrame(rows, "k long, pos long, v double").repartition(5), rows


def test_numbers_are_the_same_in_parts(spark):
    rng = np.random.default_rng(2)
    rows = [(None if i % 50 == 0 else int(i % 3 == 0), None if i % 17 == 0 else int(rng.integers(0, 400)), i) for i in range(600)]
    df = spark.createDataFrame(rows, "k long, t long, id long")
    plain = windows.positions(df, "k", ["t", "id"]).collect()
    parts = windows.positions(df, "k", ["t", "id"], coarse=F.floor(F.col("t") / 25))
    assert sorted(map(str, plain)) == sorted(map(str, parts.collect())) and parts.columns == ["k", "t", "id", "pos"]


def test_a_subject_with_many_rows_is_in_many_tasks(spark):
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        df = spark.range(6000).select((F.col("id") * 0 + 7).alias("k"), "id", F.col("id").cast("double").alias("v"))
        placed = windows.positions(df, "k", ["id"], coarse=F.floor(F.col("id") / 500))
        rolled = windows.rolling_stats(placed, "k", "v", 20, segment=500)
        counts = [r["count"] for r in rolled.groupBy(F.spark_partition_id()).count().collect()]
        assert len(counts) > 1 and sum(counts) == 6000 and max(counts) < 5000
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)


@pytest.mark.parametrize("segment", [61, 100, 128, 1 << 15])
def test_segments_change_nothing(spark, segment):
    df, rows = signal(spark, 400)
    got = {(r["k"], r["pos"]): r for r in windows.rolling_stats(df, "k", "v", 60, segment=segment).collect()}
    diff = {(r["k"], r["pos"]): r["diff_std"] for r in windows.rolling_diff_std(df, "k", "v", 60, segment=segment).collect()}
    assert len(got) == len(diff) == 800
    for k in (1, 2):
        x = np.array([v for key, _, v in rows if key == k])
        d = (x[1:] - x[:-1]) / (x[1:] + x[:-1] + 1e-7)
        for i in range(400):
            own = x[max(0, i - 60) : i + 1]
            assert got[k, i]["roll_mean"] == pytest.approx(own.mean()) and got[k, i]["roll_std"] == pytest.approx(own.std() if i else 0.0, abs=1e-9)
            moves = d[max(0, i - 60) : i]
            assert diff[k, i] == pytest.approx(np.sqrt(max(1e-7, moves.var())) if len(moves) > 1 else 1.0, rel=1e-7)
    chunks = sorted(map(tuple, windows.standardised_chunks(df, "k", "v", 60, 10, segment).select("k", "pos", "chunk_id", F.round("std_value", 8), F.round("diff_value", 8)).collect()))
    whole = sorted(map(tuple, windows.standardised_chunks(df, "k", "v", 60, 10).select("k", "pos", "chunk_id", F.round("std_value", 8), F.round("diff_value", 8)).collect()))
    assert chunks == whole and len(chunks) == 780


def test_segments_hold_their_windows(spark):
    df, _ = signal(spark, 10)
    with pytest.raises(ValueError, match="segments"):
        windows.rolling_stats(df, "k", "v", 60, segment=50)


def test_merged_moments_keep_their_digits(spark):
    """Near 1e9 sums of squares lose the deviation; merged moments don't."""
    df, rows = signal(spark, 300, base=1e9, keys=(1,))
    x = np.array([v for _, _, v in rows])
    out = {r["pos"]: r for r in windows.rolling_forms(df, "k", "v", 60, 10).collect()}
    assert sorted(out) == list(range(9, 300, 10))
    worst = 0.0
    for i, r in out.items():
        own = x[max(0, i - 60) : i + 1] - 1e9
        assert r["merged_std"] == pytest.approx(own.std(), rel=1e-6) and r["merged_mean"] - 1e9 == pytest.approx(own.mean(), abs=1e-4)
        assert r["direct_std"] == pytest.approx(own.std(), rel=1e-6) and r["ready"] == (i >= 10)
        worst = max(worst, abs(r["sums_std"] - own.std()))
    assert worst > 0.01


def test_moments_of_empty_sets_merge(spark):
    m = lambda n, mean, m2: F.struct(F.lit(n).alias("n"), F.lit(mean).alias("mean"), F.lit(m2).alias("m2"))
    none, some = m(0.0, 0.0, 0.0), m(3.0, 2.0, 2.0)
    got = spark.range(1).select(windows.merged(none, some).alias("a"), windows.merged(some, none).alias("b"), windows.merged(none, none).alias("c"), windows.merged(some, m(1.0, 6.0, 0.0)).alias("d")).first()
    assert tuple(got["a"]) == tuple(got["b"]) == (3.0, 2.0, 2.0) and got["c"]["n"] == 0 and tuple(got["d"]) == (4.0, 3.0, 14.0)
