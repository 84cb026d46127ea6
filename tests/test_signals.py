import numpy as np
import pytest

from pulsegrid.functions import filters
from pulsegrid.operators import pulse

FPS = 30.0


def test_detrending_removes_a_line():
    t = np.arange(180.0)
    assert np.abs(filters.detrend_matrix(180) @ (3 * t - 7)).max() < 1e-8


@pytest.mark.parametrize("order,low,high", [(1, 0.75, 2.5), (1, 0.75, 3.0), (3, 0.7, 2.5)])
def test_filter_gain_at_the_cutoffs(order, low, high):
    b, a = filters.butter_bandpass(order, low, high, FPS)
    z = np.exp(2j * np.pi * np.array([low, high]) / FPS)
    gain = np.abs(np.polyval(b[::-1], 1 / z) / np.polyval(a[::-1], 1 / z))
    assert np.allclose(gain, 1 / np.sqrt(2), atol=1e-9)


def test_known_coefficients():
    b, a = filters.butter_bandpass(1, 0.75, 2.5, FPS)
    assert np.allclose(b, [0.15635952, 0, -0.15635952], atol=1e-8) and np.allclose(a, [1, -1.61758769, 0.68728096], atol=1e-8)
    b, a = filters.butter_bandpass(3, 0.7, 2.5, FPS)
    assert np.allclose(b, [0.00475052, 0, -0.01425157, 0, 0.01425157, 0, -0.00475052], atol=1e-8)
    assert np.allclose(a, [1, -5.0474607, 10.8059392, -12.56877358, 8.38162518, -3.03932748, 0.46831211], atol=1e-7)


def test_filter_matrix_is_the_filter():
    x = np.random.default_rng(1).standard_normal(180)
    b, a = filters.butter_bandpass(3, 0.7, 2.5, FPS)
    assert np.allclose(filters.filtfilt_matrix(180, 3, 0.7, 2.5, FPS) @ x, filters.filtfilt(b, a, x))


def test_too_short_a_window():
    with pytest.raises(ValueError):
        filters.filtfilt_matrix(9, 1, 0.75, 2.5, FPS)


@pytest.mark.parametrize("chain", [{}, {"detrended": True, "filtered": True}, {"detrended": True, "filtered": True, "own_band": pulse.PLANE_BAND}])
def test_a_sine_gives_its_own_bin(spark, chain):
    rows = [(1, k, i, float(np.sin(2 * np.pi * k * i / 256))) for k in range(7, 22) for i in range(180)]
    df = spark.createDataFrame(rows, "face_id long, win_id long, at long, v double")
    got = {r["win_id"]: (r["bin"], r["heart_rate"]) for r in pulse.spectral_rate(df, ["face_id", "win_id"], "v", 180, **chain).collect()}
    assert got == {k: (k, k * FPS / 256 * 60) for k in range(7, 22)}


def test_bins_of_the_band():
    assert list(filters.band_bins(180, FPS)) == list(range(7, 22))


def traces(spark, rgb):
    return spark.createDataFrame([(1, 0, i, *map(float, v)) for i, v in enumerate(rgb)], "face_id long, win_id long, at long, r double, g double, b double")


def plane(rgb, ell=48):
    """All stretches at once: their projections, tuned by their deviations, centred and added where they lie."""
    stretches = np.lib.stride_tricks.sliding_window_view(rgb, ell, axis=0)[: len(rgb) - ell]
    c = stretches / stretches.mean(2, keepdims=True)
    u, v = c[:, 1] - c[:, 2], c[:, 1] + c[:, 2] - 2 * c[:, 0]
    h = u + v * (u.std(1) / v.std(1))[:, None]
    h -= h.mean(1, keepdims=True)
    out = np.zeros(len(rgb))
    np.add.at(out, np.arange(len(h))[:, None] + np.arange(ell), h)
    return out


def test_plane_projection(spark):
    rgb = np.random.default_rng(2).uniform(50, 200, (120, 3))
    got = pulse.plane_orthogonal(traces(spark, rgb), ["face_id", "win_id"], 120).orderBy("at").toPandas()["h"]
    assert np.abs(got - plane(rgb)).max() < 1e-9


def test_plane_pulse_is_detrended_and_filtered(spark):
    rgb = np.random.default_rng(5).uniform(50, 200, (120, 3))
    want = filters.filtfilt(*filters.butter_bandpass(1, 0.75, 3.0, FPS), filters.detrend_matrix(120) @ plane(rgb))
    got = pulse.plane_pulse(traces(spark, rgb), ["face_id", "win_id"], 120).orderBy("at").toPandas()["y"]
    assert np.abs(got - want).max() < 1e-9


def rate_of(x):
    """Detrending, band-pass, padded periodogram, strongest bin of the band."""
    y = filters.filtfilt(*filters.butter_bandpass(1, 0.75, 2.5, FPS), filters.detrend_matrix(len(x)) @ x)
    power = np.abs(np.fft.rfft(y, 256)) ** 2
    return (7 + power[7:22].argmax()) * FPS / 256 * 60


@pytest.mark.parametrize("name", ["plane_orthogonal", "independent", "guided", "chrominance"])
def test_extractors_and_their_rates(spark, name):
    from pulsegrid.operators import extensions

    t = np.arange(180)
    rng = np.random.default_rng(6)
    beat = np.sin(2 * np.pi * 1.4 * t / FPS)
    rgb = 120 + np.stack([0.3 * beat, 1.5 * beat, 0.6 * beat], 1) + rng.normal(0, 0.3, (180, 3)) + np.stack([t * 0.05] * 3, 1)
    keys = ["face_id", "win_id"]
    signal = extensions.EXTRACTORS[name](traces(spark, rgb), keys, 180, FPS)
    rows = signal.orderBy("at").toPandas()["v"].to_numpy()
    (got,) = extensions.ESTIMATORS["spectrum"](signal, keys, len(rows), FPS).collect()
    assert got["heart_rate"] == pytest.approx(rate_of(rows)) and abs(got["heart_rate"] - 84) < 8


def test_chrominance_by_stretches(spark):
    rgb = np.random.default_rng(7).uniform(50, 200, (180, 3))
    b, a = filters.butter_bandpass(3, 0.7, 2.5, FPS)
    want, hann = np.zeros(168), np.hanning(48)
    for i in range(6):
        c = rgb[24 * i : 24 * i + 48]
        n = c / c.mean(0)
        x, y = filters.filtfilt(b, a, n @ [3.0, -2.0, 0.0]), filters.filtfilt(b, a, n @ [1.5, 1.0, -1.5])
        want[24 * i : 24 * i + 48] += (x - x.std() / y.std() * y) * hann
    got = pulse.chrominance(traces(spark, rgb), ["face_id", "win_id"], 180).orderBy("at").toPandas()["s"]
    assert np.abs(got - want).max() < 1e-9


def test_rolling_sums_don_t_drift(spark):
    from pulsegrid.operators import windows

    x = np.random.default_rng(8).uniform(0, 1, 500) + 1e6
    df = spark.createDataFrame([(1, i, float(v)) for i, v in enumerate(x)], "face_id long, pos long, v double")
    got = windows.rolling_stats(df, "face_id", "v", 30).orderBy("pos").toPandas()
    for i in (0, 1, 29, 30, 31, 61, 62, 499):
        part = x[max(0, i - 30) : i + 1]
        assert got["n"][i] == len(part) and got["roll_mean"][i] == pytest.approx(part.mean(), rel=1e-12)
    d = np.diff(x[:100]) / (x[1:100] + x[:99] + 1e-7)
    diff = windows.rolling_diff_std(df.where("pos < 100"), "face_id", "v", 30).orderBy("pos").toPandas()["diff_std"]
    assert diff[99] == pytest.approx(max(d[-30:].std(), 1e-7**0.5), rel=1e-6) and diff[0] == diff[1] == 1.0


def field(number, value):
    """One field of a protocol buffer: a number, text or a message."""
    if isinstance(value, int):
        return bytes([number << 3, value])
    value = value.encode() if isinstance(value, str) else value
    return bytes([number << 3 | 2, len(value)]) + value


def test_network_signal(spark):
    from pulsegrid.operators import extensions

    shape = b"".join(field(1, field(1, n)) for n in (3, 2))
    tensor = lambda name: field(1, name) + field(2, field(1, field(1, 1) + field(2, shape)))
    graph = field(1, field(1, "x") + field(2, "y") + field(4, "Neg")) + field(2, "g") + field(11, tensor("x")) + field(12, tensor("y"))
    model = field(1, 8) + field(7, graph) + field(8, field(2, 13))  # a network of one operation: the negative
    clips = spark.createDataFrame([(1, [1.0, 2.0, 3.0, 4.0, 5.0, 6.0]), (2, [0.5] * 6)], "face_id long, tensor array<double>")
    out = extensions.network_signal(clips, model, (3, 2), "face_id long, at long, v double")
    assert [r["v"] for r in out.where("face_id = 1").orderBy("at").collect()] == [-1.0, -2.0, -3.0, -4.0, -5.0, -6.0] and out.count() == 12


def test_unmixing_finds_sources():
    t = np.arange(600) / FPS
    sources = np.stack([np.sin(2 * np.pi * 1.2 * t), np.sign(np.sin(2 * np.pi * 0.37 * t)), (t * 0.7) % 1 - 0.5])
    got = pulse.jade(np.random.default_rng(3).standard_normal((3, 3)) @ sources)
    match = np.abs(np.corrcoef(np.vstack([sources, got]))[:3, 3:])
    assert (match.max(1) > 0.97).all()


def test_modes_separate_fast_and_slow():
    from pulsegrid.functions import modes

    t = np.arange(300) / FPS
    fast, slow = np.sin(2 * np.pi * 2.0 * t), 3 * np.sin(2 * np.pi * 0.2 * t)
    found = modes.modes(fast + slow)
    assert np.corrcoef(found[0][30:-30], fast[30:-30])[0, 1] > 0.95
    assert modes.modes(np.arange(50.0)) == []


def test_extensions(spark):
    from pulsegrid.operators import extensions

    x = 100 + np.sin(2 * np.pi * 10 * np.arange(180) / 256)
    df = spark.createDataFrame([(1, 0, i, 90.0, float(v), 80.0) for i, v in enumerate(x)], "face_id long, win_id long, at long, r double, g double, b double")
    rate = extensions.heart_rates(df, ["face_id", "win_id"], 180, extract="green").first()["heart_rate"]
    assert rate == 10 * FPS / 256 * 60


def test_clips_must_be_whole(spark):
    df = spark.createDataFrame([(1, i) for i in range(7)], "face_id long, pos long")
    assert pulse.whole_clips(df.where("pos < 6"), "face_id", 3).where("clip_id = 1").count() == 3
    with pytest.raises(Exception, match="not a multiple"):
        pulse.whole_clips(df, "face_id", 3).collect()


def test_matrix_products_of_many_windows(spark):
    rng = np.random.default_rng(51)
    x, m = rng.standard_normal((9, 180)), filters.detrend_matrix(180)
    rows = [(f"w{i}", t, None if (i, t) == (4, 7) else float(v)) for i, w in enumerate(x) for t, v in enumerate(w)] + [("short", 0, 1.0)]
    df = spark.createDataFrame(rows, "key string, at int, v double").repartition(5)
    out = pulse.matrix_applied(df, ["key"], "v", m)
    assert "ArrayType" not in out._jdf.queryExecution().optimizedPlan().toString() and len(out._jdf.queryExecution().toString()) < 50_000
    got = {(r["key"], r["at"]): r["y"] for r in out.collect()}
    assert len(got) == 9 * 180
    for i, w in enumerate(x):
        own = [got[f"w{i}", t] for t in range(180)]
        assert own == [None] * 180 if i == 4 else np.allclose(own, m @ w, atol=1e-9)
