"""Line dedup, spelling variants and whitening against brute force, with their edge cases."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsegrid.llm import chunks, kernels, lines, variants, whitening

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
BLANK = " \t\n\x0b\x0c\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_lines(rows):
    """rows: (doc_id, text); documents are rows, no id is below all ids."""
    key = lambda line: line.strip(BLANK).translate(LOWER)
    split = [(i, (t or "").split("\n")) for i, t in rows]
    n, last = Counter(), {}
    for i, own in split:
        for k in {key(x) for x in own}:
            n[k] += 1
            last[k] = max(last.get(k, (False, 0)), (i is not None, i or 0))
    out = Counter()
    for i, own in split:
        kept = [x for x in own if len(key(x)) < 40 or n[key(x)] < 5 or last[key(x)] == (i is not None, i or 0)]
        out[i, len(own), len(own) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()] += 1
    return out


def line_rows(seed=1, n=80):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("aàbcÉdeFZ") for _ in range(rng.randint(2, 9)))
    pool = [" ".join(word() for _ in range(rng.randint(5, 16))) for _ in range(30)] + ["é" * 39, "é" * 40, "x" * 40, "x" * 39, "Ä" * 50]
    rows = []
    for i in range(n):
        own = [rng.choice(pool) for _ in range(rng.randint(0, 9))]
        own = [rng.choice(["", " ", "\t\r", "\x0b"]) + (x.upper().replace("É", "É") if rng.random() < 0.1 else x) + rng.choice(["", "  ", "\r", "\x0c"]) for x in own]
        rows.append((i * 7 % 101, "\n".join(own) + rng.choice(["", "\n", "\n\n"])))
    rows += [(900, None), (901, ""), (902, "\n"), (903, "x" * 40), (903, "x" * 40), (None, "x" * 40), (None, "\n".join([pool[0]] * 4)), (904, " " + "x" * 40), (905, "x" * 20 + "\r" + "x" * 20)]
    return rows


@pytest.mark.parametrize("bits", [lines.BITS, 64])
def test_lines(spark, monkeypatch, bits):
    """With 64 bits nearly all is suspected; the rows are the same."""
    monkeypatch.setattr(lines, "SHARD_BYTES", 4000)
    monkeypatch.setattr(chunks.Chunked.__init__, "__defaults__", ((), 2000, True))
    rows = line_rows()
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], SCHEMA).repartition(5)
    got = Counter(map(tuple, lines.dedup(docs, bits=bits).collect()))
    assert got == brute_lines(rows)
    assert sum(r[2] * n for r, n in got.items()) > 50
    kept = {(r["doc_id"], r["kept_sha256"], hashlib.sha256(r["text"].encode()).hexdigest()) for r in lines.dedup(docs, with_text=True).collect()}
    assert all(a == b for _, a, b in kept)


def test_lines_only_without_ids_and_none(spark):
    rows = [(None, "y" * 60)] * 6
    got = lines.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert [tuple(r)[:3] for r in got] == [(None, 1, 0)] * 6
    assert lines.dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    clash = spark.createDataFrame([(i, "z" * 50 + "\nshort", i) for i in range(6)], "doc_id long, text string, h long").withColumns({c: F.lit(1) for c in ("chunk", "g", "order", "last", "rows", "n_lines")})
    assert Counter(r["n_dropped"] for r in lines.dedup(clash).collect()) == {1: 5, 0: 1}


def test_a_line_in_every_chunk_and_very_long_lines(spark, monkeypatch):
    monkeypatch.setattr(chunks.Chunked.__init__, "__defaults__", ((), 3000, True))
    rows = [(i, f"own line number {i} of this one document only, no other\nAll rights are reserved by all of the authors of it") for i in range(300)]
    long = "w" * 1_000_000
    rows += [(1000 + i, f"{long}\n{i}") for i in range(5)] + [(2000, "\n" * 300_000)]
    got = Counter(map(tuple, lines.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()))
    assert got == brute_lines(rows)


def test_the_twice_seen_filter_holds_all_shared_keys():
    """Bits of a key that two messages have are set in the merged filter, by whichever way."""
    rng = np.random.default_rng(4)
    a, b = np.unique(rng.integers(0, 1000, 40)), np.unique(rng.integers(0, 1000, 40))
    for x in (a, b):
        back, rest = lines.unpacked_bits(lines.packed_bits(x) + b"rest")
        assert (back == x).all() and rest == b"rest"


def brute_words(rows):
    n = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 97 == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1 :]
            n[run] += 1
    return {w: c for w, c in n.items() if len(w) >= 5 and c >= 3}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute_variants(words):
    near = {w: [v for v in words if one_edit(w, v)] for w in words}
    form = {}
    for w, own in near.items():
        best = min(own, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 2 * words[w] else None
    out = set()
    for w in words:
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, words[w], len(near[w]), words[form[w]] if form[w] else None))
    return out


def variant_rows(seed=2, n=150):
    rng = random.Random(seed)
    base = ["".join(rng.choice("aabÀéz×") for _ in range(rng.randint(4, 9))) for _ in range(40)]
    rows = []
    for i in range(n):
        own = []
        for _ in range(60):
            w = list(rng.choice(base[: rng.randint(1, 40)]))
            if rng.random() < 0.3:
                k = rng.randrange(len(w))
                w[k : k + rng.randint(0, 1)] = rng.choice(["", "a", "bé", "Z"])
            own.append("".join(w))
        rows.append((i * 3 if i % 9 else None, rng.choice([" ", ", ", "-", "ā"]).join(own)))
    return rows + [(7, None), (8, ""), (9, "µĀ 1234"), (3, rows[1][1]), (3, rows[1][1])]


@pytest.mark.parametrize("size", [7, 60, 100_000])
def test_variants(spark, monkeypatch, size):
    monkeypatch.setattr(variants, "RANGE_WORDS", size)
    monkeypatch.setattr(variants, "HELD_WORDS", 50)
    rows = variant_rows()
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], SCHEMA).repartition(4)
    words = brute_words(rows)
    got = variants.variants(docs).collect()
    assert len(got) == len(words) > 100
    assert {tuple(r) for r in got} == brute_variants(words)


def test_words_that_share_a_beginning_over_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(variants, "RANGE_WORDS", 3)
    rng = random.Random(5)
    words = {"aaaaa" * k + "".join(rng.choice("ab") for _ in range(rng.randint(0, 3))) for k in (1, 2, 3) for _ in range(12)} | {"b" * k for k in range(5, 12)}
    rows = [(i, " ".join([w] * rng.randint(3, 30))) for i, w in enumerate(sorted(words))] + [(99, " ".join(["c" * 3000 + "d"] * 3 + ["c" * 3000] * 7))]
    got = {tuple(r) for r in variants.variants(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_variants(brute_words(rows))


def test_no_words(spark):
    assert variants.variants(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert variants.variants(spark.createDataFrame([(1, None), (2, "abcdef abcdef")], "doc_id long, text string")).count() == 0
    clash = spark.createDataFrame([(1, "abcdef " * 3, 5)], "doc_id long, text string, n long").withColumns({c: F.lit("own") for c in ("word", "form", "id", "key", "part", "p", "s", "root")})
    assert variants.variants(clash).count() == 1


def test_checksums_are_carried_on():
    rng = np.random.default_rng(6)
    texts = [bytes(rng.integers(97, 123, n).astype(np.uint8)) for n in (1, 2, 63, 64, 65, 66, 500, 7)]
    data = np.frombuffer(b"".join(texts), np.uint8)
    at = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    begun = np.array([zlib.crc32(str(k).encode()) for k in range(len(texts))], np.uint32)
    got = variants.crc_of_runs(data, at[:-1], at[1:], begun)
    assert [int(v) for v in got] == [zlib.crc32(str(k).encode() + t) for k, t in enumerate(texts)]


def test_runs_end_with_their_text():
    texts = ["abc", "", "défÿg", "ÀB×", "Āx", "y"]
    import pyarrow as pa

    data, at = kernels.packed(pa.array(texts))
    starts, ends, row = variants.runs(data, at)
    got = [(int(r), data[a:b].tobytes().decode()) for a, b, r in zip(starts, ends, row, strict=True)]
    assert got == [(0, "abc"), (2, "défÿg"), (3, "ÀB×"), (4, "x"), (5, "y")]


def brute_whitening(vectors):
    x = np.floor(64 * np.array(vectors, np.float64)).astype(np.int64) + 1_000_000
    n, s = len(x), x.sum(0)
    y = (n * x - s) / n
    value, vector = np.linalg.eigh(y.T @ y / n)
    return n, ((n * x - s) ** 2).sum(1), y, value[::-1], vector[:, ::-1]


def test_whitening(spark, monkeypatch):
    monkeypatch.setattr(whitening, "BLOCK_ROWS", 16)
    rng = np.random.default_rng(7)
    vectors = (rng.standard_normal((200, 40)) * np.linspace(0.05, 3, 40) @ np.linalg.qr(rng.standard_normal((40, 40)))[0]).astype(np.float32)
    rows = [(i, [float(v) for v in x], 1) for i, x in enumerate(vectors)]
    bad = [(500, None, 1), (501, [], 1), (502, [None] * 40, 1), (503, [1.0] * 39, 1), (504, [float("nan")] + [0.0] * 39, 1), (505, [float("inf")] + [0.0] * 39, 1), (506, [1e30] + [0.0] * 39, 1)]
    table = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>, label int").repartition(3).withColumns({c: F.lit(1) for c in ("id", "x", "n", "v", "component")})
    out = whitening.whiten(table).toPandas().sort_values(["vec_id", "component"])
    n, deviation, y, value, vector = brute_whitening(vectors)
    assert len(out) == 200 * 32 and (out["n"] == n).all() and (out["deviation"].to_numpy().reshape(200, 32) == deviation[:, None]).all()
    got = out["whitened"].to_numpy().reshape(200, 32)
    want = (y @ vector / np.sqrt(value))[:, :32]
    sign = np.sign((got * want).sum(0))
    assert np.abs(got * sign - want).max() < 1e-9
    assert np.allclose(out["explained"].to_numpy().reshape(200, 32), value[:32] / value.sum(), rtol=1e-10)
    assert out["identity_error"].nunique() == 1 and out["identity_error"].iloc[0] < 1e-10
    assert np.abs(np.cov(got.T, bias=True) - np.eye(32)).max() < 1e-10


def test_equal_variances_and_dimensions_without_any(spark):
    """Corners of a cube: all variances are equal; two dimensions are constant, one repeats another."""
    corners = [[(k >> b) & 1 for b in range(4)] for k in range(16)]
    rows = [(None if k == 3 else k % 5, [float(v) for v in c] + [7.0, -1.0, float(c[0])]) for k, c in enumerate(corners)]
    out = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).toPandas()
    assert sorted(out["component"].unique()) == [1, 2, 3, 4] and len(out) == 64
    assert out["identity_error"].iloc[0] < 1e-9 and out["vec_id"].isna().sum() == 4
    share = out.groupby("component")["explained"].first()
    assert share.loc[1] == pytest.approx(0.4) and share.loc[2:].tolist() == pytest.approx([0.2] * 3)


def test_whitening_of_equal_rows_and_none(spark):
    one = spark.createDataFrame([(1, [0.5, 0.25])] * 3, "vec_id long, embedding array<float>")
    assert whitening.whiten(one).count() == 0
    assert whitening.whiten(one.where("false")).count() == 0
    large = spark.createDataFrame([(k, [float(v), 0.0]) for k, v in enumerate([2.0**33, -(2.0**33), 1.0])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="too large|overflow|beyond|convert"):
        whitening.whiten(large).collect()


def test_scaled_dimensions_far_from_nought(spark):
    """Means far above the deviations, which centring after the product would lose."""
    rng = np.random.default_rng(8)
    vectors = rng.standard_normal((120, 6)) * [1000, 300, 100, 10, 1, 0.5] + 1e7
    rows = [(i, x.tolist()) for i, x in enumerate(vectors)]
    out = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).toPandas().sort_values(["vec_id", "component"])
    _, _, y, value, vector = brute_whitening(vectors)
    got, want = out["whitened"].to_numpy().reshape(120, 6), y @ vector / np.sqrt(value)
    assert np.abs(got * np.sign((got * want).sum(0)) - want).max() < 1e-6


def test_components_beyond_many_dimensions(spark):
    """With many more dimensions than components the steps end early."""
    rng = np.random.default_rng(9)
    vectors = rng.standard_normal((60, 90)) * 0.8 ** np.arange(90) * 40
    out = whitening.whiten(spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(vectors)], "vec_id long, embedding array<double>"), wanted=5).toPandas()
    value = brute_whitening(vectors)[3]
    assert out.groupby("component")["explained"].first().tolist() == pytest.approx((value[:5] / value.sum()).tolist(), rel=1e-9)


def test_groups_of_pairs_are_bounded(spark):
    """A word of n letters meets as many rows in a pair as the alphabet has letters."""
    words = [f"{a}{b}xyz" for a in "abcdefgh" for b in "abcdefgh"]
    vocab = spark.createDataFrame([(w, 3) for w in words], "word string, n long")
    _, pairs = variants.node_pairs(vocab)
    sizes = pairs.groupBy("p", "s").count().agg(F.max("count")).first()[0]
    assert sizes == 8
    by_word = defaultdict(int)
    for r in variants.neighbours(pairs).collect():
        by_word[r["id"]] = r["n_near"]
    assert set(by_word.values()) == {14}
