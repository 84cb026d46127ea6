"""Secret scans: base patterns, plus a randomness test battery under false-discovery control (native).

Three base kinds are matched by pattern (see BASE).  Beside them every run of 20 or more
characters of the usual encodings is a candidate.  Its encoding is inferred (hex, decimal,
base32, base64), and three statistics are set against what ordinary words would show:

* chi-squared of its characters against a uniform use of the alphabet: words use few
  letters and use them unevenly, so a low value is improbable for words;
* runs: the number of changes between letter case and digits (hex: letters and digits);
  words hardly change;
* serial correlation of neighbouring characters' values at lag 1: words alternate vowels and
  consonants, random strings don't correlate.

Each gives a p-value of the hypothesis "this is ordinary text", by normal approximations whose
means grow with the length.  Fisher's method joins them.  A Benjamini-Hochberg threshold is
taken within each length class over all candidates of the corpus, from counts of p-values in
fixed bins; candidates beyond it are added as kind `random`.

Work is linear in the text, or nearly so in the number of matches (n^(4/3) for prefix sums within
one text): places come from scans in blocks, and texts are put together from pieces once.

A secret itself is never written: `found` holds as many asterisks as it has characters, `LENGTHS[-1]` at most.

Defined results: null and empty texts have no spans and the digest of the empty string; repeated
rows give repeated rows; an empty table gives no rows; other columns stay as they are, and where one is
called `secrets` the result is `secrets_2`.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import columns, free, settled, stored, table

ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: Kind, pattern and whether a match counts; in the order in which equal starts are listed.
BASE = (
    ("assign", ASSIGN, lambda m: F.length(F.regexp_extract(m, ASSIGN, 1)) >= 12),
    ("access", r"AKIA[A-Z0-9]+", lambda m: F.length(m) >= 18),
    ("hex", r"[0-9a-f]{16,}", lambda m: F.lit(True)),
)
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
#: Name, pattern, alphabet size, and what ordinary words show: divergence from uniform use of the alphabet.
ENCODINGS = (("decimal", "^[0-9]+$", 10, 0.5), ("hex", "^([0-9a-f]+|[0-9A-F]+)$", 16, 0.6), ("base32", "^[A-Z2-7]+=*$", 32, 1.2), ("base64", "^.*$", 64, 2.5))
#: Chance of a change of class between neighbours in ordinary words, and their lag-1 correlation.
CHANGE, SERIAL = 0.15, 0.35
#: Upper bounds of the length classes; each class has its own discovery threshold.
LENGTHS = (24, 32, 48, 64, 128)
#: p-values are counted in bins of 0.25 in -ln p.
BIN, BINS = 0.25, 400
#: Code points in a part of a text that is put together anew.
PART = 256


def let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def scanned(values: Column, join) -> Column:
    """join of the whole numbers up to each place, in blocks so that no long array is copied for each value."""
    start = F.struct(F.lit(0).alias("to"), F.array().cast("array<int>").alias("all"))

    def fold(xs: Column) -> Column:
        def step(a: Column, x: Column) -> Column:
            return let(join(a["to"], x), lambda y: F.struct(y.alias("to"), F.concat(a["all"], F.array(y)).alias("all")))

        return F.aggregate(xs, start, step)

    def whole(xs: Column) -> Column:
        def blocked(size: Column) -> Column:
            blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / size).cast("int")), lambda i: fold(F.slice(xs, i * size + 1, size)))
            return let(blocks, lifted)

        def lifted(blocks: Column) -> Column:
            ends = let(F.transform(blocks, lambda b: b["to"]), lambda t: fold(t)["all"])
            before = F.concat(F.array(F.lit(0)), ends)
            return F.flatten(F.zip_with(blocks, F.slice(before, F.lit(1), F.size(blocks)), lambda b, h: F.transform(b["all"], lambda v: join(h, v))))

        return F.when(F.size(xs) > 0, let(F.ceil(F.cbrt(F.size(xs).cast("double"))).cast("int"), blocked)).otherwise(F.array().cast("array<int>"))

    return let(values, whole)


def matches(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches as (start, end, found), in code points: what lies between two matches gives their places."""

    def placed(found: Column) -> Column:
        steps = F.zip_with(found, F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found)), lambda f, b: F.length(f) + F.length(b))
        out = F.zip_with(found, scanned(steps, lambda a, x: a + x), lambda f, e: F.struct((e - F.length(f)).alias("start"), e.alias("end"), f.alias("found")))
        return F.when(F.size(found) > 0, out).otherwise(F.array().cast("array<struct<start:int,end:int,found:string>>"))

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), placed)


def lower_tail(score: Column) -> Column:
    """Normal distribution function; Abramowitz and Stegun 26.2.17."""

    def of(z: Column) -> Column:
        poly = lambda t: t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
        tail = 0.3989422804014327 * F.exp(-z * z / 2) * let(1 / (1 + 0.2316419 * F.abs(z)), poly)
        return F.greatest(let(tail, lambda p: F.when(z < 0, p).otherwise(1 - p)), F.lit(1e-300))

    return let(score, of)


def battery(token: Column) -> Column:
    """-ln of the joined p-value of "ordinary text" for one token."""
    return let(F.regexp_replace(token, "=+$", ""), lambda body: let(F.split(body, "(?<=.)(?=.)"), lambda chars: _joined(token, body, chars)))


def _joined(token: Column, body: Column, chars: Column) -> Column:
    n = F.length(body).cast("double")
    squares = F.aggregate(F.array_distinct(chars), F.lit(0.0), lambda a, c: a + F.pow(n - F.length(F.replace(body, c, F.lit(""))), F.lit(2.0)))
    size, spread = F.lit(float(ENCODINGS[-1][2])), F.lit(ENCODINGS[-1][3])
    for _, pattern, k, d in reversed(ENCODINGS[:-1]):
        is_a = token.rlike(pattern)
        size, spread = F.when(is_a, F.lit(float(k))).otherwise(size), F.when(is_a, F.lit(d)).otherwise(spread)

    def chi(x: Column) -> Column:
        k, shift = x["k"], n * x["d"]
        return (k * squares / n - n - (k - 1 + shift)) / F.sqrt(2 * (k - 1) + 4 * shift)

    p_chi = lower_tail(let(F.struct(size.alias("k"), spread.alias("d")), chi))
    classes = F.translate(body, "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/-_", "a" * 26 + "A" * 26 + "0" * 10 + "----")
    runs = F.regexp_count(classes, F.lit("a+|A+|0+|-+")).cast("double") - 1
    p_runs = lower_tail(-(runs - 0.5 - (n - 1) * CHANGE) / F.sqrt((n - 1) * CHANGE * (1 - CHANGE)))
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda a, v: a + v)

    def serial(off: Column) -> Column:
        power = total(F.transform(off, lambda v: v * v))
        lag = total(F.zip_with(F.slice(off, F.lit(1), F.size(off) - 1), F.slice(off, F.lit(2), F.size(off) - 1), lambda a, b: a * b))
        return let(power, lambda p: F.when(p > 0, F.abs(lag) / p).otherwise(F.lit(1.0)))

    centred = let(F.transform(chars, lambda c: F.ascii(c).cast("double")), lambda codes: let(total(codes) / n, lambda mean: F.transform(codes, lambda v: v - mean)))
    p_serial = lower_tail((let(centred, serial) - SERIAL) * F.sqrt(n))
    half = -(F.log(p_chi) + F.log(p_runs) + F.log(p_serial))  # chi-squared with 6 degrees of freedom, halved
    return let(half, lambda x: x - F.log(1 + x + x * x / 2))


def length_class(token: Column) -> Column:
    out = F.lit(len(LENGTHS))
    for k, most in reversed(list(enumerate(LENGTHS))):
        out = F.when(F.length(token) < most, F.lit(k)).otherwise(out)
    return out


def in_bin(score: Column) -> Column:
    return F.least(F.floor(score / BIN), F.lit(BINS)).cast("int")


def found_in(text: Column) -> Column:
    """All base spans and candidates, as (start, rank, kind, end, found, bin); a base span has no bin."""
    kinds = [_spans(F.filter(matches(text, pattern), _counts(holds)), rank, kind, lambda m: F.lit(None).cast("int")) for rank, (kind, pattern, holds) in enumerate(BASE)]
    kinds.append(_spans(matches(text, CANDIDATE), len(BASE), "random", lambda m: in_bin(battery(m["found"]))))
    return F.array_sort(F.concat(*kinds))


def masked(found: Column) -> Column:
    return F.repeat(F.lit("*"), F.least(F.length(found), F.lit(LENGTHS[-1])))


def _counts(holds):
    return lambda m: holds(m["found"])


def _spans(found: Column, rank: int, kind: str, bin_of) -> Column:
    return F.transform(found, lambda m: F.struct(m["start"].alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), m["end"].alias("end"), masked(m["found"]).alias("found"), bin_of(m).alias("bin")))


def thresholds(found: DataFrame, rate: float) -> dict[int, int]:
    """The least bin that counts as a discovery, by length class; `found` has one column, of found_in().

    Benjamini-Hochberg over all candidates of a class: the largest p whose p <= rate * rank / m.
    Gathers one row for each class and bin at most.
    """
    seen = found.toDF("found").select(F.explode(F.filter("found", lambda s: s["bin"].isNotNull())).alias("s"))
    bins = seen.select(length_class(F.col("s.found")).alias("cls"), F.col("s.bin").alias("bin")).groupBy("cls", "bin").agg(F.count("*").alias("n"))
    beyond = F.sum("n").over(Window.partitionBy("cls").orderBy(F.col("bin").desc()))
    ranked = bins.select("cls", "bin", beyond.alias("rank"), F.sum("n").over(Window.partitionBy("cls")).alias("m"))
    held = ranked.where(F.exp(-F.col("bin") * BIN) <= rate * F.col("rank") / F.col("m"))
    return {r["cls"]: r["bin"] for r in held.groupBy("cls").agg(F.min("bin").alias("bin")).collect()}


def scan(docs: DataFrame, rate: float = 0.001, keep: Sequence[str] | None = None) -> DataFrame:
    """Adds `secrets`, an array of (start, rank, kind, end, found) ordered by start and kind, to docs or to its columns named in `keep`.

    With `keep`, texts are searched once and the spans are written to the shared folder, beside the kept columns, before the
    thresholds are known; without it, texts are searched for the thresholds and again for the spans, and nothing is written.
    """
    names, name = docs.columns if keep is None else list(keep), free(docs, "secrets")
    found = docs.select(*columns(names), found_in(F.coalesce("text", F.lit(""))).alias(name))
    found = found if keep is None else stored(found)
    least = thresholds(found.select(*columns([name])), rate)

    def holds(s: Column) -> Column:
        cls, bound = length_class(s["found"]), F.lit(BINS + 1)
        for k, v in least.items():
            bound = F.when(cls == k, F.lit(v)).otherwise(bound)
        return s["bin"].isNull() | (s["bin"] >= bound)

    kept = F.transform(F.filter(*columns([name]), holds), lambda s: F.struct(*[s[f].alias(f) for f in ("start", "rank", "kind", "end", "found")]))
    return found.select(*columns(names), kept.alias(name))


def listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def without(text: Column, spans: Column, mark: str) -> Column:
    """The text with a mark for each run of overlapping spans; the text is cut into parts once, and pieces are taken from those."""

    def joined(parts: Column) -> Column:
        def piece(a: Column, b: Column) -> Column:
            def of(i: Column) -> Column:
                at = F.greatest(a - i * PART, F.lit(0))
                return F.substring(F.get(parts, i), at + 1, F.least(b - i * PART, F.lit(PART)) - at)

            whole = F.array_join(F.transform(F.sequence(F.floor(a / PART).cast("int"), F.floor((b - 1) / PART).cast("int")), of), "")
            return F.when(b > a, whole).otherwise(F.lit(""))

        def assembled(reach: Column) -> Column:
            before = F.concat(F.array(F.lit(0)), reach)
            marked = F.zip_with(spans, F.slice(before, F.lit(1), F.size(spans)), lambda s, e: F.when(s["start"] >= e, F.concat(piece(e, s["start"]), F.lit(mark))).otherwise(F.lit("")))
            return F.concat(F.array_join(marked, ""), piece(F.element_at(before, -1), F.length(text)))

        return let(scanned(F.transform(spans, lambda s: s["end"]), F.greatest), assembled)

    return let(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PART}}}"), F.lit(0)), joined)


def redact(docs: DataFrame, rate: float = 0.001, mark: str = "<secret>") -> DataFrame:
    """docs with every found span of the text replaced by a mark; n_chars follows, other columns stay."""
    found = scan(docs, rate)
    (spans,) = columns(found.columns[-1:])
    text = F.when(F.size(spans) > 0, without(F.col("text"), spans, mark)).otherwise(F.col("text"))
    changed = found.select(*[text.alias("text") if c.lower() == "text" else own for c, own in zip(docs.columns, columns(docs.columns), strict=True)])
    length = F.length("text").cast("long")
    return changed.select(*[length.alias(c) if c == "n_chars" else own for c, own in zip(docs.columns, columns(docs.columns), strict=True)])


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = settled(lambda: scan(table(spark, sf_dir, "documents").select("doc_id", "text"), keep=["doc_id"]))
    of = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("secrets", lambda s: s["kind"] != "random")
    return found.select("doc_id", *[of(k).alias(f"n_{k}") for k, _, _ in BASE], F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"), listed(F.col("secrets")).alias("spans"), of("random").alias("n_random"))
