"""Language ID by error-correcting output codes.

Every language has a codeword; one logistic classifier per bit, on hashed byte n-grams of one to
three bytes of the lower-case text, predicts the bits.  Decoding sums the logistic losses of all
bits against each codeword, each bit weighted by how well its classifier did on rows left out of
its training, and takes the codeword with the least loss.  The text is flagged as ambiguous where
the runner-up's loss is close.

Up to five languages get the exhaustive code (all 2^(k-1)-1 splits); more get pseudo-random
balanced bits, four for each doubling, drawn by a fixed rule.

Training takes about `SAMPLE` documents of each language, chosen by hash of the id, one row for each id,
and of those as many as `SAMPLE_BYTES` of text hold; prediction takes all rows and whole texts.

Defined results: null texts and texts without a letter are `und` with score 0; if no row can be
learned from, so is everything; repeated rows give repeated rows; the length of a text has no bound; an
empty table gives no rows; other columns stay as they are, and where one has a result's name the
result is `lang_pred_2` and so on.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels as K
from .common import bounded, columns, fitted, fold, free, mapped, table

#: Documents of each language that the classifiers are fitted on, and bytes of their texts.
SAMPLE, SAMPLE_BYTES = 1200, 16 << 20
BUCKETS = 1 << 12
ORDERS = (1, 2, 3)
#: A lead in weighted loss per bit below this flags the text as ambiguous.
LEAD = 0.25


def gram_ids(data: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    """For each order, the bucket of the n-gram that starts at each byte; an n-gram that leaves its text falls on the next one's bytes and is cut by `gram_sums`."""
    b = data.astype(np.uint32) + 1
    out = []
    for n in ORDERS:
        h = b[: len(b) - n + 1] * np.uint32(0x9E3779B1) if len(b) >= n else np.zeros(0, np.uint32)
        for j in range(1, n):
            h = (h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA6B) + b[j : len(b) - n + 1 + j] * np.uint32(0xC2B2AE35)
        out.append(((h ^ (h >> np.uint32(13))) * np.uint32(0x27D4EB2F + 2 * n) >> np.uint32(20)).astype(np.int32))
    return out


def gram_sums(ids: list[np.ndarray], at: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Mean of the weights of each text's n-grams, summed over the orders."""
    total = np.zeros((len(at) - 1, weights.shape[1]), np.float32)
    for n, h in zip(ORDERS, ids, strict=True):
        w = weights[h]
        edge = (at[1:-1, None] - np.arange(1, n)).ravel()
        w[edge[(edge >= 0) & (edge < len(w))]] = 0
        sums = K.by_row(np.add, w, np.minimum(at, len(w)), np.float32(0))
        total += sums / np.maximum(np.diff(at) - n + 1, 1)[:, None]
    return total


def features(texts: pa.Array) -> np.ndarray:
    """Mean n-gram frequencies of each text, one row of BUCKETS for each."""
    rows = []
    for _, _, data, at in K.blocks(texts):
        x = np.zeros((len(at) - 1, BUCKETS), np.float32)
        for i in range(len(at) - 1):
            for n, h in zip(ORDERS, gram_ids(data[at[i] : at[i + 1]], at[i : i + 2]), strict=True):
                if len(h):
                    x[i] += np.bincount(h, minlength=BUCKETS) / np.float32(len(h))
        rows.append(x)
    return np.concatenate(rows)


def codewords(k: int) -> np.ndarray:
    """k x bits matrix of -1 and 1, rows far apart, no column constant."""
    if k <= 5:
        masks = range(1, 1 << (k - 1)) if k > 1 else [1]
        return np.array([[1 if m >> i & 1 else -1 for m in masks] for i in range(k)])
    rng = np.random.default_rng(k)
    tries = []
    for _ in range(50):
        code = rng.permuted(np.where(np.arange(k)[:, None] < (k + 1) // 2, 1, -1) * np.ones(4 * int(np.ceil(np.log2(k))), int), axis=0)
        far = min((code[i] != code[j]).sum() for i in range(k) for j in range(i))
        tries.append((far, len(tries), code))
    return max(tries, key=lambda t: t[:2])[2]


class Model:
    def __init__(self, names: list[str], code: np.ndarray, weights: np.ndarray, bias: np.ndarray, trust: np.ndarray):
        self.names, self.code, self.weights, self.bias, self.trust = names, code, weights, bias, trust

    def losses(self, margins: np.ndarray) -> np.ndarray:
        """Weighted mean loss against each language's codeword."""
        loss = np.logaddexp(0, -margins[:, None, :] * self.code[None])
        return (loss * self.trust).sum(2) / self.trust.sum()

    def predict(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Language index, score and ambiguity of each text."""
        loss = self.losses(gram_sums(gram_ids(data, at), at, self.weights) + self.bias)
        order = np.sort(loss, axis=1)
        lead = order[:, 1] - order[:, 0] if loss.shape[1] > 1 else np.full(len(loss), np.inf)
        odds = np.exp(-(loss - order[:, :1]) * self.code.shape[1])
        return loss.argmin(1), 1 / odds.sum(1), lead < LEAD


def fit(texts: pa.Array, langs: list[str], part: np.ndarray, rounds: int = 150) -> Model:
    names = sorted(set(langs))
    code = codewords(len(names))
    x = features(texts)
    y = code[[names.index(v) for v in langs]].astype(np.float32)
    mean, std = x.mean(0), x.std(0) + 1e-4
    z = (x - mean) / std
    train = part > 0 if (part > 0).any() else np.ones(len(part), bool)
    w, b, vw, vb = (np.zeros(s, np.float32) for s in ((BUCKETS, code.shape[1]), code.shape[1], (BUCKETS, code.shape[1]), code.shape[1]))
    zt, yt = z[train], y[train]
    for _ in range(rounds):
        g = -yt * np.exp(-np.logaddexp(0, yt * (zt @ w + b))) / len(yt)
        vw, vb = 0.9 * vw - 0.05 * (zt.T @ g + 1e-3 * w), 0.9 * vb - 0.05 * g.sum(0)
        w, b = w + vw, b + vb
    held = ~train if (~train).any() else train
    right = (np.sign(z[held] @ w + b) == y[held]).mean(0)
    fold_w = (w / std[:, None]).astype(np.float32)
    return Model(names, code, fold_w, (b - mean @ fold_w).astype(np.float32), np.maximum(2 * right - 1, 1e-3))


def train(docs: DataFrame, sample: int = SAMPLE) -> Model | None:
    """Fits on rows outside the held-out fold that have a language and a letter."""
    known = docs.where((fold() != 1) & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.approx_count_distinct("doc_id").alias("n")).collect()}
    if not sizes:
        return None
    h, share = F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1 << 30)), F.lit(0)
    for lang, n in sizes.items():
        share = F.when(F.col("lang") == lang, F.lit(int(min(1.0, sample / max(n, 1)) * (1 << 30)))).otherwise(share)
    rows = bounded(known.where(h < share).select("doc_id", F.lower("text").alias("text"), "lang"), "lang", SAMPLE_BYTES)
    return fitted(rows.withColumn("part", F.pmod(F.xxhash64("doc_id", F.lit(6)), F.lit(4))), lambda r: fit(r["text"].combine_chunks(), r["lang"].to_pylist(), r["part"].to_numpy()))


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """docs with lang_pred, lang_score and lang_ambiguous."""
    names = columns(docs.columns)
    new = {"lang_pred": F.lit("und"), "lang_score": F.lit(0.0), "lang_ambiguous": F.lit(True)}
    nothing = docs.select(*names, *[v.alias(free(docs, n)) for n, v in new.items()])
    if model is None:
        return nothing
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS x bits floats
    schema = nothing.schema

    def run(batches):
        for batch in batches:
            m, got = shared.value, [(np.zeros(0, int), np.zeros(0), np.zeros(0, bool))]
            got += [m.predict(data, at) for _, _, data, at in K.blocks(batch.column(batch.num_columns - 2))]
            best, score, unsure = (np.concatenate(x) for x in zip(*got, strict=True))
            some = batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False)
            lang = np.where(some, np.array(m.names, object)[best], "und")
            new = [pa.array(lang, pa.string()), pa.array(np.where(some, score, 0.0)), pa.array(unsure | ~some)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], *new], names=schema.names)

    some = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    return mapped(docs.select(*names, F.lower("text"), some), run, schema)


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = identify(docs.select("doc_id", "text"), train(docs))
    return found.select("doc_id", (fold() == 1).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"), F.col("lang_ambiguous").alias("ambiguous"))
