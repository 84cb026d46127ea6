"""Toxicity: a convolutional text classifier on hashed word embeddings, trained in numpy.

A word is a run of letters, lower case.  Its embedding is the sum of the rows that the hashes
of the word and of its first 3..9 bytes pick from one table.  Filters over 1, 2 and 3 words in
a row are max-pooled over the whole text; a dense layer gives the logit.  The table starts from
the buckets' log-odds in the training rows.  For each language, guessed from the text by a
naive Bayes model of the same words, a threshold is calibrated on a part of the training rows
that the network doesn't see, and scores are shifted so that it comes to stand at 0.7.

Training takes about `SAMPLE` documents of each label, chosen by hash of the id, one row for each id,
and of those as many as `SAMPLE_BYTES` of text hold; scoring takes all rows and whole texts.

Defined results: null, empty and letterless texts get the score of a text without words;
without labelled rows of both kinds every score is 0; repeated rows give repeated rows; the length of
a text has no bound; an empty table gives no rows; other columns stay as they are, and where one has
the result's name the result is `score_2`.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels as K
from .common import bounded, columns, fitted, fold, free, let_go, mapped, stored, table

#: Documents of each label that the network is fitted on, and bytes of their texts.
SAMPLE, SAMPLE_BYTES = 3000, 48 << 20
BUCKETS, DIM, FILTERS, WIDTHS = 1 << 16, 8, 8, (1, 2, 3)
PREFIXES = (3, 4, 5, 6, 7, 8, 9)
LANG_BUCKETS = 1 << 13
CUT = 0.7


def bucket_ids(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words x 8) rows of the table, BUCKETS where a word is no longer than a prefix; whole-word hashes; first word of each text."""
    starts, ends, first = K.words(data, at, "letters")
    sums = K.prefix_sums(K.byte_values(5)[data])
    whole = K.span_hash(sums, starts, ends)
    ids = np.full((len(starts), 1 + len(PREFIXES)), BUCKETS, np.int32)
    ids[:, 0] = whole & K.U(BUCKETS - 1)
    for k, n in enumerate(PREFIXES, 1):
        longer = np.flatnonzero(ends - starts > n)
        ids[longer, k] = (K.span_hash(sums, starts[longer], starts[longer] + n) >> K.U(20 + k)) & K.U(BUCKETS - 1)
    return ids, whole, first


class Network:
    """The weights; forward() scores many texts at once, step() is one Adagrad step."""

    def __init__(self, seed: int, start: np.ndarray):
        rng = np.random.default_rng(seed)
        self.table = (rng.standard_normal((BUCKETS + 1, DIM)) * 0.05).astype(np.float32)
        self.table[:BUCKETS, 0] = start
        self.table[BUCKETS] = 0
        self.filters = [(rng.standard_normal((w, DIM, FILTERS)) * 0.3).astype(np.float32) for w in WIDTHS]
        for f in self.filters:
            f[:, 0, :] = np.abs(f[:, 0, :])
        self.bias = np.zeros(len(WIDTHS) * FILTERS, np.float32)
        self.dense = np.full(len(WIDTHS) * FILTERS, 0.2, np.float32)
        self.offset = np.float32(-2.0)
        self.squares: dict[str, np.ndarray] = {}

    def convolved(self, ids: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Embeddings and filter outputs by word; `last` marks the last word of each text."""
        x = self.table[ids[:, 0]]
        for k in range(1, ids.shape[1]):
            x += self.table[ids[:, k]]
        out = np.empty((len(x), len(WIDTHS) * FILTERS), np.float32)
        for k, f in enumerate(self.filters):
            z, shifted, stop = x @ f[0], x, last
            for j in range(1, len(f)):
                shifted = np.concatenate([shifted[1:], shifted[:1]])
                shifted[stop] = 0
                z += shifted @ f[j]
            out[:, k * FILTERS : (k + 1) * FILTERS] = z
        return x, out

    def forward(self, ids: np.ndarray, first: np.ndarray) -> np.ndarray:
        if not len(ids):
            return np.full(len(first) - 1, self.offset, np.float32)
        last = first[1:][first[1:] > first[:-1]] - 1
        _, z = self.convolved(ids, last)
        pooled = K.by_row(np.maximum, z, first, np.float32(0))
        return self._logit(np.maximum(pooled + self.bias, 0) * (first[1:] > first[:-1])[:, None])

    def _logit(self, hidden: np.ndarray) -> np.ndarray:
        return hidden @ self.dense + self.offset

    def step(self, ids: np.ndarray, first: np.ndarray, labels: np.ndarray, weight: np.ndarray, rate: float) -> None:
        last = first[1:][first[1:] > first[:-1]] - 1
        x, z = self.convolved(ids, last)
        n, m = len(first) - 1, z.shape[1]
        peak = np.stack([first[i] + z[first[i] : first[i + 1]].argmax(0) if first[i + 1] > first[i] else np.full(m, -1) for i in range(n)])
        pre = np.where(peak >= 0, z[peak, np.arange(m)] + self.bias, 0)
        hidden = np.maximum(pre, 0)
        error = (weight * (1 / (1 + np.exp(-np.clip(self._logit(hidden), -40, 40))) - labels) / n).astype(np.float32)
        back = error[:, None] * self.dense * (pre > 0)
        self._down("dense", error @ hidden + 1e-4 * self.dense, rate)
        self._down("bias", back.sum(0), rate)
        self.offset -= np.float32(rate * error.sum())
        rows, grads = [], []
        end = np.repeat(first[1:], m).reshape(n, m)
        for k, f in enumerate(self.filters):
            mine = slice(k * FILTERS, (k + 1) * FILTERS)
            g, p, stop = back[:, mine], peak[:, mine], end[:, mine]
            step = np.zeros_like(f)
            for j in range(len(f)):
                on = (p >= 0) & (p + j < stop) & (g != 0)
                doc, col = np.nonzero(on)
                at = p[doc, col] + j
                np.add.at(step[j].T, col, g[doc, col, None] * x[at])
                rows.append(ids[at])
                grads.append(g[doc, col, None] * f[j].T[col])
            self._down(f"filter{k}", step, rate, f)
        where = np.concatenate(rows)
        flat, inverse = np.unique(where, return_inverse=True)
        total = np.zeros((len(flat), DIM), np.float32)
        np.add.at(total, inverse.reshape(where.shape).ravel(), np.repeat(np.concatenate(grads), where.shape[1], axis=0))
        sq = self.squares.setdefault("table", np.full((BUCKETS + 1, DIM), 1e-3, np.float32))
        sq[flat] += total**2
        self.table[flat] -= rate * total / np.sqrt(sq[flat])
        self.table[BUCKETS] = 0

    def _down(self, name: str, grad: np.ndarray, rate: float, value: np.ndarray | None = None) -> None:
        value = getattr(self, name) if value is None else value
        sq = self.squares.setdefault(name, np.full(grad.shape, 1e-3, np.float32))
        sq += grad**2
        value -= rate * grad / np.sqrt(sq)


class Model:
    """A fitted network, the language guesser and each guessed language's shift."""

    def __init__(self, net: Network, lang_table: np.ndarray, shifts: np.ndarray):
        self.net, self.lang_table, self.shifts = net, lang_table, shifts
        self.net.squares = {}

    def score(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        ids, whole, first = bucket_ids(data, at)
        logit = self.net.forward(ids, first).astype(float) - self.shifts[guess(self.lang_table, whole, first)]
        return 1 / (1 + np.exp(-np.clip(logit + np.log(CUT / (1 - CUT)), -40, 40)))


def guess(lang_table: np.ndarray, whole: np.ndarray, first: np.ndarray) -> np.ndarray:
    return K.by_row(np.add, lang_table[(whole >> K.U(40)) & K.U(LANG_BUCKETS - 1)], first, np.float32(0)).argmax(1)


def presence(ids: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, bucket) pairs, each once."""
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    pair = np.unique((text[:, None].astype(np.int64) * (BUCKETS + 1) + ids).ravel())
    return pair // (BUCKETS + 1), pair % (BUCKETS + 1)


def fit(texts: pa.Array, labels: np.ndarray, langs: list, part: np.ndarray, epochs: int = 6, seed: int = 7) -> Model:
    """part: 0..4 of each row; rows of part 0 calibrate, the others train the network."""
    ids, whole, first = [], [], [0]
    for _, _, data, at in K.blocks(texts):
        i, w, f = bucket_ids(data, at)
        ids.append(i)
        whole.append(w)
        first.extend(f[1:] + first[-1])
    ids, whole, first = np.concatenate(ids), np.concatenate(whole), np.array(first)
    train = np.flatnonzero(part > 0) if (part > 0).any() else np.arange(len(part))
    names = sorted({x for x in langs if x is not None}) or [""]
    code = np.array([names.index(x) if x in names else -1 for x in langs])
    counts = np.full((LANG_BUCKETS, len(names)), 0.1)
    word_lang = np.repeat(code, np.diff(first))
    slot = ((whole >> K.U(40)) & K.U(LANG_BUCKETS - 1)).astype(np.int64) * len(names) + np.maximum(word_lang, 0)
    counts += np.bincount(slot, word_lang >= 0, counts.size).reshape(counts.shape)
    lang_table = np.log(counts / counts.sum(0)).astype(np.float32)

    def rows(which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.concatenate([np.arange(first[i], first[i + 1]) for i in which]) if len(which) else np.zeros(0, int)
        return ids[at], np.concatenate([[0], np.cumsum(first[which + 1] - first[which])])

    y = labels[train]
    toxic, clean = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for lo in range(0, len(train), 200):
        text, bucket = presence(*rows(train[lo : lo + 200]))
        is_toxic = y[lo : lo + 200][text] == 1
        toxic += np.bincount(bucket[is_toxic], minlength=BUCKETS + 1)[:BUCKETS]
        clean += np.bincount(bucket[~is_toxic], minlength=BUCKETS + 1)[:BUCKETS]
    odds = np.log((toxic + 0.2) / (y.sum() + 1)) - np.log((clean + 0.2) / ((1 - y).sum() + 1))
    net = Network(seed, np.clip(odds * ((toxic + clean) > 2), -2, 2) * 0.4)
    rng, weight = np.random.default_rng(seed), np.where(y == 1, len(y) / (2 * max(1, y.sum())), len(y) / (2 * max(1, (1 - y).sum())))
    for epoch in range(max(epochs, min(40, -(-6000 // len(train))))):
        order = rng.permutation(len(train))
        for lo in range(0, len(order), 64):
            pick = order[lo : lo + 64]
            net.step(*rows(train[pick]), y[pick], weight[pick], 0.05 / (1 + epoch / 4))
    lang = np.empty(len(labels), int)
    for lo in range(0, len(labels), 500):
        f = first[lo : lo + 501]
        lang[lo : lo + 500] = guess(lang_table, whole[f[0] : f[-1]], f - f[0])
    held = np.flatnonzero(part == 0)
    logits = np.concatenate([net.forward(*rows(held[lo : lo + 200])) for lo in range(0, len(held), 200)]) if len(held) else np.zeros(0)
    overall = cut(logits, labels[held], 0.0)
    shifts = np.array([cut(logits[lang[held] == k], labels[held][lang[held] == k], overall) for k in range(len(names))])
    return Model(net, lang_table, shifts)


def cut(logits: np.ndarray, labels: np.ndarray, otherwise: float) -> float:
    """The logit that splits best, by the mean of both classes' hit rates; `otherwise` for too few rows."""
    if labels.sum() < 5 or (1 - labels).sum() < 5:
        return otherwise
    order = np.argsort(logits)
    z, y = logits[order], labels[order]
    edges = (z[1:] + z[:-1]) / 2
    below = np.cumsum(1 - y)[:-1] / (1 - y).sum() + (y.sum() - np.cumsum(y)[:-1]) / y.sum()
    best = np.flatnonzero(below >= below.max() - 1e-9)
    return float(edges[best[len(best) // 2]])


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model | None:
    """Fits on labelled rows outside the held-out fold, at most `sample` of each label, by hash of the id; of several labels of an id the largest counts."""
    known = labels.where(F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where(fold() != 1)
    h = F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(1 << 30))
    sizes = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if not (sizes.get(0) and sizes.get(1)):
        return None
    share = F.lit(0)
    for label in (0, 1):
        share = F.when(F.col("toxic") == label, F.lit(int(min(1.0, sample / sizes[label]) * (1 << 30)))).otherwise(share)

    def on_sample(rows: pa.Table) -> Model | None:
        y = rows["toxic"].to_numpy().astype(np.float32)
        return fit(rows["text"].combine_chunks(), y, rows["lang"].to_pylist(), rows["part"].to_numpy()) if y.min() != y.max() else None

    with let_go(docs.sparkSession):
        chosen = stored(known.where(h < share))  # ids and labels alone: Spark sees that they are small and shuffles no text for them
        texts = docs.where((fold() != 1) & F.col("text").isNotNull()).select("doc_id", F.lower("text").alias("text"), "lang")
        rows = bounded(texts.join(chosen, "doc_id"), "toxic", SAMPLE_BYTES).withColumn("part", F.pmod(F.xxhash64("doc_id", F.lit(4)), F.lit(5)))
        return fitted(rows, on_sample)


def score(docs: DataFrame, model: Model | None, name: str = "score") -> DataFrame:
    """docs with the score of each whole text."""
    names, name = columns(docs.columns), free(docs, name)
    if model is None:
        return docs.select(*names, F.lit(0.0).alias(name))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS x DIM floats: 2 MB at every size

    def run(batches):
        for batch in batches:
            out = [shared.value.score(data, at) for _, _, data, at in K.blocks(batch.column(batch.num_columns - 1))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(np.concatenate(out) if out else np.zeros(0))], names=schema.names)

    schema = docs.select(*names, F.lit(0.0).alias(name)).schema
    return mapped(docs.select(*names, F.lower("text").alias(name)), run, schema)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels"))
    scored = score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", (fold() == 1).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
