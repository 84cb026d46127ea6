"""Quality classifier: an interpolated modified Kneser-Ney n-gram model of trusted text.

Grams are `ORDER` bytes, held as integers, so a context is a shift and a shorter gram a mask.  Counts
of trusted text are summed by gram over all its documents; shorter grams count how many
different bytes come before them.  The three discounts of each order follow from the counts of counts.
Chunks of documents send their distinct grams, packed, to shards by hash; a row's chunk follows from its id, text and place in
its file, so every pass finds the same chunks however its scan is split.  The grams that any document
has are joined with counts, with sums of their contexts and with the next shorter order; a shard
answers each chunk with the packed values of its grams, whose mean gives each document's
perplexity by byte.  The threshold of a language is a quantile of the trusted documents
that the model isn't trained on.

Defined results: null and empty texts have no perplexity and aren't kept; without a language, or
with one that has no held-out trusted document, the quantile over all languages holds; without any
there is no threshold and everything with a text is kept; a perplexity at the threshold is kept; repeated rows give repeated rows; the length
of a text has no bound; an empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels as K
from .chunks import MESSAGE, Chunked, message, shard_of
from .common import fold, settled, stored, table

ORDER, QUANTILE, CHUNK_BYTES, SHARD_BYTES = 5, 0.99, 16 << 20, 32 << 20


def grams(data: np.ndarray, at: np.ndarray, order: int = ORDER) -> np.ndarray:
    """The gram that ends at each byte; zeros stand before a text's first byte."""
    out = data.astype(np.int64)
    for k in range(1, order):
        before = np.zeros(len(data), np.int64)
        before[k:] = data[:-k] if k <= len(data) else 0
        edge = (at[:-1, None] + np.arange(k)).ravel()
        before[edge[edge < len(data)]] = 0
        out |= before << (8 * k)
    return out


def counted(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Distinct grams of a column and their counts."""
    g, n = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for _, _, data, at in K.blocks(texts):
        u, c = np.unique(grams(data, at), return_counts=True)
        g.append(u)
        n.append(c)
    u, inverse = np.unique(np.concatenate(g), return_inverse=True)
    return u, np.bincount(inverse, np.concatenate(n), len(u)).astype(np.int64)


def trusted_counts(trusted: DataFrame) -> DataFrame:
    """(gram, n) over all trusted texts, summed within each batch first."""

    def run(batches):
        for batch in batches:
            u, n = counted(batch.column("text"))
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(n)], names=["gram", "n"])

    return trusted.select("text").mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def discounts(counts: DataFrame) -> tuple[float, float, float]:
    """Chen and Goodman's three discounts, from how many grams have one, two, three and four counts."""
    seen = counts.agg(*[F.count(F.when(F.col("n") == k, 1)).alias(f"n{k}") for k in (1, 2, 3, 4)]).first()
    n1, n2, n3, n4 = seen
    if not (n1 and n2 and n3):
        return 0.5, 1.0, 1.5
    y = n1 / (n1 + 2 * n2)
    return tuple(float(min(max(d, 0.05), k)) for k, d in ((1, 1 - 2 * y * n2 / n1), (2, 2 - 3 * y * n3 / n2), (3, 3 - 4 * y * n4 / n3)))


def suffix(gram: Column, order: int) -> Column:
    return gram.bitwiseAND(F.lit((1 << (8 * order)) - 1))


def scored_grams(asked: DataFrame, counts: DataFrame, order: int = ORDER) -> DataFrame:
    """(gram, logp) of all asked grams, by joins from order 1 up."""
    by_order = {order: counts}
    for k in range(order - 1, 0, -1):
        by_order[k] = stored(by_order[k + 1].groupBy(suffix(F.col("gram"), k).alias("gram")).agg(F.count("*").alias("n")))
    lower = None
    for k in range(1, order + 1):
        d1, d2, d3 = discounts(by_order[k])
        cut = F.when(F.col("n") == 1, d1).when(F.col("n") == 2, d2).when(F.col("n") > 2, d3).otherwise(0.0)
        context = F.shiftright("gram", 8)
        sums = by_order[k].groupBy(context.alias("context")).agg(F.sum("n").alias("total"), F.sum(cut).alias("spare"))
        want = asked if k == order else asked.select(suffix(F.col("gram"), k).alias("gram")).distinct()
        full = want.join(by_order[k], "gram", "left").withColumn("context", context).join(sums, "context", "left")
        if lower is None:
            full = full.withColumn("below", F.lit(1 / 256))
        else:
            full = full.withColumn("short", suffix(F.col("gram"), k - 1)).join(lower.select(F.col("gram").alias("short"), F.col("p").alias("below")), "short")
        p = F.when(F.col("total").isNull(), F.col("below")).otherwise((F.greatest(F.coalesce("n", F.lit(0)) - cut, F.lit(0.0)) + F.col("spare") * F.col("below")) / F.col("total"))
        lower = stored(full.select("gram", p.alias("p")))
    return lower.select("gram", F.log("p").alias("logp"))


def shard_hash(gram: np.ndarray) -> np.ndarray:
    return K.mix(gram.astype(K.U) ^ K.U(0x2545F4914F6CDD1D))


def sent(u: np.ndarray, n_shards: int) -> list[tuple[int, np.ndarray]]:
    """Sorted distinct grams by shard, each part sorted."""
    shard = shard_of(shard_hash(u), n_shards)
    order = np.argsort(shard, kind="stable")
    edge = np.flatnonzero(np.diff(shard[order], prepend=-1))
    return [] if not len(u) else [(int(shard[order[a]]), u[order[a:b]]) for a, b in zip(edge, [*edge[1:], len(u)], strict=True)]


def perplexities(docs: DataFrame, trusted: DataFrame) -> DataFrame:
    """(doc_id, lang, n_bytes, perplexity) of each row under the model of the trusted texts."""
    chunked = Chunked(docs, ["lang"], CHUNK_BYTES, bucketed=False)
    n_shards = chunked.n_shards(SHARD_BYTES)

    def ask(docs: pa.Table) -> pa.Table:
        u, _ = counted(docs["text"].combine_chunks())
        chunk = docs["chunk"][0].as_py()
        return message([(chunk, s, packed_grams(g)) for s, g in sent(u, n_shards)])

    def distinct(parts: pa.Table) -> pa.Table:
        u = np.unique(np.concatenate([unpacked_grams(b.as_py()) for b in parts["data"]]))
        return pa.table({"shard": pa.array(np.full(len(u), parts["shard"][0].as_py()), pa.int32()), "gram": pa.array(u)})

    def answer(parts: pa.Table, scored: pa.Table) -> pa.Table:
        gram, logp = scored["gram"].to_numpy(), scored["logp"].to_numpy()
        order = np.argsort(gram)
        gram, logp = gram[order], logp[order]
        return message([(c, s, logp[np.searchsorted(gram, unpacked_grams(b.as_py()))].tobytes()) for c, s, b in zip(parts["chunk"].to_pylist(), parts["shard"].to_pylist(), parts["data"], strict=True)])

    def answered() -> DataFrame:
        counts = stored(trusted_counts(trusted))
        asked = stored(chunked.each(ask, MESSAGE))
        grams_of = stored(asked.groupBy("shard").applyInArrow(distinct, "shard int, gram long"))
        scored = grams_of.join(scored_grams(grams_of.select("gram"), counts), "gram").select("shard", "gram", "logp")
        return asked.groupBy("shard").cogroup(scored.groupBy("shard")).applyInArrow(answer, MESSAGE)

    answers = settled(answered)  # what led to them is gone before texts are shuffled again

    def g(docs: pa.Table, answers: pa.Table) -> pa.Table:
        work = [(at, *np.unique(grams(data, at), return_inverse=True)) for _, _, data, at in K.blocks(docs["text"].combine_chunks())]
        own = np.unique(np.concatenate([np.zeros(0, np.int64), *[u for _, u, _ in work]]))
        by_shard = dict(zip(answers["shard"].to_pylist(), answers["data"], strict=True))
        logp = np.zeros(len(own))
        for s, part in sent(own, n_shards):
            logp[np.searchsorted(own, part)] = np.frombuffer(by_shard[s].as_buffer(), np.float64)
        size, total = [np.zeros(0, np.int64)], [np.zeros(0)]
        for at, u, inverse in work:
            total.append(K.by_row(np.add, logp[np.searchsorted(own, u)][inverse], at, 0.0))
            size.append(np.diff(at))
        n, s = np.concatenate(size), np.concatenate(total)
        value = np.exp(-s / np.maximum(n, 1))
        return pa.table({"doc_id": docs["doc_id"], "lang": docs["lang"], "n_bytes": pa.array(n, pa.int64()), "perplexity": pa.array(value, pa.float64(), mask=n == 0)})

    return chunked.with_answers(answers, g, "doc_id long, lang string, n_bytes long, perplexity double")


def packed_grams(u: np.ndarray) -> bytes:
    """Sorted grams as gaps, split into planes of bytes, which shuffles compress."""
    return np.diff(u, prepend=0).astype("<i8").view(np.uint8).reshape(-1, 8)[:, :ORDER].T.tobytes()


def unpacked_grams(data: bytes) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8).reshape(ORDER, -1)
    gaps = np.zeros((planes.shape[1], 8), np.uint8)
    gaps[:, :ORDER] = planes.T
    return np.cumsum(gaps.view("<i8")[:, 0])


def classify(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE) -> DataFrame:
    """perplexities() with each language's threshold and whether a document is kept."""
    return settled(lambda: _classified(docs, labels, quantile))


def _classified(docs: DataFrame, labels: DataFrame, quantile: float) -> DataFrame:
    good = labels.where("quality = 1").select("doc_id").distinct()
    scored = stored(perplexities(docs, docs.where(fold() != 1).join(good, "doc_id", "left_semi")))
    held = scored.where(fold() == 1).join(good, "doc_id", "left_semi")
    at = F.percentile_approx("perplexity", F.lit(quantile), F.lit(10_000))
    bounds = {r["lang"]: r["at"] for r in held.where("lang is not null").groupBy("lang").agg(at.alias("at")).collect() if r["at"] is not None}
    overall = held.agg(at).first()[0]
    threshold = F.lit(overall).cast("double")
    for lang, v in bounds.items():
        threshold = F.when(F.col("lang") == lang, F.lit(v)).otherwise(threshold)
    out = scored.withColumn("threshold", threshold)
    return out.withColumn("keep", F.coalesce(F.col("perplexity") <= F.coalesce("threshold", F.lit(float("inf"))), F.lit(False)))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
