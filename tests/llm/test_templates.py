"""Texts on one template, alike but below the threshold: what is moved grows with the input, not with its pairs."""

import random

import numpy as np
import pytest

from pulsegrid.llm import jaccard

SCHEMA = "doc_id long, text string"


def template_corpus(n, seed=1):
    """n texts that share 60 % of their words in one place; no two reach 0.8, but for a few planted pairs."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(7))
    shared = [word() for _ in range(160)]
    rows = [(i, " ".join(shared + [word() for _ in range(40)])) for i in range(n)]
    for k in range(0, n, n // 4):
        rows[k + 1] = (k + 1, rows[k][1] + " " + word())
    return rows


def shuffled(spark):
    """Bytes that shuffles have written so far."""
    store = spark.sparkContext._jsc.sc().statusStore()
    stages = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), None)
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


@pytest.mark.parametrize("n", [500, 1000, 2000])
def test_templates_move_little(spark, n):
    rows = template_corpus(n)
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    size = sum(len(t) for _, t in rows)
    before = shuffled(spark)
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in jaccard.jaccard_classes(df).collect()}
    moved = shuffled(spark) - before
    pairs = {k + 1: k for k in range(0, n, n // 4)}
    want = {i: (pairs.get(i, i), int(i in pairs or i in pairs.values())) for i in range(n)}
    assert got == want
    assert moved < 4.5 * size, moved / size  # repartition(4) above and the texts' own way included


@pytest.mark.parametrize(("block", "counters"), [(2, 22), (7, 4), (400, 22)])
def test_parts_lose_no_link(spark, monkeypatch, block, counters):
    """Chains of texts around the threshold, in small blocks and with hardly any counters."""
    monkeypatch.setattr(jaccard, "BLOCK_NODES", block)
    monkeypatch.setattr(jaccard, "PART_NODES", block)
    monkeypatch.setattr(jaccard, "MOST_COUNTERS", counters)
    rng = random.Random(3)
    w = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(60):
        t = list(w)
        for _ in range(rng.randint(0, 6)):
            t[rng.randrange(120)] = f"x{rng.randrange(40)}"
        rows.append((i, " ".join(t[rng.randint(0, 12) :])))
    sets = [{tuple(t.split(" ")[k : k + 5]) for k in range(len(t.split(" ")) - 4)} for _, t in rows]
    links = [sum(len(a & b) >= 0.8 * len(a | b) for j, b in enumerate(sets) if i != j) for i, a in enumerate(sets)]
    got = {r["doc_id"]: r["n_links"] for r in jaccard.jaccard_classes(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert [got[i] for i in range(60)] == links and sum(links) > 60


def test_sets_at_the_threshold_share_a_prefix():
    rng = np.random.default_rng(4)
    for _ in range(300):
        n = int(rng.integers(1, 60))
        a = rng.choice(500, n, replace=False)
        keep = int(np.ceil(0.8 * n))
        b = np.concatenate([rng.permutation(a)[:keep], 1000 + np.arange(int(rng.integers(0, 3)))])
        order = rng.permutation(2000)
        if len(np.intersect1d(a, b)) >= 0.8 * len(np.union1d(a, b)) - 1e-6:
            heads = [set(sorted(s, key=lambda x: order[x])[: int(jaccard.prefix_length(np.array([len(s)]), 0.8)[0])]) for s in (a, b)]
            assert heads[0] & heads[1]
