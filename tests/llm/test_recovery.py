"""What rounds before found wanting: lost items, shared phrases, unstable chunks, hot rows without an id, what is left on disk."""

import glob
import os
import random
import re
import time

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from pulsegrid.llm import chunks, common, decontaminate, fingerprints, jaccard, language, lines, mixing, quality, secrets, substrings, suffixes, toxicity, variants, whitening

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n, letters="abcdefghijklmnop"):
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 9))) for _ in range(n))


def leaks_of(spark, texts, items, **kw):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    rows = decontaminate.find_leaks(docs, spark.createDataFrame(items, "item_id long, text string"), **kw).collect()
    return {r["doc_id"]: [(x["item_id"], x["distance"]) for x in r["leaks"]] for r in rows}


def test_items_without_an_id_are_found(spark):
    rng = random.Random(1)
    a, b, c = (words(rng, 20) for _ in range(3))
    texts = [f"{words(rng, 9)} {a} {words(rng, 9)} {b} {words(rng, 3)}", f"{b} {c}", words(rng, 40), None]
    got = leaks_of(spark, texts, [(None, a), (None, b), (5, c), (None, None), (None, b), (5, words(rng, 12))])
    assert got == {0: [(None, 0), (None, 0)], 1: [(5, 0), (None, 0)], 2: [], 3: []}


def test_items_in_many_blocks(spark, monkeypatch):
    """Blocks one after the other give what one block gives, also for an id whose texts are in several."""
    rng = random.Random(2)
    items = [(i % 40 if i % 11 else None, words(rng, 15)) for i in range(120)]
    texts = [f"{words(rng, 5)} {items[i % 120][1][: rng.choice([20, 400])]} {words(rng, 5)} {items[(i * 7) % 120][1]}" for i in range(150)]
    want = leaks_of(spark, texts, items)
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 900)
    monkeypatch.setattr(decontaminate, "BATCH_BYTES", 4000)
    assert leaks_of(spark, texts, items) == want
    assert sum(len(v) for v in want.values()) > 150


def probe(n, docs=100):
    """n items that share one phrase, and texts that have the phrase but no item."""
    rng = random.Random(3)
    phrase = "answer the following question in one sentence and give your reasons for it: "
    items = decontaminate.Items(list(range(n)), [phrase + words(rng, 30) for _ in range(n)], decontaminate.RATE)
    items.prepare()
    texts = [f"{words(rng, 60)} {phrase}{words(rng, 60)}" for _ in range(docs)]
    texts[5] += " " + items.texts[7]
    began = time.process_time()
    found = decontaminate.leaks(items, texts)
    return time.process_time() - began, found


def test_a_phrase_that_many_items_share_costs_little():
    for n in (200, 800):
        took, found = probe(n)
        assert [[x[0] for x in row] for row in found] == [[7] if i == 5 else [] for i in range(100)]
    assert took < 2.0  # 80,000 candidates; every one through Myers' recurrence took twice that


def test_the_sieve_keeps_all_that_match():
    """Random edits up to the budget: what the full search finds stays."""
    rng = random.Random(4)
    for _ in range(60):
        item = words(rng, rng.randint(3, 40))
        e = decontaminate.budget(len(item), 0.1)
        spoiled = list(item)
        for _ in range(e):
            k = rng.randrange(len(spoiled))
            spoiled[k : k + rng.randint(0, 1)] = rng.choice(["", "x", "yz"[: rng.randint(0, 1)]])
        items = decontaminate.Items([1], [item], 0.1)
        items.prepare()
        text = f"{words(rng, 30)} {''.join(spoiled)} {words(rng, 30)}"
        code, found = items.encoded(text), items.candidates(text)
        if len(found):
            best, _ = items.verify({0: code}, found[:, 0] * 0, found[:, 0], found[:, 1])
            good = items.plausible(code, found[:, 0], found[:, 1])
            assert good[best <= e].all()


def test_chunks_are_the_same_however_the_scan_is_split(spark, tmp_path):
    rng = random.Random(5)
    rows = [(i // 2, words(rng, 40), "en", "s", 1) for i in range(300)] + [(7, "the same row again and again", "en", "s", 1)] * 200
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/docs")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(150)], "doc_id long, quality int, toxic int")
    seen, before = [], spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("128m", "4k"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            docs = spark.read.parquet(f"{tmp_path}/docs")
            chunked = chunks.Chunked(docs, ["lang"], 2000, bucketed=False)
            seen.append(sorted(map(tuple, chunked.table.select("chunk", "order").collect())))
            assert max(r["count"] for r in chunked.table.groupBy("chunk").count().collect()) < 60  # equal rows spread
        assert seen[0] == seen[1]
        docs = spark.read.parquet(f"{tmp_path}/docs")
        out = quality.perplexities(docs, docs.where("doc_id % 2 = 0"))
        spark.conf.set("spark.sql.files.maxPartitionBytes", "128m")
        assert out.count() == 500
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    made = chunks.Chunked(spark.createDataFrame(rows, SCHEMA).select("*"), ["lang"], 2000, bucketed=False)
    assert made.table.count() == 500
    assert quality.classify(docs, labels).count() == 500


def test_rows_without_an_id_spread_over_slices(spark):
    rng = random.Random(6)
    rows = [(None if i % 2 else i, words(rng, rng.randint(1, 30)), "en", "one", 1) for i in range(600)]
    out = mixing.mix(spark.createDataFrame(rows, SCHEMA))
    plan = out._jdf.queryExecution().analyzed().toString()
    assert "xxhash64(doc_id" in plan and "text" in plan
    got = out.toPandas()
    assert got["taken"].sum() == round(got["target"].iloc[0]) and (got["taken"] <= 2 * got["size"]).all()
    first = sorted(c["position"] for r in out.where("doc_id is null").collect() for c in r["copies"])
    assert 0.4 < sum(p < 0.5 for p in first) / len(first) * 2 < 1.4  # not one after the other


SECRET = "Hj38Kslq02mMx8ZqPPaa"


def everything(spark, docs, labels, items, vectors):
    """All operators to the end."""
    return [
        mixing.mix(docs), fingerprints.compare_with_edits(docs), suffixes.remove_repeats(docs), substrings.dedup(docs),
        toxicity.score(docs, toxicity.train(docs, labels)), jaccard.jaccard_classes(docs), language.identify(docs, language.train(docs)),
        quality.classify(docs, labels), secrets.scan(docs.select("doc_id", "text"), keep=["doc_id"]), secrets.redact(docs), decontaminate.find_leaks(docs, items),
        lines.dedup(docs), variants.variants(docs), whitening.whiten(vectors),
    ]


def test_only_results_are_left_on_disk_and_no_secret(spark):
    rng = random.Random(7)
    rows = [(i, words(rng, 30) + (f' password = "{SECRET}" ' if i == 3 else ""), "en", f"s{i % 2}", 1) for i in range(60)]
    docs = spark.createDataFrame(rows, SCHEMA)
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(60)], "doc_id long, quality int, toxic int")
    items = spark.createDataFrame([(1, words(rng, 20))], "item_id long, text string")
    vectors = spark.createDataFrame([(i, [rng.random() for _ in range(3)]) for i in range(9)], "vec_id long, embedding array<double>")
    shared = common.shared_dir(spark).removeprefix("file://")
    before, tables = set(os.listdir(shared)), {t.name for t in spark.catalog.listTables()}
    with common.let_go(spark):
        outs = everything(spark, docs, labels, items, vectors)
        for out in outs:
            out.count()
        left = set(os.listdir(shared)) - before
        assert len(left) <= 8, left  # one for each operator that stores its rows
        for path in glob.glob(f"{shared}/**", recursive=True):
            if os.path.isfile(path) and path.endswith(".parquet") and path.removeprefix(shared + "/").split("/")[0] in left:
                text = spark.read.parquet(path)
                for c, kind in text.dtypes:
                    if "string" in kind:
                        assert text.where(F.col(f"`{c}`").cast("string").contains(SECRET)).isEmpty(), (path, c)
    assert set(os.listdir(shared)) - before == set() and {t.name for t in spark.catalog.listTables()} == tables


def test_few_discoveries_in_ordinary_text(spark):
    """Documents without planted secrets: joined words and numbers as they occur are no discoveries."""
    rng = random.Random(8)
    syllable = ["tion", "con", "fi", "gu", "ra", "man", "age", "ment", "sys", "tem", "ver", "si", "on", "the", "le", "ter"]
    token = lambda: "".join(rng.choice(syllable) for _ in range(rng.randint(7, 14)))
    styled = [lambda: token(), lambda: "_".join(token()[:9] for _ in range(3)), lambda: token().title() + token().title(), lambda: "/" + "/".join(token()[:8] for _ in range(4)), lambda: str(rng.randint(1990, 2030)) + "-" + token()]
    rows = [(i, " ".join(rng.choice(styled)() for _ in range(20))) for i in range(400)]
    found = secrets.scan(spark.createDataFrame(rows, "doc_id long, text string"), keep=["doc_id"])
    n = sum(len(re.findall(secrets.CANDIDATE, t)) for _, t in rows)
    wrong = found.select(F.sum(F.size(F.filter("secrets", lambda s: s["kind"] == "random")))).first()[0]
    assert n > 5000 and wrong / n < 0.001


EDGES = [(900, None, "en", "s", None), (901, "", None, "s", 0), (902, "  \n", "en", None, 3), (903, "ä", "de", None, 1), (903, "ä", "de", None, 1), (None, "lost words of no id at all", "en", "t", 26), (None, None, None, None, None)]


@pytest.fixture(scope="module")
def edge_tables(spark, tmp_path_factory):
    rng = random.Random(9)
    d = str(tmp_path_factory.mktemp("edges"))
    rows = [(i, words(rng, 40) + (" scumbag moron" if i % 5 == 0 else ""), "en", f"s{i % 3}", 1) for i in range(100)]
    rows += [(700, " ".join(f"w{k}x{k % 977}" for k in range(120_000)), "en", "s0", 1), (701, "y" * 600_000, "en", "s0", 1)]
    docs = spark.createDataFrame(rows + EDGES, SCHEMA).withColumns({c: F.lit(f"own {c}") for c in ("score", "leaks", "secrets", "size", "taken", "copies", "position", "node", "a.b")})
    docs.write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(100)] + [(None, None, None), (900, 1, None)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(None, rows[3][1]), (1, None), (2, "")], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    for t in ("labels", "benchmark", "documents"):
        spark.read.parquet(f"{d}/{t}.parquet").where("false").write.parquet(f"{d}/none/{t}.parquet")
    return d


def test_stages_on_edge_cases(spark, edge_tables):
    docs = spark.read.parquet(f"{edge_tables}/documents.parquet")
    own = [c for c in docs.columns if c not in ("doc_id", "text", "lang", "source", "n_chars")]
    for name, stage in corpus_pipeline.STAGES:
        docs = common.stored(stage(spark, docs, edge_tables))
        for c, col in zip(own, common.columns(own), strict=True):
            assert {r[0] for r in docs.select(col).distinct().collect()} == {f"own {c}"}, (name, c)
    got = {r["doc_id"] for r in docs.select("doc_id").collect()}
    assert {1, 2, 700, 701, None} <= got and not {3, 900, 901, 902} & got  # a leak; texts without words take no part in the mix


def test_stages_on_empty_tables(spark, edge_tables):
    docs = spark.read.parquet(f"{edge_tables}/none/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, f"{edge_tables}/none")
        assert docs.count() == 0
    plain = spark.read.parquet(f"{edge_tables}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:4]:
        assert stage(spark, plain, f"{edge_tables}/none").count() >= 107, name
