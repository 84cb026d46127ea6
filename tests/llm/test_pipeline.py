"""The pipeline's stages: what goes, what stays, what is returned."""

import random
import re

import pandas as pd
import pytest

import corpus_pipeline
from pulsegrid.llm import catalog

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice(["ka", "lo", "mi", "tu", "se", "no", "ri"]) for _ in range(rng.randint(1, 4)))
    prose = lambda n: " ".join(word() for _ in range(n))
    rows, labels, item = [], [], prose(30)
    for i in range(240):
        toxic = i % 5 == 0
        text = prose(rng.randint(20, 80)) + (" scumbag moron " if toxic else " ") + prose(20)
        rows.append([i, text, "en", f"src{i % 3}"])
        labels.append((i, 1, int(toxic)))
    rows += [[300, rows[1][1], "en", "src0"], [301, rows[2][1] + " " + word(), "en", "src1"], [302, f"{prose(40)} {item} {prose(40)}", "en", "src0"], [303, f'{prose(30)} password = "Hj38Kslq02mMx8Zq" {prose(20)}', "en", None]]
    d = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame([(*r, len(r[1])) for r in rows], SCHEMA).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d


def test_stages(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    columns, ids = docs.columns, []
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, tables).cache()
        ids.append({r["doc_id"] for r in docs.select("doc_id").collect()})
        if len(ids) < 5:
            assert docs.columns == columns
    plain = {i for i in range(240) if i % 5}
    assert len(plain & ids[0]) >= 0.95 * len(plain) and len([i for i in ids[0] if i < 240 and i % 5 == 0]) <= 3
    assert {300, 301} & ids[0] and not {300, 301} & ids[1] and {1, 2} <= ids[1]
    assert ids[1] - ids[2] == {302}
    assert ids[3] == ids[2]
    assert {"taken", "copies", "position"} <= set(docs.columns)
    for r in docs.collect():
        assert 0 < r["taken"] <= 2 * r["size"] and "Hj38" not in r["text"]
        assert r["size"] == len(re.findall(r"[^\x20\x09-\x0D]+", r["text"]))
    assert [s[0] for s in corpus_pipeline.STAGES][0] == "toxicity" and len(corpus_pipeline.STAGES) == 5


def test_one_row_of_each_class(spark):
    long = [" ".join(f"{w}{i}" for i in range(60)) for w in "abcde"]
    rows = [(1, long[0]), (1, long[0]), (2, long[0] + " x"), (2, long[1]), (None, long[1]), (None, long[2]), (None, long[2]), (None, long[2] + " y"), (3, long[3]), (3, long[3] + " z"), (3, long[4]), (4, ""), (5, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], SCHEMA).repartition(3)
    got = sorted(((r["doc_id"] or 0, r["text"]) for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()))
    assert [i for i, _ in got] == [0, 1, 2, 3, 3, 4, 5]
    texts = {t for _, t in got}
    assert {long[0], long[1], long[4], ""} <= texts and len(texts & {long[2], long[2] + " y"}) == len(texts & {long[3], long[3] + " z"}) == 1


def test_run_gives_the_last_stage(spark, tables):
    assert corpus_pipeline.run(spark, tables).count() > 100


def test_every_operator_is_registered():
    names = {int(n[2:].split("_")[0]) for n in catalog.QUERIES}
    assert names == set(range(1, 14))


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_sql_gives_the_same_rows(spark, name):
    import duckdb

    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    got, want = catalog.QUERIES[name](spark, sf).toPandas(), con.sql(catalog.SQL[name]).df()
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols
    rows = lambda frame: sorted(tuple("null" if pd.isna(v) else str(v) for v in r) for r in frame[cols].astype(object).itertuples(index=False, name=None))
    whole = {c: want[c].dtype for c in cols if want[c].dtype.kind in "iu"}
    assert rows(got.astype({c: "Int64" for c in whole})) == rows(want)
