"""From raw documents to a training mix, in five stages.

Each stage takes (spark, docs, sf_dir), works on all that the one before it kept and returns a
DataFrame that is written as Parquet and reread as the next one's docs.  All but the last
return the columns of documents; columns of other names, those of results included, stay as they are.

Every stage takes empty tables, nulls in any column, repeated rows and ids, and texts of any length; its docstring says what
they give.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.llm import decontaminate, jaccard, mixing, secrets, toxicity
from pulsegrid.llm.common import columns, settled, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labels' training fold, scores below its cut.

    Null and empty texts have the score of no words and stay, as all do where no label of both kinds is there to learn from; of
    several labels of an id the largest counts; equal texts have equal scores, so repeated rows stay or go together.
    """
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, model)
    (score,) = columns(scored.columns[-1:])
    return scored.where(score < toxicity.CUT).select(*columns(docs.columns))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of n-gram Jaccard links, the one with the least id (null last).

    Repeated rows are copies, of which one stays; texts without words are a class by id; a row that shares a dropped row's id
    but not its text stays.
    """
    return jaccard.representatives(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark.

    Null and empty texts and items match nothing; an item without an id counts as any other; without items all stay.
    """
    found = decontaminate.find_leaks(docs, table(spark, sf_dir, "benchmark"))
    (leaks,) = columns(found.columns[-1:])
    return found.where(F.size(leaks) == 0).select(*columns(docs.columns))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets in their texts replaced; n_chars follows the text.

    Null texts stay null and empty ones empty, with an n_chars of null and 0.
    """
    return secrets.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, in training order, with words taken and the position of each copy.

    Texts without words are never taken; a null source is a source of its own; repeated rows are taken each for itself; ties
    of position stand by id.
    """
    rest = [c for c in docs.columns if c not in ("doc_id", "source")]
    name = mixing.result_names(rest)
    mixed = mixing.mix(docs, keep=rest)
    mixed = mixing.in_training_order(mixed.where(F.col(name["taken"]) > 0), name["position"])
    return mixed.select(*columns([*docs.columns, *[name[n] for n in ("size", "taken", "copies", "position")]]))


STAGES = [
    ("toxicity", drop_toxic),
    ("n-gram Jaccard join", drop_near_copies),
    ("benchmark decontamination", drop_leaks),
    ("secret scans", redact_secrets),
    ("mixing sources", mix_sources),
]

#: A trained classifier and MinHash decide on rows, which SQL can't express; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = settled(partial(stage, spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
