"""A training corpus from raw documents: language, exact copies, near copies, mix, tokens.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept, and returns a DataFrame that is
written as Parquet and read again for the next one. All but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from lifecurve.llm import bpe, curriculum, exactdedup, langid, nearcopies
from lifecurve.session import made_since, materialize, release

#: Languages are learnt, near copies linked and ids encoded by other means than SQL has.
ORACLE_SQL = None


#: Working tables of the stage before, which go when the next one has begun.
_LEFT: list[str] = []


def stage(fn):
    """A stage that first deletes what the stage before has left, as that one's result is written by then."""

    @wraps(fn)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        _LEFT[:] = release(spark, list(_LEFT), keep=docs)
        mark = len(made_since())
        out = fn(spark, docs, sf_dir)
        _LEFT.extend(made_since(mark))
        return out

    return run


@stage
def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is identified; what the classifier rejects goes."""
    return langid.accepted(docs, langid.fit(docs))


@stage
def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts (A-Z in lower case): the one with the largest doc_id."""
    return exactdedup.one_of_each(docs)


@stage
def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (Jaccard 0.8 over five words): the one with the smallest doc_id."""
    return nearcopies.one_of_each(docs)


@stage
def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, in the order of the curriculum."""
    return curriculum.mixed(docs)


@stage
def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of every document that is left."""
    return bpe.round_trip(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("exact_copies", exact_copies),
    ("near_copies", near_copies),
    ("mix", mix),
    ("tokens", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each is written to the working folder before the next."""
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for _, step in STAGES[:-1]:
        docs = materialize(step(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
