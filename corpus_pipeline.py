"""A corpus pipeline: toxic documents go, then exact and near copies, then sources are mixed and encoded.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next stage's ``docs``.

Edge cases: a null text counts as empty in every stage, so of all null and empty texts one
stays; a null id is the smallest for exact copies and the largest for near copies; a
null source is one of its own; rows that repeat are exact copies; columns beyond doc_id, text and
source pass through, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from weirflow.llm import bpe, exact_dedup, mixing, near_copies, simhash, toxicity
from weirflow.llm.queries import table, tokenizer_file
from weirflow.llm.storage import discard_some, made, written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
#: Tables that stages have written, by application.
_left: dict[str, list[str]] = {}


def tidy(stage: Stage) -> Stage:
    """A stage that first removes what earlier stages wrote for themselves, as their results are tables by now.

    What ``docs`` still reads stays, and so does all that others have written.
    """

    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        name = spark.sparkContext.applicationId
        kept = discard_some(spark, _left.pop(name, []), docs)
        before = set(made(spark))
        done = stage(spark, docs, sf_dir)
        _left[name] = kept + [f for f in made(spark) if f not in before]
        return done

    return run


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the machine trained on ``labels`` doesn't predict toxic."""
    return toxicity.kept(docs, table(spark, sf_dir, "labels"))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest id."""
    return exact_dedup.keep_first(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies, by five-word similarity of 0.8 or more, the document with the smallest id.

    SimHash's ball hashing finds what lies within two bits, which an exact check confirms; as that links few of these, the exact join completes the groups.
    """
    return simhash.keep_one(docs, near_copies.near_duplicates)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture of sources takes them."""
    return mixing.mixed(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with the digests of ids and decoded text."""
    return bpe.encoded(docs, tokenizer_file(), outputs=("n_tokens", "ids", "ids_sha256", "decoded_sha256"), keep=("doc_id", "source"))


STAGES = [
    ("toxicity", tidy(without_toxic)),
    ("exact_dedup", tidy(without_copies)),
    ("near_copies", tidy(without_near_copies)),
    ("mixing", tidy(mixed)),
    ("bpe", tidy(tokens)),
]

#: SQL can't express the string-kernel machine; tests hold the pipeline against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
