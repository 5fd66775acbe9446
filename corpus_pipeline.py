"""A corpus cleaning pipeline over ``documents``, in five stages.

Each stage works on all rows that the one before kept; its result is written as
Parquet and read back as the next one's input.  All stages but the last return the
columns of ``documents``; the last adds what encoding found.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talkweave.llm import bpe_codec, decontaminate, line_dedup, minhash_dedup, toxicity
from talkweave.llm.queries import vocabulary
from talkweave.llm.tables import Scratch, opened, release


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: Tables of the stage before; see ``stage``.
_former: list[Scratch] = []


def stage(work: Stage) -> Stage:
    """A stage that first deletes the intermediate tables of the one before: it is given that one's written result, so nothing reads them any more."""

    @functools.wraps(work)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        release(_former)
        with opened() as tables:
            result = work(spark, docs, sf_dir)
        _former.extend(tables)
        return result

    return run


@stage
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model doesn't reject; it learns from the labels of those given."""
    return toxicity.without_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


@stage
def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that repeat an earlier one, nearly or exactly; documents left without a line go."""
    kept = line_dedup.keep_lines(docs, drop_emptied=True)
    return kept.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


@stage
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group with a similarity of 0.8 or more over five-word shingles."""
    return minhash_dedup.keep_one(docs)


@stage
def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no ten words in a row with a benchmark item."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@stage
def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their token ids and number, and whether decoding gives the text back."""
    return bpe_codec.encode(docs, vocabulary(), verified="round_trip").withColumn("n_tokens", F.size("ids").cast("long"))


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("minhash_dedup", drop_near_duplicates),
    ("decontaminate", drop_contaminated),
    ("bpe_codec", encode),
]

#: SQL can't express a learned filter; tests compare with a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, work in STAGES[:-1]:
        before = list(scratch.paths)
        docs = scratch.save(work(spark, docs, sf_dir), name)
        scratch.drop(before)
    return STAGES[-1][1](spark, docs, sf_dir)
