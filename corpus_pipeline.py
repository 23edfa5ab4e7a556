"""A corpus pipeline: five stages over `documents`, each written and read again before the next.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last have the columns of documents. Extra columns
are kept whatever their names, and an empty table stays empty. A row without an id is judged by its text like any other.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from timberline.llm import decontaminate, language_id, mixing, sharding, simhash
from timberline.llm.common import materialize

#: A document stays if its language is told with at least this score.
LEAST_SCORE = 0.5
SHARDS = 40


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter and those whose language is not told apart. Learns from the labelled documents.

    A null or empty text has no letter and goes. A tie between languages leaves a score of 0.5 or less for two or more; 0.5 stays.
    Repeated rows are judged alike.
    """
    model = language_id.fit(docs, ~language_id.held_out(F.col("doc_id")))
    if not model.languages:
        return docs  # nothing to learn from: nothing is rejected
    return language_id.keep_confident(docs, model, LEAST_SCORE)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: shingles of five words, similarity 0.8 or more.

    The smallest id of a group stays, and of repeated rows one. Null and empty texts, which have no words, are one group.
    """
    return simhash.keep_one_similar(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold ten words in a row of a benchmark item. Null texts hold none and stay; repeated rows go together."""
    return decontaminate.remove_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def sample_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Draws documents so that sources, languages and topics have their target weights.

    A null source or language is a value of its own. A text without tokens costs nothing and stays. Rows of one id and cell are drawn together.
    """
    return mixing.sample_mixture(docs)


def put_into_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with its shard. Equal texts share one; a null text counts as empty."""
    return sharding.assign_shards(docs, SHARDS)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", keep_known_languages),
    ("near_dedup", keep_one_of_each),
    ("decontamination", drop_contaminated),
    ("mixing", sample_to_weights),
    ("sharding", put_into_shards),
]

#: SimHash needs XXH64 and raking needs iteration; tests/llm holds the stages against a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
