"""A corpus pipeline: language, near duplicates, benchmark leaks, source weights, shards.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import discard, materialize
from tessera.llm.decontaminate import decontaminate
from tessera.llm.jaccard_join import keep_one
from tessera.llm.language import UNDETERMINED, identify
from tessera.llm.mixing import mix
from tessera.llm.sharding import assign_shards
from tessera.llm.text_queries import vocabulary
from tessera.session import share_package

#: Score from which a predicted language fills an empty one.
SURE = 0.95
#: Bytes of text in a shard.
SHARD_LIMIT = 16 << 20
#: A stage of this pipeline (language identification) has no SQL form.
ORACLE_SQL = None


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a determinable language (null, or no letter) go; not those with letters if nothing could be learned.

    A null ``lang`` takes the prediction if its score is ``SURE`` or more.
    """
    share_package(spark)
    found = identify(docs, vocabulary("piece_bpe_32k.model"))
    kept = found.where((F.col("lang_pred") != UNDETERMINED) | F.col("text").rlike(r"\p{L}"))
    sure = F.when((F.col("lang_pred") != UNDETERMINED) & (F.col("score") >= SURE), F.col("lang_pred"))
    return kept.withColumn("lang", F.coalesce("lang", sure)).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the least id stays."""
    share_package(spark)
    return keep_one(docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's weight asks."""
    return mix(docs)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their shard."""
    return assign_shards(docs, limit=SHARD_LIMIT)


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("benchmark_leaks", benchmark_leaks), ("mix_sources", mix_sources), ("shards", shards)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each result written before the next stage reads it, and deleted when the one after is."""
    docs, done = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
        discard(*done)
        done = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
