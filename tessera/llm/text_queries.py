"""Queries whose operators work on each text alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.language import identify
from tessera.llm.native_queries import table
from tessera.llm.secrets import scan_secrets
from tessera.llm.token_counts import count_tokens

#: Tokens above which a document is over the limit.
TOKEN_LIMIT = 1024


def vocabulary(name: str) -> str:
    """The place of a public tokenizer file."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of each document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    counted = count_tokens(docs, vocabulary("byte_bpe_50k.json"))
    n_bytes = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    return counted.select("doc_id", n_bytes.alias("n_bytes"), "n_tokens", (F.col("n_tokens") > TOKEN_LIMIT).alias("over_limit"))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of each document, as counts, a digest of the base spans, and all spans."""
    found = scan_secrets(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "secrets")
    n = lambda kind: F.expr(f"cast(size(filter(secrets, s -> s.kind = '{kind}')) as long)").alias(f"n_{kind}")
    joined = "array_join(transform({}, s -> concat_ws(':', s.kind, s.start, s.end)), ',')"
    base = joined.format("filter(secrets, s -> s.kind in ('assign', 'access', 'hex'))")
    return found.select("doc_id", n("assign"), n("access"), n("hex"), F.expr(f"sha2({base}, 256)").alias("base_sha256"), F.expr(joined.format("secrets")).alias("spans"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of each document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return identify(docs, vocabulary("piece_bpe_32k.model")).select("doc_id", "held_out", "lang_pred", "score")


QUERIES = {"op4_token_counts": op4_token_counts, "op7_secret_scan": op7_secret_scan, "op9_language_id": op9_language_id}
ORACLES: dict[str, str] = {}
