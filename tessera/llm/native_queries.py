"""Queries whose operators are DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import hash_bits_sql
from tessera.llm.decontaminate import find_contained
from tessera.llm.fingerprints import compare_edits, digits, likeness
from tessera.llm.mixing import plan_mix
from tessera.llm.sharding import BITS, assign_shards

#: Bytes of text in a shard; the tables of the SQL check fill several.
SHARD_LIMIT = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items inside documents: doc_id, item_id, n_item_shingles, n_shared, containment."""
    return find_contained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of each document and its edit, with their likeness and that to the next document."""
    found = compare_edits(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        digits(F.col("tuples")).alias("fingerprint"),
        digits(F.col("edited_tuples")).alias("edited_fingerprint"),
        likeness(F.col("tuples"), F.col("edited_tuples")).alias("near_edited"),
        likeness(F.col("tuples"), F.col("next_tuples")).alias("near_next"),
    )


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of each document."""
    planned = plan_mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return planned.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op10_extendible_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shard of each document."""
    sharded = assign_shards(table(spark, sf_dir, "documents").select("doc_id", "text"), limit=SHARD_LIMIT)
    return sharded.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "shard_id", "shard_bits")


QUERIES = {"op1_decontaminate": op1_decontaminate, "op2_order_minhash": op2_order_minhash, "op5_mix_sources": op5_mix_sources, "op10_extendible_sharding": op10_extendible_sharding}

_WORDS = r"list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\pL\pN]+'), lambda x: x <> '')"

ORACLES = {
    "op1_decontaminate": f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
ds AS (SELECT DISTINCT doc_id, array_to_string(w[i:i+4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5)),
bs AS (SELECT DISTINCT item_id, array_to_string(w[i:i+4], ' ') AS s FROM (SELECT item_id, w, unnest(range(1, len(w) - 3)) AS i FROM b WHERE len(w) >= 5)),
n AS (SELECT item_id, count(*) AS n FROM bs GROUP BY item_id)
SELECT doc_id, item_id, n.n AS n_item_shingles, count(*) AS n_shared, round(count(*)::double / n.n, 9) AS containment
FROM ds JOIN bs USING (s) JOIN n USING (item_id) GROUP BY doc_id, item_id, n.n HAVING count(*) >= 0.8::double * n.n
""",
    "op5_mix_sources": f"""
WITH RECURSIVE d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::bigint AS size FROM documents),
s AS (SELECT source, sum(size)::bigint AS source_size, (CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END)::bigint AS weight FROM d GROUP BY source),
u(step, unit) AS (
  SELECT 0, 0::double
  UNION ALL
  SELECT step + 1, (SELECT (1.5::double * sum(source_size) - 2::double * coalesce(sum(source_size) FILTER (weight * u.unit >= source_size * 2::double), 0))
                         / sum(weight) FILTER (weight * u.unit < source_size * 2::double) FROM s)
  FROM u WHERE step < 40 AND (step = 0 OR unit > 0)
),
m AS (SELECT max(unit) AS unit FROM u),
t AS (SELECT source, source_size, least(weight * unit, source_size * 2::double) AS target FROM s, m),
r AS (SELECT doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN least(target / source_size, 2::double) ELSE 0 END AS rate
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
  ((floor(rate) + ({hash_bits_sql('doc_id', '17:', 13)} / 4503599627370496::double < rate - floor(rate))::int) * size)::bigint AS taken
FROM r
""",
    "op10_extendible_sharding": f"""
WITH d AS (SELECT doc_id, coalesce(strlen(text), 0)::bigint AS n_bytes, {hash_bits_sql('doc_id')} AS a FROM documents),
n AS (SELECT k, a >> ({BITS} - k) AS p FROM (SELECT a, n_bytes, unnest(range(0, {BITS})) AS k FROM d) GROUP BY ALL HAVING sum(n_bytes) > {SHARD_LIMIT} AND min(a) < max(a)),
b AS (SELECT doc_id, n_bytes, a, (SELECT count(*) FROM n WHERE n.p = d.a >> ({BITS} - n.k))::int AS shard_bits FROM d)
SELECT doc_id, n_bytes, left(lpad(bin(a), {BITS}, '0'), shard_bits) AS shard_id, shard_bits FROM b
""",
}
