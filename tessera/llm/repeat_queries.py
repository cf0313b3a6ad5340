"""Queries about repeated passages and near duplicates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.jaccard_join import near_duplicates
from tessera.llm.native_queries import table
from tessera.llm.substring_dedup import remove_repeated_passages
from tessera.llm.suffix_dedup import remove_repeats


def _removed(unit: str) -> list:
    return [F.expr("aggregate(spans, 0L, (n, s) -> n + s.end - s.start)").alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2(F.col(unit), 256).alias("kept_sha256")]


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of each document that 200-byte repeats cover."""
    cut = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cut.select("doc_id", "n_bytes", *_removed("kept"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of each document that 13-word passages of earlier documents cover."""
    cut = remove_repeated_passages(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cut.select("doc_id", "n_words", *_removed("kept"))


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component of near duplicates of each document."""
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES = {"op8_jaccard_join": op8_jaccard_join, "op3_suffix_dedup": op3_suffix_dedup, "op6_substring_dedup": op6_substring_dedup}
_WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"

ORACLES: dict[str, str] = {
    "op3_suffix_dedup": """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, ''))::bigint AS n FROM documents),
w AS (SELECT doc_id, i, md5(substr(h, 2 * i + 1, 400)) AS k FROM (SELECT doc_id, h, unnest(range(0, n - 199)) AS i FROM d WHERE n >= 200)),
r AS (SELECT doc_id, i FROM w QUALIFY count(*) OVER (PARTITION BY k) > 1),
e AS (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS b FROM r),
s AS (SELECT doc_id, i AS a, coalesce(b + 200 < i, true) AS opens FROM e),
g AS (SELECT doc_id, a, sum(opens::int) OVER (PARTITION BY doc_id ORDER BY a) AS run FROM s),
u AS (SELECT doc_id, run, min(a) AS a, max(a) + 200 AS z FROM g GROUP BY 1, 2),
l AS (SELECT doc_id, list(struct_pack(a := a, z := z) ORDER BY a) AS runs FROM u GROUP BY 1),
k AS (SELECT doc_id, n, coalesce(list_sum(list_transform(runs, lambda x: x.z - x.a)), 0)::bigint AS n_removed, coalesce(len(runs), 0)::bigint AS n_spans, h,
  list_concat([0], list_transform(coalesce(runs, []), lambda x: x.z)) AS f, list_concat(list_transform(coalesce(runs, []), lambda x: x.a), [n]) AS t FROM d LEFT JOIN l USING (doc_id))
SELECT doc_id, n AS n_bytes, n_removed, n_spans, sha256(unhex(array_to_string(list_transform(f, lambda x, i: substr(h, 2 * x + 1, 2 * (t[i] - x))), ''))) AS kept_sha256 FROM k
""",
    "op6_substring_dedup": f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
s AS (SELECT doc_id, i, md5(array_to_string(w[i : i + 12], ' ')) AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13)),
r AS (SELECT doc_id, i FROM s QUALIFY doc_id > min(doc_id) OVER (PARTITION BY k)),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS j FROM r),
p AS (SELECT doc_id, j, lag(j) OVER (PARTITION BY doc_id ORDER BY j) AS b FROM c),
m AS (SELECT doc_id, count(*) AS n_removed, count(*) FILTER (b IS NULL OR b + 1 < j) AS n_spans, list(j) AS gone FROM p GROUP BY 1)
SELECT doc_id, len(w) AS n_words, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(array_to_string(CASE WHEN gone IS NULL THEN w ELSE list_filter(w, lambda x, i: NOT list_contains(gone, i)) END, ' ')) AS kept_sha256
FROM d LEFT JOIN m USING (doc_id)
""",
    "op8_jaccard_join": f"""
WITH RECURSIVE d AS (SELECT doc_id, {_WORDS.replace("coalesce(text, '')", "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(w) < 5 THEN array_to_string(w, ' ') ELSE array_to_string(w[i : i + 4], ' ') END AS k FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.k = b.k AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 80 * (a.n + b.n - c)),
r(doc_id, z) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.doc_id, l.y FROM r JOIN l ON l.x = r.z)
SELECT doc_id, coalesce(n, 0) AS n_shingles, least_id AS component_id FROM (SELECT doc_id, min(z) AS least_id FROM r GROUP BY 1) LEFT JOIN n USING (doc_id)
""",
}
