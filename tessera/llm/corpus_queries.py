"""Queries of periodic runs, token files and ranked search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import SPACES
from tessera.llm.native_queries import table
from tessera.llm.periodic_runs import find_runs
from tessera.llm.ranked_search import rank_documents
from tessera.llm.text_queries import vocabulary
from tessera.llm.token_files import read_tokens, write_tokens

#: The id that closes each document.
END_ID = 2


def _let(name: str, value: str, body: str) -> str:
    """``body`` with ``name`` for ``value``, computed once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def with_planted_period(docs: DataFrame) -> DataFrame:
    """``docs`` with the texts that the query asks for: where crc32(doc_id) % 10 = 0, words repeat with period p from word a on.

    A null doc_id plants nothing.
    """
    planted = _let("w", "__words", _let("a", "cast(__g % size(w) AS int)", _let("p", "cast(1 + (size(w) - a) div (3 + __g % 8) AS int)", "array_join(transform(w, (x, i) -> if(i < a, x, get(w, a + (i - a) % p))), ' ')")))
    trimmed = F.btrim(F.col("text"), F.lit(" \t\n\x0b\x0c\r"))
    chosen = (F.col("__h") % 10 == 0) & (trimmed != "")
    marked = docs.withColumn("__h", F.crc32(F.col("doc_id").cast("string").cast("binary"))).withColumn("__g", F.expr("__h div 10"))
    split = marked.withColumn("__words", F.when(chosen, F.split(trimmed, SPACES)))
    return split.withColumn("text", F.coalesce(F.expr(f"if(__words IS NULL, NULL, {planted})"), F.col("text"))).select(*docs.columns)


def strongest(runs: str = "runs") -> Column:
    """The run of the greatest length / period, compared exactly; the first of equal ones."""
    kind = "struct<start:bigint,length:bigint,period:bigint>"
    return F.expr(f"aggregate({runs}, cast(NULL AS {kind}), (m, r) -> if(m IS NULL OR r.length * m.period > m.length * r.period, r, m))")


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of words of each document, the strongest one, and digests of the runs and of the collapsed text."""
    docs = with_planted_period(table(spark, sf_dir, "documents").select("doc_id", "text"))
    found = find_runs(docs).withColumn("best", strongest())
    lines = F.expr(r"array_join(transform(runs, r -> concat(concat_ws(',', r.start, r.length, r.period), '\n')), '')")
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op12_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place, length and checksum of each document's token ids, from the files that hold them."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    path = write_tokens(docs, vocabulary("byte_bpe_50k.json"), end_id=END_ID)
    return read_tokens(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents of each benchmark item."""
    return rank_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))


QUERIES = {"op11_periodic_runs": op11_periodic_runs, "op12_token_files": op12_token_files, "op13_ranked_search": op13_ranked_search}

_TERMS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{80}-\\x{10FFFF}]+')"

#: The unsigned CRC-32 of a text of ASCII characters, bit by bit.
_CRC = "xor(list_reduce(list_concat([4294967295::bigint], flatten(list_transform(string_split({0}, ''), lambda c: list_concat([ascii(c)::bigint], list_transform(range(8), lambda j: -1::bigint))))), lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END), 4294967295)"

ORACLES = {
    "op11_periodic_runs": f"""
WITH h AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w, {_CRC.format("doc_id::varchar")} AS h FROM documents),
c AS (SELECT doc_id, w, len(w) AS n, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN h // 10 END AS g FROM h),
e AS (SELECT doc_id, w, n, g % n AS a, 1 + (n - g % n) // (3 + g % 8) AS p FROM c),
d AS (SELECT doc_id, n, CASE WHEN a IS NULL THEN w ELSE list_transform(range(n), lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % p END]) END AS w FROM e),
s AS (SELECT doc_id, i, md5(array_to_string(w[i + 1 : i + 16], ' ')) AS k FROM (SELECT doc_id, w, unnest(range(n - 15)) AS i FROM d WHERE n >= 24)),
m AS (SELECT x.doc_id, x.i, y.i - x.i AS q FROM s x JOIN s y ON x.doc_id = y.doc_id AND x.k = y.k AND x.i < y.i),
j AS (SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM m),
t AS (SELECT doc_id, q, min(i) AS a, max(i) + 16 + q AS z FROM j GROUP BY doc_id, q, island HAVING max(i) + 16 + q - min(i) >= greatest(24, 3 * q)),
r AS (SELECT doc_id, a, z, min(q) AS q FROM t GROUP BY doc_id, a, z),
v AS (SELECT doc_id, count(*) AS n_runs, string_agg(a || ',' || (z - a) || ',' || q || chr(10), '' ORDER BY a, q) AS lines, first(struct_pack(a := a, z := z, q := q) ORDER BY (z - a)::double / q DESC, a, q) AS best FROM r GROUP BY doc_id),
g AS (SELECT DISTINCT doc_id, unnest(range(a + q, z)) AS i FROM r),
l AS (SELECT doc_id, list(i) AS gone FROM g GROUP BY doc_id)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, best.a AS start, best.z - best.a AS length, best.q AS period, 1000 * (best.z - best.a) // best.q AS exponent_milli,
  sha256(coalesce(lines, '')) AS runs_sha256, sha256(array_to_string(CASE WHEN gone IS NULL THEN w ELSE list_filter(w, lambda x, i: NOT list_contains(gone, i - 1)) END, ' ')) AS collapsed_sha256
FROM d LEFT JOIN v USING (doc_id) LEFT JOIN l USING (doc_id)
""",
    "op13_ranked_search": f"""
WITH t AS (SELECT doc_id, unnest({_TERMS}) AS term FROM documents),
f AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY ALL),
n AS (SELECT doc_id, sum(tf)::bigint AS n FROM f GROUP BY doc_id),
c AS (SELECT count(*) AS docs, sum(n)::bigint AS terms FROM n),
m AS (SELECT doc_id, 100 - 90 + (90 * n * docs) // terms AS m FROM n, c),
w AS (SELECT term, floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1)))::bigint AS w FROM f, c GROUP BY term, docs),
q AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS term FROM benchmark),
s AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::bigint AS score FROM q JOIN f USING (term) JOIN m USING (doc_id) JOIN w USING (term) GROUP BY ALL)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::int AS rank, doc_id, score FROM s WHERE score > 0 QUALIFY rank <= 10
""",
}
