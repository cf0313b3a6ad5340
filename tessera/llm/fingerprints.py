"""Document fingerprints by Order MinHash.

The k-mers of a text are its runs of ``k`` words (of all its words if it has fewer), each numbered by its occurrence, so
a repeated k-mer counts every time. One random order of the numbered k-mers is cut into 64 equal parts by its leading
bits (one-permutation hashing); in each part the two least k-mers are selected, put back in their text order, and hashed
as a tuple, which changes when either is edited and when they swap places. A part with a single k-mer hashes that one.
The fingerprint lists the parts that have any, in order, as ten hexadecimal digits each (6 bits: part, 34: tuple).

The likeness of two fingerprints is the share of equal tuples among the parts that either has; of two empty ones 1.
Equal texts have equal fingerprints. Texts are split at ASCII white space; null and empty texts have no k-mers.

Everything is a column expression: no Python runs, and one text is never more than one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import SPACES, materialize, ordered_index

#: Packed values: the upper 34 bits are a hash, the lower 30 a position (a text has fewer words than that).
_LOW, _HIGH = "1073741823L", "-1073741824L"


def _let(name: str, value: str, body: str) -> str:
    """``body`` with ``name`` for ``value``, computed once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _numbered(words: str, k: int) -> str:
    """Packed hashes and positions of the occurrence-numbered k-mers of an array of words, sorted."""
    kmer = ", ".join(f"get({words}, i + {j})" for j in range(k))
    packed = f"sort_array(transform(sequence(0, greatest(size({words}) - {k}, 0)), i -> (xxhash64({kmer}) & {_HIGH}) | i))"
    heads = "filter(sequence(0, size(s) - 1), i -> i = 0 OR shiftright(get(s, i), 30) != shiftright(get(s, i - 1), 30))"
    number = f"(x, o) -> (xxhash64(shiftright(x, 30), o) & {_HIGH}) | (x & {_LOW})"
    runs = f"flatten(transform(a, (at, j) -> transform(slice(s, at + 1, coalesce(get(a, j + 1), size(s)) - at), {number})))"
    return f"sort_array({_let('s', packed, _let('a', heads, runs))})"


def _tuples(numbered: str) -> str:
    """Part and tuple hash of each part that has k-mers."""
    least = "filter(t, (x, i) -> i < 2 OR shiftright(x, 58) != shiftright(get(t, i - 2), 58))"
    first = "filter(sequence(0, size(m) - 1), i -> i = 0 OR shiftright(get(m, i), 58) != shiftright(get(m, i - 1), 58))"
    one, two = "get(m, i)", "get(m, i + 1)"
    pair = f"if(({one} & {_LOW}) < ({two} & {_LOW}), xxhash64(shiftright({one}, 30), shiftright({two}, 30)), xxhash64(shiftright({two}, 30), shiftright({one}, 30)))"
    hashed = f"if(shiftright({one}, 58) <=> shiftright({two}, 58), {pair}, xxhash64(shiftright({one}, 30)))"
    packed = f"transform({first}, i -> shiftleft(shiftright({one}, 58) & 63L, 34) | shiftrightunsigned({hashed}, 30))"
    return _let("t", numbered, _let("m", least, packed))


def with_fingerprint(df: DataFrame, text: str, name: str, k: int = 3) -> DataFrame:
    """``df`` with the tuples of a column of texts, as an array of longs."""
    trimmed = F.btrim(F.coalesce(F.col(text), F.lit("")), F.lit(" \t\n\x0b\x0c\r"))
    words = F.when(trimmed != "", F.split(trimmed, SPACES))
    tuples = F.expr(_let("w", "__words", f"if(w IS NULL, cast(array() AS array<bigint>), {_tuples(_numbered('w', k))})"))
    return df.withColumn("__words", words).withColumn(name, tuples).drop("__words")


def likeness(a: Column, b: Column) -> Column:
    """Share of equal tuples among the parts that either fingerprint has."""
    parts = lambda x: F.transform(x, lambda v: F.shiftright(v, 34))
    either = F.size(F.array_union(parts(a), parts(b)))
    return F.when(either == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / F.greatest(either, F.lit(1)))


def digits(tuples: Column) -> Column:
    """The fingerprint as a string."""
    return F.array_join(F.transform(tuples, lambda v: F.lower(F.lpad(F.hex(v), 10, "0"))), "")


def compare_edits(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", k: int = 3) -> DataFrame:
    """Fingerprints of each text, of an edit of it, and of the next text, with their likenesses.

    The edit replaces the last quarter of the code points (rounded down) by the first as many of the next document in
    ascending order of ids (null first; after the last comes the first; a lone document is its own next). Rows with one
    id follow each other by text hash. Columns: doc_id, n_chars, edited, tuples, edited_tuples, next_tuples.

    Texts are shuffled once, by a hash of id and text; both readers use those files. Order and lengths travel apart
    from the texts, and each document sends its predecessor only the head that the edit needs. Equal rows follow each
    other, so one of them is compared with itself and with the row after the last; their number multiplies the result.
    """
    row = docs.select(F.col(doc_id).alias("__id"), F.coalesce(F.col(text), F.lit("")).alias("__text"))
    row = row.withColumn("__hash", F.xxhash64("__text")).withColumn("__key", F.xxhash64("__id", "__hash"))
    lengths = row.select("__id", "__hash", "__key", F.char_length("__text").cast("long").alias("__n"))
    placed = materialize(ordered_index(lengths, [F.col("__id").asc_nulls_first(), F.col("__hash").asc(), F.col("__key").asc()], "__at"))
    total = placed.count()
    following = placed.select(((F.col("__at") + total - 1) % F.lit(max(1, total))).alias("__at"), F.col("__key").alias("__next_key"))
    # Two rows a key at most: followed by an equal row, and by another one.
    pairs = placed.join(following, "__at").groupBy("__key", "__next_key").agg(F.count("*").alias("__rows"), F.floor(F.first("__n") / 4).alias("__head"))
    asked = pairs.groupBy(F.col("__next_key").alias("__key")).agg(F.collect_list(F.struct(F.col("__key").alias("__to"), "__rows", "__head")).alias("__asked"))
    asked = materialize(asked)

    twin = F.row_number().over(Window.partitionBy("__key").orderBy("__id", "__hash"))
    # One row a key; as a difference, so that no limit sorts the texts before they are dealt.
    texts = row.select("__id", "__text", "__key", "__hash").withColumn("__twin", twin).where(F.col("__twin") - 1 == 0).drop("__twin")
    known = with_fingerprint(texts, "__text", "__tuples", k).withColumn("__n", F.char_length("__text").cast("long"))
    heads = known.join(asked, "__key").select(F.explode("__asked").alias("__a"), "__text", F.col("__tuples").alias("__next_tuples"))
    heads = heads.select(F.col("__a.__to").alias("__key"), "__a.__rows", F.expr("left(__text, cast(__a.__head AS int))").alias("__next"), "__next_tuples")
    both = known.join(heads, "__key")
    both = both.withColumn("__edited", F.expr("concat(left(__text, cast(__n - floor(__n / 4) AS int)), __next)"))
    both = with_fingerprint(both, "__edited", "__edited_tuples", k)
    found = both.select(
        F.col("__id").alias(doc_id), F.col("__n").alias("n_chars"), F.col("__edited").alias("edited"), F.col("__tuples").alias("tuples"), F.col("__edited_tuples").alias("edited_tuples"), F.col("__next_tuples").alias("next_tuples"), "__rows"
    )
    return found.withColumn("__rows", F.explode(F.sequence(F.lit(1).cast("long"), "__rows"))).drop("__rows")
