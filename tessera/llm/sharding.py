"""Sharding by extendible hashing.

A document's address is 60 bits of the MD5 of its id. A bucket holds the addresses with one prefix; it is split on the
next bit only while its texts exceed ``limit`` bytes (UTF-8; null: 0) and it holds more than one address. The directory
maps prefixes of a common length to buckets, several entries to a bucket that was not split so far.

Bytes are summed per directory cell before the shuffle, so no key or source is hot. Where a cell at the directory's
depth is still too large, the cells inside it are counted, and only those. Rows that share an id share an address and
stay together; only such a bucket of a single address may exceed the limit. Null ids share an address. An empty table
gives an empty result. Input columns named shard_id or shard_bits are replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import hash_bits, materialize, small

BITS = 60
#: Directory entries (12 bytes each) up to which a level is broadcast.
DIRECTORY_ROWS = 1 << 20
STEP = 8


def _nodes(cells: DataFrame, low: int, high: int, limit: int) -> DataFrame:
    """(depth, prefix) of the buckets of depth ``low`` to ``high`` that must be split."""
    return (
        cells.select("*", F.explode(F.sequence(F.lit(low), F.lit(high))).alias("depth"))
        .withColumn("prefix", F.expr(f"shiftright(cell, {high} - depth)"))
        .groupBy("depth", "prefix")
        .agg(F.sum("bytes").alias("bytes"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
        .where((F.col("bytes") > limit) & (F.col("lo") < F.col("hi")))
        .select("depth", "prefix")
    )


def assign_shards(docs: DataFrame, *, limit: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with shard_id (the bucket's bits, most significant first; '' is the only one) and shard_bits."""
    kept = [c for c in docs.columns if c not in ("shard_id", "shard_bits")]
    keyed = docs.select(*kept, hash_bits(F.col(doc_id)).alias("__address"))
    sizes = docs.select(hash_bits(F.col(doc_id)).alias("address"), F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long").alias("bytes"))
    total = sizes.agg(F.sum("bytes")).first()[0] or 0
    depth = min(20, max(0, math.ceil(math.log2(max(1, total / limit))) + 3))
    low, levels, inside = 0, [], sizes
    while True:
        cells = materialize(
            inside.groupBy(F.expr(f"shiftright(address, {BITS - depth})").alias("cell")).agg(F.sum("bytes").alias("bytes"), F.min("address").alias("lo"), F.max("address").alias("hi"))
        )
        split = materialize(_nodes(cells, low, depth, limit))
        # A cell's bucket lies below its ancestors that were split: they form a chain from the first of this level.
        above = cells.select("cell", F.explode(F.sequence(F.lit(low), F.lit(depth))).alias("depth")).withColumn("prefix", F.expr(f"shiftright(cell, {depth} - depth)"))
        directory = materialize(
            above.join(split.withColumn("hit", F.lit(1)), ["depth", "prefix"], "left").groupBy("cell").agg((F.lit(low) + F.count("hit")).cast("int").alias("bits"))
        )
        levels.append((depth, directory))
        over = split.where(F.col("depth") == depth).select(F.col("prefix").alias("cell"))
        n_over = over.count()
        if not n_over or depth == BITS:
            break
        inside = inside.join(small(over, n_over), F.expr(f"shiftright(address, {BITS - depth})") == F.col("cell"), "left_semi")
        low, depth = depth + 1, min(BITS, depth + STEP)
    out = keyed.withColumn("shard_bits", F.lit(None).cast("int"))
    for at, directory in levels:
        entry = directory.select(F.col("cell").alias("__cell"), F.col("bits").alias("__bits"))
        out = out.join(small(entry, directory.count(), DIRECTORY_ROWS), F.expr(f"shiftright(__address, {BITS - at})") == F.col("__cell"), "left")
        out = out.withColumn("shard_bits", F.coalesce("__bits", "shard_bits")).drop("__cell", "__bits")
    bits = F.expr(f"substring(lpad(bin(__address), {BITS}, '0'), 1, shard_bits)")
    return out.withColumn("shard_bits", F.least("shard_bits", F.lit(BITS))).withColumn("shard_id", bits).drop("__address").select(*kept, "shard_id", "shard_bits")
