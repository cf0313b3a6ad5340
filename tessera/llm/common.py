"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import atexit
import contextlib
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a lookup table up to which it may be broadcast (some tens of bytes a row).
BROADCAST_ROWS = 1 << 16
#: Rows of a key from which it counts as hot.
HOT_ROWS = 10_000

#: ASCII white space, in Java and RE2 notation.
SPACES = r"[\x20\x09-\x0D]+"

_own_dirs: dict[str, str] = {}
_written: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; in local mode one of our own where that is unset."""
    set_dir = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if set_dir:
        return set_dir.rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_dirs:
        _own_dirs[app] = "file://" + tempfile.mkdtemp(prefix="tessera-")
    return _own_dirs[app]


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tessera-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written[path] = spark
    table = spark.read.schema(df.schema).parquet(path)
    table.written_to = path
    return table


def discard(*tables: DataFrame) -> None:
    """Delete materialized tables that nothing reads any more."""
    for table in tables:
        path = table.written_to
        if path in _written:
            _delete(_written.pop(path), path)


def _delete(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


@atexit.register
def _remove_written() -> None:
    for path, spark in _written.items():
        try:
            _delete(spark, path)
        except Exception:  # the session has ended; what is left belongs to the cluster's own clean-up
            return


def bounded(ids: pa.Array, texts: pa.Array, most: int) -> Iterator[tuple[pa.Array, list[str | None]]]:
    """The rows of an Arrow batch in slices of at most ``most`` bytes of text; a longer text makes one of its own."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
    start = 0
    while start < len(ends):
        before = int(ends[start - 1]) if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + most, "right")))
        yield ids.slice(start, stop - start), texts.slice(start, stop - start).to_pylist()
        start = stop


def release_memory() -> None:
    """Give the worker's freed memory back to the system, so that the next stage finds it."""
    import ctypes
    import gc

    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def small(df: DataFrame, rows: int, most: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` marked for broadcast if its counted ``rows`` are few enough, else as it is."""
    return F.broadcast(df) if rows <= most else df


def join_classes(rows: DataFrame, classes: DataFrame, keys: list[str], members: str) -> DataFrame:
    """``rows`` left-joined with ``classes``, which has a row at most for each key and in ``members`` its number of rows.

    Keys of many rows (BROADCAST_ROWS of them at most, as their rows add up to those of the table) are joined by
    broadcast where the rows are; only the others are shuffled. ``members`` isn't returned.
    """
    total = classes.agg(F.sum(members)).first()[0] or 0
    hot = F.col(members) > max(HOT_ROWS, total // BROADCAST_ROWS)
    added = [c for c in classes.columns if c not in (*keys, members)]
    top = classes.where(hot).drop(members).withColumn("__hot", F.lit(True))
    placed = rows.join(F.broadcast(top), keys, "left")
    back = [*rows.columns, *added]
    done = placed.where("__hot").select(*back)
    rest = placed.where(F.col("__hot").isNull()).select(*rows.columns).join(classes.where(~hot).drop(members), keys, "left").select(*back)
    return done.unionByName(rest)


def input_bytes(df: DataFrame) -> int:
    """Catalyst's estimate of the size of ``df``; for files their size on disk."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def hash_bits(key: Column, salt: str = "", digits: int = 15) -> Column:
    """The first ``4 * digits`` bits of the MD5 of ``salt`` and the key's text, as a long. Null counts as empty."""
    text = F.concat(F.lit(salt), F.coalesce(key.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text), 1, digits), 16, 10).cast("long")


def hash_bits_sql(key: str, salt: str = "", digits: int = 15) -> str:
    """The DuckDB twin of ``hash_bits``."""
    return f"('0x' || substr(md5('{salt}' || coalesce(({key})::varchar, '')), 1, {digits}))::bigint"


def ordered_index(keys: DataFrame, by: list[Column], name: str = "ordinal") -> DataFrame:
    """``keys`` with its 0-based position in the order ``by``, without bringing all rows to one task.

    The rows are dealt by range and numbered within each range; the ranges' counts (one row a partition)
    give the offsets. ``keys`` should be narrow: it is written once.
    """
    spark = keys.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = materialize(
        keys.repartitionByRange(parts, *by)
        .sortWithinPartitions(*by)
        .select("*", F.spark_partition_id().alias("__part"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("__row"))
    )
    counts = [(r["__part"], r["n"]) for r in placed.groupBy("__part").agg(F.count("*").alias("n")).collect()]  # one row a partition
    start, offsets = 0, []
    for part, n in sorted(counts):
        offsets.append((part, start))
        start += n
    table = spark.createDataFrame(offsets, "__part int, __start long")
    return placed.join(F.broadcast(table), "__part").withColumn(name, F.col("__start") + F.col("__row")).drop("__part", "__start", "__row")
