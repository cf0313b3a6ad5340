"""Cached tables by content hash, and the manifest of exported ones."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.parameters import branch_name


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


class Catalog:
    """Tables under ``root/category/stem_branch_key``; a table that is complete is read instead of made again."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def path(self, category: str, stem: str, branch: str, key: str) -> str:
        return f"{self.root}/{category}/{stem}_{branch_name(branch)}_{key}"

    def table(self, category: str, stem: str, branch: str, key: str, make: Callable[[], DataFrame]) -> DataFrame:
        path = self.path(category, stem, branch, key)
        if not _exists(self.spark, f"{path}/_SUCCESS"):
            make().write.mode("overwrite").parquet(path)
        return self.spark.read.parquet(path)

    def branches(self, category: str, stem: str, key: str) -> list[tuple[str, str]]:
        """(branch, path) of the complete tables of a stem and key, sorted."""
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{category}")
        system = folder.getFileSystem(self.spark._jsc.hadoopConfiguration())
        found = system.globStatus(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{category}/{stem}_*_{key}/_SUCCESS")) or []
        names = [f.getPath().getParent() for f in found]
        return sorted((n.getName()[len(stem) + 1 : -len(key) - 1], n.toString()) for n in names)

    def latest(self, category: str, stem: str) -> str | None:
        """The complete table of a stem that was written last, whatever its branch and key; of equally late ones the last by name."""
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{category}/{stem}_*/_SUCCESS")
        found = folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(folder) or []
        times = [(f.getModificationTime(), f.getPath().getParent().toString()) for f in found]
        return max(times)[1] if times else None


def manifest_row(df: DataFrame, *, bundle: str, family: str, label: str, branch: str, support: str | None = None) -> DataFrame:
    """One row about an exported table: counts, lineage and the range of its support column."""
    has = support is not None and support in df.columns
    aggs = [F.count("*").alias("row_count")]
    aggs += [F.min(support).cast("long").alias("min_subject_support"), F.max(support).cast("long").alias("max_subject_support")] if has else [F.lit(None).cast("long").alias(n) for n in ("min_subject_support", "max_subject_support")]
    about = {"bundle": bundle, "family": family, "label": label, "analysis_branch": branch, "subject_support_column": support if has else None}
    return df.agg(*aggs).select(*(F.lit(v).cast("string").alias(k) for k, v in about.items()), "row_count", F.lit(len(df.columns)).alias("column_count"), "min_subject_support", "max_subject_support")


def with_lineage(df: DataFrame, *, family: str, branch: str, first: tuple[str, ...] = ()) -> DataFrame:
    """Lineage columns, then the named ones that exist, then the rest."""
    head = [c for c in first if c in df.columns]
    return df.select(F.lit(family).alias("analysis_family"), F.lit(branch).alias("analysis_branch"), *head, *(c for c in df.columns if c not in head))


def supported(df: DataFrame, least: int, column: str = "n_subjects") -> DataFrame:
    """Rows with enough subjects; a missing count is 0."""
    return df.where(F.coalesce(column, F.lit(0)) >= least)
