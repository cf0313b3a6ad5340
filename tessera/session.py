"""Session factory shared by tests, bench and the entry point."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import SparkSession


def make_session(master: str = "local[8]", partitions: int = 8, memory: str = "8g", **conf: str) -> SparkSession:
    """A session with ANSI mode on, UTC time and AQE; extra settings come as ``spark_sql_x="..."`` keywords."""
    builder = (
        SparkSession.builder.master(master)
        .appName("tessera")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("_", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def share_package(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package from where the driver did, where they share its file system."""
    root = str(Path(__file__).resolve().parent.parent)
    environment = spark.sparkContext.environment
    paths = environment.get("PYTHONPATH", "").split(":")
    if root not in paths:
        environment["PYTHONPATH"] = ":".join(filter(None, [*paths, root]))
    return spark
