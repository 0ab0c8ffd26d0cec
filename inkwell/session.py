"""Session helpers shared by the driver entry, the benchmark and the tests."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession


def local_session(app: str = "inkwell", cpus: int | str = "*", partitions: int = 8) -> SparkSession:
    """A local session with adaptive execution and UTC; cluster settings win when a session exists."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("INKWELL_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


#: Rows of an Arrow batch where rows hold whole texts.
TEXT_ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One driver table of a scale-factor directory; from here on the session hands texts to Python in batches of at most ``TEXT_ROWS``."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if name in ("documents", "pages") and int(spark.conf.get(key)) > TEXT_ROWS:
        spark.conf.set(key, str(TEXT_ROWS))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
