"""Session defaults shared by tests, the bench and interactive use."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build_session(
    app: str = "tessella", cores: int | str = "*", partitions: int = 8, **conf: str
) -> SparkSession:
    """A local session with the settings the library is designed for.

    On a cluster the caller brings a session; nothing here is needed there but
    UTC time and adaptive execution, which is Spark's default.
    """
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
