"""Session factory with the settings the operators are designed for."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build_session(app: str = "docketloom", master: str | None = None, **conf: str) -> SparkSession:
    """Return a session with adaptive execution on and UTC time.

    On a cluster leave ``master`` unset and let spark-submit decide; keyword
    arguments are Spark settings with ``__`` standing for a dot.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.parquet.filterPushdown": "true",
    }
    settings.update({k.replace("__", "."): v for k, v in conf.items()})
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
