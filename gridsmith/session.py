"""A Spark session with the settings that the toolkit is tested under."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "gridsmith", master: str | None = None, jobs: int | None = None) -> SparkSession:
    """The running session as it is, or a new one: ANSI on, adaptive execution on, UTC; ``jobs`` sets the shuffle partitions."""
    if running := SparkSession.getActiveSession():
        return running
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {"spark.sql.ansi.enabled": "true", "spark.sql.adaptive.enabled": "true", "spark.sql.session.timeZone": "UTC", "spark.sql.timestampType": "TIMESTAMP_NTZ", "spark.ui.showConsoleProgress": "false"}
    if jobs:
        settings["spark.sql.shuffle.partitions"] = str(jobs)
    for k, v in settings.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()
