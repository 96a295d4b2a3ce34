"""Session defaults. They suit a laptop and a cluster alike: AQE decides partition sizes and join strategies at run time."""

from __future__ import annotations

from pyspark.sql import SparkSession

DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
}


def session(master: str | None = None, name: str = "lexmatch", **conf: str) -> SparkSession:
    """A session with DEFAULTS and conf on top; names in conf use __ for dots."""
    builder = SparkSession.builder.appName(name).config(map=DEFAULTS | {k.replace("__", "."): v for k, v in conf.items()})
    return (builder.master(master) if master else builder).getOrCreate()
