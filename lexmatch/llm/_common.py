"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Rows of a file of a table whose number of rows has a known bound.
FILE_ROWS = 1 << 17


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, read from the session.

    Where it is unset, a local master gets a temporary folder and any other master a folder in the warehouse.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        local = spark.sparkContext.master.split("[")[0] == "local"
        base = tempfile.mkdtemp(prefix="lexmatch-") if local else spark.conf.get("spark.sql.warehouse.dir") + "/_lexmatch"
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, with as many underscores before each as it takes not to clash with df's columns, whatever their case."""
    taken, out = {x.lower() for x in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def few(df: DataFrame, rows: int | None) -> DataFrame:
    """df in as few partitions as `rows` rows at most need, or as it is where no bound is known.

    Each file costs its own work in a store; on a local disk Hadoop starts processes for it, to set its mode.
    """
    return df if rows is None else df.coalesce(max(1, -(-rows // FILE_ROWS)))


def materialize(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """Writes df once as Parquet in the shared folder and reads it back.

    What is read later no longer depends on the executors that made it, and a costly plan runs once.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lexmatch-{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def discard(spark: SparkSession, path: str) -> None:
    """Deletes a folder that materialize() wrote."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
