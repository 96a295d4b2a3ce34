"""Cutting a plan into stages that survive lost executors, and ranking rows without a single-task window."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; where it is unset, as in tests on a local master, a temporary folder."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        local = spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local"
        found = tempfile.mkdtemp(prefix="lexmatch-") if local else f"{spark.conf.get('spark.sql.warehouse.dir')}/_stages"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


#: A table of fewer bytes than this is dealt out before costly work on each row, if few tasks read it.
SMALL = 1 << 30


def spread(df: DataFrame) -> DataFrame:
    """df as it is, or dealt out to all cores if it is a small table that fewer tasks would read, as one file with one row group is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size < SMALL and cores > 1 and len(df.inputFiles()) < cores else df


def written(df: DataFrame, label: str) -> DataFrame:
    """df as a Parquet table in the shared folder: computed once, and no longer tied to the executors that made it."""
    path = f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    found = df.sparkSession.read.schema(df.schema).parquet(path)
    found._written_to = path
    return found


def dropped(*tables: DataFrame | None) -> None:
    """Deletes the files of tables that written() gave, once nothing reads them any more."""
    for df in tables:
        path = getattr(df, "_written_to", None)
        if path:
            at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


def ranked(df: DataFrame, order: list[Column | str], name: str) -> DataFrame:
    """df with its 0-based rank in the total order as column `name`.

    Rows are range-partitioned and sorted, numbered within each partition, and shifted by the counts of the partitions before: one row
    per partition is all that meets in one place.
    """
    low = (1 << 33) - 1  # monotonically_increasing_id holds the partition above 33 bits of row number
    placed = written(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), "ranked")
    parts = placed.groupBy(F.shiftright("_at", 33).alias("_part")).agg(F.count("*").alias("n")).collect()  # as many rows as partitions
    before, total = {}, 0
    for row in sorted(parts):
        before[row["_part"]] = total
        total += row["n"]
    shift = F.element_at(F.create_map(*[F.lit(x) for pair in before.items() for x in pair]), F.shiftright("_at", 33)) if before else F.lit(0)
    return placed.withColumn(name, (shift + F.col("_at").bitwiseAND(low)).cast("long")).drop("_at")
