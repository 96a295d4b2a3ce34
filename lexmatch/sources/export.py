"""JSON of graphs for drawing: nodes with x = y = id, and links between them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def d3_nodes(nodes: DataFrame, id_col: str = "order_id") -> DataFrame:
    """(json): one object per node."""
    return nodes.select(F.to_json(F.struct(F.col(id_col).cast("bigint").alias("x"), F.col(id_col).cast("bigint").alias("y"))).alias("json"))


def d3_links(edges: DataFrame, src: str = "src_order", dst: str = "dst_order") -> DataFrame:
    """(json): one object per linked pair of nodes, parallel edges once."""
    pairs = edges.select(F.col(src).cast("bigint").alias("source"), F.col(dst).cast("bigint").alias("target")).distinct()
    return pairs.select(F.to_json(F.struct("source", "target")).alias("json"))


def write_d3(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Writes both as JSON lines in path/nodes and path/links; a viewer wraps them in one object."""
    d3_nodes(nodes).withColumnRenamed("json", "value").write.mode("overwrite").text(f"{path}/nodes")
    d3_links(edges).withColumnRenamed("json", "value").write.mode("overwrite").text(f"{path}/links")
