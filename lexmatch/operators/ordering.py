"""Orders over the automaton: sibling rank, topological ids, the word bijection, and the compressed-row form."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexmatch.operators.automaton import ROOT, Automaton, prefixes
from lexmatch.plans.stages import ranked, written


def child_order(automaton: Automaton) -> DataFrame:
    """(src, label, dst, sibling): edges with the 0-based place of each among its siblings, by falling score of the target, then label."""
    scored = automaton.edges().join(automaton.scores().select(F.col("state").alias("dst"), "score"), "dst")
    place = F.row_number().over(Window.partitionBy("src").orderBy(F.desc("score"), "label")) - 1  # a state has at most one edge per letter
    return scored.select("src", "label", "dst", place.cast("bigint").alias("sibling"))


def word_index(dictionary: DataFrame, automaton: Automaton | None = None) -> DataFrame:
    """(term, freq, idx): a word's rank among all in depth-first order with children by falling score, words before their extensions.

    Before a word come its own beginnings that are words, and all words through the earlier siblings of each node on its path: those are
    numbers that trie nodes hold, so a word's rank is a sum over its prefixes and words are never sorted.
    """
    automaton = automaton or Automaton(dictionary, keep=written)
    state = automaton.states.select("language", "state").join(automaton.scores().select("state", "score"), "state").select("language", "score")
    nodes = automaton.nodes.where("prefix <> ''").select("prefix", "language", "is_terminal", "reachable").join(state, "language")
    # a node has at most one child per letter
    earlier = Window.partitionBy("parent").orderBy(F.desc("score"), "label").rowsBetween(Window.unboundedPreceding, -1)
    nodes = nodes.select("prefix", "is_terminal", "reachable", "score", F.expr("substring(prefix, 1, length(prefix) - 1)").alias("parent"), F.expr("right(prefix, 1)").alias("label"))
    nodes = nodes.select("prefix", "is_terminal", F.coalesce(F.sum("reachable").over(earlier), F.lit(0)).alias("before"))
    steps = prefixes(dictionary).where("pos > 0").select("term", "freq", "prefix").join(nodes, "prefix")
    before = F.col("before") + (F.col("is_terminal") & (F.col("prefix") != F.col("term"))).cast("bigint")
    return written(steps.groupBy("term").agg(F.max("freq").alias("freq"), F.sum(before).cast("bigint").alias("idx")), "ranks")


#: Steps between levels, some tens of bytes each, up to which their order is found in one task; beyond, level by level over all tasks.
ONE_TASK = 1_000_000


def topological(automaton: Automaton, every: int = 6, one_task: int = ONE_TASK) -> DataFrame:
    """(state, level, order_id): ids of a breadth-first topological order, root 0, children visited by label.

    A state's level is its longest path from the root. Within a level, states follow their last visited parent, and under one
    parent the label. That is settled level by level: a state's key is the greatest key of its parents one level up, and the
    least label from there. A graph whose steps are counted to be at most `one_task` is ordered in one task. For a larger one a loop of
    joins runs once per letter of the longest word; every few rounds the keys so far are written. Both give the same ids.
    """
    levels = automaton.states.select("state", "level")
    steps = automaton.edges().join(levels.select(F.col("state").alias("src"), F.col("level").alias("up")), "src").join(levels.select(F.col("state").alias("dst"), "level"), "dst")
    steps = written(steps.where("up = level - 1").select("src", "label", "dst", "level"), "steps")
    if steps.limit(one_task + 1).count() <= one_task:
        return steps.withColumn("graph", F.lit(0)).groupBy("graph").applyInPandas(_ordered, "state string, level int, order_id bigint")
    depth = levels.agg(F.max("level").alias("m")).first()["m"] or 0
    now = automaton.states.where(F.col("state") == ROOT).select("state", F.lit("").alias("key"))
    found, recent = None, now.withColumn("level", F.lit(0))
    for level in range(1, depth + 1):
        near = steps.where(F.col("level") == level).join(now.withColumnRenamed("state", "src"), "src")
        last = F.max(F.struct("key", (-F.ascii("label")).alias("less"), "label"))
        now = near.groupBy(F.col("dst").alias("state")).agg(last.alias("last")).select("state", F.concat("last.key", "last.label").alias("key"))
        recent = recent.unionByName(now.withColumn("level", F.lit(level)))
        if level % every == 0 or level == depth:
            recent = written(recent, "keys")
            found = recent if found is None else found.unionByName(recent)
            now = recent.where(F.col("level") == level).select("state", "key")
            recent = recent.where("false")
    found = recent if found is None else found
    return ranked(found.select("state", "level", "key"), ["level", "key"], "order_id").select("state", "level", "order_id")


def _ordered(steps: pd.DataFrame) -> pd.DataFrame:
    """topological() of one table of steps. A state's place in its level stands for its key."""
    names, places = [pd.DataFrame({"state": [ROOT], "level": [0]})], pd.Series([0], index=[ROOT])
    for level, near in steps.groupby("level", sort=True):
        near = near.assign(parent=places.reindex(near["src"]).to_numpy(), letter=near["label"].map(ord))
        last = near.sort_values(["parent", "letter"], ascending=[False, True]).drop_duplicates("dst").sort_values(["parent", "letter"])
        places = pd.Series(range(len(last)), index=last["dst"].to_numpy())
        names.append(pd.DataFrame({"state": last["dst"].to_numpy(), "level": int(level)}))
    found = pd.concat(names, ignore_index=True)
    return found.assign(order_id=range(len(found)))


class CompressedRows:
    """The automaton as node and edge tables with dense ids, edges of a node next to each other in sibling order."""

    def __init__(self, automaton: Automaton) -> None:
        self.automaton = automaton
        self.order = written(topological(automaton), "order")
        ids = self.order.select("state", "order_id")
        named = child_order(automaton).join(automaton.edges().select("src", "label", "weight"), ["src", "label"])
        named = named.join(ids.select(F.col("state").alias("src"), F.col("order_id").alias("src_order")), "src").join(ids.select(F.col("state").alias("dst"), F.col("order_id").alias("dst_order")), "dst")
        self.edges = written(ranked(named.select("src_order", "sibling", "dst_order", "label", "weight"), ["src_order", "sibling"], "edge_id"), "csr").select("edge_id", "src_order", "dst_order", "label", "weight")

    def nodes(self) -> DataFrame:
        """(order_id, first_edge, degree, reachable, is_terminal); first_edge of a node without edges is that of the next node's."""
        degree = self.edges.groupBy(F.col("src_order").alias("order_id")).agg(F.count("*").alias("degree"))
        base = self.order.join(self.automaton.states.select("state", "reachable", "is_terminal"), "state").join(degree, "order_id", "left")
        known = base.select("order_id", F.coalesce("degree", F.lit(0)).alias("degree"), "reachable", "is_terminal")
        return running(known, "order_id", "degree", "first_edge").select("order_id", "first_edge", "degree", "reachable", "is_terminal")


def running(df: DataFrame, order: str, value: str, name: str) -> DataFrame:
    """df with the sum of `value` over all rows before, in `order`, as `name`. Sums within range partitions, shifted by those before."""
    placed = written(df.repartitionByRange(order).sortWithinPartitions(order).withColumn("_part", F.spark_partition_id()), "running")
    parts = placed.groupBy("_part").agg(F.sum(value).alias("n")).collect()  # as many rows as partitions
    before, total = {}, 0
    for row in sorted(parts):
        before[row["_part"]] = total
        total += row["n"]
    shift = F.element_at(F.create_map(*[F.lit(x) for pair in before.items() for x in pair]), F.col("_part")) if before else F.lit(0)
    own = F.coalesce(F.sum(value).over(Window.partitionBy("_part").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return placed.withColumn(name, (own + shift).cast("bigint")).drop("_part")


def delta_offsets(nodes: DataFrame) -> DataFrame:
    """(order_id, first_edge, delta): offsets as differences from the node before, as the file format stores them; running() undoes it.

    Ids are dense, so the node before is found by its id and no window over all rows is needed.
    """
    before = nodes.select((F.col("order_id") + 1).alias("order_id"), F.col("first_edge").alias("before"))
    return nodes.join(before, "order_id", "left").select("order_id", "first_edge", (F.col("first_edge") - F.coalesce("before", F.lit(0))).alias("delta"))
