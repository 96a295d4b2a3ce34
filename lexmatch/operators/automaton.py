"""The minimal acyclic automaton of a dictionary, derived by set operations.

A trie node is a prefix; its right language is the set of what may follow it. Nodes with equal right languages are one state. A set
is told by the number of its strings and two independent 64-bit sums of their hashes, which add up piece by piece: no node, not
even the root, whose language is the whole dictionary, ever has its strings gathered. A state is named by its shortest, then first, prefix.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmatch.functions.distance import floor_log2

ROOT = ""


def prefixes(dictionary: DataFrame) -> DataFrame:
    """(term, freq, pos, prefix, suffix): a row for each cut of each term, before the first letter and after the last too."""
    cuts = F.explode(F.sequence(F.lit(0), F.length("term"))).alias("pos")
    rows = dictionary.where("term is not null and term <> ''").select("term", "freq", cuts)
    return rows.select("term", "freq", "pos", F.substring("term", F.lit(1), F.col("pos")).alias("prefix"), F.substring(F.col("term"), F.col("pos") + 1, F.length("term")).alias("suffix"))


def trie(dictionary: DataFrame) -> DataFrame:
    """(prefix, language, is_terminal, reachable, weight): one row per trie node; weight is the frequency of all words through it."""
    sets = [F.count("*").alias("reachable"), F.bit_xor(F.xxhash64("suffix")).alias("x"), F.bit_xor(F.xxhash64("suffix", F.lit("second"))).alias("y")]
    rows = prefixes(dictionary).groupBy("prefix").agg(*sets, F.max(F.col("suffix") == "").alias("is_terminal"), F.sum("freq").cast("bigint").alias("weight"))
    return rows.select("prefix", F.struct("reachable", "x", "y").alias("language"), "is_terminal", "reachable", "weight")


class Automaton:
    """States and edges of a dictionary (unique terms). Frames are computed on demand and kept in `keep`'s form between uses."""

    def __init__(self, dictionary: DataFrame, keep=lambda df, label: df) -> None:
        self.dictionary = dictionary
        self.keep = keep
        self.nodes = keep(trie(dictionary), "trie")
        first = F.min(F.struct(F.length("prefix").alias("n"), "prefix"))
        found = self.nodes.groupBy("language").agg(first.alias("first"), F.max("is_terminal").alias("is_terminal"), F.max("reachable").alias("reachable"), F.max(F.length("prefix")).alias("level"))
        self.states = keep(found.select("language", F.col("first.prefix").alias("state"), "is_terminal", "reachable", "level"), "states")
        self._edges: DataFrame | None = None
        self._scores: DataFrame | None = None

    def members(self) -> DataFrame:
        """(prefix, state) of every trie node."""
        return self.nodes.select("prefix", "language").join(self.states.select("language", "state"), "language").select("prefix", "state")

    def edges(self) -> DataFrame:
        """(src, label, dst, weight): states' edges with the frequency of all words that take them."""
        if self._edges is None:
            child = self.nodes.where(F.length("prefix") > 0).select("language", "weight", F.expr("substring(prefix, 1, length(prefix) - 1)").alias("parent"), F.expr("right(prefix, 1)").alias("label"))
            parent = self.nodes.select(F.col("prefix").alias("parent"), F.col("language").alias("above"))
            sums = child.join(parent, "parent").groupBy("above", "label", "language").agg(F.sum("weight").alias("weight"))
            name = lambda column, to: self.states.select(F.col("language").alias(column), F.col("state").alias(to))
            self._edges = self.keep(sums.join(name("above", "src"), "above").join(name("language", "dst"), "language").select("src", "label", "dst", "weight"), "edges")
        return self._edges

    def stats(self) -> DataFrame:
        """One row: n_trie_nodes, n_states, n_edges, n_terminals."""
        nodes = self.nodes.agg(F.count("*").alias("n_trie_nodes"))
        states = self.states.agg(F.count("*").alias("n_states"), F.sum(F.col("is_terminal").cast("bigint")).alias("n_terminals"))
        edges = self.edges().agg(F.count("*").alias("n_edges"))
        return nodes.crossJoin(states).crossJoin(edges).select("n_trie_nodes", "n_states", "n_edges", F.coalesce("n_terminals", F.lit(0)).alias("n_terminals"))  # one row each

    def scores(self) -> DataFrame:
        """(state, own_score, score): the log-popularity of words that end in a state, and that of all paths on from it.

        A merged state's own score adds up those of all its words. A state's score adds the own scores at the ends of the words
        that pass its naming prefix.
        """
        if self._scores is None:
            state = self.states.select("language", "state")
            last = self.nodes.where("is_terminal").select(F.col("prefix").alias("term"), "language").join(state, "language")
            ends = self.keep(self.dictionary.select("term", floor_log2("freq").alias("s")).join(last, "term").select("term", "state", "s"), "ends")
            own = self.keep(ends.groupBy("state").agg(F.sum("s").alias("own_score")), "own")
            word = ends.join(own, "state").select("term", F.col("own_score").alias("freq"))
            total = prefixes(word).groupBy(F.col("prefix").alias("state")).agg(F.sum("freq").cast("bigint").alias("score"))
            found = self.states.select("state").join(own, "state", "left").join(total, "state", "left")
            self._scores = self.keep(found.select("state", F.coalesce("own_score", F.lit(0)).cast("bigint").alias("own_score"), F.coalesce("score", F.lit(0)).cast("bigint").alias("score")), "scores")
        return self._scores
