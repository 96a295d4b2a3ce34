"""Lookups of query words in a dictionary: exact, and within k edits under the OSA distance.

A lookup of many words is a similarity join. The planner picks how candidates are found; all of them are verified exactly:

exact      k = 0: an equi-join.
pairs      for a workload of up to FEW_QUERIES words, which is counted first: it is sent to the dictionary's tasks and met there by
           length, and the counts of letters, 128 bits to a word, rule out nearly all that is left before a distance is computed. Both are
           done for whole arrays of words (lexmatch.functions.batches). The dictionary is read once.
deletions  for larger workloads. Every edit takes at most one letter from either side, so words within k edits share a string left by at most k deletions
           from each: an equi-join on hashes of such strings. Up to FEW_KEYS of a workload's are sent to the dictionary's tasks. For longer words only a prefix of 2k + 3 letters is used, which loses nothing, as
           edits that lie beyond it leave it as it is and those within it cost no more there.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmatch.functions import batches, distance

FEW_QUERIES = 5_000
#: Keys of a workload that every task may hold, some 12 bytes each.
FEW_KEYS = 4_000_000
_NAMES = ["query", "term", "freq", "distance"]


def exact(queries: DataFrame, dictionary: DataFrame) -> DataFrame:
    """(query, term, freq, distance) for queries that are terms."""
    found = queries.join(dictionary.withColumnRenamed("term", "query"), "query")
    return found.select("query", F.col("query").alias("term"), "freq", F.lit(0).alias("distance"))


def _prefix(word: Column, k: int) -> Column:
    return F.substring(word, 1, 2 * k + 3)


def variants(words: DataFrame, column: str, k: int) -> DataFrame:
    """words with one row per key: the hash of a string left by at most k deletions from the word's prefix. Keys that collide only add candidates."""
    return words.withColumn("key", F.explode(F.transform(distance.deletions(_prefix(F.col(column), k), k), lambda x: F.xxhash64(x))))


def _keyed(words: DataFrame, column: str, k: int) -> DataFrame:
    """words with one row per key of batches.keys(). An Arrow pass, through which no filter moves into what made the words."""

    def make(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            for own, key in batches.keys(batches.Words(batch[column].to_pylist()), k):
                rows = batch.take(pa.array(own))
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(key.view(np.int64))], [*rows.schema.names, "key"])

    return words.mapInArrow(make, ", ".join(f"{name} {kind}" for name, kind in words.dtypes) + ", key bigint")


def _by_deletions(queries: DataFrame, dictionary: DataFrame, k: int) -> DataFrame:
    """(query, term, freq), each once, among them all pairs within k edits."""
    near = _keyed(dictionary, "term", k).join(_keyed(queries, "query", k), "key")
    # the bound is checked where pairs meet, so that only those within it, few and mostly results, move to become distinct
    return near.where((F.abs(F.length("query") - F.length("term")) <= k) & (_plain(k) <= 2 * k)).select("query", "term", "freq").distinct()


def _met(words: list[str], dictionary: DataFrame, k: int, by_keys: bool) -> DataFrame:
    """(query, term, freq, distance) for the words of a workload that was counted: each task gets them all and a part of the dictionary."""
    # few bytes but much work: spread over all tasks, where adaptive execution would put a small dictionary into one
    spread = dictionary.select("term", "freq").repartition(int(dictionary.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def match(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, asked = batches.Words(words), pa.array(words, pa.string())
        of = batches.Keys(wanted, k).near if by_keys else lambda terms: batches.near(wanted, terms, k)
        for held in _gathered(found):
            for q, t, distance in of(batches.Words(held["term"].to_pylist())):
                yield pa.RecordBatch.from_arrays([asked.take(pa.array(q)), held["term"].take(pa.array(t)), held["freq"].take(pa.array(t)), pa.array(distance, pa.int32())], _NAMES)

    return spread.mapInArrow(match, f"query string, term string, freq {dict(dictionary.dtypes)['freq']}, distance int")


def _gathered(found: Iterator[pa.RecordBatch], rows: int = 1 << 16, size: int = 32 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in fewer batches."""
    held: list[pa.RecordBatch] = []
    for batch in found:
        held.append(batch)
        if sum(x.num_rows for x in held) >= rows or sum(x.nbytes for x in held) >= size:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held = []
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def _measured(near: DataFrame, k: int) -> DataFrame:
    """(query, term, freq, distance) of the pairs (query, term, freq) within k edits."""

    def measure(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            asked = batch["query"].dictionary_encode()
            distance = batches.osa(batches.Words(asked.dictionary.to_pylist()), batches.Words(batch["term"].to_pylist()), asked.indices.to_numpy(), np.arange(batch.num_rows))
            made = pa.RecordBatch.from_arrays([batch["query"], batch["term"], batch["freq"], pa.array(distance, pa.int32())], _NAMES)
            yield made.filter(pa.array(distance <= k))

    return near.select("query", "term", "freq").mapInArrow(measure, f"query string, term string, freq {dict(near.dtypes)['freq']}, distance int")


def _plain(k: int) -> Column:
    """The Levenshtein distance of query and term, a very large number beyond 2k. It stands once in a condition, which is then computed last."""
    return F.levenshtein("query", "term", 2 * k).bitwiseAND(0x7FFFFFFF)


def lookup(queries: DataFrame, dictionary: DataFrame, k: int, strategy: str = "auto") -> DataFrame:
    """(query, term, freq, distance): every term within k edits of every query. Null queries match nothing; a repeated query counts once.

    The empty query matches all terms of at most k letters. strategy: auto, deletions or pairs, which refuses a large workload.
    """
    if k < 0 or strategy not in ("auto", "deletions", "pairs"):
        raise ValueError(f"k {k} or strategy {strategy} is unknown")
    queries = queries.where("query is not null").select("query").distinct()
    dictionary = dictionary.where("term is not null").select("term", "freq")
    if k == 0:
        return exact(queries, dictionary)
    few = FEW_QUERIES if strategy != "deletions" else FEW_KEYS // sum(math.comb(batches.prefix(k), i) for i in range(k + 1))
    words = [x["query"] for x in queries.limit(few + 1).collect()]
    if len(words) <= few:
        return _met(words, dictionary, k, by_keys=strategy == "deletions")
    if strategy == "pairs":
        raise ValueError(f"over {FEW_QUERIES} queries; use deletions")
    return _measured(_by_deletions(queries, dictionary, k), k)


class FuzzyDictionary:
    """A dictionary (term, freq) for many lookups, kept in memory and on disk until close(); with persist=False as the caller keeps it."""

    def __init__(self, dictionary: DataFrame, persist: bool = True) -> None:
        self.frame = dictionary.select("term", F.col("freq").cast("bigint").alias("freq"))
        self._persist = persist
        if persist:
            self.frame.persist(StorageLevel.MEMORY_AND_DISK)
        self._ranks: DataFrame | None = None

    def __enter__(self) -> FuzzyDictionary:
        return self

    def __exit__(self, *_: object) -> None:
        self.close()

    @property
    def word_count(self) -> int:
        return self.frame.count()

    def lookup(self, queries: DataFrame | str, k: int = 0, strategy: str = "auto") -> DataFrame:
        """Terms within k edits of a word, or of each row of queries (query)."""
        if isinstance(queries, str):
            queries = self.frame.sparkSession.createDataFrame([(queries,)], "query string")
        return lookup(queries, self.frame, k, strategy)

    def matched(self, queries: DataFrame, k: int = 0) -> DataFrame:
        """Queries with a term within k edits."""
        return queries.join(self.lookup(queries, k).select("query").distinct(), "query", "left_semi")

    def unmatched(self, queries: DataFrame, k: int = 0) -> DataFrame:
        """Queries without one."""
        return queries.join(self.lookup(queries, k).select("query").distinct(), "query", "left_anti")

    def totals(self, queries: DataFrame, ks: tuple[int, ...] = (0, 1, 2, 3)) -> DataFrame:
        """(k, total): results of all queries for each k. One lookup at the largest k gives them all."""
        found = self.lookup(queries, max(ks)).groupBy("distance").agg(F.count("*").alias("n"))
        wanted = self.frame.sparkSession.createDataFrame([(k,) for k in ks], "k int")
        return wanted.join(F.broadcast(found), F.col("distance") <= F.col("k"), "left").groupBy("k").agg(F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("total"))

    def report(self, queries: DataFrame, word: str, ks: tuple[int, ...] = (0, 1, 2, 3)) -> DataFrame:
        """(part, k, term, n): a row "total" with the results of all queries for each k, and a row "term" with the frequency of each term within the largest k of word."""
        totals = self.totals(queries, ks).select(F.lit("total").alias("part"), "k", F.lit(None).cast("string").alias("term"), F.col("total").alias("n"))
        terms = self.lookup(word, max(ks)).select(F.lit("term").alias("part"), F.lit(max(ks)).alias("k"), "term", F.col("freq").alias("n"))
        return totals.unionByName(terms)

    def best(self, queries: DataFrame, k: int = 2) -> DataFrame:
        """The nearest term of each query, the most frequent of the nearest, the first by letters of those."""
        pick = F.min(F.struct("distance", (-F.col("freq")).alias("less"), "term"))
        found = self.lookup(queries, k).groupBy("query").agg(pick.alias("best"))
        return found.select("query", F.col("best.term").alias("term"), (-F.col("best.less")).alias("freq"), F.col("best.distance").alias("distance"))

    def ranks(self) -> DataFrame:
        """(term, freq, idx): the bijection between words and 0..n-1."""
        from lexmatch.operators import ordering

        if self._ranks is None:
            self._ranks = ordering.word_index(self.frame)
            if self._persist:
                self._ranks.persist(StorageLevel.MEMORY_AND_DISK)
        return self._ranks

    def get_index(self, words: DataFrame) -> DataFrame:
        """words (query) with idx, -1 for what isn't a term."""
        found = words.join(self.ranks().select(F.col("term").alias("query"), "idx"), "query", "left")
        return found.withColumn("idx", F.coalesce("idx", F.lit(-1)))

    def get_word(self, indexes: DataFrame) -> DataFrame:
        """indexes (idx) with term; an index out of range has none and no row."""
        return indexes.join(self.ranks().select("idx", "term"), "idx")

    def close(self) -> None:
        """Frees what was kept; a second call does nothing."""
        if self._persist:
            self.frame.unpersist()
            if self._ranks is not None:
                self._ranks.unpersist()
