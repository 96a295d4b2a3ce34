"""Lookups of words that arrive in a stream, and running frequencies of them.

The dictionary's variants are a static table, so each batch of the stream is an equi-join with it and no state is kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmatch.functions import distance
from lexmatch.operators.fuzzy import variants


def stream_lookup(queries: DataFrame, dictionary: DataFrame, k: int, key: str = "query") -> DataFrame:
    """queries (a stream with column `key` and others) with term, freq and distance for each term within k edits; append mode.

    A term that several variants lead to is verified for the first of them alone: the join's variant is the least common one.
    """
    words = dictionary.where("term is not null").select("term", "freq")
    if k == 0:
        return queries.join(words.withColumnRenamed("term", key), key).withColumn("term", F.col(key)).withColumn("distance", F.lit(0))
    left = variants(queries.where(F.col(key).isNotNull()).withColumn("_word", F.col(key)), "_word", k)
    near = left.join(variants(words, "term", k), "key")
    hashes = lambda c: F.transform(distance.deletions(F.substring(F.col(c), 1, 2 * k + 3), k), lambda x: F.xxhash64(x))
    first = F.array_min(F.array_intersect(hashes("_word"), hashes("term")))
    once = near.where(F.col("key") == first).drop("key", "_word")
    return once.withColumn("distance", distance.within(key, "term", k)).where("distance is not null")


def stream_dictionary(texts: DataFrame, column: str = "text") -> DataFrame:
    """Running dictionary (term, freq) of a stream of texts; complete or update mode."""
    from lexmatch.sources import corpus

    return corpus.dictionary(texts, column)


def windowed_counts(events: DataFrame, word: str, time: str, late: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """(window, term, n) of words in a stream by event time; append mode, words later than `late` behind the newest are left out."""
    return events.withWatermark(time, late).groupBy(F.window(time, width), F.col(word).alias("term")).agg(F.count("*").alias("n"))
