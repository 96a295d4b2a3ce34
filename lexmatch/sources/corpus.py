"""Dictionaries and query workloads from text."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DICTIONARY = "term string, freq bigint"
WORKLOAD = "noisy string, clean string, distance int"


def corpus_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """dictionary(term, freq) of lines "term count". Lines of another form, and counts that aren't whole numbers from 0 on, are passed over."""
    parts = F.split(F.col(column), " ", -1)
    count = F.get(parts, F.lit(1))
    kept = lines.where((F.size(parts) == 2) & count.rlike("^[0-9]{1,19}$"))
    return kept.select(F.get(parts, F.lit(0)).alias("term"), F.expr("try_cast({} as bigint)".format(f"split(`{column}`, ' ', -1)[1]")).alias("freq")).where("freq is not null")


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    return corpus_lines(spark.read.text(path))


def workload_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """queries(noisy, clean, distance) of lines of three tokens parted by white space, the last a whole number; others are passed over."""
    parts = F.split(F.col(column), r"\s")
    kept = lines.where((F.size(parts) == 3) & F.get(parts, F.lit(2)).rlike("^[0-9]{1,9}$"))
    return kept.select(F.get(parts, F.lit(0)).alias("noisy"), F.get(parts, F.lit(1)).alias("clean"), F.get(parts, F.lit(2)).cast("int").alias("distance"))


def read_workload(spark: SparkSession, path: str) -> DataFrame:
    return workload_lines(spark.read.text(path))


def word_list(spark: SparkSession, words: list[str], freq: int = 0) -> DataFrame:
    return spark.createDataFrame([(w, freq) for w in words], DICTIONARY)


def words(table: DataFrame, column: str = "text") -> DataFrame:
    """Every word of a text column as `term`: runs of ASCII letters in lower case. Null texts have none."""
    parts = table.select(F.explode(F.split(F.col(column), "[^A-Za-z]+")).alias("word"))
    return parts.where("word <> ''").select(F.lower("word").alias("term"))


#: Bytes of a text that are cut into words at once, and words that are counted before their counts move on.
PIECE, COUNTED = 1 << 20, 1 << 18
_LETTERS = bytes(i + 32 if 65 <= i <= 90 else i if 97 <= i <= 122 else 32 for i in range(256))


def dictionary(table: DataFrame, column: str = "text") -> DataFrame:
    """dictionary(term, freq) of a text column's words, as words() gives them. They are counted where texts are read, so no row of each word moves."""

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter[bytes] = Counter()
        for batch in batches:
            for text in batch.column(0):
                # letters in lower case, all else a space: every byte of a letter beyond ASCII has its top bit set
                data, at = b"" if text.as_py() is None else text.as_py().translate(_LETTERS), 0
                while at < len(data):
                    end = data.find(b" ", at + PIECE)
                    end = len(data) if end < 0 else end
                    found.update(data[at:end].split())
                    at = end
                    if len(found) >= COUNTED:
                        yield _entries(found)
                        found.clear()
        yield _entries(found)

    made = table.select(F.col(column).cast("string").cast("binary").alias("text")).mapInArrow(counts, DICTIONARY)
    return made.groupBy("term").agg(F.sum("freq").alias("freq"))


def _entries(counts: Counter[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([*counts], pa.binary()).cast(pa.string()), pa.array([*counts.values()], pa.int64())], ["term", "freq"])


def merged(entries: DataFrame) -> DataFrame:
    """A dictionary from entries in any order: frequencies of repeated terms are added; null and empty terms, and null counts, drop out."""
    return entries.where("term <> '' and freq is not null").groupBy("term").agg(F.sum("freq").cast("bigint").alias("freq"))


def order_violations(lists: DataFrame) -> DataFrame:
    """Rows of lists (list_id, pos, term) whose term isn't above its list's previous one, with that as `previous`; an empty term never is."""
    from pyspark.sql import Window

    before = F.lag("term").over(Window.partitionBy("list_id").orderBy("pos"))
    return lists.withColumn("previous", before).where("term <= previous or term = ''")


def noisy(term: Column | str) -> Column:
    """A term with one made mistake, by its length modulo 4: its first two letters swapped, the second dropped, doubled, or the first replaced."""
    t = F.col(term) if isinstance(term, str) else term
    head, second, rest = t.substr(1, 1), t.substr(2, 1), F.substring(t, F.lit(3), F.length(t))
    kind = F.length(t) % 4
    return F.when(kind == 0, F.concat(second, head, rest)).when(kind == 1, F.concat(head, rest)).when(kind == 2, F.concat(head, second, second, rest)).otherwise(F.concat(F.lit("x"), second, rest))
