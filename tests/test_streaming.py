from pyspark.sql import functions as F

from lexmatch.operators import fuzzy
from lexmatch.sources import corpus
from lexmatch.streaming import lookup


def drained(df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).start()
    q.processAllAvailable()
    q.stop()
    return df.sparkSession.table(name)


def test_stream_equals_batch(spark, tmp_path):
    words = corpus.word_list(spark, ["cat", "cart", "dog", "act", "catalogue"], 3)
    queries = ["cat", "dgo", "catalog", "caet", "cat"]
    spark.createDataFrame([(w,) for w in queries], "query string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("query string").parquet(str(tmp_path / "in"))
    for k in (0, 1, 2):
        got = sorted(map(tuple, drained(lookup.stream_lookup(stream, words, k), f"found{k}").select("query", "term", "freq", "distance").collect()))
        want = fuzzy.lookup(spark.createDataFrame([(w,) for w in set(queries)], "query string"), words, k).collect()
        assert got == sorted(x for row in map(tuple, want) for x in [row] * queries.count(row[0]))


def test_running_dictionary_and_windows(spark, tmp_path):
    rows = [("a b a", "2024-01-01 00:00:00"), ("b", "2024-01-01 00:04:00"), ("a", "2024-01-01 00:30:00")]
    spark.createDataFrame(rows, "text string, at string").select("text", F.to_timestamp("at").alias("ts")).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("text string, ts timestamp").parquet(str(tmp_path / "in"))
    assert {tuple(x) for x in drained(lookup.stream_dictionary(stream), "running", "complete").collect()} == {("a", 3), ("b", 2)}
    counts = drained(lookup.windowed_counts(stream, "text", "ts"), "windows")
    assert {(x["term"], x["n"]) for x in counts.collect()} <= {("a b a", 1), ("b", 1), ("a", 1)}
