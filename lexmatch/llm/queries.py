"""One query per operator, with production parameters over whole tables, and their SQL where it can say the same."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmatch.llm import decontaminate, extract, grading, media, packing, secrets, sharding, simhash, simple8b, warc
from lexmatch.llm._common import shared_dir, table


def op1_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.extract(table(spark, sf_dir, "pages"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.find(docs, table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", F.col("_n_words").alias("n_words"), F.col("_n_hit").alias("n_hit"), F.size("_items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "_items"), 256).alias("items_sha256"), F.col("_contaminated").alias("contaminated"))


def op4_grading(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = grading.classify(docs, grading.quality_grade(table(spark, sf_dir, "labels")))
    return found.select("doc_id", F.col("_grade").alias("expected_grade"), F.col("_tail").alias("tail_probability"), F.col("_keep").alias("keep"))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(secrets.scan(table(spark, sf_dir, "documents")))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.cluster(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Derivative records as read back from the files that they were written to; page_id is carried in a header."""
    made = warc.derive(warc.responses(table(spark, sf_dir, "pages")))
    named = made.withColumn("headers", F.map_concat("headers", F.create_map(F.lit("X-Page-ID"), F.coalesce(F.col("key").cast("string"), F.lit("")))))
    warc.write(named, path := f"{shared_dir(spark)}/lexmatch-warc-{uuid.uuid4().hex}")
    found = warc.read(spark, path).withColumn("page_id", F.expr("try_cast(headers['X-Page-ID'] as bigint)"))
    return warc.columns(found).drop("date", "content_type")


def op8_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.documents_as_media(table(spark, sf_dir, "documents"))


def op9_simple8b(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simple8b.digest_ids(spark, simple8b.write_ids(table(spark, sf_dir, "documents")))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sharding.assign(table(spark, sf_dir, "documents"))
    shards = sharding.directory(found).select("shard", F.col("n_bytes").alias("shard_bytes"), F.col("n_docs").alias("shard_docs"))
    return found.join(shards, "shard").select("doc_id", "n_bytes", "shard", "depth", "shard_bytes", "shard_docs")


QUERIES = {
    "op1_extraction": op1_extraction,
    "op2_packing": op2_packing,
    "op3_decontamination": op3_decontamination,
    "op4_grading": op4_grading,
    "op5_secrets": op5_secrets,
    "op6_simhash": op6_simhash,
    "op7_warc": op7_warc,
    "op8_media": op8_media,
    "op9_simple8b": op9_simple8b,
    "op10_sharding": op10_sharding,
}
ORACLES: dict[str, str] = {"op3_decontamination": decontaminate.oracle(), "op5_secrets": secrets.oracle(), "op10_sharding": sharding.oracle()}
