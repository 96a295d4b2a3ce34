"""Sharding by extendible hashing, in DataFrame functions only.

A record's address is a string of bits: 60 of its id's hash, then 60 of its text's, then 60 of its place in the table. The directory
starts as one bucket; a bucket whose records exceed the byte limit splits on the next bit, and only such buckets do, until every one
fits or is a single record. That end state doesn't depend on the order of splits: a bucket is the shortest prefix whose records fit.
So the directory is computed from sums: bytes are added up for prefixes of about four bits more than an even spread would need,
then for shorter ones as long as any fit. Only buckets that still don't fit - a third of all rows may share one id - go on to further bits, with
the sums of their own records alone. Nothing is gathered on the driver but the total.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmatch.llm import _common

LIMIT, BITS, EXTRA, OVERHEAD = 1 << 20, 60, 4, 8
LEVELS = 6  #: bits that one pass over the sums goes up


def _bits(value: Column) -> Column:
    """The first 60 bits of a string's MD5, as a long."""
    return F.conv(F.substring(F.md5(F.coalesce(value.cast("string"), F.lit("null"))), 1, BITS // 4), 16, 10).cast("long")


def _depths(rows: DataFrame, width: int, limit: int) -> DataFrame:
    """(g, v, depth): for each cell v of `width` bits under the address g, the least number of its bits that makes a bucket fit; null if none does.

    Sums go upward from the cells, LEVELS bits at a time. A prefix that doesn't fit has no shorter one that does, so this ends at the first
    block of levels whose top fits nowhere, a few bits above an even spread's depth; a cell is a row for each level looked at, not for each bit.
    """
    cells, _ = _common.materialize(rows.groupBy("g", "v").agg(F.sum("n_bytes").alias("n"), F.count("*").alias("rows")), "cells")
    now, low, first, fits = cells.withColumnRenamed("v", "p"), width, width, None
    while True:
        top = max(0, low - LEVELS)
        steps = now.select("g", "n", "rows", "p", F.explode(F.sequence(F.lit(top), F.lit(first))).alias("d")).withColumn("p", F.expr(f"shiftright(p, {low} - d)"))
        sums, _ = _common.materialize(steps.groupBy("g", "d", "p").agg(F.sum("n").alias("n"), F.sum("rows").alias("rows")), "sums")
        fitting = sums.where((F.col("n") <= limit) | (F.col("rows") <= 1)).select("g", "d", "p")
        fits = fitting if fits is None else fits.unionByName(fitting)
        if not top or fitting.where(F.col("d") == top).isEmpty():
            break
        now, low, first = sums.where(F.col("d") == top).drop("d"), top, top - 1
    steps = cells.select("g", "v", F.explode(F.sequence(F.lit(top), F.lit(width))).alias("d")).withColumn("p", F.expr(f"shiftright(v, {width} - d)"))
    found = steps.join(fits.withColumn("fits", F.lit(True)), ["g", "d", "p"], "left")
    return found.groupBy("g", "v").agg(F.min(F.when(F.col("fits"), F.col("d"))).alias("depth"))


def assign(docs: DataFrame, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text", keep: bool = False) -> DataFrame:
    """One row per row of docs: doc_id, n_bytes (of the text's UTF-8, and 8 for the id), shard (its bucket's bits) and depth (how many).

    keep adds the input's columns as c0, c1, ... Null ids and texts are records like others; a text over the limit is alone in its
    shard. Rows that agree in id and text are told apart by their place in the table, which is written first and stays the same.
    An empty table gives no rows.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    kept = [F.col(f"`{x}`").alias(f"c{i}") for i, x in enumerate(docs.columns)] if keep else []
    held = docs.select(F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(text) + OVERHEAD).cast("long").alias("n_bytes"), _bits(F.col(id_col)).alias("h0"), _bits(text).alias("h1"), F.monotonically_increasing_id().alias("row"), *kept)
    held, _ = _common.materialize(held, "records")
    total = held.agg(F.sum("n_bytes").alias("n")).first()["n"] or 0
    first = min(BITS, max(1, math.ceil(math.log2(max(1, total / limit)))) + EXTRA)
    out, columns = None, ["doc_id", "n_bytes", *[f"c{i}" for i in range(len(kept))]]
    left = held.withColumn("h2", _bits(F.col("row"))).withColumn("g", F.lit(""))
    for name in ("h0", "h1", "h2"):
        for value, width in ((F.shiftright(name, BITS - first), first), (F.col(name).bitwiseAND((1 << BITS - first) - 1), BITS - first)):
            if not width:
                continue
            rows = left.withColumn("v", value)
            made, _ = _common.materialize(rows.join(_common.materialize(_depths(rows, width, limit), "depths")[0], ["g", "v"]), "buckets")
            done = made.where("depth is not null").select(*columns, F.concat("g", F.expr(f"lpad(bin(shiftright(v, {width} - depth)), depth, '0')")).alias("shard"))
            out = done if out is None else out.unionByName(done)
            left = made.where("depth is null").withColumn("g", F.concat("g", F.expr(f"lpad(bin(v), {width}, '0')"))).drop("v", "depth")
            if left.isEmpty():
                return out.withColumn("depth", F.length("shard").cast("long"))
    raise AssertionError("two rows of one table have one place")


def directory(assigned: DataFrame) -> DataFrame:
    """One row per shard: shard, depth, n_docs, n_bytes."""
    return assigned.groupBy("shard", "depth").agg(F.count("*").alias("n_docs"), F.sum("n_bytes").alias("n_bytes"))


def write(docs: DataFrame, path: str, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Writes docs as Parquet with a folder for each shard; a task writes whole shards, each within the limit."""
    rows = assign(docs, limit, id_col, text_col, keep=True)
    named = rows.select(*[F.col(f"c{i}").alias(x) for i, x in enumerate(docs.columns)], F.concat(F.lit("b"), "shard").alias("_shard"))
    named.repartition("_shard").write.partitionBy("_shard").parquet(path)


def oracle() -> str:
    """op10's rows in DuckDB's SQL, for tables whose ids are unique."""
    return f"""
with d as (select doc_id, strlen(coalesce(text, '')) + {OVERHEAD} as n, ('0x' || substr(md5(coalesce(doc_id::varchar, 'null')), 1, {BITS // 4}))::bigint as h from documents),
s as (select depth, h >> ({BITS} - depth) as p, sum(n) as n, count(*) as n_rows from d, unnest(range(0, {BITS} + 1)) as t(depth) group by all),
f as (select d.doc_id, d.n, d.h, min(s.depth) as depth from d join s on d.h >> ({BITS} - s.depth) = s.p where s.n <= {LIMIT} or s.n_rows <= 1 group by all)
select doc_id, f.n::bigint as n_bytes, left(lpad(bin(h), {BITS}, '0'), depth::int) as shard, depth::bigint as depth, s.n::bigint as shard_bytes, s.n_rows::bigint as shard_docs
from f join s using (depth) where h >> ({BITS} - depth) = s.p"""
