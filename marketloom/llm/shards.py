"""Sharding by extendible hashing: a directory of hash prefixes whose oversized buckets split bit by bit.

A row's hash is the first 60 bits of the md5 of its id and text. All buckets start as one; a
bucket whose bytes are over the limit splits on the next bit, and only such buckets do. Eight bits are settled
a round from the byte sums of 256 cells under each open bucket, so a round costs one aggregate over narrow
rows. Rows of equal hash are repeats of one row and can't split by hash: they are dealt to numbered pages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketloom.settings import cut_lineage

BITS, STEP = 60, 10


def _bits(value: str, depth: str):
    return F.when(F.col(depth) == 0, "").otherwise(F.lpad(F.bin(value), F.col(depth), F.lit("0")))


def hashed(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, n_bytes, hash)``; a null text has no bytes."""
    key = F.md5(F.concat_ws(":", F.coalesce(F.col(doc_id).cast("string"), F.lit("-")), F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary"))).cast("binary"))
    return documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"), F.conv(F.substring(key, 1, BITS // 4), 16, 10).cast("long").alias("hash"))


def assigned(documents: DataFrame, limit: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, n_bytes, shard, depth, page)`` for every row.

    ``shard`` is the prefix as a string of bits, ``depth`` its length. The bytes of a (shard, page)
    are within ``limit``, but for a single row that is larger alone. ``page`` is 0 except among repeats of one
    row that together pass the limit. Empty tables give no rows; other columns are ignored.
    """
    rows = cut_lineage(hashed(documents, doc_id, text).withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()), "hashed")
    live, out = rows, []
    for base in range(0, BITS, STEP):
        depth = base + STEP
        cells = live.groupBy(F.shiftright("hash", BITS - depth).alias("cell")).agg(F.sum("n_bytes").alias("bytes"))
        cells = cut_lineage(cells, "cells")
        levels = cells.select("cell", "bytes", F.explode(F.sequence(F.lit(base), F.lit(depth))).alias("depth"))
        levels = levels.withColumn("prefix", F.expr(f"shiftright(cell, {depth} - depth)"))
        nodes = levels.groupBy("depth", "prefix").agg(F.sum("bytes").alias("bytes")).where(F.col("bytes") <= limit)
        settled = levels.select("cell", "depth", "prefix").join(nodes.select("depth", "prefix"), ["depth", "prefix"]).groupBy("cell").agg(F.min("depth").alias("depth"))
        known = cells.select("cell").join(settled, "cell", "left").withColumnRenamed("cell", "_cell")
        placed = cut_lineage(live.join(known, F.shiftright("hash", BITS - depth) == F.col("_cell")).drop("_cell"), "placed")
        out.append(placed.where("depth is not null").withColumn("page", F.lit(0).cast("long")))
        live = placed.where("depth is null").drop("depth")
        if live.isEmpty():
            break
    else:
        before = Window.partitionBy("hash").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
        counts = live.groupBy("hash", "_part").agg(F.count("*").alias("_n"))
        counts = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
        numbered = live.withColumn("_in", F.row_number().over(Window.partitionBy("hash", "_part").orderBy("_at")) - 1).join(counts, ["hash", "_part"])
        each = F.greatest(F.floor(F.lit(limit) / F.col("n_bytes")), F.lit(1))
        out.append(numbered.withColumn("depth", F.lit(BITS)).withColumn("page", F.floor((F.col("_before") + F.col("_in")) / each)))
    every = out[0].select("doc_id", "n_bytes", "hash", "depth", "page")
    for more in out[1:]:
        every = every.union(more.select("doc_id", "n_bytes", "hash", "depth", "page"))
    prefix = every.withColumn("_prefix", F.expr(f"shiftright(hash, {BITS} - depth)"))
    return prefix.select("doc_id", "n_bytes", _bits("_prefix", "depth").alias("shard"), F.col("depth").cast("long").alias("depth"), "page")


def write(documents: DataFrame, limit: int, path: str, doc_id: str = "doc_id", text: str = "text") -> None:
    """Writes the rows as Parquet, one folder for each shard and page; needs unique ids."""
    where = assigned(documents, limit, doc_id, text).select(F.col("doc_id").alias("_id"), "shard", "page")
    joined = documents.join(where, F.col(doc_id).cast("long").eqNullSafe(F.col("_id"))).drop("_id")
    joined.repartition("shard", "page").write.partitionBy("shard", "page").parquet(path)
