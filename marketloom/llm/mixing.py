"""Mixing sources to target weights by a low-discrepancy schedule, in DataFrame expressions only.

The documents of a source are shuffled by a hash and laid end to end; the resulting run of words is
cut into blocks of ``block`` words. Slot i of the schedule has the golden-ratio point
frac(i * phi), in integers modulo 2**31, and belongs to the source whose interval of cumulative
weights holds it; the slots of a source are ranked, and slot rank r takes block r modulo the
source's blocks. Low discrepancy keeps every prefix of the schedule near the weights, and the whole
within a few blocks of them. A source of fewer than ``SMALL`` blocks, for which a few blocks are all it has, is cut
into ``PARTS`` finer blocks instead and takes as many as come nearest to its target, the schedule of
the others staying as it is. Prefix sums run inside hash buckets (documents) and chunks (slots), with one row of
totals for each source and bucket, so a source with a third of all rows is no single task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketloom.settings import cut_lineage

#: Weights by rank of the source, and 2**31 divided by the golden ratio.
WEIGHTS = (5, 2, 1)
GOLDEN = 1327217885
_MODULUS = 1 << 31
#: Sources of fewer blocks than SMALL are cut into PARTS blocks of their own.
SMALL, PARTS = 8, 64


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, share: float = 1.5, ceiling: float = 2.0) -> DataFrame:
    """``(source, source_size, weight, target)`` of ``(source, size)``: one row for each source, null last.

    ``share`` of all words is split by weight; a source stops at ``ceiling`` times its size and the
    rest is split again. With sources in the order of ceiling over weight, those at their ceiling are a
    prefix: the first source whose share of what is left by its predecessors stays under its ceiling ends it.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    named = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    rank = (F.row_number().over(named) - 1) % len(WEIGHTS)
    totals = totals.withColumn("weight", F.element_at(F.array(*map(F.lit, WEIGHTS)), (rank + 1).cast("int")).cast("double"))
    totals = totals.withColumn("most", F.col("source_size") * F.lit(ceiling))
    order = (F.col("most") / F.col("weight"), F.col("source").isNull(), F.col("source").cast("binary"))
    before = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    onward = Window.orderBy(*order).rowsBetween(0, Window.unboundedFollowing)
    upto = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    every = Window.partitionBy()
    left = F.lit(share) * F.sum("source_size").over(every) - F.coalesce(F.sum("most").over(before), F.lit(0.0))
    totals = totals.withColumn("level", left / F.sum("weight").over(onward))
    totals = totals.withColumn("open", F.max((F.col("level") * F.col("weight") <= F.col("most")).cast("int")).over(upto))
    level = F.first(F.when(F.col("open") == 1, F.col("level")), ignorenulls=True).over(every)
    target = F.when(F.col("open") == 1, F.least("most", F.col("weight") * level)).otherwise(F.col("most"))
    return totals.select("source", "source_size", "weight", target.alias("target"))


def _bucket(hashed: str) -> Column:
    """4096 buckets of the shuffled order."""
    return F.substring(hashed, 1, 3)


def placed(documents: DataFrame) -> DataFrame:
    """Adds ``start``: the words that come before a document in its source's shuffled run.

    ``documents`` has ``(key, source, size)``; the order is that of the md5 of the key.
    """
    df = documents.withColumn("_h", F.md5(F.col("key").cast("binary")))
    df = df.withColumn("_b", _bucket("_h"))
    counts = df.groupBy("source", "_b").agg(F.sum("size").alias("_n"))
    before = Window.partitionBy("source").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(F.col("source").alias("_s"), F.col("_b").alias("_c"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_o"))
    inner = Window.partitionBy("source", "_b").orderBy("_h", "size").rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumn("_in", F.coalesce(F.sum("size").over(inner), F.lit(0)))
    df = df.join(offsets, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_b") == F.col("_c")))
    return df.withColumn("start", F.col("_o") + F.col("_in")).drop("_h", "_b", "_in", "_s", "_c", "_o")


def block_words(block: int) -> Column:
    """Words of a block of a source: ``block``, or less in a small source."""
    small = F.col("source_size") < SMALL * block
    return F.when(small, F.least(F.lit(block), F.ceil(F.col("source_size") / PARTS))).otherwise(F.lit(block)).cast("long")


def schedule(targets: DataFrame, block: int, chunk: int = 1 << 16) -> DataFrame:
    """``(slot, source, rank, block)``: every slot's source, its rank there and the block it takes.

    As many slots as the targets hold blocks. Slots whose rank is past the ceiling of the source
    (twice its blocks) stay empty and are left out. Small sources have no slots of their
    intervals, but as many finer ones as their target holds, placed evenly over the schedule.
    """
    named = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    summed = F.sum("target").over(named.rowsBetween(Window.unboundedPreceding, 0))
    part = F.floor(summed / F.sum("target").over(Window.partitionBy()) * _MODULUS)
    part = F.when(F.lead("weight").over(named).isNull(), F.lit(_MODULUS)).otherwise(part)
    bounds = targets.where("target > 0").withColumn("_to", part.cast("long"))
    lag = F.coalesce(F.lag("_to").over(Window.orderBy("_to")), F.lit(0))
    bounds = bounds.withColumn("_from", lag).where("_to > _from")
    # Intervals are met by the upper bits of the point, so no slot is compared with all sources.
    shift = 21
    cells = F.sequence(F.shiftright("_from", shift), F.shiftright(F.col("_to") - 1, shift))
    bounds = bounds.select("source", "source_size", "target", "_from", "_to", F.explode(cells).alias("_cell"))
    spark = targets.sparkSession
    total = targets.agg(F.ceil(F.sum("target") / block).alias("n")).first()["n"] or 0
    slots = spark.range(total).withColumnRenamed("id", "slot")
    slots = slots.withColumn("_point", (F.col("slot") % _MODULUS) * GOLDEN % _MODULUS).withColumn("_cell", F.shiftright("_point", shift))
    owned = slots.join(bounds, "_cell").where("_point >= _from and _point < _to").select("slot", "source", "source_size", F.floor(F.col("slot") / chunk).alias("_chunk"))
    counts = owned.groupBy("source", "_chunk").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("source").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(F.col("source").alias("_s"), F.col("_chunk").alias("_c"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_o"))
    inner = Window.partitionBy("source", "_chunk").orderBy("slot")
    owned = owned.withColumn("_in", F.row_number().over(inner) - 1)
    ranked = owned.join(offsets, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_chunk") == F.col("_c"))).withColumn("rank", F.col("_o") + F.col("_in"))
    blocks = F.ceil(F.col("source_size") / block)
    whole = ranked.where((F.col("rank") < 2 * blocks) & (F.col("source_size") >= SMALL * block)).select("slot", "source", "rank", (F.col("rank") % blocks).alias("block"))
    fine = targets.where((F.col("source_size") > 0) & (F.col("source_size") < SMALL * block)).withColumn("_w", block_words(block))
    fine = fine.withColumn("_blocks", F.ceil(F.col("source_size") / F.col("_w")))
    # The last block is short, so whole rounds are counted by words and only the rest by blocks.
    rounds = F.floor(F.col("target") / F.col("source_size"))
    rest = F.round((F.col("target") - rounds * F.col("source_size")) / F.col("_w")).cast("long")
    fine = fine.withColumn("_n", F.least(rounds * F.col("_blocks") + F.least(rest, "_blocks"), 2 * F.col("_blocks"))).where("_n > 0")
    fine = fine.withColumn("rank", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)))
    slot = F.floor((F.col("rank") + 0.5) / F.col("_n") * total).alias("slot")
    return whole.union(fine.select(slot, "source", "rank", (F.col("rank") % F.col("_blocks")).alias("block")))


def mixed(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", block: int = 256) -> DataFrame:
    """``(doc_id, source, size, source_size, target, taken)`` for every row.

    ``taken`` counts the words of the document in all slots that take one of its blocks, at most
    twice its size. Null and empty texts have size 0 and take nothing; a null source is a source of its
    own, the last. Rows that repeat id and text are laid out one after the other. Other columns are
    ignored; an empty table gives no rows.
    """
    rows = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"))
    rows = cut_lineage(rows, "sizes")
    targets = cut_lineage(source_targets(rows), "targets")
    slots = schedule(targets, block)
    key = F.concat_ws(":", F.col("doc_id").cast("string"), F.col("size").cast("string"))
    laid = cut_lineage(placed(rows.withColumn("key", key)), "laid")
    words = targets.select(F.col("source").alias("_n"), block_words(block).alias("_w"))
    cut = laid.where("size > 0").join(words, F.col("source").eqNullSafe(F.col("_n")))
    last = F.floor((F.col("start") + F.col("size") - 1) / F.col("_w"))
    pieces = cut.select("source", "start", "size", "_w", F.explode(F.sequence(F.floor(F.col("start") / F.col("_w")), last)).alias("block"))
    held = F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * F.col("_w")) - F.greatest(F.col("start"), F.col("block") * F.col("_w"))
    pieces = pieces.select("source", "start", "block", held.alias("words"))
    times = slots.groupBy("source", "block").agg(F.count("*").alias("times")).withColumnRenamed("source", "_s").withColumnRenamed("block", "_k")
    taken = pieces.join(times, F.col("source").eqNullSafe(F.col("_s")) & (F.col("block") == F.col("_k")))
    taken = taken.groupBy("source", "start").agg(F.sum(F.col("words") * F.col("times")).alias("taken"))
    taken = taken.select(F.col("source").alias("_s"), F.col("start").alias("_t"), "taken")
    full = laid.join(taken, F.col("source").eqNullSafe(F.col("_s")) & (F.col("start") == F.col("_t")) & (F.col("size") > 0), "left")
    named = targets.select(F.col("source").alias("_n"), "source_size", "target")
    full = full.join(named, F.col("source").eqNullSafe(F.col("_n")))
    return full.select("doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))
