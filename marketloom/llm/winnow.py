"""Document fingerprints by winnowing, in DataFrame expressions only.

The units are words. Every run of ``k`` words has a hash; in each window of ``w`` consecutive runs
the smallest hash is selected, the rightmost of equal ones, with its position. Two texts that share
``w + k - 1`` words in a row share a selected hash, at the same place of that passage. Shorter texts have
one window over what there is; a text of fewer than ``k`` words has one run of all its words.

Hash and position share one long: 31 bits of hash above 32 bits that count positions down, so the
least value of a window is its smallest hash at the rightmost place. Window minima come from
doubling: the minimum over 2n runs is the lesser of two neighbouring minima over n.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_LOW = (1 << 32) - 1
_SPACE = " \t\n\x0b\x0c\r"


def _shifted(column: str, by: int) -> Column:
    return F.expr(f"slice({column}, {by + 1}, greatest(size({column}) - {by}, 0))")


def with_fingerprint(df: DataFrame, text: str, into: str, k: int = 3, w: int = 8) -> DataFrame:
    """Adds ``into``: the selected (hash, position) longs of ``text`` in order; null texts have none.

    Temporary columns start with ``_w``; the input must not use such names.
    """
    keep = df.columns
    df = df.withColumn("_w", F.btrim(text, F.lit(_SPACE)))
    df = df.withColumn("_w", F.when(F.col("_w") == "", F.array().cast("array<string>")).otherwise(F.split("_w", f"[{_SPACE}]+")))
    df = df.withColumn("_wh", F.transform("_w", lambda x: F.xxhash64(x))).drop("_w")
    df = df.withColumn("_wg", F.col("_wh"))
    for i in range(1, k):
        df = df.withColumn("_wg2", F.zip_with("_wg", _shifted("_wh", i), lambda x, y: F.xxhash64(x, y))).drop("_wg").withColumnRenamed("_wg2", "_wg")
    df = df.withColumn("_wg", F.expr(f"slice(_wg, 1, greatest(size(_wg) - {k - 1}, least(size(_wg), 1)))"))
    pack = lambda x, i: F.shiftleft(F.shiftrightunsigned(x, 33), 32).bitwiseOR(F.lit(_LOW) - i.cast("long"))
    df = df.withColumn("_wp", F.transform("_wg", pack)).drop("_wg", "_wh")
    df = df.withColumn("_wn", F.size("_wp"))
    done = 1
    while done < w:
        step = min(done, w - done)
        df = df.withColumn("_wq", F.zip_with("_wp", _shifted("_wp", step), lambda x, y: F.least(x, y))).drop("_wp").withColumnRenamed("_wq", "_wp")
        done += step
    chosen = F.expr(f"array_distinct(slice(_wp, 1, greatest(_wn - {w - 1}, least(_wn, 1))))")
    return df.withColumn(into, F.coalesce(chosen, F.expr("cast(array() as array<bigint>)"))).select(*keep, into)


def hashes(selected: Column) -> Column:
    """Distinct hashes without positions."""
    return F.array_distinct(F.transform(selected, lambda x: F.shiftright(x, 32)))


def printed(selected: Column) -> Column:
    """``hash@position`` joined by commas."""
    one = lambda x: F.concat(F.lower(F.hex(F.shiftright(x, 32))), F.lit("@"), (F.lit(_LOW) - x.bitwiseAND(F.lit(_LOW))).cast("string"))
    return F.array_join(F.transform(selected, one), ",")


def likeness(a: str, b: str) -> Column:
    """Shared over all distinct hashes; two empty fingerprints are alike."""
    both = F.size(F.array_intersect(a, b)).cast("double")
    every = F.size(a) + F.size(b) - both
    return F.when(every == 0, 1.0).otherwise(both / every)


def _range_of(order: str, bounds: list[int]) -> Column:
    """How many bounds are not below the value: 0 for the largest values; nulls have a range behind all others."""
    side = max(1, math.isqrt(len(bounds)))
    rows = [bounds[i : i + side] for i in range(0, len(bounds), side)]  # descending
    if not rows:
        return F.when(F.col(order).isNull(), 1).otherwise(0)
    value = F.col(order)
    tops = F.array(*[F.lit(r[-1]).cast("long") for r in rows])
    table = F.array(*[F.array(*[F.lit(b).cast("long") for b in r]) for r in rows])
    whole = F.size(F.filter(tops, lambda b: b >= value))
    part = F.size(F.filter(F.get(table, whole), lambda b: b >= value))
    return F.when(value.isNull(), len(rows) * side + 1).otherwise(whole * side + F.greatest(part, F.lit(0)))


def with_next(df: DataFrame, order: str, tie: str, columns: list[str], buckets: int = 1024) -> DataFrame:
    """Adds ``next_<column>``: the values of the next row by ``order`` descending, of the first after the last.

    Rows are dealt to at most ``buckets`` ranges of ``order`` and sorted only inside a range; each
    range also receives the first row of the range after it. What reaches the driver are the range
    bounds and each range's largest value, at most ``buckets`` of either. Nulls come last; rows of
    equal ``order`` are ordered by ``tie`` descending. Needs a long ``order`` and no column
    named ``_at``, ``_late``, ``_top`` or ``_for``.
    """
    steps = [i / buckets for i in range(1, buckets)]
    bounds = df.agg(F.percentile_approx(order, steps, 20 * buckets).alias("b")).first()["b"] or []
    at = _range_of(order, sorted(set(bounds), reverse=True))
    firsts = sorted((r["_at"], r["_top"]) for r in df.groupBy(at.alias("_at")).agg(F.max(order).alias("_top")).collect())
    heads = [{"_top": firsts[(i + 1) % len(firsts)][1], "_for": firsts[i][0]} for i in range(len(firsts))]
    table = F.from_json(F.lit(json.dumps(heads)), "array<struct<_top: bigint, _for: int>>")
    heads_df = df.sparkSession.range(1).select(F.inline(table))  # at most ``buckets`` + 1 rows
    marked = df.withColumn("_at", at).join(F.broadcast(heads_df), F.col(order).eqNullSafe(F.col("_top")), "left")
    own = F.struct(F.col("_at"), F.lit(0).alias("_late"))
    head = F.struct(F.col("_for").alias("_at"), F.lit(1).alias("_late"))
    places = F.when(F.col("_for").isNull(), F.array(own)).otherwise(F.array(own, head))
    dealt = marked.select(*df.columns, F.inline(places))
    w = Window.partitionBy("_at").orderBy("_late", F.col(order).desc_nulls_last(), F.col(tie).desc_nulls_last())
    return dealt.select("*", *[F.lead(c).over(w).alias(f"next_{c}") for c in columns]).where("_late = 0").drop("_at", "_late")


def edited_fingerprints(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = 3, w: int = 8) -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likeness.

    Edited: the last floor(n / 3) code points give way to the first as many (or all) of the next
    document by descending id; the last one takes from the first. Null texts count as empty. Rows
    without an id come last; rows that repeat an id stand side by side, the larger text first. Other columns are
    ignored. An empty table gives no rows. ``near_edited`` and ``near_next`` are the shared hashes
    over all hashes of two fingerprints, 1 for two empty ones.
    """
    df = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    df = with_next(with_fingerprint(df, "text", "selected", k, w), "doc_id", "text", ["text", "selected"])
    cut = F.floor(F.col("n_chars") / 3).cast("int")
    df = df.withColumn("n_chars", F.length("text").cast("long"))
    edited = F.concat(F.substring("text", F.lit(1), F.col("n_chars").cast("int") - cut), F.substring("next_text", F.lit(1), cut))
    df = df.withColumn("edited", edited).drop("text", "next_text")
    df = with_fingerprint(df, "edited", "edited_selected", k, w)
    for name in ("selected", "edited_selected", "next_selected"):
        df = df.withColumn(f"{name}_set", hashes(F.col(name)))
    return df.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        printed(F.col("selected")).alias("fingerprint"),
        printed(F.col("edited_selected")).alias("edited_fingerprint"),
        likeness("selected_set", "edited_selected_set").alias("near_edited"),
        likeness("selected_set", "next_selected_set").alias("near_next"),
    )
