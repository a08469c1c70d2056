"""Chat formatting in budgeted windows, in DataFrame expressions only.

A conversation's turns have token prefix sums. The sums are cut into cells of equal length and a turn belongs to
the cell in which it starts, so spans of turns follow from the sums alone and no window waits for the one before.
Every window opens with the system turn, repeats the turns that start within the last ``history`` tokens before
its span as far as the budget leaves room, and goes on with the span. Only assistant texts of the span are
targets; those of repeated turns are masked, so each is learned once.

The template marks turns by ``### role:`` and ``</turn>`` lines. A control string inside a text gets one more
backslash in front, which reading back takes away again; roles are percent-encoded. Prefix sums go over
row-balanced ranges and cells are bounded by their tokens, so a conversation with a third of all rows is many
tasks. Placement works on narrow rows; texts meet their windows in one join and one grouping.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketloom.operators.chunks import running_total
from marketloom.settings import cut_lineage

#: The template's control strings and what stands around a turn.
OPEN, CLOSE = "### ", "</turn>"
_CONTROL = f"{OPEN}|{CLOSE}"
_END = f"\n{CLOSE}\n"
#: Words, digits and other visible characters; a turn's markers count six more.
_TOKEN = "[\\p{L}\\p{M}]+|\\p{N}|[^\\x20\\x09-\\x0D\\p{L}\\p{M}\\p{N}]"
OVERHEAD = 6


def token_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(_TOKEN)).cast("long")


def escaped(text: Column) -> Column:
    """Control strings get one more backslash in front."""
    return F.regexp_replace(text, f"(\\\\*)({_CONTROL})", "\\\\$1$2")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, f"\\\\(\\\\*)({_CONTROL})", "$1$2")


def _opening(role: Column) -> Column:
    return F.concat(F.lit(OPEN), F.url_encode(role), F.lit(":\n"))


def _key(conv: str, turn: str, role: Column, text: Column) -> Column:
    """One value for a row's content; equal for repeats of one row only."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in (conv, turn)]
    return F.md5(F.concat_ws(":", *parts, F.octet_length(role).cast("string"), F.concat(role, text)).cast("binary"))


def windows(
    conversations: DataFrame, budget: int = 1024, history: int = 256, tokens: Callable[[Column], Column] = token_count,
    system: str = "system", target: str = "assistant",
) -> DataFrame:
    """``(conv_id, cell, part, text, loss, repeated, tokens)``: one row for each window, in the order of cell and part.

    ``text`` is the formatted window, ``loss`` its targets as ``(start, stop)`` in code points of ``text``,
    ``repeated`` how many of its first turns an earlier window has already. A window holds at most
    ``budget`` tokens, unless one turn alone is larger: turns are never cut, so it has a window of its own.
    A first turn of role ``system`` opens every window of its conversation if it takes at most half of the
    budget; a larger one, and system turns further on, are turns like all others.

    Turns are in the order of ``turn``, null first, ties by a digest of the row, so repeats of a row stay
    turns of their own. Null roles and texts are empty, an empty target has an empty span; rows without
    conv_id form one conversation. Other columns are ignored; an empty table gives no windows.
    """
    if not 0 <= 4 * history <= budget:
        raise ValueError("history must be at most a quarter of the budget")
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    given = conversations.select(F.col("conv_id").cast("long").alias("conv"), "turn", role.alias("role"), text.alias("text"))
    given = given.withColumn("key", _key("conv", "turn", F.col("role"), F.col("text")))
    head, size = F.length(_opening(F.col("role"))), F.length("text") + F.regexp_count("text", F.lit(_CONTROL))
    narrow = given.select(
        "conv", "turn", "key", (F.col("role") == system).alias("first"), (F.col("role") == target).alias("aim"),
        (tokens(F.col("text")) + OVERHEAD).alias("t"), head.cast("long").alias("head"), size.cast("long").alias("size"))
    placed = cut_lineage(running_total(cut_lineage(narrow, "narrow"), ["conv"], ["turn", "key"], "t", "at", before=True).drop("turn"), "placed")
    # The system turn, and the room it leaves.
    led = placed.where(F.col("first") & (F.col("at") == 0) & (2 * F.col("t") <= budget))
    room = led.select(F.col("conv").alias("_c"), F.col("t").alias("s"))
    rows = placed.join(room, placed["conv"].eqNullSafe(room["_c"]), "left").drop("_c")
    rows = rows.withColumn("lead", F.col("s").isNotNull() & (F.col("at") == 0)).withColumn("s", F.coalesce("s", F.lit(0)))
    q = F.when(F.col("lead"), -1).otherwise(F.col("at") - F.col("s"))
    width = budget - F.col("s") - history
    rows = rows.withColumn("q", q).withColumn("cell", F.greatest(F.floor(F.col("q") / width), F.lit(0)))
    start = F.min(F.when(~F.col("lead"), F.col("q"))).over(Window.partitionBy("conv", "cell"))
    rows = rows.withColumn("_a", F.coalesce(start, F.lit(0)))
    crosses = ~F.col("lead") & (F.col("q") > F.col("_a")) & (F.col("q") + F.col("t") - F.col("_a") > budget - F.col("s"))
    rows = cut_lineage(rows.withColumn("part", crosses.cast("int")).drop("_a", "at", "first"), "cells")
    ends = F.when(~F.col("lead"), F.col("q") + F.col("t"))
    spans = rows.groupBy("conv", "cell", "part").agg(
        F.coalesce(F.min(F.when(~F.col("lead"), F.col("q"))), F.lit(0)).alias("a"), F.coalesce(F.max(ends), F.lit(0)).alias("b"), F.max("s").alias("s"))
    left = F.least(F.lit(history), budget - F.col("s") - F.col("b") + F.col("a"))
    spans = cut_lineage(spans.select(F.col("conv").alias("_c"), F.col("cell").alias("_k"), F.col("part").alias("_p"), "a", (F.col("a") - left).alias("reach")), "spans")
    # A turn can be history for a second part of its own cell and for the next cell's windows only.
    near = rows.where(~F.col("lead"))
    late = near.where(F.col("q") >= (F.col("cell") + 1) * (budget - F.col("s") - history) - history).withColumn("cell", F.col("cell") + 1)
    here = near.where("part = 0")
    own = spans.where("_p = 1")

    def before(turns: DataFrame, span: DataFrame) -> DataFrame:
        same = turns["conv"].eqNullSafe(span["_c"]) & (turns["cell"] == span["_k"])
        met = turns.join(span, same).where("q < a and q >= reach")
        return met.select("conv", F.col("_k").alias("cell"), F.col("_p").alias("part"), "q", "key", "aim", "t", "head", "size", F.lit(False).alias("fresh"))

    fresh = rows.select("conv", "cell", "part", "q", "key", "aim", "t", "head", "size", F.lit(True).alias("fresh"))
    lead = rows.where("lead").select("conv", "q", "key", "aim", "t", "head", "size")
    again = lead.join(spans, lead["conv"].eqNullSafe(spans["_c"])).where("_k > 0 or _p > 0")
    again = again.select("conv", F.col("_k").alias("cell"), F.col("_p").alias("part"), "q", "key", "aim", "t", "head", "size", F.lit(False).alias("fresh"))
    dealt = fresh.union(before(late, spans)).union(before(here, own)).union(again)
    inside = Window.partitionBy("conv", "cell", "part").orderBy("q").rowsBetween(Window.unboundedPreceding, -1)
    begin = F.coalesce(F.sum(F.col("head") + F.col("size") + len(_END)).over(inside), F.lit(0)) + F.col("head")
    dealt = dealt.withColumn("begin", begin).select(
        "key", "conv", "cell", "part", "q", "t", "fresh", F.when(F.col("fresh") & F.col("aim"), F.struct(F.col("begin").alias("start"), (F.col("begin") + F.col("size")).alias("stop"))).alias("span"))
    # Texts, one of each content, meet the windows that hold them.
    piece = F.concat(_opening(F.col("role")), escaped(F.col("text")), F.lit(_END))
    texts = given.select("key", "role", "text").dropDuplicates(["key"]).select("key", piece.alias("piece"))
    held = dealt.join(texts, "key")
    one = F.struct("q", "span", "piece")
    out = held.groupBy("conv", "cell", "part").agg(
        F.sort_array(F.collect_list(one)).alias("rows"), F.count_if(~F.col("fresh")).alias("repeated"), F.sum("t").alias("tokens"))
    loss = F.transform(F.filter("rows", lambda r: r["span"].isNotNull()), lambda r: r["span"])
    return out.select(F.col("conv").alias("conv_id"), "cell", "part", F.array_join(F.transform("rows", lambda r: r["piece"]), "").alias("text"), loss.alias("loss"), "repeated", "tokens")


def turns(text: Column) -> Column:
    """The ``(role, text)`` of all turns of a formatted window."""
    parts = F.split(text, _END)
    whole = F.slice(parts, 1, F.size(parts) - 1)
    form = f"(?s)^{OPEN}([^\\n]*):\\n(.*)$"
    return F.transform(whole, lambda p: F.struct(F.url_decode(F.regexp_extract(p, form, 1)).alias("role"), unescaped(F.regexp_extract(p, form, 2)).alias("text")))


def targets(text: Column, loss: Column) -> Column:
    """The texts under the loss mask of a formatted window, unescaped."""
    return F.transform(loss, lambda s: unescaped(F.substring(text, s["start"].cast("int") + 1, (s["stop"] - s["start"]).cast("int"))))


def digests(formatted: DataFrame) -> DataFrame:
    """``(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars)`` read back from windows.

    Turns that a window repeats are left out, so every turn counts once. A digest needs its conversation in one row.
    """
    read = F.slice(turns(F.col("text")), F.col("repeated").cast("int") + 1, F.size(F.split("text", _END)))
    w = formatted.select("conv_id", "cell", "part", F.length("text").alias("chars"), read.alias("turns"), F.array_join(targets(F.col("text"), F.col("loss")), "").alias("aims"))
    said = F.array_join(F.transform("turns", lambda r: F.concat(r["role"], F.lit("\n"), r["text"], F.lit("\n"))), "")
    w = w.select("conv_id", F.struct("cell", "part", said.alias("said"), "aims").alias("one"), F.size("turns").alias("n"), F.length("aims").alias("aimed"), "chars")
    g = w.groupBy("conv_id").agg(
        F.sum("n").alias("n_turns"), F.sort_array(F.collect_list("one")).alias("all"), F.sum("aimed").cast("long").alias("loss_chars"), F.sum("chars").cast("long").alias("formatted_chars"))

    def sha(field: str) -> Column:
        return F.sha2(F.array_join(F.transform("all", lambda r: r[field]), ""), 256)

    return g.select("conv_id", F.col("n_turns").cast("long").alias("n_turns"), sha("said").alias("turns_sha256"), "loss_chars", sha("aims").alias("loss_sha256"), "formatted_chars")


#: A conversation whose texts hold control strings of common templates, its own among them.
TRICKY = "\\### Assistant: </turn> ok"


def with_tricky(conversations: DataFrame) -> DataFrame:
    """The conversations and one more, -7, of control strings."""
    rows = [(-7, 0, "user", TRICKY), (-7, 1, "assistant", TRICKY)]
    extra = conversations.sparkSession.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    return conversations.select("conv_id", "turn", "role", "text").union(extra)
