"""Lineage graphs, registries, similarity search and trace tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketloom.functions.text import jaccard, token_literal, tokens
from marketloom.operators.chunks import with_lookback
from marketloom.settings import cut_lineage


def traverse(edges: DataFrame, start: str, direction: str = "out", depth: int = 6) -> DataFrame:
    """``(node, depth)``: breadth-first reach of one node within ``depth`` hops, without a node limit.

    The frontier is a table: a hop joins it with the edges (parent, child) and drops nodes seen
    before. Hops are written to the shared folder, and the walk ends when a hop finds nothing new.
    """
    if depth < 1 or direction not in ("out", "in", "both"):
        raise ValueError("depth or direction out of range")
    steps = []
    if direction in ("out", "both"):
        steps.append(edges.select(F.col("parent").alias("node"), F.col("child").alias("next")))
    if direction in ("in", "both"):
        steps.append(edges.select(F.col("child").alias("node"), F.col("parent").alias("next")))
    moves = steps[0] if len(steps) == 1 else steps[0].unionByName(steps[1])
    seen = edges.sparkSession.range(1).select(F.lit(start).alias("node"), F.lit(0).cast("bigint").alias("depth"))
    frontier = seen
    for hop in range(1, depth + 1):
        reach = moves.join(frontier.select("node"), "node", "left_semi").select(F.col("next").alias("node")).distinct()
        frontier = cut_lineage(reach.join(seen, "node", "left_anti").withColumn("depth", F.lit(hop).cast("bigint")), "frontier")
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


def traversed_edges(edges: DataFrame, reached: DataFrame) -> DataFrame:
    """The edges between reached nodes."""
    ends = reached.select("node")
    inner = edges.join(ends.withColumnRenamed("node", "parent"), "parent", "left_semi")
    return inner.join(ends.withColumnRenamed("node", "child"), "child", "left_semi").select(*edges.columns)


def depths(nodes: DataFrame, node: str, parent: str) -> DataFrame:
    """Depth of every node of a forest by pointer doubling: log2(depth) joins.

    Each round is written to the shared folder, so plans stay short.
    """
    d = nodes.select(F.col(node).alias("node"), F.col(parent).alias("up"))
    d = d.withColumn("depth", F.when(F.col("up").isNull(), 0).otherwise(1).cast("bigint"))
    while True:
        d = cut_lineage(d, "depth")
        if d.where("up IS NOT NULL").isEmpty():
            return d.select("node", "depth")
        above = d.select(F.col("node").alias("up"), F.col("up").alias("_u"), F.col("depth").alias("_d"))
        d = d.join(above, "up", "left").select("node", F.col("_u").alias("up"), (F.col("depth") + F.coalesce("_d", F.lit(0))).alias("depth"))


def similar_statements(corpus: DataFrame, key: str, text: str, tags: str, statement: str, wanted: Sequence[str], limit: int) -> DataFrame:
    """Top matches of one statement: one scan of the corpus, no pairing of rows."""
    if not 1 <= limit <= 50:
        raise ValueError("limit must lie in 1..50")
    mine = token_literal(corpus.sparkSession, statement)
    want = F.array(*[F.lit(t) for t in sorted(set(wanted))]) if wanted else F.array().cast("array<string>")
    corpus = corpus.select(key, tags, tokens(text).alias("_t"))
    base = jaccard(F.col("_t"), mine)
    either = (F.size(want) > 0) | (F.size(tags) > 0)
    score = F.when(either, base * 0.85 + jaccard(F.col(tags), want) * 0.15).otherwise(base)
    return corpus.select(key, score.alias("score")).orderBy(F.desc("score"), key).limit(limit)


def similar_experiments(corpus: DataFrame, key: str, spec: dict, limit: int) -> DataFrame:
    """Weighted signature similarity; the same fingerprint scores 1.

    corpus: key, fingerprint, hypothesis, universe[], parameters[], dataset, code.
    """
    def arr(xs: Sequence[str]) -> Column:
        return F.array(*[F.lit(x) for x in xs]) if xs else F.array().cast("array<string>")

    corpus = corpus.withColumn("_t", tokens("hypothesis"))
    # Weights of the signature parts.
    score = (
        jaccard(F.col("_t"), token_literal(corpus.sparkSession, spec["hypothesis"])) * 0.40
        + jaccard(F.col("universe"), arr(spec["universe"])) * 0.20
        + jaccard(F.col("parameters"), arr(spec["parameters"])) * 0.15
        + (F.col("dataset") == spec["dataset"]).cast("double") * 0.15
        + (F.col("code") == spec["code"]).cast("double") * 0.10
    )
    score = F.when(F.col("fingerprint") == spec["fingerprint"], 1.0).otherwise(score)
    return corpus.select(key, score.alias("score")).orderBy(F.desc("score"), key).limit(limit)


def similar_features(corpus: DataFrame, key: str, hypothesis: str, fields: Sequence[str], lookback: int, limit: int) -> DataFrame:
    """corpus: key, hypothesis, fields[], lookback."""
    near = F.least(F.col("lookback"), F.lit(lookback)) / F.greatest(F.col("lookback"), F.lit(lookback))
    corpus = corpus.withColumn("_t", tokens("hypothesis"))
    # Weights of the feature parts.
    score = (
        jaccard(F.col("_t"), token_literal(corpus.sparkSession, hypothesis)) * 0.60
        + jaccard(F.col("fields"), F.array(*[F.lit(f) for f in fields])) * 0.25 + near * 0.15
    )
    return corpus.select(key, score.alias("score")).orderBy(F.desc("score"), key).limit(limit)


def illegal_transitions(history: DataFrame, by: str, order: Sequence[str], status: str, allowed: Sequence[tuple[str, str]]) -> DataFrame:
    """Revisions whose status may not follow the previous one, per entity."""
    ok = F.lit(False)

    def previous(frame: DataFrame, part: Sequence[str]) -> DataFrame:
        return frame.withColumn("_p", F.lag(status).over(Window.partitionBy(*part).orderBy(*order)))

    for a, b in allowed:
        ok = ok | ((F.col("_p") == a) & (F.col(status) == b))
    d = with_lookback(history, [by], list(order), 1, previous)
    bad = F.col("_p").isNotNull() & ~ok
    return d.groupBy(by).agg(F.count("*").alias("revisions"), F.count_if(bad).alias("illegal"))


def register(existing: DataFrame, incoming: DataFrame, key: Sequence[str], content: str) -> DataFrame:
    """Idempotent append: APPEND new ids, SKIP equal content, CONFLICT otherwise.

    Existing content per id is unique; several incoming contents for one id conflict too.
    """
    inc = incoming.groupBy(*key).agg(F.min(content).alias("_lo"), F.max(content).alias("_hi"))
    old = existing.groupBy(*key).agg(F.min(content).alias("_old"), F.max(content).alias("_old2"))
    j = inc.join(old, list(key), "left")
    action = (
        F.when(F.col("_lo") != F.col("_hi"), "CONFLICT").when(F.col("_old").isNull(), "APPEND")
        .when((F.col("_old") == F.col("_lo")) & (F.col("_old2") == F.col("_lo")), "SKIP").otherwise("CONFLICT")
    )
    return j.select(*key, action.alias("action"))


def assemble_spans(lines: DataFrame, text: str) -> DataFrame:
    """Spans from start / end / event lines: first start, last end, latest attributes.

    Everything is one mergeable grouping by span id.
    """
    schema = "event string, span_id string, at string, name string, status string, attributes map<string,string>"
    d = lines.select(F.from_json(text, schema).alias("e")).select("e.*").where("span_id IS NOT NULL AND span_id <> ''")
    start, end = F.col("event") == "span_start", F.col("event") == "span_end"
    attr = (F.col("event") == "event") & (F.col("name") == "attributes")
    g = d.groupBy("span_id").agg(
        F.min(F.when(start, F.col("at"))).alias("started_at"),
        F.count_if(start).alias("starts"),
        F.max(F.when(end, F.col("at"))).alias("ended_at"),
        F.max_by("status", F.when(end, F.col("at"))).alias("_status"),
        F.max_by("attributes", F.when(attr, F.col("at"))).alias("attributes"),
        F.count_if((F.col("event") == "event") & ~attr).alias("events"),
    )
    state = F.when(F.col("starts") == 0, "orphan").when(F.col("ended_at").isNull(), "open").otherwise(F.coalesce("_status", F.lit("open")))
    return g.select("span_id", "started_at", "ended_at", state.alias("status"), "attributes", "events", F.greatest(F.col("starts") - 1, F.lit(0)).alias("duplicate_starts"))


def thread_index(rows: DataFrame, thread: str, project: str, derived: Column, updated: str) -> DataFrame:
    """Threads with their project: explicit, else inferred from the thread, else derived."""
    per = rows.groupBy(thread).agg(
        F.max(project).alias("_p"), F.count_distinct(project).alias("projects"), F.max(updated).alias("updated_at"), F.count("*").alias("rows"))
    return per.select(thread, F.coalesce("_p", derived).alias("project"), "updated_at", "rows", (F.col("projects") > 1).alias("conflict"))


def union_graphs(nodes: Sequence[DataFrame], edges: Sequence[DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Graphs merged: one row per node id with a type conflict flag, distinct edges."""
    from marketloom.operators.sets import union_parts

    n = union_parts(nodes).groupBy("node").agg(F.min("kind").alias("kind"), (F.min("kind") != F.max("kind")).alias("conflict"))
    return n, union_parts(edges).select("parent", "child", "relation").distinct()


def merge_registries(sources: dict[str, DataFrame], key: str, definition: str, extra: str) -> DataFrame:
    """Entities of several registries; differing definitions are flagged, not resolved."""
    from marketloom.operators.sets import tagged_union

    u = tagged_union({k: v.select(key, definition, extra) for k, v in sources.items()}, "registry")
    u = u.groupBy(key, "registry").agg(F.min(definition).alias("_a"), F.max(definition).alias("_b"), F.count(extra).alias("_e"))
    return u.groupBy(key).agg(
        F.sort_array(F.collect_set("registry")).alias("registries"), (F.min("_a") != F.max("_b")).alias("conflict"), F.sum("_e").alias("evaluations"))
