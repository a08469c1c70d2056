"""Tokens, set similarity, content ids, JSON flattening and reason categories."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marketloom.functions.numeric import Col, as_col
from marketloom.settings import cut_lineage

# Token patterns.
LATIN = "[a-z0-9]+"
CJK = "[\\u3400-\\u9fff]+"


def tokens(text: Col) -> Column:
    """Distinct Latin words and CJK bigrams; a lone CJK character is its own token."""
    low = F.lower(as_col(text))
    words = F.regexp_extract_all(low, F.lit(LATIN), F.lit(0))
    runs = F.regexp_extract_all(low, F.lit(CJK), F.lit(0))

    def bigrams(run: Column) -> Column:
        last = F.greatest(F.length(run) - 1, F.lit(1))
        return F.transform(F.sequence(F.lit(1), last), lambda i: F.substr(run, i, F.lit(2)))

    return F.array_distinct(F.concat(words, F.flatten(F.transform(runs, bigrams))))


def jaccard(left: Column, right: Column) -> Column:
    """Set similarity; two empty sets are alike, one empty set is not."""
    a, b = F.size(left), F.size(right)
    both = F.size(F.array_intersect(left, right))
    # Inputs are sets, so the union follows from the sizes.
    return F.when((a == 0) & (b == 0), 1.0).when((a == 0) | (b == 0), 0.0).otherwise(both / (a + b - both))


def token_literal(spark: SparkSession, text: str) -> Column:
    """Tokens of one statement as a literal array, so that rows do not repeat the work."""
    row = spark.range(1).select(tokens(F.lit(text)).alias("t")).first()
    return F.array(*[F.lit(t) for t in row["t"]]).cast("array<string>")


def content_id(columns: Sequence[str], prefix: str) -> Column:
    """Hash of the row's columns as JSON with sorted keys; NULL fields stay in."""
    body = F.to_json(F.struct(*[F.col(c) for c in sorted(columns)]), {"ignoreNullFields": "false"})
    return F.concat(F.lit(prefix + "-"), F.substring(F.sha2(body, 256), 1, 24))


def flatten_json(df: DataFrame, key: str, text: str) -> DataFrame:
    """Nested objects to (key, field, value) rows with dotted fields; lists stay whole.

    The text is read and parsed once. Each level of nesting is written and only its objects go on to the next,
    so the work follows the size of the documents whatever their depth. Texts without an object on top give no rows.
    """
    view = df.select(F.col(key).alias("_k"), F.lit("").alias("_f"), F.parse_json(F.col(text)).alias("_v"))
    done = None
    while True:
        inner = view.lateralJoin(df.sparkSession.tvf.variant_explode(F.col("_v").outer())).where("key is not null")
        field = F.when(F.col("_f") == "", F.col("key")).otherwise(F.concat_ws(".", "_f", "key"))
        nested = F.coalesce(F.schema_of_variant("value").startswith("OBJECT"), F.lit(False))
        level = inner.select("_k", field.alias("_f"), F.col("value").alias("_v"), nested.alias("_nested"))
        level = cut_lineage(level.withColumns({"_leaf": F.when(~F.col("_nested"), F.to_json("_v")), "_v": F.when(F.col("_nested"), F.col("_v"))}), "flatten")
        leaf = level.where("not _nested").select(F.col("_k").alias(key), F.col("_f").alias("field"), F.col("_leaf").alias("value"))
        done = leaf if done is None else done.unionByName(leaf)
        view = level.where("_nested").select("_k", "_f", "_v")
        if view.isEmpty():
            return done


def reason_category(reason: Col) -> Column:
    """Group of a reason code by prefix and content; the first match wins."""
    r = F.upper(as_col(reason))

    def has(*parts: str) -> Column:
        out = F.lit(False)
        for p in parts:
            out = out | r.contains(p)
        return out

    # Categories and the fragments that select them, in order.
    return (
        F.when(r.startswith("MODEL_ERROR") | has("MODEL_", "ALPHA", "RISK"), "model/cash fallback")
        .when(has("T1_", "SELLABLE"), "T+1")
        .when(has("LOT", "QUANTITY", "NOTIONAL"), "lot / quantity")
        .when(has("SUSPEND"), "suspension")
        .when(has("LIMIT_UP", "LIMIT_DOWN", "PRICE_LIMIT"), "price limit")
        .when(has("CASH"), "cash scaling")
        .when(has("SESSION", "DATA"), "session / data")
        .when(r.isin("ACCEPTED", "MODEL_TARGET", "NOT_REBALANCE_SESSION", "NO_TARGET_DELTA"), "normal / no action")
        .otherwise("other")
    )
