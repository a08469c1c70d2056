"""Walk-forward folds, tags and splits. The calendar is the only thing that is indexed."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketloom.settings import cut_lineage


def purged_folds(
    calendar: DataFrame, date: str, train: int, test: int, step: int, purge: int, embargo: int,
    by: Sequence[str] = (), expanding: bool = False,
) -> DataFrame:
    """Complete folds as date ranges: train [.., ..], then a gap, then test [.., ..].

    ``calendar`` holds dates (per ``by`` group, e.g. an outer fold); its distinct dates are
    written once, so the source is scanned once. Bounds are looked up by an equi-join.
    """
    calendar = cut_lineage(calendar.select(*by, date).distinct(), "calendar")
    w = Window.partitionBy(*by, F.lit(0)).orderBy(date) if by else Window.orderBy(date)
    idx = calendar.withColumn("i", F.row_number().over(w) - 1)
    gap = purge + embargo
    n = idx.groupBy(*by).agg(F.count("*").alias("n")) if by else idx.agg(F.count("*").alias("n"))
    count = F.floor((F.col("n") - (train + gap + test)) / step) + 1
    f = n.where(F.col("n") >= train + gap + test).withColumn("fold", F.explode(F.sequence(F.lit(0).cast("bigint"), count - 1)))
    first = F.lit(0) if expanding else F.col("fold") * step
    end = F.col("fold") * step + train
    bounds = {"train_start": first, "train_end": end - 1, "test_start": end + gap, "test_end": end + gap + test - 1}
    marks = F.array(*[F.struct(F.lit(k).alias("mark"), v.cast("bigint").alias("i")) for k, v in bounds.items()])
    rows = f.select(*by, "fold", F.explode(marks).alias("m")).select(*by, "fold", "m.mark", "m.i")
    hit = rows.join(idx.withColumn("i", F.col("i").cast("bigint")), [*by, "i"])
    return hit.groupBy(*by, "fold").agg(*[F.max(F.when(F.col("mark") == k, F.col(date))).alias(k) for k in bounds])


def role_days(folds: DataFrame, date: str, keep: Sequence[str] = ("fold",)) -> DataFrame:
    """Folds exploded to (fold, role, day)."""
    roles = F.array(
        F.struct(F.lit("train").alias("role"), F.col("train_start").alias("a"), F.col("train_end").alias("b")),
        F.struct(F.lit("test").alias("role"), F.col("test_start").alias("a"), F.col("test_end").alias("b")),
    )
    d = folds.select(*keep, F.explode(roles).alias("r")).select(*keep, "r.*")
    return d.select(*keep, "role", F.explode(F.sequence("a", "b")).alias(date), F.col("b").alias("role_end"))


def tag(df: DataFrame, folds: DataFrame, date: str) -> DataFrame:
    """Panel rows once per (fold, role) that holds their date; an equi-join on the day."""
    return df.join(role_days(folds, date), date)


def nested_folds(calendar: DataFrame, outer: DataFrame, date: str, train: int, test: int, step: int, purge: int, embargo: int) -> DataFrame:
    """Inner folds inside each outer training range."""
    days = role_days(outer.withColumnRenamed("fold", "outer_fold"), date, ["outer_fold"]).where("role = 'train'")
    inner = calendar.select(date).distinct().join(days.select("outer_fold", date), date)
    return purged_folds(inner, date, train, test, step, purge, embargo, by=["outer_fold"])


def thirds(calendar: DataFrame, date: str) -> DataFrame:
    """Development, validation and outer thirds with a purge day before each boundary."""
    d = calendar.select(date).distinct()
    d = d.withColumns({"_i": F.row_number().over(Window.orderBy(date)), "_n": F.count("*").over(Window.partitionBy())})
    a, b = F.floor(F.col("_n") / 3), F.floor(F.col("_n") * 2 / 3)
    part = (
        F.when((F.col("_i") == a) | (F.col("_i") == b), "purge").when(F.col("_i") < a, "development")
        .when(F.col("_i") < b, "validation").otherwise("outer_exploratory")
    )
    return d.select(date, part.alias("part"))


def gap_minutes(folds: DataFrame, sessions: DataFrame, required: int) -> DataFrame:
    """Trading minutes between train end and test start per fold, against a minimum."""
    gaps = folds.select("fold", F.explode(F.expr("sequence(date_add(train_end, 1), date_sub(test_start, 1))")).alias("session_date"))
    j = gaps.join(sessions.select("session_date", "minutes"), "session_date", "left")
    g = j.groupBy("fold").agg(F.coalesce(F.sum("minutes"), F.lit(0)).alias("gap_minutes"))
    return g.withColumn("sufficient", F.col("gap_minutes") >= required)


def choose_by_inner(inner: DataFrame, outer: DataFrame, score: str) -> DataFrame:
    """Per outer fold the candidate with the best mean inner score, with its outer metrics."""
    m = inner.groupBy("outer_fold", "candidate").agg(F.avg(score).alias("inner_score"))
    w = Window.partitionBy("outer_fold").orderBy(F.desc("inner_score"), "candidate")
    best = m.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
    return best.join(outer, ["outer_fold", "candidate"])
