"""Session-anchored bars, multi-interval fan-out and bar-level summaries.

min_by/max_by over plain columns, extremes and sums all combine before the shuffle, so a
third of the rows in one asset costs no more than the same rows spread out.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketloom.operators.chunks import running_total
from marketloom.operators.sets import tagged_union


def ohlcv(order: str, price: str | None = None) -> list[Column]:
    """Open, high, low, close, volume of ordered rows (bars, or ticks of ``price``)."""
    o, h, lo, c = (price,) * 4 if price else ("open", "high", "low", "close")
    return [
        F.min_by(o, order).alias("open"),
        F.max(h).alias("high"),
        F.min(lo).alias("low"),
        F.max_by(c, order).alias("close"),
        F.sum("volume").alias("volume"),
        F.count("*").alias("rows"),
    ]


def session_bars(df: DataFrame, width: int, by: Sequence[str] = ("asset", "session_date"), slot: str = "slot") -> DataFrame:
    """Bars of ``width`` base slots anchored at the open; partial buckets stay visible."""
    g = df.groupBy(*by, F.floor(F.col(slot) / width).alias("bucket")).agg(*ohlcv(slot))
    return g.withColumns(
        {
            "bar_start": F.col("bucket") * width,
            "bar_end": (F.col("bucket") + 1) * width,
            "coverage": F.col("rows") / width,
            "is_complete": F.col("rows") == width,
        }
    )


def multi_interval(df: DataFrame, widths: Sequence[int], by: Sequence[str] = ("asset", "session_date"), slot: str = "slot") -> DataFrame:
    """Several widths from one scan: each row is replicated per width before one grouping."""
    d = df.withColumn("width", F.explode(F.array(*[F.lit(int(w)) for w in widths])))
    g = d.groupBy(*by, "width", F.floor(F.col(slot) / F.col("width")).alias("bucket")).agg(*ohlcv(slot))
    return g.withColumn("is_complete", F.col("rows") == F.col("width"))


def slices(bars: DataFrame, labels: DataFrame, cells: dict[str, tuple[int, int]], keys: Sequence[str]) -> DataFrame:
    """Named slices: bars of one width with labels of one horizon, stacked."""
    parts = {
        name: bars.where(F.col("width") == w).join(labels.where(F.col("horizon") == h), list(keys), "left")
        for name, (w, h) in cells.items()
    }
    return tagged_union(parts, "slice")


def liquidity_profile(df: DataFrame, by: str, day: str, price: str, volume: str, order: str) -> DataFrame:
    """Daily turnover and last price per asset, then exact medians over days."""
    d = df.groupBy(by, day).agg(F.sum(F.col(price) * F.col(volume)).alias("turnover"), F.max_by(price, order).alias("last_price"))
    return d.groupBy(by).agg(
        F.count("*").alias("days"), F.median("turnover").alias("median_turnover"), F.median("last_price").alias("median_price")
    )


def session_endpoints(df: DataFrame, by: Sequence[str], slot: str, first_by: int, last_from: int, minimum: int) -> DataFrame:
    """First open and last close per session, only where both ends are really covered."""
    g = df.groupBy(*by).agg(
        F.min_by("open", slot).alias("_o"), F.max_by("close", slot).alias("_c"), F.min(slot).alias("_a"), F.max(slot).alias("_b"), F.count("*").alias("rows")
    )
    ok = (F.col("_a") <= first_by) & (F.col("_b") >= last_from) & (F.col("rows") >= minimum)
    return g.select(*by, "rows", F.when(ok, F.col("_o")).alias("first_open"), F.when(ok, F.col("_c")).alias("last_close"))


def exact_quantiles(df: DataFrame, by: Sequence[str], value: str, points: Sequence[float]) -> DataFrame:
    """Linear-interpolated quantiles (Type 7) per group, exact for groups of any size.

    ``percentile`` would hold all distinct values of a group in one task. Here values are
    counted, the counts run up over ranges of values that hold equally many of them, and each
    quantile picks the two values that hold its neighbouring ranks.
    """
    c = df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("_v")).agg(F.count("*").alias("_c"))
    s = c.groupBy(*by).agg(F.sum("_c").alias("_n"))
    r = running_total(c, by, ["_v"], "_c", "_cum").join(s, list(by))

    def at(rank: Column) -> Column:
        return F.max(F.when((F.col("_cum") - F.col("_c") <= rank) & (rank < F.col("_cum")), F.col("_v")))

    out = []
    for p in points:
        h = (F.col("_n") - 1) * F.lit(float(p))
        below = F.floor(h)
        a, b = at(below), at(F.least(below + 1, F.col("_n") - 1))
        out.append((a + (b - a) * F.max(h - below)).alias(f"q{int(p * 100):02d}"))
    return r.groupBy(*by).agg(*out)


def compounded(df: DataFrame, by: Sequence[Column | str], ret: str) -> DataFrame:
    """Compound return per group; a product also handles total losses."""
    return df.groupBy(*by).agg((F.product(F.col(ret) + 1) - 1).alias("period_return"), F.count(ret).alias("periods"))


def funnel(df: DataFrame, by: Sequence[str], stages: dict[str, Column], costs: Sequence[str]) -> DataFrame:
    """How many rows reach each stage, and the summed costs."""
    return df.groupBy(*by).agg(*[F.count_if(c).alias(n) for n, c in stages.items()], *[F.sum(c).alias(c) for c in costs])


def reason_histogram(df: DataFrame, codes: str) -> DataFrame:
    return df.select(F.explode(codes).alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


def heat_map(df: DataFrame, dims: Sequence[Column], value: str, totals: bool = False) -> DataFrame:
    """Mean and count over dimensions; ``totals`` adds every subtotal."""
    g = df.cube(*dims) if totals else df.groupBy(*dims)
    return g.agg(F.avg(value).alias("mean"), F.count(value).alias("n"))


def dimensions(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Distinct members of each dimension with counts, from one scan."""
    pairs = F.array(*[F.struct(F.lit(c).alias("dimension"), F.col(c).cast("string").alias("member")) for c in columns])
    return df.select(F.explode(pairs).alias("p")).groupBy("p.dimension", "p.member").agg(F.count("*").alias("rows"))


def fold_rollup(df: DataFrame, by: Sequence[str], value: str, valid: Column) -> DataFrame:
    """Folds to candidates: NULL folds are skipped by the mean but fail validity."""
    return df.groupBy(*by).agg(
        F.avg(value).alias("mean"),
        F.min(value).alias("worst"),
        F.max(value).alias("best"),
        F.count("*").alias("folds"),
        F.count_if(valid).alias("valid_folds"),
    )


def weighted_fill(df: DataFrame, by: Sequence[str], quantity: str, price: str) -> DataFrame:
    """Volume-weighted price; no quantity gives NULL."""
    q = F.sum(quantity)
    return df.groupBy(*by).agg(q.alias("quantity"), F.try_divide(F.sum(F.col(quantity) * F.col(price)), q).alias("vwap"))


def catalog_rollup(programs: DataFrame, validations: DataFrame, reserves: DataFrame) -> DataFrame:
    """Programs with their last validation and reserve; stray validations stay as rows.

    programs: program_id; validations: program_id, evidence_id, passed; reserves: program_id, status.
    """
    last = validations.groupBy("program_id").agg(F.max(F.struct("evidence_id", "passed")).alias("v"))
    last = last.select("program_id", F.col("v.evidence_id").alias("evidence_id"), F.col("v.passed").alias("passed"))
    j = programs.withColumn("_p", F.lit(True)).join(last, "program_id", "full_outer").join(reserves, "program_id", "left")
    stage = (
        F.when(F.col("_p").isNull(), "UNMATCHED_VALIDATION").when(F.col("evidence_id").isNull(), "NOT_VALIDATED")
        .when(~F.col("passed"), "VALIDATION_FAILED").when(F.col("status").isNull(), "READY_FOR_RESERVE").otherwise("RESERVE_USED")
    )
    return j.select("program_id", "evidence_id", "status", stage.alias("stage"))


def run_summary(df: DataFrame, by: Sequence[str], flags: dict[str, Column]) -> DataFrame:
    """Counts per flag and their rates."""
    g = df.groupBy(*by).agg(F.count("*").alias("total"), *[F.count_if(c).alias(n) for n, c in flags.items()])
    return g.withColumns({f"{n}_rate": F.try_divide(F.col(n), F.col("total")) for n in flags})
