"""Row validity, duplicates, conflicts, profiles, reconciliations and gates.

Every check is a partially aggregated grouping, so one key that holds a large share of
the rows is reduced on the map side and never gathered as a group of rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketloom.functions.numeric import reasons
from marketloom.operators.chunks import running_total, with_lookback
from marketloom.operators.resample import exact_quantiles

OHLCV = ("open", "high", "low", "close", "volume")


def valid_identity(asset: str = "asset", ts: str = "ts") -> Column:
    return F.col(ts).isNotNull() & F.col(asset).isNotNull() & (F.trim(F.col(asset)) != "")


def valid_prices() -> Column:
    o, h, lo, c = (F.col(x) for x in OHLCV[:4])
    present = o.isNotNull() & h.isNotNull() & lo.isNotNull() & c.isNotNull()
    positive = (o > 0) & (h > 0) & (lo > 0) & (c > 0)
    ordered = (h >= F.greatest(o, lo, c)) & (lo <= F.least(o, h, c))
    return F.coalesce(present & positive & ordered, F.lit(False))


def valid_volume() -> Column:
    return F.coalesce(F.col("volume") >= 0, F.lit(False))


def valid_bars(df: DataFrame, asset: str = "asset", ts: str = "ts") -> DataFrame:
    """Keep rows that satisfy every bar invariant; nothing is repaired."""
    return df.where(valid_identity(asset, ts) & valid_prices() & valid_volume())


def collapse_exact(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Full-row duplicates become one row."""
    return df.select(*columns).distinct()


def _extremes(columns: Sequence[str], counts: bool = True) -> list[Column]:
    out = [F.count("*").alias("_n")]
    for c in columns:
        out += [F.min(c).alias(f"_lo_{c}"), F.max(c).alias(f"_hi_{c}")]
        if counts:
            out.append(F.count(c).alias(f"_k_{c}"))
    return out


def _uniform(columns: Sequence[str]) -> Column:
    """One content per key: no column has two values, or a value beside a NULL."""
    ok = F.lit(True)
    for c in columns:
        ok = ok & F.col(f"_lo_{c}").eqNullSafe(F.col(f"_hi_{c}"))
        ok = ok & ((F.col(f"_k_{c}") == 0) | (F.col(f"_k_{c}") == F.col("_n")))
    return ok


def quarantine_conflicts(
    df: DataFrame, keys: Sequence[str], values: Sequence[str] = OHLCV
) -> DataFrame:
    """One row per key whose rows all agree; keys with differing content vanish.

    Extremes of plain columns stay in the hash aggregate, so neither a distinct pass nor
    a window over the key is needed. Judged on all rows: filter validity afterwards.
    """
    g = df.groupBy(*keys).agg(*_extremes(values)).where(_uniform(values))
    return g.select(*keys, *[F.col(f"_lo_{c}").alias(c) for c in values])


def clean_bars(df: DataFrame, asset: str = "asset", ts: str = "ts") -> DataFrame:
    """Conflicts out first, then invalid rows: a bad row can quarantine a good one."""
    return valid_bars(quarantine_conflicts(df, [asset, ts]), asset, ts)


def corpus_summary(df: DataFrame, asset: str = "asset", ts: str = "ts") -> DataFrame:
    """One row of counts: rows, assets, time range, duplicates, invalid rows.

    Rolled up key -> asset -> total from a single scan.
    """
    uniform = F.lit(True)
    for c in OHLCV:
        uniform = uniform & F.col(f"_lo_{c}").eqNullSafe(F.col(f"_hi_{c}"))
    flagged = df.select(
        asset,
        ts,
        *OHLCV,
        (~valid_identity(asset, ts)).cast("bigint").alias("_bad_id"),
        (~valid_prices()).cast("bigint").alias("_bad_px"),
        (~valid_volume()).cast("bigint").alias("_bad_vol"),
    )
    per_key = flagged.groupBy(asset, ts).agg(
        *_extremes(OHLCV, counts=False),
        F.sum("_bad_id").alias("_bad_id"),
        F.sum("_bad_px").alias("_bad_px"),
        F.sum("_bad_vol").alias("_bad_vol"),
    )
    dup = F.col("_n") > 1

    def total(cond: Column, what: Column) -> Column:
        return F.sum(F.when(cond, what).otherwise(F.lit(0)).cast("bigint"))

    one = F.lit(1)
    per_asset = per_key.groupBy(asset).agg(
        F.sum("_n").alias("row_count"),
        F.min(F.unix_timestamp(ts)).alias("min_epoch"),
        F.max(F.unix_timestamp(ts)).alias("max_epoch"),
        total(dup, one).alias("duplicate_keys"),
        total(dup & uniform, one).alias("exact_duplicate_keys"),
        total(dup & ~uniform, one).alias("conflicting_keys"),
        total(dup & uniform, F.col("_n") - 1).alias("exact_extra_rows"),
        total(dup & ~uniform, F.col("_n") - 1).alias("conflicting_extra_rows"),
        F.sum("_bad_id").alias("invalid_identity"),
        F.sum("_bad_px").alias("invalid_prices"),
        F.sum("_bad_vol").alias("invalid_volume"),
    )
    sums = [
        "row_count", "duplicate_keys", "exact_duplicate_keys", "conflicting_keys",
        "exact_extra_rows", "conflicting_extra_rows", "invalid_identity", "invalid_prices",
        "invalid_volume",
    ]
    return per_asset.agg(
        F.count(asset).alias("asset_count"),
        F.min("min_epoch").alias("min_epoch"),
        F.max("max_epoch").alias("max_epoch"),
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in sums],
    )


#: Rows of one key up to which a task may gather the key's values.
GATHERED = 10_000


def _variants(column: str, kind: str) -> Column:
    """Distinct values of a column as a set in memory; NULL is one, NaN is one, and -0.0 is 0.0."""
    c = F.col(column)
    missing = (F.count(c) < F.count("*")).cast("bigint")
    if kind not in ("double", "float"):
        return F.size(F.collect_set(c)) + missing
    odd = F.coalesce(F.max(F.isnan(c).cast("bigint")), F.lit(0))
    return F.size(F.collect_set(F.when(c == 0, F.lit(0).cast(kind)).when(~F.isnan(c), c))) + odd + missing


def duplicate_groups(
    df: DataFrame, keys: Sequence[str], values: Sequence[str] = OHLCV, gathered: int = GATHERED
) -> DataFrame:
    """Duplicate keys with the number of variants per column; NULL is a variant.

    Rows move once, to their key, and only the repeated ones are compared there. Keys of more than
    ``gathered`` rows, at most one in so many rows, take another way that spreads a key over tasks.
    """
    rows = df.select(*keys, *values)
    large = df.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > gathered)
    large = F.broadcast(large.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]))
    same = reduce(and_, [rows[k].eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)])
    kinds = dict(rows.dtypes)
    few = rows.join(large, same, "left_anti").withColumn("_n", F.count("*").over(Window.partitionBy(*keys)))
    few = few.where("_n > 1").groupBy(*keys).agg(
        F.count("*").alias("group_rows"),
        *[_variants(c, kinds[c]).cast("bigint").alias(f"{c}_variants") for c in values],
    )
    many = rows.join(large, same, "left_semi").groupBy(*keys).agg(
        F.count("*").alias("group_rows"),
        *[
            (F.count_distinct(c) + (F.count(c) < F.count("*")).cast("bigint")).alias(f"{c}_variants")
            for c in values
        ],
    )
    conflicting = reduce(or_, [F.col(f"{c}_variants") > 1 for c in values])
    return few.unionByName(many.where("group_rows > 1")).withColumn("conflicting", conflicting)


def worst_conflicts(groups: DataFrame, keys: Sequence[str], limit: int) -> DataFrame:
    """The ``limit`` largest conflicting groups, ties broken by key."""
    return (
        groups.where("conflicting")
        .orderBy(F.desc("group_rows"), *keys)
        .limit(limit)
    )


def outside_hours(
    df: DataFrame,
    zone: str = "UTC",
    regular: tuple[str, str] = ("09:30", "16:00"),
    extended: tuple[str, str] = ("04:00", "20:00"),
    ts: str = "ts",
) -> DataFrame:
    """Counts of observations outside regular and extended local hours."""
    clock = F.date_format(F.from_utc_timestamp(ts, zone), "HH:mm")
    t = df.select("asset", clock.alias("_c"))

    def outside(band: tuple[str, str]) -> Column:
        return F.count_if((F.col("_c") < band[0]) | (F.col("_c") >= band[1]))

    return t.groupBy("asset").agg(
        F.count("*").alias("observations"),
        outside(regular).alias("outside_regular"),
        outside(extended).alias("outside_extended"),
    )


def certify(metrics: DataFrame, rules: Sequence[tuple[Column, str]]) -> DataFrame:
    """Add ``blockers`` (codes whose condition holds) and ``passed``."""
    out = metrics.withColumn("blockers", reasons(*rules))
    return out.withColumn("passed", F.size("blockers") == 0)


def master_profile(master: DataFrame, placeholder: str = "1970-01-01") -> DataFrame:
    """Counts over a security master (asset, list_date, delist_date, status)."""
    per = master.groupBy("asset").agg(
        F.count("*").alias("n"),
        F.count_if(F.col("list_date") == F.lit(placeholder).cast("date")).alias("ph"),
        F.count_if(F.col("list_date").isNull()).alias("nolist"),
        F.count("delist_date").alias("delisted"),
    )
    return per.agg(
        F.sum("n").alias("row_count"),
        F.count("*").alias("asset_count"),
        F.sum(F.col("n") - 1).alias("duplicate_rows"),
        F.sum("ph").alias("placeholder_list_dates"),
        F.sum("nolist").alias("null_list_dates"),
        F.sum("delisted").alias("delisted"),
    )


def daily_profile(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Counts over a daily table: duplicates, prices, OHLC order, negative flow."""
    o, h, lo, c = (F.col(x) for x in OHLCV[:4])
    positive = (o > 0) & (h > 0) & (lo > 0) & (c > 0)
    disordered = positive & ((h < F.greatest(o, lo, c)) | (lo > F.least(o, h, c)))
    per = df.groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.count_if(~positive).alias("nonpos"),
        F.count_if(disordered).alias("dis"),
        F.count_if(F.col("volume") < 0).alias("neg"),
    )
    return per.agg(
        F.sum("n").alias("row_count"),
        F.count("*").alias("key_count"),
        F.count_if(F.col("n") > 1).alias("duplicate_keys"),
        F.sum("nonpos").alias("nonpositive_prices"),
        F.sum("dis").alias("disordered_ohlc"),
        F.sum("neg").alias("negative_flow"),
    )


def clock_sequence(df: DataFrame, keys: Sequence[str], stamp: Column, expected: Sequence[str]) -> DataFrame:
    """Per group the stamps seen against the expected ones: match, missing, extra.

    Distinct stamps per group are bounded by the minutes of a day.
    """
    want = F.array(*[F.lit(x) for x in expected])
    seen = df.select(*keys, stamp.alias("_s")).distinct()
    g = seen.groupBy(*keys).agg(F.sort_array(F.collect_set("_s")).alias("_seen"))
    return g.select(
        *keys,
        (F.col("_seen") == want).alias("matches"),
        F.sort_array(F.array_except(want, F.col("_seen"))).alias("missing"),
        F.sort_array(F.array_except(F.col("_seen"), want)).alias("extra"),
    )


def reconcile_daily(
    intraday: DataFrame, daily: DataFrame, tolerances: Mapping[str, float], keys: Sequence[str]
) -> DataFrame:
    """Daily bars against the roll-up of intraday rows, one verdict per column.

    ``intraday`` carries ``ts`` and ``price, size`` columns.
    """
    rolled = intraday.groupBy(*keys).agg(
        F.min_by("price", "ts").alias("open_i"),
        F.max("price").alias("high_i"),
        F.min("price").alias("low_i"),
        F.max_by("price", "ts").alias("close_i"),
        F.sum("size").cast("double").alias("volume_i"),
    )
    joined = daily.join(rolled, list(keys), "left")
    checks = [
        F.coalesce(F.abs(F.col(c) - F.col(f"{c}_i")) <= F.lit(tol), F.lit(False)).alias(f"{c}_ok")
        for c, tol in tolerances.items()
    ]
    return joined.select(*keys, F.col("open_i").isNotNull().alias("covered"), *checks)


def is_no_trade_placeholder(previous_close: str = "pre_close", amount: str = "amount") -> Column:
    """A row that encodes a suspension: no prices, no flow, close carried forward."""
    zero = (
        (F.col("open") == 0)
        & (F.col("high") == 0)
        & (F.col("low") == 0)
        & (F.col("volume") == 0)
        & (F.col(amount) == 0)
    )
    carried = (
        (F.col("close") > 0)
        & (F.col(previous_close) > 0)
        & (F.abs(F.col("close") - F.col(previous_close)) <= 1e-9)
    )
    return F.coalesce(zero & carried, F.lit(False))


def provider_diff(left: DataFrame, right: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Coverage and value differences of two providers; keys are unique per side."""
    lhs = left.select(*keys, F.col(value).alias("_l"), F.lit(1).alias("_inl"))
    rhs = right.select(*keys, F.col(value).alias("_r"), F.lit(1).alias("_inr"))
    j = lhs.join(rhs, list(keys), "full_outer")
    gap = F.abs(F.col("_l") - F.col("_r"))
    scale = F.greatest(F.abs("_l"), F.abs("_r"))
    return j.agg(
        F.count("_inl").alias("left_rows"),
        F.count("_inr").alias("right_rows"),
        F.count_if(F.col("_inr").isNull()).alias("left_only"),
        F.count_if(F.col("_inl").isNull()).alias("right_only"),
        F.count_if(F.col("_inl").isNotNull() & F.col("_inr").isNotNull()).alias("common"),
        F.max(gap).alias("max_abs_diff"),
        F.max(F.try_divide(gap, scale)).alias("max_rel_diff"),
    )


def ingest_issues(df: DataFrame, expected_assets: DataFrame, asset: str = "asset", ts: str = "ts",
                  available: str = "available_at") -> DataFrame:
    """Issue counts per asset and code: DUPLICATE, CLOCK, MISSING_ASSET, CALENDAR_GAP.

    Rows shrink to one per (asset, ts) first. The common calendar is compared by counts
    (dates of the union minus dates of the asset), so no grid of pairs is built.
    """
    key = df.groupBy(asset, ts).agg(F.count("*").alias("n"), F.max(available).alias("av"))
    dup = (
        key.where("n > 1").groupBy(asset).agg(F.count("*").alias("issues"))
        .withColumn("code", F.lit("DUPLICATE"))
    )

    def previous(frame: DataFrame, part: Sequence[str]) -> DataFrame:
        return frame.withColumn("prev", F.lag("av").over(Window.partitionBy(*part).orderBy(ts)))

    clock = (
        with_lookback(key, [asset], [ts], 1, previous)
        .where(F.col("av") <= F.col("prev"))
        .groupBy(asset).agg(F.count("*").alias("issues"))
        .withColumn("code", F.lit("CLOCK"))
    )
    missing = (
        expected_assets.select(asset).join(key.select(asset).distinct(), asset, "left_anti")
        .select(asset, F.lit(1).cast("bigint").alias("issues"), F.lit("MISSING_ASSET").alias("code"))
    )
    total = key.select(ts).distinct().agg(F.count("*").alias("all_ts"))
    per = key.groupBy(asset).agg(F.count("*").alias("own"))
    gap = (
        per.join(F.broadcast(total))
        .where(F.col("own") < F.col("all_ts"))
        .select(asset, (F.col("all_ts") - F.col("own")).alias("issues"), F.lit("CALENDAR_GAP").alias("code"))
    )
    out = dup.unionByName(clock).unionByName(missing).unionByName(gap)
    return out.select(asset, "code", "issues")


def clock_offsets(
    left: DataFrame, right: DataFrame, offsets: Sequence[int], step_seconds: int, by: str = "asset"
) -> DataFrame:
    """Best whole-step clock offset per asset and the price gap at that offset.

    Both sides carry (asset, ts, close) with one row per key. Only the right side is
    replicated, once per candidate offset, and the join stays an equi-join.
    """
    lhs = left.select(by, F.unix_timestamp("ts").alias("e"), F.col("close").alias("cl"))
    rhs = right.select(
        by,
        F.unix_timestamp("ts").alias("e0"),
        F.col("close").alias("cr"),
        F.explode(F.array(*[F.lit(int(k)) for k in offsets])).alias("offset_steps"),
    ).select(by, "cr", "offset_steps", (F.col("e0") + F.col("offset_steps") * step_seconds).alias("e"))
    gap = F.abs(F.col("cl") / F.col("cr") - 1)
    hits = (
        lhs.join(rhs, [by, "e"])
        .groupBy(by, "offset_steps")
        .agg(
            F.count("*").alias("overlap"),
            F.median(gap).alias("median_gap"),
            F.max(gap).alias("max_gap"),
        )
    )
    w = Window.partitionBy(by).orderBy(F.desc("overlap"), F.abs("offset_steps"), "offset_steps")
    best = hits.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
    sizes = left.groupBy(by).agg(F.count("*").alias("nl")).join(
        right.groupBy(by).agg(F.count("*").alias("nr")), by
    )
    return best.join(sizes, by).select(
        by,
        "offset_steps",
        "overlap",
        (F.col("overlap") / F.least("nl", "nr")).alias("overlap_ratio"),
        "median_gap",
        "max_gap",
    )


def broker_offset(df: DataFrame, by: str, offset: str, quantum: float, tolerance: float) -> DataFrame:
    """Median clock offset per broker rounded to ``quantum`` and its worst residual."""
    middle = exact_quantiles(df, [by], offset, [0.5]).withColumnRenamed("q50", "median_offset")
    med = df.groupBy(by).agg(
        F.count("*").alias("observations"), F.min(offset).alias("_lo"), F.max(offset).alias("_hi")
    )
    med = med.join(middle, by, "left")
    snap = F.round(F.col("median_offset") / quantum) * quantum
    out = med.withColumn("clock_offset", snap)
    worst = F.greatest(F.abs(F.col("_hi") - F.col("clock_offset")), F.abs(F.col("_lo") - F.col("clock_offset")))
    out = out.withColumn("max_residual", worst).drop("_lo", "_hi")
    return certify(out, [(F.col("max_residual") > tolerance, "CLOCK_RESIDUAL")])


def quote_quality(
    df: DataFrame, max_spread_bps: float, max_age: float, expected_delay: float
) -> DataFrame:
    """Spread, age and reason codes per quote; a merely stale quote may count as delayed.

    Columns: bid, ask, sampled_at, retrieved_at.
    """
    mid = (F.col("bid") + F.col("ask")) / 2
    spread = F.when(mid > 0, (F.col("ask") - F.col("bid")) / mid * 10000)
    age = F.unix_timestamp("retrieved_at") - F.unix_timestamp("sampled_at")
    out = df.withColumns({"spread_bps": spread, "age": age.cast("double")})
    out = out.withColumn(
        "codes",
        reasons(
            (F.col("bid") <= 0, "NONPOSITIVE_BID"),
            (F.col("ask") < F.col("bid"), "CROSSED"),
            (F.col("spread_bps") > max_spread_bps, "SPREAD_WIDE"),
            (F.col("age") > max_age, "STALE"),
            (F.col("age") < 0, "FUTURE"),
        ),
    )
    only_stale = (F.size("codes") == 1) & F.array_contains("codes", "STALE")
    delayed = only_stale & (F.abs(F.col("age") - expected_delay) <= max_age)
    return out.withColumn(
        "status",
        F.when(F.size("codes") == 0, "USABLE").when(delayed, "DELAYED_REFERENCE").otherwise("REJECTED"),
    )


def coverage_inventory(df: DataFrame, calendar: DataFrame, start: str, end: str) -> DataFrame:
    """Asset x month coverage: sessions seen, complete sessions, missing sessions.

    ``df`` has (asset, session_date, observed); ``calendar`` (session_date, expected).
    The grid comes from exploding each asset's months, so empty cells are zero rows.
    """
    per_session = (
        df.groupBy("asset", "session_date").agg(F.sum("observed").alias("observed"))
        .join(calendar, "session_date")
        .select(
            "asset",
            F.trunc("session_date", "month").alias("month"),
            (F.col("observed") >= F.col("expected")).cast("bigint").alias("full"),
        )
    )
    cells = per_session.groupBy("asset", "month").agg(
        F.count("*").alias("seen"), F.sum("full").alias("complete")
    )
    months = F.sequence(
        F.trunc(F.lit(start).cast("date"), "month"),
        F.trunc(F.lit(end).cast("date"), "month"),
        F.expr("INTERVAL 1 MONTH"),
    )
    grid = cells.select("asset").distinct().select("asset", F.explode(months).alias("month"))
    expected = calendar.groupBy(F.trunc("session_date", "month").alias("month")).agg(
        F.count("*").alias("expected_sessions")
    )
    zero = F.lit(0).cast("bigint")
    return (
        grid.join(cells, ["asset", "month"], "left")
        .join(expected, "month", "left")
        .select(
            "asset",
            "month",
            F.coalesce("seen", zero).alias("seen_sessions"),
            F.coalesce("complete", zero).alias("complete_sessions"),
            F.coalesce("expected_sessions", zero).alias("expected_sessions"),
        )
    )


def common_dates(df: DataFrame, date: str, asset: str, members: int) -> DataFrame:
    """Dates on which every one of ``members`` assets appears."""
    if members <= 0:
        return df.select(date).where(F.lit(False))
    return (
        df.select(date, asset).distinct().groupBy(date).agg(F.count("*").alias("n"))
        .where(F.col("n") == members).select(date)
    )


def panel_summary(df: DataFrame, ts: str, ready: Column, labelled: Column, minimum: int) -> DataFrame:
    """Breadth per formation rolled up to one row."""
    per = df.groupBy(ts).agg(
        F.count("*").alias("n"),
        F.count_if(ready).alias("ready"),
        F.count_if(ready & labelled).alias("joint"),
    )
    return per.agg(
        F.count("*").alias("formations"),
        F.sum("n").alias("rows"),
        F.min("joint").alias("min_joint"),
        F.max("joint").alias("max_joint"),
        F.count_if(F.col("joint") >= minimum).alias("broad_formations"),
        F.count_if((F.col("joint") < minimum) & (F.col("ready") >= minimum)).alias("label_short"),
    )


def price_authority(requests: DataFrame, events: DataFrame, coverage: DataFrame) -> DataFrame:
    """May a raw price be used over [start, end] given the corporate-action record?

    requests: request_id, asset, start, end, cross_session
    events:   asset, effective_at          coverage: asset, covered_from, covered_to

    Events inside an interval are counted as a difference of running totals taken at the
    interval's two ends: a union and a running sum instead of a range join.
    """
    ends = requests.select(
        "asset", "request_id",
        F.explode(
            F.array(
                F.struct(F.col("start").alias("t"), F.lit(-1).alias("side")),
                F.struct(F.col("end").alias("t"), F.lit(1).alias("side")),
            )
        ).alias("p"),
    ).select("asset", "request_id", "p.t", "p.side", F.lit(0).cast("bigint").alias("hits"))
    marks = (
        events.groupBy("asset", F.col("effective_at").alias("t")).agg(F.count("*").alias("hits"))
        .withColumn("side", F.lit(0)).withColumn("request_id", F.lit(None).cast("bigint"))
    )
    # At equal times a start (-1) comes before the event and an end (+1) after it.
    run = running_total(
        ends.unionByName(marks), ["asset"], ["t", "side"], "hits", "seen"
    ).where("side <> 0")
    inside = run.groupBy("request_id").agg(F.sum(F.col("seen") * F.col("side")).alias("events_inside"))
    out = requests.join(inside, "request_id", "left").join(coverage, "asset", "left")
    covered = (F.col("covered_from") <= F.col("start")) & (F.col("end") <= F.col("covered_to"))
    cross = F.col("cross_session")
    known = F.col("covered_from").isNotNull()
    out = out.withColumn(
        "blockers",
        reasons(
            (cross & ~known, "COVERAGE_UNAVAILABLE"),
            (cross & known & ~covered, "INTERVAL_NOT_COVERED"),
            (cross & known & covered & (F.col("events_inside") > 0), "RAW_PRICE_DISCONTINUITY"),
        ),
    )
    return out.select("request_id", "asset", "events_inside", "blockers", (F.size("blockers") == 0).alias("allowed"))


def overlay(base: DataFrame, extra: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Fill gaps of ``base`` from ``extra``; two differing values are a conflict."""
    side = extra.select(key, *[F.col(c).alias(f"_x_{c}") for c in columns])
    j = base.join(side, key, "left")
    conflict = F.lit(False)
    for c in columns:
        conflict = conflict | F.coalesce(F.col(c) != F.col(f"_x_{c}"), F.lit(False))
    return j.select(
        key, *[F.coalesce(c, f"_x_{c}").alias(c) for c in columns], conflict.alias("conflict")
    )
