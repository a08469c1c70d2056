"""SQL twins of the panel adapters, shared as common table expressions."""

from __future__ import annotations

PANELS = """WITH ticks AS (
  SELECT event_type AS asset, ts, value AS price,
         CAST(json_extract_string(props, '$.k') AS BIGINT) AS size, event_id, user_id
  FROM events),
sessions AS (
  SELECT CAST(d AS DATE) AS session_date, d + INTERVAL 9 HOUR AS open_at,
         CASE WHEN isodow(d) = 5 THEN d + INTERVAL 13 HOUR ELSE d + INTERVAL 17 HOUR END AS close_at,
         isodow(d) = 5 AS is_half_day
  FROM (SELECT unnest(generate_series((SELECT date_trunc('day', min(ts)) FROM events)::TIMESTAMP, (SELECT date_trunc('day', max(ts)) FROM events)::TIMESTAMP, INTERVAL 1 DAY)) AS d)),
hourly AS (
  SELECT asset, CAST(ts AS DATE) AS session_date, CAST(hour(ts) - 9 AS BIGINT) AS slot,
         arg_min(price, ts) AS open, max(price) AS high, min(price) AS low,
         arg_max(price, ts) AS close, CAST(sum(size) AS DOUBLE) AS volume, count(*) AS n
  FROM ticks WHERE hour(ts) >= 9 AND hour(ts) < CASE WHEN isodow(ts) = 5 THEN 13 ELSE 17 END GROUP BY 1, 2, 3),
vendor AS (
  SELECT 'S' || CAST(l_suppkey AS VARCHAR) AS asset, l_shipdate AS ts,
         l_extendedprice / l_quantity AS open,
         l_extendedprice / l_quantity * (1 + l_tax) AS high,
         l_extendedprice / l_quantity * (1 - l_tax) AS low,
         l_extendedprice / l_quantity * (1 - l_discount) AS close,
         l_quantity - 2 AS volume
  FROM lineitem),
daily AS (
  SELECT p_brand AS asset, CAST(l_shipdate AS DATE) AS d,
         round(avg(l_extendedprice / l_quantity), 8) AS px,
         max(l_extendedprice / l_quantity) AS hi, min(l_extendedprice / l_quantity) AS lo,
         sum(l_quantity) AS vol, count(*) AS n
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2),
weekly AS (
  SELECT asset, CAST(date_trunc('week', d) AS DATE) AS wk,
         CAST(year(date_trunc('week', d)) AS BIGINT) AS yr,
         arg_min(px, d) AS open, max(hi) AS high, min(lo) AS low, arg_max(px, d) AS close,
         sum(vol) AS volume, count(*) AS days, count(*) >= 3 AS is_complete
  FROM daily GROUP BY 1, 2, 3)"""


def pub(body: str, doubles: str = "", dates: str = "", stamps: str = "", digits: int = 6) -> str:
    """Round doubles and render dates and timestamps as text, like ``published``."""
    parts = [f"round({c}, {digits}) + 0.0 AS {c}" for c in doubles.split()]
    parts += [f"strftime({c}, '%Y-%m-%d') AS {c}" for c in dates.split()]
    parts += [f"strftime({c}, '%Y-%m-%d %H:%M:%S') AS {c}" for c in stamps.split()]
    replace = f" REPLACE ({', '.join(parts)})" if parts else ""
    return f"SELECT *{replace} FROM ({body}) AS q"


# Tail probabilities as SQL text: the same nested sums, term by term, as ``functions.tails``.


def _down(n: int | str) -> str:
    return f"list_transform(range(CAST({n} AS BIGINT), 0, -1), lambda i: CAST(i AS DOUBLE))"


def _fold(n: int | str, start: str, step: str) -> str:
    """Inside-out sum; ``step`` speaks of the sum so_far and the term nth."""
    return f"list_reduce(list_prepend(CAST({start} AS DOUBLE), {_down(n)}), lambda so_far, nth: {step})"


def erfc_sql(x: str) -> str:
    near = f"1 - 2 / sqrt(pi()) * ({x}) * exp(-({x}) * ({x})) * {_fold(60, '1', f'1 + so_far * 2 * ({x}) * ({x}) / (2 * nth + 1)')}"
    far = f"exp(-({x}) * ({x})) / (sqrt(pi()) * {_fold(60, x, f'({x}) + nth / 2 / so_far')})"
    return f"CASE WHEN ({x}) < 2.5 THEN {near} ELSE {far} END"


def normal_upper_sql(z: str) -> str:
    half = f"({erfc_sql(f'abs({z}) / sqrt(2.0)')}) / 2"
    return f"(CASE WHEN {z} >= 0 THEN {half} ELSE 1 - {half} END)"


def normal_quantile_sql(p: str) -> str:
    """For p of at least one half, the case of the expected maximum of several trials."""
    q, t = f"(1 - ({p}))", f"sqrt(-2 * ln(1 - ({p})))"
    guess = f"greatest(0, {t} - (2.515517 + 0.802853 * {t} + 0.010328 * {t} * {t}) / (1 + 1.432788 * {t} + 0.189269 * {t} * {t} + 0.001308 * {t} * {t} * {t}))"

    def better(z: str) -> str:
        e = f"(({erfc_sql('x / sqrt(2.0)')}) / 2 - {q}) * sqrt(2 * pi()) * exp(x * x / 2)"
        return f"list_transform([{z}], lambda x: x + ({e}) / (1 - x * ({e}) / 2))[1]"

    return better(better(guess))


def chi2_upper_sql(stat: str, dof: int) -> str:
    h = f"(({stat}) / 2)"
    if dof % 2 == 0:
        return f"exp(-{h}) * {_fold(dof // 2 - 1, '1', f'1 + so_far * {h} / nth')}"
    rest = f"exp(-{h}) * 2 * sqrt({h}) / sqrt(pi()) * {_fold((dof - 1) // 2 - 1, '1', f'1 + so_far * {h} / (nth + 0.5)')}"
    return f"{erfc_sql(f'sqrt({h})')} + {rest if dof >= 3 else '0'}"


def student_upper_sql(t: str, k: str) -> str:
    """For fewer than 2,000 degrees of freedom."""
    x, c2 = f"abs({t})", f"(({k}) / (({k}) + ({t}) * ({t})))"
    sine = f"({x} / sqrt(({k}) + ({t}) * ({t})))"
    even = f"{sine} * {_fold(f'({k}) // 2 - 1', '1', f'so_far * {c2} * (2 * nth - 1) / (2 * nth) + 1')}"
    more = f"CASE WHEN ({k}) >= 3 THEN {sine} * sqrt({c2}) * {_fold(f'(({k}) - 1) // 2 - 1', '1', f'so_far * {c2} * (2 * nth) / (2 * nth + 1) + 1')} ELSE 0 END"
    odd = f"2 / pi() * (atan({x} / sqrt({k})) + {more})"
    tail = f"greatest((1 - CASE WHEN ({k}) % 2 = 0 THEN {even} ELSE {odd} END) / 2, 0)"
    return f"(CASE WHEN ({t}) >= 0 THEN {tail} ELSE 1 - {tail} END)"
