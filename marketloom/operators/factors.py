"""Factors written as expressions and computed as columns.

    close = field("close")
    factor = zscore(winsor(divide(ret(close, 4), std(ret(close, 2), 8)), 0.05, 0.95))
    out = with_factors(panel, {"momentum": factor}, asset="asset", session="yr", ts="wk")

An expression is checked when it is built (units, window limits). ``with_factors`` adds its
sub-expressions level by level; equal sub-expressions share one column, windows of one
level share one sort, and time windows keep the (asset, session) layout until a
cross-section needs the rows of one timestamp together.

Every level is masked before the next one uses it: short history, an incomplete bar in the
look-back, or a missing number give NULL with a reason code.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field as data_field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketloom.functions.numeric import average_rank, clip, finite, safe_divide
from marketloom.operators import cross, windows

PRICE, VOLUME, NUMBER = "price", "volume", "number"
MAX_WINDOW = 512

# Input fields and their units.
FIELDS = {"open": PRICE, "high": PRICE, "low": PRICE, "close": PRICE, "volume": VOLUME}


@dataclass(frozen=True)
class Factor:
    op: str
    args: tuple["Factor", ...] = ()
    params: tuple = ()
    unit: str = data_field(default=NUMBER, compare=False)

    @property
    def key(self) -> str:
        """Canonical text; arguments of commutative operators are sorted."""
        inner = [a.key for a in self.args]
        if self.op in ("add", "multiply"):
            inner.sort()
        return f"{self.op}({','.join([*inner, *map(repr, self.params)])})"

    @property
    def depth(self) -> int:
        return 1 + max((a.depth for a in self.args), default=-1)

    @property
    def lookback(self) -> int:
        """Bars needed, the current one included."""
        below = max((a.lookback for a in self.args), default=1)
        own = {"lag": lambda: self.params[0]}.get(
            self.op, lambda: self.params[0] - 1 if self.op in ROLLING else 0
        )()
        return below + own

    @property
    def crossed(self) -> bool:
        return self.op in CROSS or any(a.crossed for a in self.args)

    def __add__(self, other: "Factor") -> "Factor":
        return _same_unit("add", self, other)

    def __sub__(self, other: "Factor") -> "Factor":
        return _same_unit("subtract", self, other)

    def __mul__(self, other: "Factor") -> "Factor":
        if NUMBER not in (self.unit, other.unit):
            raise ValueError("one side of a product must be a plain number")
        return Factor("multiply", (self, other), (), self.unit if other.unit == NUMBER else other.unit)

    def __neg__(self) -> "Factor":
        return Factor("negate", (self,), (), self.unit)


ROLLING = ("ret", "logret", "mean", "std", "lowest", "highest")
CROSS = ("rank", "zscore", "winsor", "gate")
MAY_OVERFLOW = ("field", "add", "subtract", "multiply", "divide", "ret", "logret")


def _same_unit(op: str, a: Factor, b: Factor) -> Factor:
    if a.unit != b.unit:
        raise ValueError(f"{op} of {a.unit} and {b.unit}")
    return Factor(op, (a, b), (), a.unit)


def _windowed(op: str, x: Factor, n: int, unit: str, least: int) -> Factor:
    if not least <= n <= MAX_WINDOW:
        raise ValueError(f"{op}: window {n} outside {least}..{MAX_WINDOW}")
    if x.crossed:
        raise ValueError(f"{op}: a time window cannot follow a cross-section")
    return Factor(op, (x,), (n,), unit)


def field(name: str) -> Factor:
    return Factor("field", (), (name,), FIELDS[name])


def const(value: float) -> Factor:
    return Factor("const", (), (float(value),))


def lag(x: Factor, n: int) -> Factor:
    return _windowed("lag", x, n, x.unit, 1)


def ret(x: Factor, width: int) -> Factor:
    return _windowed("ret", x, width, NUMBER, 2)


def logret(x: Factor, width: int) -> Factor:
    return _windowed("logret", x, width, NUMBER, 2)


def mean(x: Factor, width: int) -> Factor:
    return _windowed("mean", x, width, x.unit, 1)


def std(x: Factor, width: int) -> Factor:
    return _windowed("std", x, width, x.unit, 2)


def lowest(x: Factor, width: int) -> Factor:
    return _windowed("lowest", x, width, x.unit, 1)


def highest(x: Factor, width: int) -> Factor:
    return _windowed("highest", x, width, x.unit, 1)


def divide(a: Factor, b: Factor, epsilon: float = 1e-12, fallback: float | None = None) -> Factor:
    unit = NUMBER if a.unit == b.unit else a.unit
    return Factor("divide", (a, b), (epsilon, fallback), unit)


def clipped(x: Factor, low: float, high: float) -> Factor:
    if low >= high:
        raise ValueError("clip bounds must increase")
    return Factor("clip", (x,), (low, high), x.unit)


def rank(x: Factor) -> Factor:
    return Factor("rank", (x,))


def zscore(x: Factor) -> Factor:
    return Factor("zscore", (x,))


def winsor(x: Factor, low: float, high: float) -> Factor:
    return Factor("winsor", (x,), (low, high), x.unit)


def gate(x: Factor, regimes: Sequence[str]) -> Factor:
    """Keep ``x`` only where the panel's ``regime`` column is one of ``regimes``."""
    return Factor("gate", (x,), tuple(sorted(regimes)), x.unit)


def _walk(f: Factor, seen: dict[str, Factor]) -> None:
    for a in f.args:
        _walk(a, seen)
    seen.setdefault(f.key, f)


def with_factors(
    df: DataFrame,
    factors: dict[str, Factor],
    asset: str = "asset",
    session: str | None = "session_date",
    ts: str = "ts",
    complete: str = "is_complete",
    minimum: int = 2,
    reasons: bool = True,
) -> DataFrame:
    """Add one column per factor (and ``<name>_reason``) to a panel of bars."""
    nodes: dict[str, Factor] = {}
    for f in factors.values():
        _walk(f, nodes)
    slot = {key: f"_f{i}" for i, key in enumerate(nodes)}
    by = [asset, session] if session else [asset]
    spans = sorted({n.lookback for n in nodes.values()})
    keep = df.columns
    base = {"_pos": F.row_number().over(windows.along(by, ts))}
    base |= {
        f"_ok{n}": F.min(F.col(complete).cast("int")).over(windows.frame(n, by, ts)) == 1 for n in spans
    }
    out = df.withColumns(base)
    for depth in range(1 + max(n.depth for n in nodes.values())):
        level = {k: n for k, n in nodes.items() if n.depth == depth}
        raw = {}
        for k, n in level.items():
            x = _value(n, [slot[a.key] for a in n.args], by, ts, minimum)
            raw[f"{slot[k]}_x"] = finite(x) if n.op in MAY_OVERFLOW else x
        out = out.withColumns(raw)
        masked: dict[str, Column] = {}
        for k, n in level.items():
            c = slot[k]
            short = F.col("_pos") < n.lookback
            broken = ~F.col(f"_ok{n.lookback}")
            masked[c] = F.when(~short & ~broken, F.col(f"{c}_x"))
            if not reasons:
                continue
            why = F.when(short, "INSUFFICIENT_HISTORY").when(broken, "INCOMPLETE_BAR")
            own = F.when(F.col(f"{c}_x").isNull(), _own_reason(n, [slot[a.key] for a in n.args], ts, minimum))
            masked[f"{c}_r"] = F.coalesce(why, *[F.col(f"{slot[a.key]}_r") for a in n.args], own)
        out = out.withColumns(masked)
    picked = [F.col(slot[f.key]).alias(name) for name, f in factors.items()]
    if reasons:
        picked += [F.col(f"{slot[f.key]}_r").alias(f"{name}_reason") for name, f in factors.items()]
    return out.select(*keep, *picked)


def _own_reason(n: Factor, args: list[str], ts: str, minimum: int) -> Column:
    code = F.lit("NUMERIC_UNAVAILABLE")
    if n.op in ("rank", "zscore", "winsor"):
        narrow = F.count(args[0]).over(Window.partitionBy(ts)) < minimum
        return F.when(narrow, "INSUFFICIENT_CROSS_SECTION").otherwise(code)
    if n.op == "gate":
        return F.lit("REGIME_EXCLUDED")
    return code


def _value(n: Factor, args: list[str], by: list[str], ts: str, minimum: int) -> Column:
    x = F.col(args[0]) if args else None
    y = F.col(args[1]) if len(args) > 1 else None
    p = n.params
    if n.op == "field":
        return F.col(p[0]).cast("double")
    if n.op == "const":
        return F.lit(p[0])
    if n.op in ("add", "subtract", "multiply", "negate"):
        return {"add": lambda: x + y, "subtract": lambda: x - y, "multiply": lambda: x * y, "negate": lambda: -x}[n.op]()
    if n.op == "divide":
        return safe_divide(x, y, p[0], p[1])
    if n.op == "clip":
        return clip(x, p[0], p[1])
    if n.op == "lag":
        return windows.lagged(x, p[0], by, ts)
    if n.op in ROLLING:
        make = {
            "ret": windows.simple_return, "logret": windows.log_return, "mean": windows.rolling_mean,
            "std": windows.rolling_std, "lowest": windows.rolling_min, "highest": windows.rolling_max,
        }[n.op]
        return make(x, p[0], by, ts)
    count = F.count(x).over(Window.partitionBy(ts))
    if n.op == "rank":
        return F.when(count >= max(minimum, 2), (average_rank(x, [ts]) - 1) / (count - 1))
    if n.op == "zscore":
        return cross.zscore_population(x, [ts], minimum)
    if n.op == "winsor":
        return F.when(count >= minimum, cross.winsorized(x, [ts], p[0], p[1]))
    if n.op == "gate":
        return F.when(F.col("regime").isin(list(p)), x)
    raise ValueError(f"unknown factor operator {n.op}")


def catalog() -> dict[str, Factor]:
    """Named factors with fixed windows."""
    close, high, low, volume = field("close"), field("high"), field("low"), field("volume")
    relative = divide(volume, mean(volume, 8))
    bottom = lowest(low, 8)
    place = divide(close - bottom, highest(high, 8) - bottom) - const(0.5)
    return {
        "volatility_scaled_momentum": zscore(winsor(divide(ret(close, 4), std(ret(close, 2), 8)), 0.05, 0.95)),
        "volume_conditioned_reversal": rank(winsor(-ret(close, 3) * relative, 0.05, 0.95)),
        "volume_confirmed_range_location": zscore(winsor(place * relative, 0.05, 0.95)),
    }
