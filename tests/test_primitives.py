from __future__ import annotations

import math
import random

import pytest

from helpers import assert_layout_free
from marketloom.operators.primitives import Primitive, candidate_values, vocabulary

BAR = "asset string, s int, t int, high double, low double, close double, volume double, ok boolean"


def bars(seed=5):
    """Two assets, sessions of uneven length, incomplete bars, flat bars, volumes of zero, missing and negative inputs."""
    rng = random.Random(seed)
    rows = []
    for asset in ("A", "B"):
        t = 0
        for s, n in enumerate((3, 18, 1, 25, 14)):
            for _ in range(n):
                low = rng.uniform(5, 9)
                high = low if rng.random() < 0.1 else low + rng.uniform(0, 2)
                close = rng.choice([low, high, (low + high) / 2])
                volume = 0.0 if rng.random() < 0.6 else float(rng.randrange(1, 9))
                ok = None if rng.random() < 0.02 else rng.random() > 0.05
                if rng.random() < 0.02:
                    close = rng.choice([None, -1.0, 0.0])
                rows.append((asset, s, t, high, low, close, volume, ok))
                t += 1
    return rows


def expected(p: Primitive, history):
    """From the definition, on the bars of one asset up to the current one."""
    if len(history) < p.window:
        return None, "INSUFFICIENT_HISTORY"
    window = history[-p.window :]
    if any(b[1] != window[-1][1] for b in window):
        return None, "CROSS_SESSION_WINDOW"
    if not all(b[7] for b in window):
        return None, "INCOMPLETE_BAR"
    high, low, close, volume = ([b[i] for b in window] for i in (3, 4, 5, 6))
    positive = all(c is not None and c > 0 for c in close)
    if p.kind in ("reversal", "momentum"):
        if any(c is None or c <= 0 for c in (close[0], close[-1])):
            return None, "NUMERIC_UNAVAILABLE"
        r = close[-1] / close[0] - 1
        return (-r if p.kind == "reversal" else r), None
    if p.kind == "range_mean":
        if any(c is None or c == 0 for c in close):
            return None, "NUMERIC_UNAVAILABLE"
        return sum((h - lo) / c for h, lo, c in zip(high, low, close)) / p.window, None
    if p.kind == "return_volatility":
        if not positive:
            return None, "NUMERIC_UNAVAILABLE"
        r = [math.log(b / a) for a, b in zip(close, close[1:])]
        m = sum(r) / len(r)
        return math.sqrt(sum((x - m) ** 2 for x in r) / len(r)), None
    if p.kind == "volume_surprise":
        m = sum(volume[:-1]) / (p.window - 1)
        return (None, "ZERO_REFERENCE_VOLUME") if m <= 0 else (volume[-1] / m - 1, None)
    if high[0] - low[0] <= 1e-15:
        return 0.0, None
    return (None, "NUMERIC_UNAVAILABLE") if close[0] is None else ((close[0] - low[0]) / (high[0] - low[0]) - 0.5, None)


def values(df):
    return candidate_values(df, vocabulary(), ["asset", "t"], "asset", "s", "t", "ok")


def test_vocabulary_counts_and_limits():
    names = [p.name for p in vocabulary()]
    assert len(names) == len(set(names)) == 62 and names[:2] == ["reversal_02", "reversal_03"] and names[-1] == "close_location_01"
    for kind, window in (("momentum", 1), ("range_mean", 14), ("close_location", 2)):
        with pytest.raises(ValueError):
            Primitive(kind, window)


def test_every_candidate_agrees_with_its_definition(spark):
    data = bars()
    got = {(r["asset"], r["t"], r["candidate"]): (r["value"], r["reason"]) for r in values(spark.createDataFrame(data, BAR)).collect()}
    assert len(got) == len(data) * 62
    seen = set()
    for asset in ("A", "B"):
        own = [b for b in data if b[0] == asset]
        for i in range(len(own)):
            for p in vocabulary():
                value, reason = expected(p, own[: i + 1])
                have, why = got[asset, own[i][2], p.name]
                assert why == reason, (asset, i, p.name, why, reason)
                assert (have is None) == (value is None) and (value is None or abs(have - value) < 1e-9), (asset, i, p.name)
                seen.add(reason)
    assert seen == {None, "INSUFFICIENT_HISTORY", "CROSS_SESSION_WINDOW", "INCOMPLETE_BAR", "ZERO_REFERENCE_VOLUME", "NUMERIC_UNAVAILABLE"}


def test_empty_panel_and_layout(spark):
    assert values(spark.createDataFrame([], BAR)).count() == 0
    assert_layout_free(values, spark.createDataFrame(bars()[:40], BAR))
