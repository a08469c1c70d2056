"""User feature functions over trailing windows, run in Arrow batches on the executors.

Rows lie in balanced ranges of (key, order). A range brings the last rows of its key from the ranges
before it as a halo, so every row goes to Python once (a halo at most ``lookback - 1`` rows a range) and
windows are strided views of the batch. A key that holds most of the table is many ranges.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketloom.operators.chunks import CHUNK, ranged


@dataclass(frozen=True)
class FeatureSpec:
    """Contract of a user feature: its inputs, its look-back and its function.

    ``fn`` maps an array of shape (rows, lookback, fields) to one value per row, oldest bar
    first. A non-finite result is an error of the function, not a missing value.
    """

    feature_id: str
    fields: tuple[str, ...]
    lookback: int
    fn: Callable[[np.ndarray], np.ndarray]


def with_halo(df: DataFrame, by: Sequence[str], order: Sequence[str], rows: int, ranges: int | None = None) -> DataFrame:
    """Balanced ranges, each led by the ``rows`` rows of its first key that precede it (``_halo``).

    Adds ``_chunk``, ``_run`` (the key as one number) and ``_halo``; ranges lie together and in order.
    """
    d = ranged(df, by, order, ranges).withColumn("_run", F.xxhash64(*by) if by else F.lit(0).cast("long"))
    cols = d.columns
    last = Window.partitionBy(*by, CHUNK).orderBy(*[F.desc(o) for o in order])
    ends = d.withColumn("_back", F.row_number().over(last)).where(F.col("_back") <= rows)
    # Of the ranges of a key, a range needs the nearest rows only, which ``rows`` ranges before it hold at most.
    places = d.select(*by, CHUNK).distinct()
    here = Window.partitionBy(*by).orderBy(CHUNK)
    places = places.withColumn("_next", F.collect_list(CHUNK).over(here.rowsBetween(1, max(rows, 1)))).where(F.size("_next") > 0)
    same = F.lit(True)
    named = places.select(*[F.col(k).alias(f"_p{i}") for i, k in enumerate(by)], F.col(CHUNK).alias("_pc"), "_next")
    for i, k in enumerate(by):
        same = same & F.col(k).eqNullSafe(F.col(f"_p{i}"))
    sent = ends.join(named, same & (F.col(CHUNK) == F.col("_pc"))).withColumn("_to", F.explode("_next"))
    near = Window.partitionBy(*by, "_to").orderBy(F.desc(CHUNK), F.col("_back"))
    sent = sent.withColumn("_n", F.row_number().over(near)).where(F.col("_n") <= rows)
    halo = sent.select(*[c for c in cols if c != CHUNK], F.col("_to").alias(CHUNK), F.lit(True).alias("_halo"))
    both = d.withColumn("_halo", F.lit(False)).unionByName(halo)
    return both.repartition(CHUNK).sortWithinPartitions(CHUNK, *by, F.desc("_halo"), *order)


def trailing(values: np.ndarray, starts: np.ndarray, lookback: int) -> tuple[np.ndarray, np.ndarray]:
    """Windows that end at each row as a view of shape (rows, lookback, fields), and which of them are whole.

    ``starts`` holds the index at which each row's run begins; a window is whole if it stays in its run
    and holds no NaN.
    """
    n = len(values)
    whole = np.zeros(n, bool)
    if n < lookback:
        return np.zeros((0, lookback, values.shape[1])), whole
    view = np.lib.stride_tricks.sliding_window_view(values, lookback, axis=0).transpose(0, 2, 1)
    bad = np.concatenate([[0], np.cumsum(np.isnan(values).any(axis=1))])
    at = np.arange(lookback - 1, n)
    whole[at] = (at - lookback + 1 >= starts[at]) & (bad[at + 1] == bad[at - lookback + 1])
    return view, whole


def with_feature(df: DataFrame, spec: FeatureSpec, by: Sequence[str], order: str, ranges: int | None = None) -> DataFrame:
    """Add the feature column; rows without a full, non-NULL window stay NULL."""
    laid = with_halo(df, by, [order], spec.lookback - 1, ranges)
    fields, lookback, fn, name = list(spec.fields), spec.lookback, spec.fn, spec.feature_id
    kept = [c for c in df.columns if c != name]
    inputs = [F.col(c).cast("double").alias(f"_in{i}") for i, c in enumerate(fields)]
    sent = laid.select(*kept, CHUNK, "_run", "_halo", *inputs)

    def evaluate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry_values, carry_ids = np.zeros((0, len(fields))), np.zeros((0, 2), np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [batch.column(f"_in{i}").to_numpy(zero_copy_only=False) for i in range(len(fields))]
            values = np.concatenate([carry_values, np.column_stack(columns).astype(float)])
            ids = np.concatenate([carry_ids, np.column_stack([batch.column(CHUNK).to_numpy(), batch.column("_run").to_numpy()]).astype(np.int64)])
            new = np.concatenate([[True], (ids[1:] != ids[:-1]).any(axis=1)])
            starts = np.maximum.accumulate(np.where(new, np.arange(len(ids)), 0))
            view, whole = trailing(values, starts, lookback)
            own = ~batch.column("_halo").to_numpy(zero_copy_only=False)
            whole[: len(carry_ids)] = False
            whole[len(carry_ids) :] &= own
            out = np.full(len(ids), np.nan)
            if whole.any():
                windows = view[whole[lookback - 1 :]]
                got = np.asarray(fn(windows), dtype=float)
                if not np.isfinite(got).all():
                    raise ValueError(f"feature {name} returned a non-finite value")
                out[whole] = got
            kept_rows = len(ids) - (lookback - 1) if lookback > 1 else len(ids)
            carry_values, carry_ids = values[max(kept_rows, 0) :], ids[max(kept_rows, 0) :]
            column = pa.array(out[len(out) - batch.num_rows :], mask=~whole[len(whole) - batch.num_rows :])
            made = pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], column], [*kept, name])
            yield made.filter(pa.array(own))

    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in kept) + f", `{name}` double"
    return sent.mapInArrow(evaluate, schema)
