"""Removal of passages that repeat across documents, by relative parsing against an index of all documents.

The reference is the whole corpus, indexed in blocks by anchor: the smallest ``anchor``-word hash
among the word runs of a window (rightmost on ties), so equal windows have equal anchors and
meet in the same block. A document is cut greedily into the longest pieces whose windows all
share one anchor, and every piece is parsed against the block of its anchor:

* a piece that occurs whole in an earlier document is one factor, and all of its windows repeat;
* elsewhere (the factor boundaries) the windows of the piece are looked up one by one.

Adjacent factors join into the duplicate spans. Blocks are hash aggregates that combine
map-side, so a passage in a third of all documents costs one row for each task. Every window of
``window`` words is decided exactly (up to 128-bit hash collisions), whatever its document's length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketloom.llm import texts
from marketloom.settings import cut_lineage

_POSITION = np.uint64(34)
_NO_ID = (1 << 63) - 1


def _anchored(words: np.ndarray, window: int, anchor: int) -> np.ndarray:
    """For each window start the position of its anchor; only windows inside one row mean anything."""
    grams = texts.run_hashes(words, anchor, seed=1)
    at = np.arange(len(grams), dtype=np.uint64)
    low = ((grams >> _POSITION) << _POSITION) | (((np.uint64(1) << _POSITION) - np.uint64(1)) - at)
    span, reach = window - anchor + 1, 1
    while reach * 2 <= span:
        low = np.minimum(low[:-reach], low[reach:])
        reach *= 2
    if span > reach:
        low = np.minimum(low[: len(low) - (span - reach)], low[span - reach :])
    return (((np.uint64(1) << _POSITION) - np.uint64(1)) - (low & ((np.uint64(1) << _POSITION) - np.uint64(1)))).astype(np.int64)


def _span_hash(words: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """A hash of words[start:stop] for many spans of any length."""
    prefix = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * texts._power_table(texts._BASE, len(words))[: len(words)], out=prefix[1:])
    h = (prefix[stop] - prefix[start]) * texts._power_table(texts._BASE_INVERSE, len(words))[start]
    return texts.mix(h + (stop - start).astype(np.uint64))


def _pieces(window: int, anchor: int):
    """Pieces of each row: runs of windows with one anchor, as word positions of first and last window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, order = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for lo, hi in texts.row_slices(batch.column(2)):
                data, offsets = texts.raw_text(batch.column(2).slice(lo, hi - lo))
                starts, stops, first = texts.word_bounds(data, offsets)
                if len(starts) < window:
                    continue
                words = texts.word_hashes(data, starts, stops)
                at = _anchored(words, window, anchor)
                row = np.repeat(np.arange(hi - lo), np.diff(first))
                valid = row[: len(at)] == row[window - 1 : window - 1 + len(at)]
                begins = valid.copy()
                begins[1:] &= ~valid[:-1] | (at[1:] != at[:-1]) | (row[1 : len(at)] != row[: len(at) - 1])
                ends = valid.copy()
                ends[:-1] &= ~valid[1:] | (at[1:] != at[:-1]) | (row[1 : len(at)] != row[: len(at) - 1])
                one, last = np.flatnonzero(begins), np.flatnonzero(ends)
                if not len(one):
                    continue
                grams = texts.run_hashes(words, anchor)
                owner = row[one]
                out = [grams[at[one]].view(np.int64), _span_hash(words, one, last + window).view(np.int64), order[lo + owner], key[lo + owner], (one - first[owner]).astype(np.int32), (last - first[owner]).astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in out], ["anchor", "piece", "ord", "key", "first", "last"])

    return run


def _windows(window: int):
    """Hashes of the windows of listed pieces: (key, ord, text, pieces) in, one row for each window out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, order = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            lists = batch.column(3)
            for lo, hi in texts.row_slices(batch.column(2)):
                data, offsets = texts.raw_text(batch.column(2).slice(lo, hi - lo))
                starts, stops, base = texts.word_bounds(data, offsets)
                whole = texts.run_hashes(texts.word_hashes(data, starts, stops), window, seed=2)
                part = lists.slice(lo, hi - lo)
                flat, count = part.flatten(), np.diff(part.offsets.to_numpy())
                owner = np.repeat(np.arange(hi - lo), count)
                anchor, one, last = (flat.field(k).to_numpy() for k in range(3))
                many = (last - one + 1).astype(np.int64)
                at = np.repeat(one - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(many.sum())
                owner = np.repeat(owner, many)
                out = [np.repeat(anchor, many), whole[base[owner] + at].view(np.int64), order[lo + owner], key[lo + owner], at.astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in out], ["anchor", "piece", "ord", "key", "first"])

    return run


def _keyed(documents: DataFrame, doc_id: str, text: str) -> DataFrame:
    rows = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.withColumn("key", F.xxhash64("doc_id", "text"))


def _spans(rows: DataFrame, window: int, anchor: int) -> DataFrame:
    """``(key, start, stop)`` in words for the repeated windows of every keyed row."""
    ordered = rows.select("key", F.coalesce("doc_id", F.lit(_NO_ID)).alias("ord"), "text")
    schema = "anchor long, piece long, ord long, key long, first int, last int"
    pieces = cut_lineage(ordered.where("text is not null").mapInArrow(_pieces(window, anchor), schema), "pieces")
    blocks = pieces.groupBy("anchor").agg(F.min("piece").alias("p1"), F.max("piece").alias("p2"), F.min("ord").alias("o1"), F.max("ord").alias("o2"))
    # Written, so that the join below reads two plain shuffles and a hot block's pieces can be split.
    blocks = cut_lineage(blocks.where("o1 < o2").select("anchor", "o1", (F.col("p1") != F.col("p2")).alias("mixed")), "blocks")
    shared = cut_lineage(pieces.join(blocks, "anchor"), "shared-pieces")
    stop = lambda c: (F.col(c) + window).alias("stop")
    spans = shared.where("not mixed and ord > o1").select("key", F.col("first").alias("start"), stop("last"))
    mixed = shared.where("mixed")
    factors = cut_lineage(mixed.groupBy("anchor", "piece").agg(F.min("ord").alias("earliest")), "factors")
    parsed = cut_lineage(mixed.join(factors, ["anchor", "piece"]).select("anchor", "ord", "key", "first", "last", "earliest"), "parsed")
    spans = spans.union(parsed.where("ord > earliest").select("key", F.col("first").alias("start"), stop("last")))
    edges = parsed.where("ord = earliest").groupBy("key").agg(F.collect_list(F.struct("anchor", "first", "last")).alias("pieces"))
    opened = rows.select("key", "doc_id", "text").join(edges, "key").select("key", F.coalesce("doc_id", F.lit(_NO_ID)).alias("ord"), "text", "pieces")
    windows = opened.mapInArrow(_windows(window), "anchor long, piece long, ord long, key long, first int")
    earliest = windows.groupBy("anchor", "piece").agg(F.min("ord").alias("earliest"))
    repeated = windows.join(earliest, ["anchor", "piece"]).where("ord > earliest")
    return spans.union(repeated.select("key", F.col("first").alias("start"), stop("first")))


def repeated_spans(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = 50, anchor: int = 16) -> DataFrame:
    """``(doc_id, start, stop)``: word spans, maximal and apart, covered by repeated windows.

    A window of ``window`` words repeats if its words also stand, in order, in a row with a smaller
    id. A row without an id comes after all others and removes nothing. Null and short texts,
    and empty tables, have no spans. Rows that repeat id and text have equal spans.
    """
    return cleaned(documents, doc_id, text, window, anchor).select("doc_id", F.explode("spans").alias("s")).select("doc_id", "s.start", "s.stop").distinct()


def _clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi in texts.row_slices(batch.column(1)):
            part = batch.slice(lo, hi - lo)
            data, offsets = texts.raw_text(part.column(1))
            starts, stops, base = texts.word_bounds(data, offsets)
            raw = data.tobytes()
            spans, kept = part.column(2).to_pylist(), []
            merged, total, gone = [], [], []
            for i in range(hi - lo):
                a, b = int(base[i]), int(base[i + 1])
                cover = np.zeros(b - a + 1, np.int64)
                for s in spans[i] or ():
                    cover[s["start"]] += 1
                    cover[s["stop"]] -= 1
                keep = np.cumsum(cover[:-1]) == 0
                change = np.flatnonzero(np.diff(np.concatenate([[True], keep, [True]])))
                merged.append([{"start": int(x), "stop": int(y)} for x, y in change.reshape(-1, 2)])
                words = np.flatnonzero(keep) + a
                kept.append(b" ".join([raw[x:y] for x, y in zip(starts[words].tolist(), stops[words].tolist(), strict=True)]).decode())
                total.append(b - a)
                gone.append(b - a - len(words))
            spans_type = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string()), pa.array(merged, spans_type)], ["doc_id", "n_words", "n_removed", "kept", "spans"])


def cleaned(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = 50, anchor: int = 16) -> DataFrame:
    """``(doc_id, n_words, n_removed, kept, spans)`` for each row: its kept words joined by one space."""
    rows = _keyed(documents, doc_id, text)
    spans = _spans(rows, window, anchor)
    listed = spans.groupBy("key").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))
    joined = rows.select("key", "doc_id", "text").join(listed, "key", "left").select("doc_id", "text", "spans")
    return joined.mapInArrow(_clean, "doc_id long, n_words long, n_removed long, kept string, spans array<struct<start:int,stop:int>>")
