"""Near-duplicate documents by a chosen-path similarity join over MinHash sketches.

1. One pass over the texts gives every document the hash of its whole shingle set and a sketch
   of ``COORDINATES`` minwise values of eight bits. Documents with equal sets form one class.
2. ``trees`` independent trees start with all classes in the root. A node picks one coordinate
   (a second one with probability 1/threshold - 1) by a hash of its own path; a class goes to the
   child named by its value there. Nodes of at most ``node_limit`` classes are compared
   exhaustively by sketch. In a larger node everyone is compared with one pivot; classes almost
   equal to it leave with their link, the others branch again, until no large node is left.
3. Candidate links form groups. Within a group all pairs are compared on full shingle sets, in
   chunk pairs of bounded size, and only links that hold there count.

Only groups found in step 2 reach step 3, so the trees decide recall: a pair at the threshold
meets in a leaf with probability 0.87 a tree after one level and 0.45 after eight.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketloom.llm import graph, texts
from marketloom.settings import cut_lineage

COORDINATES = 128
_M64 = (1 << 64) - 1


def _splitmix(x: int) -> int:
    x = (x + 0x9E3779B97F4A7C15) & _M64
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & _M64
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & _M64
    return x ^ (x >> 31)


_MULTIPLY = np.array([_splitmix(2 * i) | 1 for i in range(COORDINATES)], np.uint64).astype(np.uint32)[:, None] | np.uint32(1)
_ADD = np.array([_splitmix(2 * i + 1) for i in range(COORDINATES)], np.uint64).astype(np.uint32)[:, None]


def shingle_sets(column: pa.Array, size: int = 5) -> Iterator[np.ndarray]:
    """For each row its sorted distinct shingle hashes; fewer than ``size`` words make one shingle."""
    for start, end in texts.row_slices(column):
        data, offsets = texts.raw_text(column.slice(start, end - start))
        begins, stops, first = texts.word_bounds(data, offsets)
        words = texts.word_hashes(data, begins, stops, lower=True)
        runs = texts.run_hashes(words, size)
        for i in range(end - start):
            a, b = int(first[i]), int(first[i + 1])
            if b - a >= size:
                yield np.unique(runs[a : b - size + 1])
            elif b > a:
                yield texts.run_hashes(words[a:b], b - a, seed=b - a)
            else:
                yield np.zeros(0, np.uint64)


def minwise(values: np.ndarray) -> np.ndarray:
    """The smallest hash of the set under each coordinate's hash function, mixed once more."""
    low = values.astype(np.uint32)[None, :]
    best = np.full(COORDINATES, 0xFFFFFFFF, np.uint32)
    for at in range(0, low.shape[1], 2048):
        h = low[:, at : at + 2048] * _MULTIPLY + _ADD
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x2C1B3C6D)
        h ^= h >> np.uint32(13)
        np.minimum(best, h.min(axis=1), out=best)
    best *= np.uint32(0x297A2D39)
    return best


def _sketches(trees: int, threshold: float):
    """Set signature, sketch bytes and the first branches of every tree, from full minwise values."""
    roots = np.array([_splitmix(7_000_000 + t) for t in range(trees)], np.uint64)
    picks = _picks(roots, threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            count, signature, sketches, branches = [], [], [], []
            for values in shingle_sets(batch.column(1)):
                count.append(len(values))
                if not len(values):
                    signature.append(None)
                    sketches.append(None)
                    branches.append(None)
                    continue
                best = minwise(values)
                signature.append(hashlib.blake2b(values.tobytes(), digest_size=16).digest())
                sketches.append((best >> np.uint32(24)).astype(np.uint8).tobytes())
                branches.append(np.concatenate([_child(node, at, best[at]) for node, at in picks]).view(np.int64))
            columns = [batch.column(0), pa.array(count, pa.int64()), pa.array(signature, pa.binary()), pa.array(sketches, pa.binary()), pa.array(branches, pa.list_(pa.int64())), batch.column(2)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_shingles", "signature", "sketch", "branches", "nid"])

    return run


def _picks(path: np.ndarray, threshold: float) -> list[tuple[np.ndarray, np.ndarray]]:
    """For nodes their coordinates, from their own paths alone: one each, and a second one for some."""
    h = texts.mix(path.astype(np.uint64))
    one = (h % np.uint64(COORDINATES)).astype(np.int64)
    other = (one + 1 + ((h >> np.uint64(20)) % np.uint64(COORDINATES - 1)).astype(np.int64)) % COORDINATES
    second = (h >> np.uint64(40)).astype(np.float64) / float(1 << 24) < 1 / threshold - 1
    return [(h, one), (h[second], other[second])]


def _child(node: np.ndarray, coordinate: np.ndarray, value: np.ndarray) -> np.ndarray:
    key = (coordinate.astype(np.uint64) << np.uint64(32)) + value.astype(np.uint64) + np.uint64(1)
    return texts.mix(node ^ texts.mix(key * np.uint64(0x9E3779B97F4A7C15)))


def _children(path: np.ndarray, sketches: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows and child paths of members of nodes below the first level, where sketch bytes suffice."""
    every = np.arange(len(path))
    h = texts.mix(path.astype(np.uint64))
    second = (h >> np.uint64(40)).astype(np.float64) / float(1 << 24) < 1 / threshold - 1
    rows = [every, every[second]]
    paths = [_child(node, at, sketches[r, at]) for (node, at), r in zip(_picks(path, threshold), rows, strict=True)]
    return np.concatenate(rows), np.concatenate(paths)


def _matrix(column: pa.Array) -> np.ndarray:
    data, offsets = _bytes(column)
    return data.reshape(len(offsets) - 1, COORDINATES)


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return (np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)), at - at[0]


def _runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.RecordBatch]:
    """Batches of a sorted partition, cut so that no run of equal leading ``keys`` is split."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        last = [batch.column(k)[batch.num_rows - 1] for k in range(keys)]
        same = np.ones(batch.num_rows, bool)
        for k in range(keys):
            same &= batch.column(k).to_numpy(zero_copy_only=False) == last[k].as_py()
        tail = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
        if tail or (held and any(held[-1].column(k)[0].as_py() != last[k].as_py() for k in range(keys))):
            done = [*held, batch.slice(0, tail)] if tail else held
            yield from _joined(done)
            held = [batch.slice(tail)]
        else:
            held.append(batch)
    yield from _joined(held)


def _joined(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parts = [p for p in parts if p.num_rows]
    if parts:
        yield from pa.Table.from_batches(parts).combine_chunks().to_batches()


def _edges(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a.astype(np.int64)), pa.array(b.astype(np.int64))], ["a", "b"])


def _compare_leaves(least: float):
    """Links of all leaf nodes of a sorted partition, as a star in each linked set of a node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _runs(batches, 1):
            path, node = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            marks = _matrix(batch.column(2))
            root = np.arange(len(path))
            left, right, fresh = [], [], 0
            gap, at = 1, np.flatnonzero(path[1:] == path[:-1])
            while len(at):
                apart = at[root[at] != root[at + gap]] if len(left) else at
                for part in range(0, len(apart), 65536):
                    some = apart[part : part + 65536]
                    hit = some[(marks[some] == marks[some + gap]).sum(axis=1, dtype=np.int32) >= least * COORDINATES]
                    left.append(hit)
                    right.append(hit + gap)
                    fresh += len(hit)
                if fresh > 1024:  # pairs that are linked already need no comparison
                    root = texts.local_components(len(path), np.concatenate([*left, np.arange(len(path))]), np.concatenate([*right, root]))
                    left, right, fresh = [at[:0]], [at[:0]], 0
                gap += 1
                at = at[at + gap < len(path)]
                at = at[path[at] == path[at + gap]]
            if left:
                root = texts.local_components(len(path), np.concatenate([*left, np.arange(len(path))]), np.concatenate([*right, root]))
                moved = np.flatnonzero(root != np.arange(len(path)))
                if len(moved):
                    yield _edges(node[moved], node[root[moved]])

    return run


def _likeness(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        like = (_matrix(batch.column(2)) == _matrix(batch.column(4))).mean(axis=1)
        yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(like)], ["path", "node", "sketch", "pivot", "like"])


def _branch(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = _matrix(batch.column(2))
            rows, paths = _children(batch.column(0).to_numpy(), marks, threshold)
            yield pa.RecordBatch.from_arrays([pa.array(paths.view(np.int64)), batch.column(1).take(pa.array(rows))], ["path", "node"])

    return run


def candidate_links(classes: DataFrame, threshold: float, node_limit: int) -> DataFrame:
    """Links ``(a, b)`` between classes ``(node, sketch, branches)`` whose sketches agree, found by the trees."""
    # 4.5 standard deviations of a sketch estimate below the threshold; unequal values agree once in 256.
    spread = (threshold * (1 - threshold) / COORDINATES) ** 0.5
    least = threshold - 4.5 * spread
    loose, near = least - 0.1, 0.96
    links = []
    level = classes.select(F.explode("branches").alias("path"), "node")
    while True:
        # Written first, so that a hot path's rows can be split in the join. Both sides grow with the
        # corpus, so the joins of this module are planned as shuffles at every size.
        counts = cut_lineage(level.groupBy("path").agg(F.count("*").alias("members")).where("members > 1"), "path-counts")
        shared = cut_lineage(level.join(counts.hint("merge"), "path"), "paths")
        leaves = shared.where(F.col("members") <= node_limit).join(classes.select("node", "sketch").hint("merge"), "node").select("path", "node", "sketch")
        sorted_leaves = leaves.repartition("path").sortWithinPartitions("path")
        links.append(cut_lineage(sorted_leaves.mapInArrow(_compare_leaves(least), "a long, b long"), "leaf-links"))
        large = shared.where(F.col("members") > node_limit)
        if large.isEmpty():
            break
        pivots = large.groupBy("path").agg(F.min("node").alias("pivot"))
        marked = pivots.join(classes.select(F.col("node").alias("pivot"), F.col("sketch").alias("mark")), "pivot")
        seen = large.join(classes.select("node", "sketch"), "node").join(marked, "path").select("path", "node", "sketch", "pivot", "mark")
        judged = cut_lineage(seen.mapInArrow(_likeness, "path long, node long, sketch binary, pivot long, like double"), "pivots")
        links.append(judged.where((F.col("like") >= loose) & (F.col("node") != F.col("pivot"))).select(F.col("node").alias("a"), F.col("pivot").alias("b")))
        rest = judged.where((F.col("like") < near) & (F.col("node") != F.col("pivot")))
        level = rest.select("path", "node", "sketch").mapInArrow(_branch(threshold), "path long, node long")
    out = links[0]
    for more in links[1:]:
        out = out.union(more)
    return out


def _sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, end in texts.row_slices(batch.column(4), 1 << 20):
                part = batch.slice(start, end - start)
                sets = [v.tobytes() for v in shingle_sets(part.column(4), size)]
                yield pa.RecordBatch.from_arrays([*part.columns[:4], pa.array(sets, pa.large_binary()).cast(pa.binary())], ["node", "group", "chunk", "chunks", "shingles"])

    return run


def set_links(sets: list[np.ndarray], within: np.ndarray, hundredths: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs with 100 * intersection >= hundredths * union; members of unlike ``within`` only if both occur."""
    m = len(sets)
    sizes = np.array([len(s) for s in sets], np.int64)
    shared = np.zeros((m, m), np.int64)
    if m == 2:
        shared[0, 1] = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
    else:
        values = np.concatenate(sets)
        order = np.argsort(values, kind="stable")
        owner = np.repeat(np.arange(m), sizes)[order]
        values = values[order]
        fresh = np.ones(len(values), bool)
        fresh[1:] = values[1:] != values[:-1]
        token = np.cumsum(fresh) - 1
        often = np.bincount(token)[token] > 1
        owner, token = owner[often], token[often]
        if len(token):
            token = np.cumsum(np.concatenate([[0], token[1:] != token[:-1]]))
            total = np.zeros((m, m), np.float64)
            step = max(256, (8 << 20) // (4 * m))
            for at in range(0, int(token[-1]) + 1, step):
                lo, hi = np.searchsorted(token, [at, at + step])
                block = np.zeros((step, m), np.float32)
                block[token[lo:hi] - at, owner[lo:hi]] = 1
                total += block.T @ block
            shared = np.rint(total).astype(np.int64)
    i, j = np.triu_indices(m, 1)
    same = within[0] == within
    if not same.all():
        keep = same[i] != same[j]
        i, j = i[keep], j[keep]
    both = shared[i, j]
    hit = 100 * both >= hundredths * (sizes[i] + sizes[j] - both)
    return i[hit], j[hit]


def _confirm(hundredths: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _runs(batches, 3):
            keys = [batch.column(k).to_numpy() for k in range(3)]
            node, chunk = batch.column(3).to_numpy(), batch.column(4).to_numpy()
            data, offsets = _bytes(batch.column(5))
            cut = np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1
            out_a, out_b = [], []
            for lo, hi in zip([0, *cut], [*cut, len(node)], strict=True):
                if hi - lo < 2:
                    continue
                sets = [data[offsets[r] : offsets[r + 1]].view(np.uint64) if offsets[r] % 8 == 0 else np.frombuffer(data[offsets[r] : offsets[r + 1]].tobytes(), np.uint64) for r in range(lo, hi)]
                i, j = set_links(sets, chunk[lo:hi], hundredths)
                root = texts.local_components(hi - lo, i, j)
                moved = np.flatnonzero(root != np.arange(hi - lo))
                out_a.append(node[lo + moved])
                out_b.append(node[lo + root[moved]])
            if out_a:
                yield _edges(np.concatenate(out_a), np.concatenate(out_b))

    return run


def _row_key(doc_id: Column, text: Column) -> Column:
    """The document's id; a text without an id gets a negative key of its own text."""
    return F.coalesce(doc_id, F.lit(-1) - F.shiftrightunsigned(F.xxhash64(text), 2))


def near_duplicates(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = 5, hundredths: int = 85, trees: int = 16, node_limit: int = 2048, chunk: int = 256) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)``, one row for each input row.

    Null and wordless texts have no shingles and link with nothing. Rows that repeat an id are
    one document and share a component. A row without an id can be linked but names no component; if no
    row of its component has an id, ``component_id`` is null and ``kept`` false. Other columns
    of the input are ignored, whatever their names. Empty tables give no rows.
    """
    threshold = hundredths / 100
    rows = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    rows = rows.withColumn("nid", F.when(F.col("text").isNotNull(), _row_key(F.col("doc_id"), F.col("text"))))
    schema = "doc_id long, n_shingles long, signature binary, sketch binary, branches array<long>, nid long"
    marked = cut_lineage(rows.select("doc_id", "text", "nid").mapInArrow(_sketches(trees, threshold), schema), "sketches")
    full = marked.where("n_shingles > 0")
    named = full.groupBy("signature").agg(F.coalesce(F.min("doc_id"), F.min("nid")).alias("node"))
    known = cut_lineage(full.join(named.hint("merge"), "signature").select("doc_id", "nid", "node", "n_shingles", "sketch", "branches"), "classes")
    classes = cut_lineage(known.where("nid = node").select("node", "sketch", "branches").distinct(), "representatives")
    found = graph.components(candidate_links(classes, threshold, node_limit), "candidates")

    sizes = found.groupBy("component").agg(F.ceil(F.count("*") / chunk).alias("chunks"))
    grouped = found.join(sizes, "component").select("node", F.col("component").alias("group"), F.pmod(F.xxhash64("node"), "chunks").alias("chunk"), "chunks")
    wanted = rows.where("nid is not null").select(F.col("nid").alias("node"), "text").join(grouped.hint("merge"), "node").select("node", "group", "chunk", "chunks", "text")
    sets = wanted.mapInArrow(_sets(size), "node long, group long, chunk long, chunks long, shingles binary")
    facing = sets.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
    pairs = facing.select("group", F.least("chunk", "other").alias("one"), F.greatest("chunk", "other").alias("two"), "node", "chunk", "shingles")
    pairs = pairs.repartition("group", "one", "two").sortWithinPartitions("group", "one", "two")
    true_links = pairs.mapInArrow(_confirm(hundredths), "a long, b long")
    repeated = known.where("nid <> node").select(F.col("nid").alias("a"), F.col("node").alias("b"))
    split_ids = repeated.where("a >= 0").join(classes.select(F.col("node").alias("a")), "a", "left_semi")
    linked = graph.components(true_links.union(split_ids), "links")

    placed = known.select("doc_id", "n_shingles", "node").join(linked, "node", "left").withColumn("label", F.coalesce("component", "node"))
    best = placed.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    full_rows = placed.join(best, "label").select("doc_id", "n_shingles", "component_id")
    bare = marked.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return full_rows.union(bare).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))
