"""Near-duplicate vectors by sorted projection passes.

Each pass gives a vector the signs of its random projections as one long, sorts all vectors by (label,
that long), and compares every vector with the ``window`` before and after it, by cosine in double
precision. Verified pairs of all passes are united to components. Links between vectors all lie
inside components, so the number of links of each vector then comes from comparing the members of
each component exhaustively, in chunk pairs of bounded size; only counts leave a task. Equal
vectors are one class throughout.

How many passes a vector needs is seen from the sorted order itself. If k signs are the longest prefix it shares
with the rows ``window`` places before and after, every vector that shares k + 1 signs was compared with it. A
partner at the threshold shares a sign with probability Phi(m * least / sqrt(1 - least**2)), where m is how far the
vector lies from that plane (0.936 on average at 0.98; less for the planes that cut a vector off its cluster). The
passes of a vector multiply to the probability that one of its partners was never met; vectors for which it is
above ``miss`` are open, whatever filled their windows: a large label, a dense cluster, or the border of a range.
Open vectors go through further passes among themselves (a pair with one settled vector is settled),
and what is left, or small enough, is compared exhaustively.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketloom.llm import graph, texts
from marketloom.settings import cut_lineage

BITS = 62

SEED = 11

#: Rounds of further passes before all that is still open is compared exhaustively.
ROUNDS = 40

#: Logarithm of the normal distribution function at 0 to 8.
_STEPS = np.linspace(0, 8, 4097)
_LOG_PHI = np.array([math.log1p(-0.5 * math.erfc(t / math.sqrt(2))) for t in _STEPS])


def _planes(passes: int, dim: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, dim]).normal(size=(dim, passes * BITS))


def _signs(x: np.ndarray, planes: np.ndarray) -> np.ndarray:
    """One long of signs for each row and pass."""
    power = (1 << np.arange(BITS - 1, -1, -1, dtype=np.int64)).astype(np.int64)
    return ((x @ planes > 0).reshape(len(x), -1, BITS) * power).sum(axis=2)


def _keys(passes: int):
    """Valid vectors with their class signature, bytes, and one sort key for each pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                lists = batch.column(2)
                flat = lists.flatten()
                ends = np.cumsum([0, *(0 if n is None else n for n in lists.value_lengths().to_pylist())])
                values = flat.to_numpy(zero_copy_only=False).astype(np.float64)
                ok, sig, data, keys = [], [], [], []
                by_dim: dict[int, list[int]] = {}
                for r in range(batch.num_rows):
                    v = values[ends[r] : ends[r + 1]]
                    if len(v) and np.isfinite(v).all() and v.any():
                        by_dim.setdefault(len(v), []).append(r)
                for dim, rows in by_dim.items():
                    x = np.stack([_unit(values[ends[r] : ends[r + 1]]) for r in rows])
                    if dim not in planes:
                        planes[dim] = _planes(passes, dim, SEED)
                    found = _signs(x, planes[dim])
                    for i, r in enumerate(rows):
                        raw = _packed(values[ends[r] : ends[r + 1]])
                        ok.append(r)
                        data.append(raw)
                        sig.append(hashlib.blake2b(raw, digest_size=16).digest())
                        keys.append(found[i])
                if ok:
                    take = pa.array(ok)
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(sig, pa.binary()), pa.array(data, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], ["vec_id", "label", "signature", "vector", "keys"])

    return run


def _packed(v: np.ndarray) -> bytes:
    """The components as they came: single precision where that holds them."""
    single = v.astype(np.float32)
    return b"\x04" + single.tobytes() if np.array_equal(single, v) else b"\x08" + v.tobytes()


def _unit(v: np.ndarray) -> np.ndarray:
    v = v / np.abs(v).max()
    return v / np.linalg.norm(v)


def _stack(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors in double precision, filled up with zeros to one width, and their own widths."""
    raw = column.to_pylist()
    kinds: dict[tuple[int, int], list[int]] = {}
    for i, b in enumerate(raw):
        kinds.setdefault((b[0], len(b)), []).append(i)
    width = np.array([(len(b) - 1) // b[0] for b in raw])
    x = np.zeros((len(raw), width.max(initial=0)))
    for (item, length), at in kinds.items():
        joined = np.frombuffer(b"".join(raw[i] for i in at), np.uint8).reshape(len(at), length)[:, 1:]
        v = np.ascontiguousarray(joined).view(np.float32 if item == 4 else np.float64).astype(np.float64)
        v /= np.abs(v).max(axis=1, keepdims=True)
        x[np.array(at), : v.shape[1]] = v / np.linalg.norm(v, axis=1, keepdims=True)
    return x, width


def _fresh(passes: int, seed: int):
    """Sort keys of a further round of passes, from planes of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                x, width = _stack(batch.column(2))
                keys = np.zeros((batch.num_rows, passes), np.int64)
                for dim in np.unique(width).tolist():
                    if dim not in planes:
                        planes[dim] = _planes(passes, dim, seed)
                    keys[width == dim] = _signs(x[width == dim, :dim], planes[dim])
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(list(keys), pa.list_(pa.int64()))], ["label", "node", "vector", "keys"])

    return run


def _shared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Number of leading signs that two keys share."""
    differ = a ^ b
    high, low = differ >> 31, differ & ((1 << 31) - 1)
    return BITS - np.where(high > 0, 31 + np.frexp(high.astype(np.float64))[1], np.frexp(low.astype(np.float64))[1])


def _missed(x: np.ndarray, planes: np.ndarray, most: np.ndarray, slope: float) -> np.ndarray:
    """Logarithm of the probability that a partner at the threshold does not share ``most`` + 1 signs with a row."""
    shared = np.zeros((len(x), BITS + 1))
    np.cumsum(np.interp(np.abs(x @ planes) * slope, _STEPS, _LOG_PHI), axis=1, out=shared[:, 1:])
    met = np.where(most < BITS, np.exp(shared[np.arange(len(x)), np.minimum(most + 1, BITS)]), 0.0)
    return np.log(np.maximum(1 - met, 1e-300))


def _near(window: int, least: float, passes: int, seed: int):
    """Links of each row of a sorted partition to the ``window`` rows on both sides, as stars; and what they leave open.

    A row with null ``b`` tells the logarithm of the probability that the pass missed a partner of ``a``.
    Rows with fewer than ``window`` rows before or after them in their partition tell nothing.
    """
    slope, block = least / math.sqrt(max(1 - least * least, 1e-12)), 128

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, planes = None, {}
        for batch in batches:
            if not batch.num_rows:
                continue
            label, node, group, key = (batch.column(k).to_numpy() for k in (0, 1, 3, 4))
            x, width = _stack(batch.column(2))
            old = 0
            if held is not None:
                old = len(held[0])
                label, node, group, key, width = (np.concatenate(pair) for pair in zip(held[:5], (label, node, group, key, width), strict=True))
                wide = max(x.shape[1], held[5].shape[1])
                x = np.concatenate([np.pad(part, ((0, 0), (0, wide - part.shape[1]))) for part in (held[5], x)])
            n, left, right = len(node), [], []
            for lo in range(max(0, old - window), n - 1, block):
                hi, end = min(lo + block, n), min(lo + block + window, n)
                i, j = np.nonzero(x[lo:hi] @ x[lo:end].T >= least)
                gap, i, j = j - i, i + lo, j + lo
                ok = (gap > 0) & (gap <= window) & (j >= old) & (label[i] == label[j]) & (group[i] == group[j]) & (width[i] == width[j])
                left.append(i[ok])
                right.append(j[ok])
            root = texts.local_components(n, np.concatenate([*left, np.arange(n)]), np.concatenate([*right, np.arange(n)]))
            moved = np.flatnonzero(root != np.arange(n))
            # Rows whose window ends in this batch: the first of a partition and its last have none.
            at = np.arange(max(window, old - window), n - window)
            most = np.full(len(at), -1)
            for other in (at - window, at + window):
                same = (label[at] == label[other]) & (group[at] == group[other])
                most = np.maximum(most, np.where(same, _shared(key[at], key[other]), -1))
            missed = np.zeros(len(at))
            for dim, turn in {*zip(width[at].tolist(), group[at].tolist(), strict=True)}:
                if dim not in planes:
                    planes[dim] = _planes(passes, dim, seed)
                some = np.flatnonzero((width[at] == dim) & (group[at] == turn))
                missed[some] = _missed(x[at[some], :dim], planes[dim][:, turn * BITS : (turn + 1) * BITS], most[some], slope)
            a = np.concatenate([node[moved], node[at]])
            b = pa.array(np.concatenate([node[root[moved]], node[at]]), mask=np.arange(len(a)) >= len(moved))
            yield pa.RecordBatch.from_arrays([pa.array(a), b, pa.array(np.concatenate([np.zeros(len(moved)), missed]))], ["a", "b", "missed"])
            keep = max(0, n - 2 * window)
            held = (label[keep:], node[keep:], group[keep:], key[keep:], width[keep:], x[keep:])

    return run


def _faced(least: float):
    """Links between the members of each chunk pair of a label, as stars."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from marketloom.llm.minhash_paths import _runs

        for batch in _runs(batches, 3):
            keys = [batch.column(k).to_numpy() for k in range(3)]
            node = batch.column(3).to_numpy()
            x, width = _stack(batch.column(4))
            cut = np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1
            for lo, hi in zip([0, *cut], [*cut, len(node)], strict=True):
                i, j = np.nonzero(np.triu(x[lo:hi] @ x[lo:hi].T >= least, 1))
                same = width[lo + i] == width[lo + j]
                root = texts.local_components(hi - lo, i[same], j[same])
                moved = np.flatnonzero(root != np.arange(hi - lo))
                yield pa.RecordBatch.from_arrays([pa.array(node[lo + moved]), pa.array(node[lo + root[moved]])], ["a", "b"])

    return run


def _counted(least: float):
    """Linked copies of each member of a chunk pair of a component; self comparisons are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from marketloom.llm.minhash_paths import _runs

        for batch in _runs(batches, 3):
            keys = [batch.column(k).to_numpy() for k in range(3)]
            node, chunk, copies = (batch.column(k).to_numpy() for k in (3, 4, 5))
            vectors, _ = _stack(batch.column(6))
            cut = np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1
            out_node, out_links = [], []
            for lo, hi in zip([0, *cut], [*cut, len(node)], strict=True):
                x = vectors[lo:hi]
                linked = x @ x.T >= least
                np.fill_diagonal(linked, False)
                if keys[1][lo] != keys[2][lo]:
                    linked &= chunk[lo:hi, None] != chunk[None, lo:hi]
                out_node.append(node[lo:hi])
                out_links.append(linked @ copies[lo:hi])
            if out_node:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out_node)), pa.array(np.concatenate(out_links).astype(np.int64))], ["node", "links"])

    return run


def _found(reps: DataFrame, passes: int, window: int, least: float, miss: float, more: int, exhaustive: int) -> DataFrame:
    """Verified links ``(a, b)``: every partner of every vector is met, but for a probability of ``miss`` at the threshold."""
    links, turn = None, 0
    live = reps.select("label", "node", "vector", "keys", F.lit(0.0).alias("so_far"))
    while True:
        passed = live.select("label", "node", "vector", F.posexplode("keys").alias("pass", "key"))
        ordered = passed.repartitionByRange("pass", "label", "key", "node").sortWithinPartitions("pass", "label", "key", "node")
        ordered = ordered.select("label", "node", "vector", "pass", "key")
        met = cut_lineage(ordered.mapInArrow(_near(window, least, more if turn else passes, SEED + turn), "a long, b long, missed double"), "passes")
        pairs = met.where("b is not null").select("a", "b")
        links = pairs if links is None else links.union(pairs)
        told = met.where("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("missed").alias("missed"))
        left = live.select("label", "node", "so_far").join(told, "node", "left")
        left = left.select("label", "node", (F.col("so_far") + F.coalesce("missed", F.lit(0.0))).alias("so_far"))
        left = cut_lineage(left.where(F.col("so_far") > float(np.log(miss))), "open")
        size = left.groupBy("label").count().agg(F.sum("count").alias("n"), F.sum(F.col("count") * F.col("count").cast("double")).alias("pairs")).first()
        if not size["n"]:
            return links
        rows = left.join(reps.select("node", "vector"), "node").select("label", "node", "vector", "so_far")
        if turn == ROUNDS or size["pairs"] <= exhaustive * size["n"]:
            return links.union(_all_links(rows, least))
        turn += 1
        schema = "label long, node long, vector binary, keys array<long>"
        fresh = rows.select("label", "node", "vector").mapInArrow(_fresh(more, SEED + turn), schema)
        live = cut_lineage(fresh.join(left.select("node", "so_far"), "node"), "open-keys")


def _all_links(rows: DataFrame, least: float, chunk: int = 1024) -> DataFrame:
    """Links ``(a, b)`` among all vectors of each label, in chunk pairs."""
    sizes = rows.groupBy("label").agg(F.ceil(F.count("*") / chunk).alias("chunks"))
    facing = rows.join(sizes, "label").withColumn("chunk", F.pmod(F.xxhash64("node"), "chunks"))
    facing = facing.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
    pairs = facing.select("label", F.least("chunk", "other").alias("one"), F.greatest("chunk", "other").alias("two"), "node", "vector")
    pairs = pairs.repartition("label", "one", "two").sortWithinPartitions("label", "one", "two")
    return pairs.mapInArrow(_faced(least), "a long, b long")


def near_duplicates(embeddings: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", least: float = 0.98, passes: int = 12, window: int = 64, chunk: int = 256, miss: float = 1e-3, more: int = 6, exhaustive: int = 16384) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` for every row.

    Vectors link if their labels are equal and not null and their cosine is ``least`` or more. Null,
    empty and zero vectors, those with null or non-finite components, and those without a label link
    with nothing; vectors of unlike length do not link. Rows that repeat a vector link with each other. A row
    without an id can be linked but names no component: if no row of its component has an id,
    ``component_id`` is null and ``kept`` false. Other columns are ignored.

    ``passes`` is the first round; open vectors go through ``more`` at a time, and are compared exhaustively
    once that takes at most ``exhaustive`` comparisons for each of them.
    """
    rows = embeddings.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).cast("long").alias("label"), F.col(embedding).cast("array<double>").alias("embedding"))
    schema = "vec_id long, label long, signature binary, vector binary, keys array<long>"
    valid = cut_lineage(rows.where("label is not null and embedding is not null").mapInArrow(_keys(passes), schema), "vectors")
    # Keys of rows without an id are below all ids that may occur.
    keyed = valid.withColumn("nid", F.coalesce("vec_id", F.lit(-1) - F.shiftrightunsigned(F.xxhash64("label", "signature"), 2)))
    named = keyed.groupBy("label", "signature").agg(F.coalesce(F.min("vec_id"), F.min("nid")).alias("node"), F.count("*").alias("copies"))
    named = cut_lineage(named, "vector-classes")
    known = keyed.join(named, ["label", "signature"])
    reps = cut_lineage(known.where("nid = node").select("node", "label", "copies", "vector", "keys").distinct(), "representatives")
    links = _found(reps, passes, window, least, miss, more, exhaustive)
    linked = graph.components(links, "vector-links")

    sizes = linked.groupBy("component").agg(F.ceil(F.count("*") / chunk).alias("chunks"))
    members = linked.join(sizes, "component").join(reps.select("node", "copies", "vector"), "node")
    facing = members.withColumn("chunk", F.pmod(F.xxhash64("node"), "chunks")).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
    pairs = facing.select("component", F.least("chunk", "other").alias("one"), F.greatest("chunk", "other").alias("two"), "node", "chunk", "copies", "vector")
    pairs = pairs.repartition("component", "one", "two").sortWithinPartitions("component", "one", "two")
    counts = pairs.mapInArrow(_counted(least), "node long, links long").groupBy("node").agg(F.sum("links").alias("links"))

    placed = keyed.select("vec_id", "label", "signature").join(named, ["label", "signature"]).join(linked, "node", "left").withColumn("_root", F.coalesce("component", "node"))
    best = placed.groupBy("_root").agg(F.min("vec_id").alias("component_id"))
    full = placed.join(best, "_root").join(counts, "node", "left").select("vec_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    sound = F.size("embedding") > 0
    sound &= ~F.exists("embedding", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))) & F.exists("embedding", lambda v: v != 0)
    bare = rows.where(F.coalesce(~(sound & F.col("label").isNotNull()), F.lit(True))).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return full.union(bare).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
