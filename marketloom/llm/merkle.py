"""A Merkle manifest of a dataset, built and proved by time-forward processing.

Leaves are digests of rows; the leaves of a group, in order, form a tree of fan-out eight, and the
roots of the groups form one more tree. A node is labelled (level, index): parents come after their
children. Digests travel forward in time through a priority queue ordered by the parent's label: a sweep
takes all messages for the smallest label, hashes them and sends the result on. The queue is external:
inside an aligned block of 8**LEVELS nodes it is a heap in the task, and what leaves a block is a row of
the next round's table, which the shuffle sorts by label. A reversed sweep, from the root down, sends
every node the path above it (its siblings, level by level), again by heap inside a block and by rows
between blocks. One row a block carries the path, so proofs don't multiply in the shuffle, and a task
holds one block whatever the size of a group. Texts are hashed where they are scanned and never shuffled.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketloom.operators.chunks import numbered
from marketloom.settings import cut_lineage

#: Fan-out of the trees, and levels of a block.
FAN, LEVELS = 8, 3
BLOCK = FAN**LEVELS
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

NODES = "tree string, block long, pos long, digest binary, height int"
PATHS = "tree string, block long, path binary, subroot binary, root binary"


def digest_of(values: Sequence[Column]) -> Column:
    """SHA-256 of the values one after the other: ``-`` for null, else byte count, colon, value."""
    text = [v.cast("string") for v in values]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in text]), 256)


def folded(text: Column) -> Column:
    """The text with A-Z in lower case and nothing else changed."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def every_third(key: str) -> Column:
    return F.crc32(F.col(key).cast("string").cast("binary")) % 3 == 0


def _hash(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def _sweep(digests: list[str], levels: int) -> list[tuple[int, int, list[str]]]:
    """Runs ``(level, index, children's digests)`` in label order; the last one's digest is the top.

    Messages are ``((level, index) of the receiver, slot, digest)``.
    """
    queue = [((1, i // FAN), i, d) for i, d in enumerate(digests)] if levels else []
    runs = []
    while queue:
        label, run = queue[0][0], []
        while queue and queue[0][0] == label:
            run.append(heapq.heappop(queue)[2])
        runs.append((*label, run))
        if label[0] < levels:
            heapq.heappush(queue, ((label[0] + 1, label[1] // FAN), label[1], _hash("".join(run))))
    return runs


def _top(digests: list[str], levels: int) -> str:
    runs = _sweep(digests, levels)
    return _hash("".join(runs[-1][2])) if runs else digests[0]


Path = tuple  # () at the root, else (digests left of the node, digests right of it, the parent's path)


def _paths(digests: list[str], levels: int, above: Path) -> list[Path]:
    """The path of every digest of a block whose top has the path ``above``, by a sweep against label order."""
    runs = _sweep(digests, levels)
    out: list[Path] = [above] * len(digests)
    queue = [(-levels, 0, above)]
    for level, index, run in reversed(runs):
        *label, path = heapq.heappop(queue)
        assert label == [-level, -index]
        for slot in range(len(run) - 1, -1, -1):
            sent = ("".join(run[:slot]), "".join(run[slot + 1 :]), path)
            at = index * FAN + slot
            if level == 1:
                out[at] = sent
            else:
                heapq.heappush(queue, (1 - level, -at, sent))
    return out


def _packed(path: Path) -> bytes:
    out = bytearray()
    while path:
        left, right, path = path
        out += bytes([len(left) // 64, len(right) // 64]) + bytes.fromhex(left + right)
    return bytes(out)


def _unpacked(data: bytes) -> Path:
    levels, at = [], 0
    while at < len(data):
        left, right = data[at], data[at + 1]
        text = data[at + 2 : at + 2 + 32 * (left + right)].hex()
        levels.append((text[: 64 * left], text[64 * left :]))
        at += 2 + 32 * (left + right)
    path: Path = ()
    for left, right in reversed(levels):
        path = (left, right, path)
    return path


def _siblings(path: Path) -> str:
    out = []
    while path:
        left, right, path = path
        out += [left, right]
    return "".join(out)


def _folded_up(digest: str, path: Path) -> str:
    while path:
        left, right, path = path
        digest = _hash(left + digest + right)
    return digest


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, list[dict]]]:
    """Rows of each (tree, block), which lie together."""
    key, rows = None, []
    for batch in batches:
        for row in batch.to_pylist():
            if (now := (row["tree"], row["block"])) != key and rows:
                yield key, rows
                rows = []
            key = now
            rows.append(row)
    if rows:
        yield key, rows


def _rise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for (tree, block), rows in _blocks(batches):
        height = rows[0]["height"]
        top = _top([r["digest"].hex() for r in rows], min(LEVELS, height))
        yield pa.RecordBatch.from_pylist(
            [{"tree": tree, "block": block // BLOCK, "pos": block, "digest": bytes.fromhex(top), "height": max(height - LEVELS, 0)}],
            schema=pa.schema([("tree", pa.string()), ("block", pa.int64()), ("pos", pa.int64()), ("digest", pa.binary()), ("height", pa.int32())]))


def _led(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, dict, list[dict]]]:
    """Blocks with the row that brings their path, which sorts first."""
    for key, rows in _blocks(batches):
        yield key, rows[0], rows[1:]


def _fall(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The path of every node that is a block of the round below."""
    schema = pa.schema([("tree", pa.string()), ("block", pa.int64()), ("path", pa.binary()), ("subroot", pa.binary()), ("root", pa.binary())])
    for (tree, _), head, rows in _led(batches):
        paths = _paths([r["digest"].hex() for r in rows], min(LEVELS, rows[0]["height"]), _unpacked(head["path"]))
        out = [{"tree": tree, "block": r["pos"], "path": _packed(p), "subroot": head["subroot"], "root": head["root"]} for r, p in zip(rows, paths)]
        yield pa.RecordBatch.from_pylist(out, schema=schema)


def _prove(with_proofs: bool) -> Callable:
    fields = [(c, pa.string()) for c in ("leaf", "subroot", "root", "proof_sha256", "folded_root")]
    schema = pa.schema([("doc_id", pa.int64()), *fields, ("verified", pa.bool_())] + ([("proof", pa.list_(pa.list_(pa.string())))] if with_proofs else []))

    def levels(path: Path) -> list[list[str]]:
        out = []
        while path:
            left, right, path = path
            out.append([left, right])
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, head, rows in _led(batches):
            subroot, root = head["subroot"].hex(), head["root"].hex()
            digests = [r["digest"].hex() for r in rows]
            out = []
            tails: dict[int, str] = {}  # runs of a block share what lies above them
            for row, leaf, path in zip(rows, digests, _paths(digests, min(LEVELS, rows[0]["height"]), _unpacked(head["path"]))):
                if path:
                    above = path[2]
                    tail = tails.setdefault(id(above), _siblings(above))
                    proof = _hash(path[0] + path[1] + tail)
                else:
                    proof = _hash("")
                reached = _folded_up((row["changed"] or row["digest"]).hex(), path)
                item = {"doc_id": row["doc_id"], "leaf": leaf, "subroot": subroot, "root": root, "proof_sha256": proof, "folded_root": reached, "verified": reached == root}
                out.append(item | ({"proof": levels(path)} if with_proofs else {}))
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    return run


def _height(n: Column) -> Column:
    """Rounds of eight until one of ``n`` nodes is left."""
    return F.size(F.filter(F.array(*[F.lit(FAN**k) for k in range(21)]), lambda p: n > p)).cast("int")


def _laid(nodes: DataFrame) -> DataFrame:
    return nodes.repartition("tree", "block").sortWithinPartitions("tree", "block", "pos")


def _risen(nodes: DataFrame, purpose: str) -> tuple[DataFrame, list[DataFrame]]:
    """The tops of the trees and, round by round, the nodes below them; the driver sees one height."""
    rounds = [nodes]
    while (rounds[-1].agg(F.max("height")).first()[0] or 0) > 0:
        rounds.append(cut_lineage(_laid(rounds[-1]).mapInArrow(_rise, NODES), purpose))
    return rounds[-1].select("tree", "digest"), rounds


def _fallen(tops: DataFrame, rounds: list[DataFrame], purpose: str) -> DataFrame:
    """``tops`` (tree, path, subroot, root) as rows of ``PATHS`` for the blocks of the lowest round."""
    paths = tops.select("tree", F.lit(0).cast("long").alias("block"), "path", "subroot", "root")
    for nodes in reversed(rounds[1:]):
        paths = cut_lineage(_with_paths(nodes, paths).mapInArrow(_fall, PATHS), purpose)
    return paths


def _with_paths(nodes: DataFrame, paths: DataFrame) -> DataFrame:
    return _laid(nodes.unionByName(paths.withColumn("pos", F.lit(-1).cast("long")), allowMissingColumns=True))


def manifest(
    documents: DataFrame, group: str = "lang", key: str = "doc_id", fields: Sequence[str] = FIELDS, text: str = "text",
    tampered: Callable[[str], Column] = every_third, tampering: Callable[[Column], Column] = folded, with_proofs: bool = False,
) -> DataFrame:
    """``(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified)`` for every row.

    ``leaf`` digests the ``fields``; ``subroot`` and ``root`` top the trees of the row's group and of all
    groups; ``proof_sha256`` digests the siblings on the way up. Where ``tampered(key)`` holds, ``text`` is
    put through ``tampering`` before its leaf is folded up again, otherwise the leaf itself is; ``verified``
    tells whether that reaches the root. ``with_proofs`` adds the siblings as ``[left, right]`` for each level.

    Groups are ordered by their bytes, null first; leaves by ``key``, null first, then by leaf digest, so
    repeated rows are leaves of their own in a defined order. A null key is never tampered with. Null
    fields digest as ``-``, empty texts as ``0:``. Other columns are ignored; an empty table gives no rows.
    """
    values = [F.col(f) for f in fields]
    other = [tampering(F.col(f)) if f == text else F.col(f) for f in fields]
    hit = F.coalesce(tampered(key), F.lit(False)) & F.col(text).isNotNull()
    leaves = documents.select(
        F.col(group).cast("string").alias("tree"), F.col(key).cast("long").alias("doc_id"), F.unhex(digest_of(values)).alias("digest"),
        F.when(hit, F.unhex(digest_of(other))).alias("changed"))
    placed = cut_lineage(numbered(cut_lineage(leaves, "hashed"), ["tree"], ["doc_id", "digest"], "pos"), "leaves")
    counts = placed.groupBy("tree").agg(_height(F.count("*")).alias("height")).withColumnRenamed("tree", "_t")
    pos = F.col("pos") - 1
    nodes = placed.withColumn("block", F.floor(pos / BLOCK)).withColumn("pos", pos)
    nodes = cut_lineage(nodes.join(counts, nodes["tree"].eqNullSafe(counts["_t"])).drop("_t"), "nodes")
    subroots, rounds = _risen(nodes.select("tree", "block", "pos", "digest", "height"), "rise")

    named = cut_lineage(numbered(subroots.withColumnRenamed("tree", "name"), [], ["name"], "pos"), "subroots")
    height = named.agg(_height(F.count("*")).alias("height"))
    upper = named.crossJoin(height).select(F.lit("").alias("tree"), "name", (F.col("pos") - 1).alias("pos"), "digest", "height")
    upper = cut_lineage(upper.withColumn("block", F.floor(F.col("pos") / BLOCK)), "upper")
    tops, above = _risen(upper.select("tree", "block", "pos", "digest", "height"), "rise")
    start = tops.select("tree", F.lit(bytearray()).alias("path"), "digest", F.col("digest").alias("root")).withColumnRenamed("digest", "subroot")
    fallen = _with_paths(upper.select("tree", "block", "pos", "digest", "height"), _fallen(start, above, "fall")).mapInArrow(_fall, PATHS)
    paths = upper.join(fallen.select(F.col("block").alias("pos"), "path", "root"), "pos")
    subtops = paths.select(F.col("name").alias("tree"), "path", F.col("digest").alias("subroot"), "root")

    proof = ", proof array<array<string>>" if with_proofs else ""
    out = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean" + proof
    return _with_paths(nodes, cut_lineage(_fallen(subtops, rounds, "fall"), "paths")).mapInArrow(_prove(with_proofs), out)
