"""A prefix trie over conversations, built as a burst trie.

A conversation is cut into pieces of ``SPAN`` turns. All pieces that follow the same prefix are suffixes in one
container under that trie head, equal suffixes being one row with a count. A container with more than
``burst`` different suffixes bursts: its head becomes a trie node and every next turn id a container of its own,
in rounds that touch oversized containers only. The remaining containers are sorted, and a sweep with a
stack of one path turns each into nodes. Node ids are XORs of position-salted 128-bit turn hashes, so the heads
of all pieces are known without walking the trie, and long conversations need no more rounds than short ones.

Sums over subtrees climb from the sweeps to the burst heads round by round. What lies below a piece's last turn
is added to the piece of its smallest member, from which it reaches all ancestors, so no pass goes
turn by turn. Only hashes and lengths of turns are shuffled, never their texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketloom.operators.chunks import CHUNK, numbered, ranged
from marketloom.settings import cut_lineage

#: Turns of a piece, and different suffixes a container may hold before it bursts.
SPAN, BURST = 64, 4096
_FRAME = 1 << 12

_EMPTY = hashlib.sha256(b"").hexdigest()
_COLUMNS = ("kind", "depth", "hi", "lo", "phi", "plo", "off", "conv", "parent", "n", "children", "leaves", "saved")
_TYPES = {"kind": pa.string(), "off": pa.int32()}
_SCHEMA = pa.schema([(c, _TYPES.get(c, pa.int64())) for c in _COLUMNS])
_OUT = ", ".join(f"{c} {dict(kind='string', off='int').get(c, 'long')}" for c in _COLUMNS)


def rebuilt(conversations: DataFrame, shared: int = 100, most: int = 6) -> tuple[DataFrame, DataFrame]:
    """``(member, total)`` and ``(member, at, item, length, total)`` of conversations that share openings.

    Conversation c opens with the first h = crc32(c) % ``most`` turns of conversation c - c % ``shared`` (all if it
    has fewer, none if it is absent) and goes on with its own turns after the first h. Turns are in the order of
    ``turn``, null first; turns that tie are ordered by the digest of role and text, so repeated rows stay
    turns of their own. Null roles and texts are empty. Rows without a conv_id belong to no conversation
    and are left out.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    item = F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"))
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv"), "turn", item.alias("item"), F.length(text).cast("long").alias("length"))
    own = cut_lineage(numbered(cut_lineage(rows, "items"), ["conv"], ["turn", "item"], "pos").select("conv", "pos", "item", "length"), "turns")
    sizes = cut_lineage(own.groupBy("conv").agg(F.max("pos").alias("n")), "sizes")
    named = sizes.select("conv", "n", (F.crc32(F.col("conv").cast("string").cast("binary")) % most).alias("h"), (F.col("conv") - F.col("conv") % shared).alias("base"))
    first = sizes.select(F.col("conv").alias("base"), F.col("n").alias("has"))
    members = named.join(first, "base", "left").withColumn("m", F.least("h", F.coalesce("has", F.lit(0))))
    members = cut_lineage(members.withColumn("total", F.col("m") + F.greatest(F.col("n") - F.col("h"), F.lit(0))), "members")
    opening = own.where((F.col("conv") % shared == 0) & (F.col("pos") < most)).withColumnRenamed("conv", "base")
    opening = members.join(opening, "base").where("pos <= m").select("conv", F.col("pos").alias("at"), "item", "length", "total")
    rest = own.join(members.select("conv", "h", "m", "total"), "conv").where("pos > h").select("conv", (F.col("pos") - F.col("h") + F.col("m")).alias("at"), "item", "length", "total")
    return members.select(F.col("conv").alias("member"), "total"), opening.union(rest).withColumnRenamed("conv", "member")


def _along(rows: DataFrame, by: str, order: str, sums: dict[str, Column], back: bool = False) -> DataFrame:
    """Adds aggregates over the rows of a key before (or after) each row, with one carried row for each frame.

    ``order`` counts densely from 0, so frames of equally many values are balanced whatever the key holds.
    """
    frame = F.floor(F.col(order) / _FRAME).alias("_frame")
    rows = rows.withColumn("_frame", frame)
    each = rows.groupBy(by, "_frame").agg(*[c.alias(f"_all_{n}") for n, c in sums.items()])
    span = (1, Window.unboundedFollowing) if back else (Window.unboundedPreceding, -1)
    outer = Window.partitionBy(by).orderBy("_frame").rowsBetween(*span)
    inner = Window.partitionBy(by, "_frame").orderBy(order).rowsBetween(*span)
    join = {n: (F.bit_xor if n in ("hi", "lo") else F.sum) for n in sums}
    carried = each.select(by, "_frame", *[F.coalesce(join[n](f"_all_{n}").over(outer), F.lit(0)).alias(f"_old_{n}") for n in sums])
    rows = rows.withColumns({f"_in_{n}": F.coalesce(c.over(inner), F.lit(0)) for n, c in sums.items()}).join(carried, [by, "_frame"])

    def both(n: str) -> Column:
        a, b = F.col(f"_in_{n}"), F.col(f"_old_{n}")
        return a.bitwiseXOR(b) if n in ("hi", "lo") else a + b

    out = rows.withColumns({f"head_{n}" if n in ("hi", "lo") else n: both(n) for n in sums})
    return out.drop("_frame", *[f"_{p}_{n}" for n in sums for p in ("in", "old")])


def _pieces(members: DataFrame, steps: DataFrame) -> DataFrame:
    """``(member, k, path, lens, total, hi, lo, head_hi, head_lo)``: suffixes of up to SPAN turns and their heads."""
    steps = steps.select("member", "total", "at", F.col("length").cast("long").alias("length"), F.xxhash64(F.lit(1), "at", "item").alias("hi"), F.xxhash64(F.lit(2), "at", "item").alias("lo"))
    one = F.struct("at", "hi", "lo", "length")
    cut = steps.groupBy("member", F.floor((F.col("at") - 1) / SPAN).alias("k")).agg(
        F.sort_array(F.collect_list(one)).alias("a"), F.max("total").alias("total"), F.bit_xor("hi").alias("hi"), F.bit_xor("lo").alias("lo"))
    path = F.unhex(F.array_join(F.transform("a", lambda x: F.concat(F.lpad(F.hex(x["hi"]), 16, "0"), F.lpad(F.hex(x["lo"]), 16, "0"))), ""))
    cut = cut.select("member", "k", path.alias("path"), F.transform("a", lambda x: x["length"]).alias("lens"), "total", "hi", "lo")
    zero = F.lit(0).cast("long")
    ended = members.where(F.col("total") % SPAN == 0).select(
        "member", F.floor(F.col("total") / SPAN).alias("k"), F.lit(bytearray()).alias("path"), F.array().cast("array<bigint>").alias("lens"), "total", zero.alias("hi"), zero.alias("lo"))
    every = cut_lineage(cut.unionByName(ended), "pieces")
    short = every.where(F.col("total") < SPAN).withColumns({"head_hi": zero, "head_lo": zero})
    long = _along(every.where(F.col("total") >= SPAN), "member", "k", {"hi": F.bit_xor("hi"), "lo": F.bit_xor("lo")})
    return short.unionByName(long.select(short.columns))


def _long(binary: Column) -> Column:
    return F.conv(F.hex(binary), 16, -10).cast("long")


class _Node:
    __slots__ = ("children", "conv", "hi", "leaves", "length", "lo", "n", "ports", "saved")

    def __init__(self, hi: int, lo: int, length: int):
        self.hi, self.lo, self.length = hi, lo, length
        self.n = self.children = self.leaves = self.saved = 0
        self.conv, self.ports = None, []


def _sweep(span: int):
    """Sorted containers to nodes: rows of kind node, port (a node that heads the next piece) and total."""

    def close(stack: list[_Node], keep: int, off: int, depth: int, out: list[tuple], first: tuple) -> None:
        while len(stack) > keep:
            node = stack.pop()
            at = off + len(stack)
            saved = (node.n - 1) * node.length
            if at == span:
                parent = stack[-1]
                parent.ports.append((node.hi, node.lo, saved))
                node.saved += saved
            else:
                node.leaves += not node.children
                node.saved += saved
                top = not stack
                known = stack[-1] if stack else None
                out.append((("top" if top else "node"), depth + len(stack), node.hi, node.lo, *first, node.conv, None, node.n, node.children, node.leaves, node.saved, known))
                for hi, lo, more in node.ports:
                    out.append(("port", depth + len(stack) + 1, hi, lo, None, None, None, None, node.conv, None, None, None, more, None))
            if stack:
                up = stack[-1]
                up.n += node.n
                up.conv = node.conv if up.conv is None or node.conv < up.conv else up.conv
                up.children += 1
                up.leaves += node.leaves
                up.saved += node.saved

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        container, stack, before, out, first, off, depth = None, [], b"", [], (), 0, 0

        def rows() -> pa.RecordBatch:
            full = [r[:8] + ((r[-1].conv if r[-1] is not None else r[8]),) + r[9:13] for r in out]
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*full), _SCHEMA)], schema=_SCHEMA)

        for batch in batches:
            for row in batch.to_pylist():
                path, lens = row["path"], row["lens"]
                turns = len(path) // 16
                if (key := (row["depth"], row["hi"], row["lo"])) != container:
                    close(stack, 0, off, depth, out, first)
                    # Parents' members are complete only when they are closed, so rows go out between containers.
                    if len(out) > 10_000:
                        yield rows()
                    container, off, depth, first = key, row["off"], row["depth"], (row["phi"], row["plo"], row["off"])
                    stack.append(_Node(row["hi"], row["lo"], lens[off - 1] if off else 0))
                    before, shared = path, off
                else:
                    shared = off
                    while 16 * shared < len(path) and path[16 * shared : 16 * shared + 16] == before[16 * shared : 16 * shared + 16]:
                        shared += 1
                    close(stack, shared - off + 1, off, depth, out, first)
                    before = path
                for i in range(shared, turns):
                    up = stack[-1]
                    hi = int.from_bytes(path[16 * i : 16 * i + 8], "big", signed=True)
                    lo = int.from_bytes(path[16 * i + 8 : 16 * i + 16], "big", signed=True)
                    stack.append(_Node(up.hi ^ hi, up.lo ^ lo, lens[i]))
                end = stack[-1]
                end.n += row["n"]
                end.conv = row["conv"] if end.conv is None or row["conv"] < end.conv else end.conv
                end.leaves += row["hung_leaves"]
                end.saved += row["hung_saved"]
        close(stack, 0, off, depth, out, first)
        if out:
            yield rows()

    return run


_HEAD = ["depth", "hi", "lo"]


def _level(pieces: DataFrame, burst: int, span: int, purpose: str) -> DataFrame:
    """Nodes, ports and burst heads (kind head) of ``pieces`` as rows of ``_OUT``; tops and heads know their parent's id."""
    none = F.lit(None).cast("long")
    start = pieces.groupBy("k", "head_hi", "head_lo", "path", "lens").agg(
        F.count("*").alias("n"), F.min("member").alias("conv"), F.sum("hung_leaves").alias("hung_leaves"), F.sum("hung_saved").alias("hung_saved"))
    start = start.select(
        (F.col("k") * span).alias("depth"), F.col("head_hi").alias("hi"), F.col("head_lo").alias("lo"), none.alias("phi"), none.alias("plo"),
        F.lit(0).alias("off"), "path", "lens", "n", "conv", "hung_leaves", "hung_saved")
    live, closed, heads = cut_lineage(start, purpose), [], []
    for off in range(span):
        full = cut_lineage(live.groupBy(*_HEAD).agg(F.count("*").alias("_n")).where(F.col("_n") > burst).select(*_HEAD), purpose)
        if full.isEmpty():
            closed.append(live)
            break
        closed.append(live.join(full, _HEAD, "left_anti"))
        over = live.join(full, _HEAD, "left_semi")
        step = F.substring("path", 16 * off + 1, 16)
        more = F.octet_length("path") > 16 * off
        next_hi, next_lo = _long(F.substring(step, 1, 8)), _long(F.substring(step, 9, 8))
        over = over.withColumns({"_hi": F.when(more, F.col("hi").bitwiseXOR(next_hi)), "_lo": F.when(more, F.col("lo").bitwiseXOR(next_lo)), "_len": F.when(more, F.get("lens", F.lit(off)))})
        own = F.coalesce(F.get("lens", F.lit(off - 1)), F.lit(0)) if off else F.lit(0)
        keys = [*_HEAD, "phi", "plo", "off"]
        kids = over.groupBy(*keys, own.cast("long").alias("own"), "_hi", "_lo", "_len").agg(
            F.sum("n").alias("n"), F.min("conv").alias("conv"), F.sum("hung_leaves").alias("hung_leaves"), F.sum("hung_saved").alias("hung_saved"))
        kids = cut_lineage(kids, purpose)
        head = kids.groupBy(*keys, "own").agg(F.sum("n").alias("n"), F.min("conv").alias("conv"), F.count("_hi").alias("children"))
        last = off + 1 == span
        heads.append((cut_lineage(head, purpose), kids if last else None))
        live = over.where(more & F.lit(not last)).select(
            (F.col("depth") + 1).alias("depth"), F.col("_hi").alias("hi"), F.col("_lo").alias("lo"), F.col("hi").alias("phi"), F.col("lo").alias("plo"),
            F.lit(off + 1).alias("off"), "path", "lens", "n", "conv", "hung_leaves", "hung_saved")
        live = cut_lineage(live, purpose)
    held = closed[0]
    for more in closed[1:]:
        held = held.union(more)
    swept = held.repartition(*_HEAD).sortWithinPartitions(*_HEAD, "path").mapInArrow(_sweep(span), _OUT)
    done = cut_lineage(swept, purpose)
    # Sums below the burst heads, from the deepest round up.
    below, found = done.where("kind = 'top' and off > 0").select((F.col("depth") - 1).alias("depth"), "phi", "plo", "leaves", "saved"), []
    for head, ports in reversed(heads):
        if ports is not None:
            own = (F.col("n") - 1) * F.col("_len")
            ports = ports.where("_hi is not null").select(*_HEAD, "_hi", "_lo", "hung_leaves", F.col("hung_saved"), own.alias("saved"))
            below = below.union(ports.select("depth", "hi", "lo", "hung_leaves", F.col("hung_saved") + F.col("saved")))
            least = head.select(*_HEAD, F.col("conv").alias("parent"))
            found.append(ports.join(least, _HEAD).select(F.lit("port").alias("kind"), (F.col("depth") + 1).alias("depth"), F.col("_hi").alias("hi"), F.col("_lo").alias("lo"), "parent", "saved"))
        sums = below.groupBy("depth", F.col("phi").alias("hi"), F.col("plo").alias("lo")).agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("_saved"))
        full = head.join(sums, _HEAD, "left").withColumn("saved", F.col("_saved") + (F.col("n") - 1) * F.col("own"))
        full = cut_lineage(full.select(F.lit("head").alias("kind"), *_HEAD, "phi", "plo", "off", "conv", "n", "children", "leaves", "saved"), purpose)
        found.append(full)
        below = below.union(full.where("off > 0").select((F.col("depth") - 1).alias("depth"), "phi", "plo", "leaves", "saved"))
    for more in found:
        done = done.unionByName(more, allowMissingColumns=True)
    return done


def _ends(pieces: DataFrame) -> DataFrame:
    """``(depth, hi, lo, ends_sha256)`` of every node at which members end.

    The ids of a node are joined to text range by range; one task hashes a node's texts in order, one at a time.
    """
    last = pieces.where(F.octet_length("path") < 16 * SPAN)
    ended = last.select(F.col("total").alias("depth"), F.col("hi").bitwiseXOR(F.col("head_hi")).alias("hi"), F.col("lo").bitwiseXOR(F.col("head_lo")).alias("lo"), "member")
    laid = ranged(ended, _HEAD, ["member"])
    text = F.array_join(F.transform(F.sort_array(F.collect_list("member")), lambda x: x.cast("string")), ",")
    texts = laid.groupBy(*_HEAD, CHUNK).agg(text.alias("text")).repartition(*_HEAD).sortWithinPartitions(*_HEAD, CHUNK)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sha = None, None
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if (now := tuple(row[c] for c in _HEAD)) != key:
                    if key is not None:
                        out.append((*key, sha.hexdigest()))
                    key, sha = now, hashlib.sha256(row["text"].encode())
                else:
                    sha.update(b"," + row["text"].encode())
            if out:
                yield _listed(out)
        if key is not None:
            yield _listed([(*key, sha.hexdigest())])

    return texts.mapInArrow(digest, "depth long, hi long, lo long, ends_sha256 string")


def _listed(rows: list[tuple]) -> pa.RecordBatch:
    d, h, lo, s = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(d, pa.int64()), pa.array(h, pa.int64()), pa.array(lo, pa.int64()), pa.array(s)], [*_HEAD, "ends_sha256"])


def nodes(members: DataFrame, steps: DataFrame, burst: int = BURST) -> DataFrame:
    """One row for every node of the trie of all members' sequences.

    ``members`` has ``(member, total)`` with unique ids, ``steps`` one row ``(member, at, item, length, total)`` for
    each position from 1 to total. Returns ``(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256)``: the smallest member that starts with the node's sequence, its depth, the
    parent's conv_id (null at the root), the members, children and childless nodes below (itself included),
    (members - 1) times the length of the last step, summed over the subtree, and the digest of the ids that
    end here. Members without steps sit at the root; without members there are no nodes.
    """
    pieces = _pieces(members, steps)
    zero = F.lit(0).cast("long")
    plain = pieces.withColumns({"hung_leaves": zero, "hung_saved": zero})
    deep = plain.where("k > 0")
    if not deep.isEmpty():
        sums = _level(deep, burst, SPAN, "deep").where(f"kind in ('top', 'head') and off = 0 and depth % {SPAN} = 0")
        sums = sums.select(F.col("conv").alias("member"), (F.col("depth") / SPAN).cast("long").alias("k"), F.col("leaves").alias("_l"), F.col("saved").alias("_s"))
        long = pieces.where(F.col("total") >= SPAN).join(sums, ["member", "k"], "left")
        long = _along(long, "member", "k", {"hung_leaves": F.sum(F.coalesce("_l", zero)), "hung_saved": F.sum(F.coalesce("_s", zero))}, back=True)
        plain = plain.where(F.col("total") < SPAN).unionByName(long.select(plain.columns))
    found = cut_lineage(_level(cut_lineage(plain, "hung"), burst, SPAN, "trie"), "nodes")
    inner = found.where("kind = 'node'").select(*_HEAD, "conv", "parent", "n", "children", "leaves", "saved")
    tops = found.where("kind in ('top', 'head')")
    parents = found.where("kind = 'head'").select((F.col("depth") + 1).alias("_d"), F.col("hi").alias("_h"), F.col("lo").alias("_l"), F.col("conv").alias("_p"))
    ports = found.where("kind = 'port'").select(*_HEAD, F.col("parent").alias("_p"), F.col("saved").alias("_more"))
    under = tops.where("off > 0").join(parents, (F.col("depth") == F.col("_d")) & (F.col("phi") == F.col("_h")) & (F.col("plo") == F.col("_l")))
    under = under.select(*_HEAD, "conv", F.col("_p").alias("parent"), "n", "children", "leaves", "saved")
    first = tops.where("off = 0").join(ports, _HEAD, "left")
    first = first.select(*_HEAD, "conv", F.col("_p").alias("parent"), "n", "children", "leaves", (F.col("saved") + F.coalesce("_more", zero)).alias("saved"))
    every = inner.union(under).union(first).join(_ends(pieces), _HEAD, "left")
    return every.select(
        F.col("conv").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), F.col("n").alias("n_convs"), F.col("children").alias("n_children"),
        F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(_EMPTY)).alias("ends_sha256"))
