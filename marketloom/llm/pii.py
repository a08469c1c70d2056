"""Personal data by fixed patterns and by a character BiLSTM with CRF transitions, written and trained in numpy.

Patterns find well-formed items; the network is trained on the spans that they find in a bounded
sample, with the items rewritten in ways the patterns miss, and adds spans of the same kinds. A text is cut into
overlapping windows. All windows of a batch run through the network together; where two windows overlap, each
character takes its scores from the window in which it lies further from an edge, and one Viterbi
pass with the CRF transitions decodes the whole text.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from marketloom.llm import charnet, texts
from marketloom.settings import cut_lineage

#: The kinds in their order, and the base patterns.
KINDS = ("email", "ip", "card", "phone")
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

#: Longest character window and what two neighbours share.
WINDOW, OVERLAP = 256, 64
HIDDEN = 12
#: Windows decoded in one go; a longer run of windows is cut there, which bounds memory.
RUN_WINDOWS = 1024
#: Added to the hash of sample pieces without an item.
PLAIN = 1 << 48
TAGS = 1 + 2 * len(KINDS)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def _digits(value: str) -> str:
    return "".join(c for c in value if "0" <= c <= "9")


def _accepted(kind: int, value: str) -> bool:
    if kind == 1:
        return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in value.split("."))
    digits = _digits(value) if kind > 1 else ""
    return kind == 0 or (kind == 2 and 14 <= len(digits) <= 19 and luhn(digits)) or (kind == 3 and 10 <= len(digits) <= 15)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(start, kind, end)`` of all accepted matches, in code points, sorted."""
    out = []
    for kind, pattern, mark in ((0, EMAIL, "@"), (1, IP, "."), (2, CARD, ""), (3, PHONE, "+")):
        if mark in text:
            out += [(m.start(), kind, m.end()) for m in pattern.finditer(text) if _accepted(kind, m[0])]
    return sorted(out)


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def _at_mark(value: str) -> bool:
    return "@" in value or "(at)" in value or "[at]" in value


def _plausible(kind: int, value: str) -> bool:
    """What any item of a kind must hold, however it is written. Every such item has a digit or an at mark."""
    if kind == 0:
        return _at_mark(value) and any(c.isascii() and c.isalpha() for c in value)
    groups = re.findall("[0-9]+", value)
    if kind == 1:
        return len(groups) == 4 and all(len(g) <= 3 and int(g) <= 255 for g in groups)
    digits = "".join(groups)
    return (14 <= len(digits) <= 19 and luhn(digits)) if kind == 2 else 10 <= len(digits) <= 15


def _trigger(text: str, codes: np.ndarray) -> np.ndarray:
    """Positions without which no plausible item exists: digits and at marks."""
    hit = ((codes >= 48) & (codes <= 57)) | (codes == 64)
    if "(at)" in text or "[at]" in text:
        hit[[m.start() for m in re.finditer(r"[(\[]at[)\]]", text)]] = True
    return np.flatnonzero(hit)


def added_spans(net: charnet.Net, batch: list[str]) -> list[list[tuple[int, int, int]]]:
    """Spans of the network in every text.

    Windows without a digit or an at mark can't hold an accepted span, so only windows that have one
    near are scored; the runs between such gaps are decoded as a whole.
    """
    stride = WINDOW - OVERLAP
    codes = [charnet.encode(t) for t in batch]
    runs = []  # text, first window, windows
    for i, (text, code) in enumerate(zip(batch, codes, strict=True)):
        near = _trigger(text, code)
        if len(near):
            last = max(0, -(-(len(code) - OVERLAP) // stride) - 1)
            wanted = np.unique(np.clip(np.concatenate([(near - OVERLAP) // stride, near // stride, (near + OVERLAP) // stride]), 0, last))
            cut = np.flatnonzero(np.diff(wanted) > 1) + 1
            for part in np.split(wanted, cut):
                for at in range(0, len(part), RUN_WINDOWS):
                    runs.append((i, int(part[at]), len(part[at : at + RUN_WINDOWS])))
    runs.sort(key=lambda r: r[2])
    found: list[list[tuple[int, int, int]]] = [[] for _ in batch]
    at = 0
    while at < len(runs):
        group, windows = [], 0
        while at < len(runs) and (not group or (len(group) + 1) * runs[at][2] <= RUN_WINDOWS):
            group.append(runs[at])
            at += 1
        longest = group[-1][2]
        ids = np.full((sum(r[2] for r in group), WINDOW), charnet.PAD, np.uint8)
        for i, first, count in group:
            for k in range(count):
                piece = codes[i][(first + k) * stride : (first + k) * stride + WINDOW]
                ids[windows, : len(piece)] = piece
                windows += 1
        scored = charnet.scores(net, ids)
        emit = np.zeros((len(group), (longest - 1) * stride + WINDOW, TAGS), np.float32)
        lengths, row = [], 0
        for g, (i, first, count) in enumerate(group):
            for k in range(count):  # where windows overlap, each half goes to the window it lies deeper in
                begin = 0 if k == 0 else OVERLAP // 2
                emit[g, k * stride + begin : k * stride + WINDOW] = scored[row + k, begin:]
            row += count
            lengths.append(min((count - 1) * stride + WINDOW, len(codes[i]) - first * stride))
        paths = charnet.viterbi(net, emit, np.array(lengths))
        for (i, first, _), path, length in zip(group, paths, lengths, strict=True):
            found[i] += _named(batch[i], path[:length], first * stride)
    return found


def _named(text: str, path: np.ndarray, offset: int) -> list[tuple[int, int, int]]:
    kind = np.where(path == 0, -1, (path.astype(np.int64) - 1) // 2)
    edge = np.flatnonzero(np.concatenate([[True], (kind[1:] != kind[:-1]) | ((path[1:] % 2 == 1) & (path[1:] > 0))]))
    out = []
    for a, b in zip(edge.tolist(), [*edge[1:].tolist(), len(path)], strict=True):
        k = int(kind[a])
        if k < 0:
            continue
        value = text[offset + a : offset + b]
        tail = value.rstrip(" .,;:\n\t")
        head = tail.lstrip(" .,;:\n\t")
        start = offset + a + len(tail) - len(head)
        apart = not (text[max(0, start - 1) : start].isalnum() or text[start + len(head) : start + len(head) + 1].isalnum())
        if head and apart and _plausible(k, head):
            out.append((start, k, start + len(head)))
    return out


def all_spans(base: list[tuple[int, int, int]], added: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Base spans and those added ones that touch none of them."""
    out = list(base)
    for a, k, b in added:
        if all(b <= x or y <= a for x, _, y in base):
            out.append((a, k, b))
    return sorted(set(out))


def _respelled(kind: int, value: str, rng: np.random.Generator) -> str:
    """The item as people also write it, where no base pattern finds it."""
    pick = int(rng.integers(4))
    if kind == 0:
        name, _, host = value.partition("@")
        return [value, f"{name} (at) {host}", f"{name}[at]{host}", f"{name} @ {host}"][pick]
    if kind == 1:
        return [value, value.replace(".", " . "), value.replace(".", "[.]"), value.replace(".", "-")][pick]
    digits = _digits(value)
    if kind == 2:
        fours = [digits[i : i + 4] for i in range(0, len(digits), 4)]
        return [value, ".".join(fours), "/".join(fours), "_".join(fours)][pick]
    area, a, b = digits[-10:-7], digits[-7:-4], digits[-4:]
    return [value, f"({area}) {a}-{b}", f"{area}-{a}-{b}", f"{area}.{a}.{b}"][pick]


def examples(samples: list[str], seed: int = 3, length: int = 96) -> tuple[np.ndarray, np.ndarray]:
    """Training windows from text pieces: their base spans are labelled, most of them rewritten first."""
    rng = np.random.default_rng(seed)
    ids, tags = [], []
    for text in samples:
        for _ in range(2):
            parts, labels, at = [], [], 0
            for a, k, b in base_spans(text):
                if a < at:
                    continue
                new = _respelled(k, text[a:b], rng)
                parts += [text[at:a], new]
                labels += [0] * (a - at) + [1 + 2 * k] + [2 + 2 * k] * (len(new) - 1)
                at = b
            parts.append(text[at:])
            code = charnet.encode("".join(parts))
            labels += [0] * (len(code) - len(labels))
            first = int(rng.integers(max(1, len(code) - length + 1)))
            row, mark = np.full(length, charnet.PAD, np.uint8), np.zeros(length, np.int64)
            piece = code[first : first + length]
            row[: len(piece)] = piece
            mark[: len(piece)] = labels[first : first + length]
            ids.append(row)
            tags.append(mark)
    return np.array(ids).reshape(-1, length), np.array(tags).reshape(-1, length)


def _pieces(each: int):
    """Pieces of 160 characters around found items and elsewhere, the ``each`` of lowest hash of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[tuple[int, str]] = []
        for batch in batches:
            for lo, hi in texts.row_slices(batch.column(0)):
                for text in batch.column(0).slice(lo, hi - lo).to_pylist():
                    spans = base_spans(text)
                    starts = [max(0, a - 70) for a, _, _ in spans] + [len(text) // 2]
                    for piece in {text[s : s + 160] for s in starts}:
                        h = int.from_bytes(hashlib.blake2b(piece.encode(), digest_size=6).digest(), "big")
                        best.append((h if base_spans(piece) else h + PLAIN, piece))
                best = sorted(set(best))
                plain = [b for b in best if b[0] >= PLAIN]
                best = best[: min(each, len(best) - len(plain))] + plain[: each // 4]
        if best:
            yield pa.RecordBatch.from_arrays([pa.array([h for h, _ in best]), pa.array([t for _, t in best])], ["h", "piece"])

    return run


def fit(documents: DataFrame, text: str = "text", windows: int = 400, epochs: int = 12) -> charnet.Net:
    """A net from at most ``windows`` pieces with items and a quarter as many without, of lowest hash."""
    rows = documents.select(F.col(text).alias("text")).where("length(text) > 0").mapInArrow(_pieces(windows), "h long, piece string")
    rows = cut_lineage(rows.distinct(), "pieces")  # at most 1.25 * windows rows of a task
    with_items = rows.where(f"h < {PLAIN}").orderBy("h", "piece").limit(windows)
    without = rows.where(f"h >= {PLAIN}").orderBy("h", "piece").limit(windows // 4)
    samples = [r["piece"] for r in with_items.union(without).collect()]
    ids, tags = examples(sorted(samples))
    return charnet.train(ids, tags, HIDDEN, TAGS, epochs if len(ids) else 0)


def _find(shared, at: int, drop: list[int]):
    """Appends spans and the masked text to batches whose text is column ``at``; columns ``drop`` go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("stop", pa.int32()), ("base", pa.bool_())]))
        for batch in batches:
            for lo, hi in texts.row_slices(batch.column(at), 2 << 20):
                rows = batch.slice(lo, hi - lo)
                some = rows.column(at).to_pylist()
                out, masked = [], []
                for text, added in zip(some, added_spans(net, [t or "" for t in some]), strict=True):
                    base = base_spans(text or "")
                    own, full = set(base), all_spans(base, added)
                    out.append([{"kind": KINDS[k], "start": a, "stop": b, "base": (a, k, b) in own} for a, k, b in full])
                    masked.append(None if text is None else _masked(text, full))
                kept = [i for i in range(rows.num_columns) if i not in drop]
                columns = [rows.column(i) for i in kept] + [pa.array(out, kind), pa.array(masked, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, [rows.schema.names[i] for i in kept] + ["spans", "masked"])

    return run


def _masked(text: str, spans: list[tuple[int, int, int]]) -> str:
    parts, at = [], 0
    for a, k, b in spans:
        if a >= at:
            parts += [text[at:a], f"<{KINDS[k]}>"]
        elif b > at:  # two kinds overlap: the rest of the later one goes as well
            a = at
        at = max(at, b)
    return "".join([*parts, text[at:]]) if spans else text


def find(documents: DataFrame, net: charnet.Net, text: str = "text") -> DataFrame:
    """All rows and columns, with ``spans`` in code points and ``masked``, the text with each span as its kind.

    Null and empty texts have no spans, and a null text stays null. Columns of these two names are replaced.
    """
    shared = documents.sparkSession.sparkContext.broadcast(net)
    old = [i for i, c in enumerate(documents.columns) if c in ("spans", "masked")]
    added = StructType.fromDDL("spans array<struct<kind:string,start:int,stop:int,base:boolean>>, masked string")
    schema = StructType([f for i, f in enumerate(documents.schema.fields) if i not in old] + added.fields)
    return documents.mapInArrow(_find(shared, documents.columns.index(text), old), schema)
