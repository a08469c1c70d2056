"""Byte-level BPE encoding and decoding with given merges, by batched merge rounds in numpy.

Texts are cut into words by the vocabulary's pattern. The distinct words that a worker has not met
yet are encoded together: the symbols of all words stand in one flat array, the rank of every
adjacent pair comes from a binary search over the sorted pair keys, and each round merges the
lowest-ranked pair of every word (leftmost first where occurrences overlap) until no word has
a pair left. A pair made by a merge always ranks after that merge, so the rounds give what merging
one pair at a time gives. Word results are kept in a store of bounded size for each worker.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketloom.llm import texts

#: Units kept by a worker before its store starts anew.
STORE_WORDS = 600_000
#: Words merged together: their arrays stay in a core's cache.
WORDS_AT_ONCE = 8192
_NONE = np.iinfo(np.int32).max


def byte_letters() -> dict[int, str]:
    """The letter that byte-level vocabularies write for each byte: printable ones stand for themselves."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in shown)}


@dataclass
class Vocabulary:
    """Fixed-size arrays of a tokenizer file: pairs by key, merged ids by rank, token bytes, special strings."""

    pattern: str
    byte_ids: np.ndarray
    pair_keys: np.ndarray
    pair_ranks: np.ndarray
    merged: np.ndarray
    size: int
    token_bytes: bytes
    token_ends: np.ndarray
    special: dict[str, int]

    @classmethod
    def read(cls, path: str, pattern: str) -> Vocabulary:
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        ids, byte_of = file["model"]["vocab"], {c: b for b, c in byte_letters().items()}
        special = {t["content"]: t["id"] for t in file["added_tokens"]}
        size = max([*ids.values(), *special.values()]) + 1
        spelled = {i: bytes(byte_of[c] for c in t) for t, i in ids.items()} | {i: t.encode() for t, i in special.items()}
        pieces = [spelled.get(i, b"") for i in range(size)]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in file["model"]["merges"]]
        keys = np.array([ids[a] * size + ids[b] for a, b in pairs], np.int64)
        order = np.argsort(keys)
        return cls(
            pattern,
            np.array([ids[byte_letters()[b]] for b in range(256)], np.int32),
            keys[order],
            order.astype(np.int32),
            np.array([ids[a + b] for a, b in pairs], np.int32),
            size,
            b"".join(pieces),
            np.cumsum([0, *map(len, pieces)]),
            special,
        )

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a.astype(np.int64) * self.size + b
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == key, self.pair_ranks[at], _NONE)


def merge_words(vocabulary: Vocabulary, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Token ids of all words in one array, and the end of each word in it; no word may be empty."""
    symbols = vocabulary.byte_ids[np.frombuffer(b"".join(words), np.uint8)]
    word = np.repeat(np.arange(len(words), dtype=np.int32), [len(w) for w in words])
    rank = np.full(len(symbols), _NONE, np.int32)
    inner = np.flatnonzero(word[1:] == word[:-1])
    rank[inner] = vocabulary.ranks(symbols[inner], symbols[inner + 1])
    done_symbols, done_words = [], []
    while len(symbols):
        first = np.flatnonzero(word[1:] != word[:-1]) + 1
        first = np.concatenate([[0], first])
        lowest = np.minimum.reduceat(rank, first)
        best = np.repeat(lowest, np.diff(first, append=len(symbols)))
        if 4 * np.count_nonzero(lowest == _NONE) >= len(lowest):
            open_ = best != _NONE
            done_symbols.append(symbols[~open_])
            done_words.append(word[~open_])
            symbols, word, rank, best = symbols[open_], word[open_], rank[open_], best[open_]
            if not len(symbols):
                break
        hit = np.flatnonzero((rank == best) & (rank != _NONE))
        if (hit[1:] == hit[:-1] + 1).any():  # overlapping occurrences: every other one of a row, from the left
            place = np.arange(len(hit))
            fresh = np.concatenate([[True], hit[1:] != hit[:-1] + 1])
            hit = hit[(place - np.maximum.accumulate(np.where(fresh, place, 0))) % 2 == 0]
        symbols[hit] = vocabulary.merged[rank[hit]]
        stays = np.ones(len(symbols), bool)
        stays[hit + 1] = False
        moved = hit - np.arange(len(hit))
        symbols, word, rank = symbols[stays], word[stays], rank[stays]
        right = moved[moved + 1 < len(symbols)]
        left = moved[moved > 0] - 1
        again = np.concatenate([left, right])
        again = again[word[again] == word[again + 1]]
        rank[moved] = _NONE
        rank[again] = vocabulary.ranks(symbols[again], symbols[again + 1])
    if not done_symbols:
        return np.zeros(0, np.int32), np.zeros(len(words), np.int64)
    symbols, word = np.concatenate(done_symbols), np.concatenate(done_words)
    order = np.argsort(word, kind="stable")
    return symbols[order], np.cumsum(np.bincount(word, minlength=len(words)))


class Encoder:
    """Encodes batches of texts; one for each worker and task.

    Texts are looked up by units: the stretches between spaces, each with the space before it. A
    word of the pattern holds a space only at its front, so units can be cut into words apart from
    each other, unless white space stands beside a space; such texts are cut as a whole.
    """

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.find = regex.compile(vocabulary.pattern).findall
        self.split = regex.compile("(" + "|".join(map(regex.escape, sorted(vocabulary.special, key=len, reverse=True))) + ")").split if vocabulary.special else None
        self.letters = np.frombuffer(vocabulary.token_bytes, np.uint8)
        self.reset()

    def reset(self) -> None:
        #: Unit to its place in the store, or -1 where it can't be cut apart from its neighbours.
        self.known: dict[str, int] = {}
        self.flat = np.zeros(0, np.int32)
        self.ends = np.zeros(1, np.int64)

    def whole(self, text: str) -> np.ndarray:
        """Ids of one text or unit, without the store."""
        out = []
        for i, part in enumerate(self.split(text) if self.split else [text]):
            if i % 2:
                out.append(np.array([self.vocabulary.special[part]], np.int32))
            elif part:
                out.append(merge_words(self.vocabulary, [w.encode() for w in self.find(part)])[0])
        return np.concatenate(out) if out else np.zeros(0, np.int32)

    def learn(self, units: set[str]) -> None:
        new = [u for u in units if u not in self.known]
        if len(self.known) + len(new) > STORE_WORDS:
            self.reset()
            new = list(units)
        find, known, at = self.find, self.known, len(self.ends) - 1
        words, counts = [], []
        for u in new:
            if u.strip() == (u[1:] if u[:1] == " " else u) and u:
                found = find(u[1:] if u[0] == " " else " " + u)
                known[u] = at + len(counts)
                counts.append(len(found))
                words += found
            else:
                known[u] = -1
        if counts:
            parts = [merge_words(self.vocabulary, [w.encode() for w in words[i : i + WORDS_AT_ONCE]]) for i in range(0, len(words), WORDS_AT_ONCE)]
            ends = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(e, prepend=0) for _, e in parts] or [np.zeros(0, np.int64)]))])
            self.ends = np.concatenate([self.ends, self.ends[-1] + ends[np.cumsum(counts)]])
            self.flat = np.concatenate([self.flat, *(i for i, _ in parts)])

    def encode(self, batch: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one array and the end of each text in it."""
        every, stops, apart = [], [], []
        for text in batch:
            special = any(m in text for m in self.vocabulary.special)
            apart.append(special)
            if not special:
                units = text.split(" ")
                units[0] = " " + units[0]  # a unit holds no space, so this marks the one without a space before it
                every += units
            stops.append(len(every))
        self.learn(set(every))
        at = np.fromiter(map(self.known.__getitem__, every), np.int64, len(every))
        begin = self.ends[at]
        size = np.where(at < 0, 0, self.ends[at + 1] - begin)
        total = np.concatenate([[0], np.cumsum(size)])
        ids = self.flat[np.repeat(begin - total[:-1], size) + np.arange(total[-1])]
        odd = np.concatenate([[0], np.cumsum(at < 0)])
        out, start = [], 0
        for text, special, stop in zip(batch, apart, stops, strict=True):
            out.append(self.whole(text) if special or odd[stop] > odd[start] else ids[total[start] : total[stop]])
            start = stop
        return np.concatenate(out), np.cumsum([len(x) for x in out])

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of the tokens, one after the other."""
        begin = self.vocabulary.token_ends[ids]
        size = self.vocabulary.token_ends[ids + 1] - begin
        total = np.concatenate([[0], np.cumsum(size)])
        return self.letters[np.repeat(begin - total[:-1], size) + np.arange(total[-1])].tobytes()


def _texts(column: pa.Array) -> Iterator[tuple[int, list[str]]]:
    for lo, hi in texts.row_slices(column, 2 << 20):
        yield lo, [t or "" for t in column.slice(lo, hi - lo).to_pylist()]


def _encode(shared, digests: bool, with_ids: bool = False):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value)
        for batch in batches:
            for lo, some in _texts(batch.column(1)):
                ids, ends = encoder.encode(some)
                doc_id = batch.column(0).slice(lo, len(some))
                if not digests:
                    offsets = pa.array(np.concatenate([[0], ends]), pa.int32())
                    yield pa.RecordBatch.from_arrays([doc_id, pa.ListArray.from_arrays(offsets, pa.array(ids, pa.int32()))], ["doc_id", "ids"])
                    continue
                parts = np.split(ids, ends[:-1])
                back = [encoder.decode(p).decode("utf-8", "replace") for p in parts]
                columns = [doc_id, pa.array([len(p) for p in parts], pa.int64()), pa.array([hashlib.sha256(p.astype("<u4").tobytes()).hexdigest() for p in parts])]
                columns.append(pa.array([hashlib.sha256(t.encode()).hexdigest() for t in back]))
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(ids, pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    return run


def _decode(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value)
        for batch in batches:
            lists = batch.column(1)
            back = [None if x is None else encoder.decode(np.array(x, np.int64)).decode("utf-8", "replace") for x in lists.to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(back, pa.string())], ["doc_id", "text"])

    return run


def encode(documents: DataFrame, path: str, pattern: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, ids)`` for every row; a null or empty text has no ids. Other columns are ignored."""
    shared = documents.sparkSession.sparkContext.broadcast(Vocabulary.read(path, pattern))
    return documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(_encode(shared, False), "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """``(doc_id, text)`` of ``(doc_id, ids)``; bytes that are no UTF-8 become U+FFFD, null ids stay null."""
    shared = encoded.sparkSession.sparkContext.broadcast(Vocabulary.read(path, pattern))
    return encoded.select("doc_id", "ids").mapInArrow(_decode(shared), "doc_id long, text string")


def digests(documents: DataFrame, path: str, pattern: str, doc_id: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """Encodes and decodes every text in one pass: number of ids, digest of the ids, digest of the decoded text.

    ``with_ids`` adds the ids themselves. Null texts count as empty; other columns are ignored.
    """
    shared = documents.sparkSession.sparkContext.broadcast(Vocabulary.read(path, pattern))
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    rows = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(_encode(shared, True, with_ids), schema)
