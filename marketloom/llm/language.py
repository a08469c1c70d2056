"""Language identification as mixture inference: every text is a blend of languages.

Letter trigrams of each language are counted over all training rows. For a text, expectation
maximisation estimates the share of each language from the likelihoods of its trigrams; nested
sets of its leading languages are refitted, and the set with the best likelihood less
``log(n)`` for each language is taken. The prediction is the language with the largest share.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from marketloom.llm import texts

#: Letter classes: 0 for anything but letters, 1-26 for a-z, the rest for other letters by code point.
CLASSES = 40
GRAMS = CLASSES**3
_ROUNDS, _REFITS = 12, 5


def _letter_class(point: int) -> int:
    c = chr(point).lower()[0]
    if not c.isalpha():
        return 0
    return ord(c) - 96 if "a" <= c <= "z" else 27 + ord(c) % (CLASSES - 27)


_table: list[np.ndarray] = []


def _classes(text: str) -> np.ndarray:
    if not _table:
        _table.append(np.array([_letter_class(p) if not 0xD800 <= p < 0xE000 else 0 for p in range(0x30000)], np.uint8))
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return _table[0][np.minimum(points, 0x2FFFF)]


def trigrams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct trigram codes of a text with their counts; white space at both ends counts as a boundary."""
    c = _classes(f" {text} ").astype(np.int64)
    codes = c[:-2] * CLASSES * CLASSES + c[1:-1] * CLASSES + c[2:]
    if len(codes) < 4000:
        found, counts = np.unique(codes, return_counts=True)
    else:
        full = np.bincount(codes, minlength=GRAMS)
        found = np.flatnonzero(full)
        counts = full[found]
    return (found[1:], counts[1:]) if len(found) and found[0] == 0 else (found, counts)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: dict[str, np.ndarray] = {}
    for batch in batches:
        langs = batch.column(0).to_pylist()
        for lo, hi in texts.row_slices(batch.column(1)):
            for lang, text in zip(langs[lo:hi], batch.column(1).slice(lo, hi - lo).to_pylist(), strict=True):
                grams, n = trigrams(text)
                seen.setdefault(lang, np.zeros(GRAMS, np.int64))[grams] += n
    for lang, full in seen.items():
        at = np.flatnonzero(full)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at), pa.array(full[at])], ["lang", "gram", "n"])


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang") -> tuple[list[str], np.ndarray]:
    """Languages in order and the likelihood of each trigram under each, from all labelled rows.

    The driver receives at most ``GRAMS`` sums for each language. Rows without text or label teach nothing.
    """
    rows = labelled.select(F.col(lang).alias("lang"), F.col(text).alias("text")).where("lang is not null and text is not null")
    sums = rows.mapInArrow(_counts, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(sums["lang"].unique())
    count = np.zeros((GRAMS, len(langs)))
    count[sums["gram"].to_numpy(np.int64), np.searchsorted(langs, sums["lang"].to_numpy(str)) if langs else []] = sums["n"]
    share = (count + 0.1) / (count.sum(axis=0) + 0.1 * GRAMS)
    return langs, share.astype(np.float32)


def _blend(shares: np.ndarray, like: np.ndarray, counts: np.ndarray, first: np.ndarray, sizes: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Shares after some rounds of expectation maximisation for many texts, and their log likelihoods."""
    total = np.add.reduceat(counts, first)[:, None]
    for _ in range(rounds):
        weight = like * np.repeat(shares, sizes, axis=0)
        weight *= (counts / np.maximum(weight.sum(axis=1), 1e-30))[:, None]
        shares = np.add.reduceat(weight, first, axis=0) / total
    mixed = (like * np.repeat(shares, sizes, axis=0)).sum(axis=1)
    return shares, np.add.reduceat(counts * np.log(np.maximum(mixed, 1e-30)), first)


def infer(parts: list[tuple[np.ndarray, np.ndarray]], likelihood: np.ndarray) -> np.ndarray:
    """Language shares of texts given as (trigrams, counts); every text needs one trigram at least."""
    sizes = np.array([len(g) for g, _ in parts])
    first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    like = likelihood[np.concatenate([g for g, _ in parts])]
    counts = np.concatenate([n for _, n in parts]).astype(np.float32)
    langs = likelihood.shape[1]
    shares, score = _blend(np.full((len(parts), langs), 1 / langs, np.float32), like, counts, first, sizes, _ROUNDS)
    penalty = np.log(np.add.reduceat(counts, first))
    best, best_score = shares, score - langs * penalty
    order = np.argsort(-shares, axis=1, kind="stable")
    place = np.argsort(order, axis=1)
    for k in range(1, langs):
        some = np.where(place < k, np.maximum(shares, 1e-6), 0).astype(np.float32)
        some, score = _blend(some / some.sum(axis=1, keepdims=True), like, counts, first, sizes, _REFITS if k > 1 else 0)
        better = score - k * penalty > best_score
        best = np.where(better[:, None], some, best)
        best_score = np.where(better, score - k * penalty, best_score)
    return best


def _tag(shared, at: int, drop: list[int]):
    """Appends prediction, score and blend to batches whose text is column ``at``; columns ``drop`` go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, likelihood = shared.value
        kind = pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())]))
        for batch in batches:
            for lo, hi in texts.row_slices(batch.column(at), 1 << 20):
                rows = batch.slice(lo, hi - lo)
                parts = [trigrams(t or "") for t in rows.column(at).to_pylist()]
                some = [i for i, (g, _) in enumerate(parts) if len(g) and langs]
                named, score, blend = ["und"] * len(parts), [0.0] * len(parts), [[] for _ in parts]
                if some:
                    shares = infer([parts[i] for i in some], likelihood).astype(np.float64)
                    top = shares.argmax(axis=1)
                    for i, row, t in zip(some, shares, top.tolist(), strict=True):
                        named[i], score[i] = langs[t], min(1.0, float(row[t]))
                        blend[i] = [{"lang": langs[j], "share": float(row[j])} for j in np.flatnonzero(row > 0)]
                kept = [i for i in range(rows.num_columns) if i not in drop]
                columns = [rows.column(i) for i in kept] + [pa.array(named), pa.array(score), pa.array(blend, kind)]
                yield pa.RecordBatch.from_arrays(columns, [rows.schema.names[i] for i in kept] + ["lang_pred", "score", "blend"])

    return run


def predict(documents: DataFrame, model: tuple[list[str], np.ndarray], text: str = "text") -> DataFrame:
    """All rows and columns, with ``lang_pred``, ``score`` and ``blend`` from the text alone.

    ``und`` with score 0 for null texts, texts without letters, and models without languages.
    ``blend`` lists the chosen languages and their shares. Columns of these three names are replaced.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model)
    old = [i for i, c in enumerate(documents.columns) if c in ("lang_pred", "score", "blend")]
    added = StructType.fromDDL("lang_pred string, score double, blend array<struct<lang:string,share:double>>")
    schema = StructType([f for i, f in enumerate(documents.schema.fields) if i not in old] + added.fields)
    return documents.mapInArrow(_tag(shared, documents.columns.index(text), old), schema)


def held_out(doc_id: str = "doc_id"):
    """Whether a row is kept from training: crc32 of the id as text divides by 5; rows without an id are not."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))


def trained(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> tuple[list[str], np.ndarray]:
    """The model of all labelled rows that are not held out; rows without an id teach nothing."""
    return fit(documents.where(F.crc32(F.col(doc_id).cast("string")) % 5 != 0), text, lang)
