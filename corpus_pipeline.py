"""A training-data pipeline over ``documents``: one operator a stage, written and read again between stages."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marketloom.llm import bpe, language, minhash_paths, mixing, pii
from marketloom.settings import cut_lineage

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: A document whose leading language has less than this share of it is rejected.
LEAST_SHARE = 0.3


def _wrapped(docs: DataFrame, *names: str) -> DataFrame:
    """The whole row as one column ``row`` beside the columns a stage reads, so no name of a stage meets a user's column."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *names)


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters, and those in which no language leads, go; the others stay as they are.

    Null and empty texts hold no letter and go. Rows without an id teach nothing but are judged like all others;
    repeated rows share one fate. Texts are read whole. An empty table stays empty.
    """
    tagged = language.predict(_wrapped(docs, "text"), language.trained(docs.select("doc_id", "text", "lang")))
    return tagged.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SHARE)).select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked at similarity 0.8 or more stays: the one with the smallest doc_id.

    Texts without words link with nothing and stay. Rows without an id all stay. An id names one document: of
    several rows with one id the one with the smallest text stays (null last), since a group is named by its id.
    """
    kept = minhash_paths.near_duplicates(docs.select("doc_id", "text"), hundredths=80).where("kept").select(F.col("doc_id").alias("id")).distinct()
    rows = _wrapped(docs, "doc_id", "text")
    single = rows.join(kept, F.col("doc_id") == F.col("id"), "left_semi")
    first = Window.partitionBy("doc_id").orderBy(F.col("text").asc_nulls_last())
    single = single.withColumn("place", F.row_number().over(first)).where("place = 1")
    return single.select("row.*").union(docs.where("doc_id is null"))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every item of personal data gives way to its kind in angle brackets; ``n_chars`` follows the new text.

    All rows stay. Texts without items, empty and null ones stay as they are; the ``n_chars`` of a null text is null.
    """
    found = pii.find(_wrapped(docs, "text"), pii.fit(docs.select("text")))
    new = {"text": F.col("masked"), "n_chars": F.length("masked").cast("long")}
    return found.select(*[(new[c] if c in new else F.col("row")[c]).alias(c) for c in docs.columns])


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes its words, rounded: not at all, once or twice.

    Documents without words take part in no mix and go. A null source is a source of its own. Rows that repeat id
    and text are taken as often as the one of them that is taken most.
    """
    rows = _wrapped(docs, "text", "source", F.xxhash64("doc_id", "text").alias("key"))
    taken = mixing.mixed(rows, doc_id="key").where("size > 0")
    copies = taken.groupBy(F.col("doc_id").alias("key")).agg(F.max(F.round(F.col("taken") / F.col("size"))).cast("int").alias("copies"))
    often = rows.join(copies.where("copies > 0"), "key")
    return often.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``(doc_id, n_tokens, ids_sha256, decoded_sha256, ids)`` of every row; null texts count as empty and have no tokens."""
    return bpe.digests(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN, with_ids=True)


STAGES: list[tuple[str, Stage]] = [
    ("language", identify),
    ("near_duplicates", near_duplicates),
    ("personal_data", mask_personal_data),
    ("mixing", mix),
    ("tokens", tokenize),
]

#: Trained models, minwise trees and tokens have no SQL; tests hold the stages against plain Python on small tables.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies all stages to ``documents``; every stage but the last is written to the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
