"""Stages of the corpus pipeline; each takes (spark, docs, sf_dir) and calls one operator.

Defined results: all stages but the last return the columns they were given, also extra ones whose names an operator uses
itself; an empty table gives no rows. Null, empty and letterless texts are rejected by the first stage; line dedup keeps every row;
rows without an id stay in the near-copy stage, as do null and empty texts, which copy nothing; a row that repeats another
stays or goes with it, and its copies are drawn alike. The last stage reads null as empty.
"""

from __future__ import annotations

import gc

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import byte_bpe, chosen_path, language_id, line_chunks, mixing
from .common import read, set_aside, ship_code


def _tidy(spark: SparkSession) -> None:
    """Let go of what earlier stages left on the driver: plans, broadcasts and shuffles that nothing refers to."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


#: columns of documents, the only ones the stages look at
DOCUMENT = ("doc_id", "text", "lang", "source", "n_chars")


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; the others are rejected."""
    ship_code(spark)
    _tidy(spark)
    model = language_id.fit(docs)
    rows, carried = set_aside(docs, *DOCUMENT)
    return language_id.identify(rows, model).filter(~F.col("rejected")).select(*carried)


def without_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without their repeated multi-line chunks and long runs; n_chars follows the text. Every row stays."""
    _tidy(spark)
    rows, carried = set_aside(docs, *DOCUMENT)
    out = line_chunks.dedup_passages(rows)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*carried)


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies the row with the smallest doc_id stays; rows without an id stay.

    Of texts of one class that share that id, one stays.
    """
    ship_code(spark)
    _tidy(spark)
    rows, carried = set_aside(docs, *DOCUMENT)
    kept = chosen_path.jaccard_join(rows, row_keys=True).filter("stays and doc_id is not null").select(
        F.col("doc_id").cast(docs.schema["doc_id"].dataType).alias("_id"), F.col("key1").alias("_k1"), F.col("key2").alias("_k2")).distinct()
    keyed = rows.select("*", *[k.alias(name) for k, name in zip(chosen_path.row_keys(F.col("text")), ("_key1", "_key2"))])
    named = keyed.join(kept, (keyed["doc_id"] == kept["_id"]) & (keyed["_key1"] == kept["_k1"]) & (keyed["_key2"] == kept["_k2"]), "left_semi")
    return named.select(*rows.columns).unionByName(rows.filter("doc_id is null")).select(*carried)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows drawn at their fitted rates: some twice, some not at all."""
    _tidy(spark)
    rows, carried = set_aside(docs, *DOCUMENT)
    return mixing.drawn(mixing.mix(rows, read(spark, sf_dir, "labels")), carried)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every whole text, told by their digests."""
    ship_code(spark)
    _tidy(spark)
    return byte_bpe.digests(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
