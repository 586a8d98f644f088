"""Exact copies by progressive refinement: length, prefix hash, full hash.

Two texts are equal when they are identical after deleting every character of
``[\\x20\\x09-\\x0D]``; a null text counts as empty. Groups are refined on narrow rows:
first by the length of the normalised text, then by a hash of its first characters, and
only rows that still share both get a full SHA-256. A caller that wants the digest of
every row anyway (``digest_all``) gets it from the first scan, so the text is read once;
otherwise the second scan reads the surviving rows only.

Every level is an aggregate with a map-side part and a join of narrow rows; no group of
copies is ever collected, however many rows it holds.

Defined results: of equal texts the row with the most code points stays, then the
smallest id, null ids last. Rows that repeat id and text are copies like any other; one
of them stays. All empty and null texts are copies of each other. Empty table: no rows.
Other columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import save_stage
from .common import same, small_side

WHITE = " \t\n\x0b\f\r"
PREFIX_CHARS = 64


def squeezed(text: Column) -> Column:
    out = F.coalesce(text, F.lit(""))
    for char in WHITE:
        out = F.replace(out, F.lit(char), F.lit(""))
    return out


def _scan(docs: DataFrame) -> DataFrame:
    rows = docs.select(F.col("doc_id"), F.length(F.coalesce("text", F.lit(""))).cast("long").alias("n_chars"),
                       squeezed(F.col("text")).alias("norm"))
    return rows.select("doc_id", "n_chars", F.length("norm").cast("long").alias("size"),
                       F.xxhash64(F.substring("norm", 1, PREFIX_CHARS)).alias("head"), "norm")


def _digest() -> Column:
    return F.sha2(F.col("norm"), 256).alias("text_sha256")


def _repeated(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows whose keys occur more than once."""
    shared = rows.groupBy(*keys).count().filter("count > 1").drop("count")
    return rows.join(shared, list(keys), "left_semi")


def exact_copies(docs: DataFrame, digest_all: bool = False) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 (null for unique texts unless ``digest_all``)."""
    scan = _scan(docs)
    first = save_stage(scan.select("doc_id", "n_chars", "size", "head", *([_digest()] if digest_all else [])), "copies-keys")
    survivors = _repeated(_repeated(first, "size"), "size", "head")
    if digest_all:
        rows = first
    else:
        wanted = save_stage(survivors.select("doc_id", "size", "head").distinct(), "copies-survivors")
        full = save_stage(scan.join(small_side(wanted, 48), same(scan, wanted, "doc_id", "size", "head"), "left_semi")
                          .select("doc_id", "n_chars", "size", "head", _digest()), "copies-full")
        alone = first.join(wanted, same(first, wanted, "doc_id", "size", "head"), "left_anti")
        survivors, rows = full, full.unionByName(alone.withColumn("text_sha256", F.lit(None).cast("string")))
    order = F.struct((-F.col("n_chars")).alias("fewer"), F.col("doc_id").isNull().alias("unnamed"), F.col("doc_id").alias("id"))
    groups = (survivors.groupBy("size", "head", "text_sha256").agg(F.count("*").alias("n"), F.min(order).alias("best"))
              .filter("n > 1").select("size", "head", "text_sha256", "n", F.col("best.id").alias("best_id"), (-F.col("best.fewer")).alias("best_chars")))
    out = rows.join(groups, ["size", "head", "text_sha256"], "left").withColumn(
        "chosen", F.col("n").isNull() | (F.col("doc_id").eqNullSafe(F.col("best_id")) & (F.col("n_chars") == F.col("best_chars"))))
    again = Window.partitionBy("text_sha256", "doc_id", "chosen", "size", "head").orderBy("n_chars")  # only rows that repeat id and text meet here
    return out.select(
        "doc_id", F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("best_id")).alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        (F.col("chosen") & ((F.row_number().over(again) == 1) | F.col("n").isNull())).alias("kept"), "text_sha256")
