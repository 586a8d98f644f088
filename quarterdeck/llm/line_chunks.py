"""Removal of line passages that repeat across documents, by content-defined chunks.

The lines of a text are hashed; a rolling hash over the last two line hashes chooses the
chunk boundaries (never two in a row), so an insertion moves only those beside it. Chunks of two
or more lines that occur more than once anywhere are removed, but for the first
occurrence (smallest doc_id, nulls last, then chunk number).

Only hashes are shuffled at first. Texts are looked at again for the documents that hold
a repeated hash, and their suspicious chunks are compared as bytes (grouped by the chunk
text itself), so a hash collision removes nothing. Counts have a map-side part; a passage
held by a third of all documents is one row per map task.

Defined results: a null text stays null and has no chunks; an empty text is one empty
line; chunks of one line are never removed; a text all of whose chunks go becomes empty.
Rows that repeat id and text are one document and get the same result. Other columns are
kept, except that the operator adds the three columns of :func:`dedup_lines`.

A passage without a complete shared chunk is not seen by the chunks. :func:`dedup_passages`
also removes such passages: every two-line window, and every line of more than
``RUN_WORDS`` words, is hashed and compared in the same way; windows that are not the
first of their text, and follow each other line by line, form a maximal run, which is
removed if it has more than ``RUN_WORDS`` words. As the first occurrence always lies
earlier, each line that goes is left in some document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import save_stage
from .common import set_aside, small_side

#: a boundary may follow every line whose rolling hash is a multiple of this; the mean chunk has about four lines
DIVISOR = 2
#: multiplier of the older line in the rolling hash
OLDER = 31
#: maximal runs of repeated windows, and single repeated lines, go if they have more words than this
RUN_WORDS = 50


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def _line_hash(line: Column) -> Column:
    return F.conv(F.substring(F.md5(line), 1, 7), 16, 10).cast("long")


def spans(lines: Column, hashes: Column) -> Column:
    """Array of (first, last) line numbers of the chunks, counted from 0."""
    last = F.size(lines) - 1
    chosen = lambda i: (i >= 1) & ((F.get(hashes, i - 1) * OLDER + F.get(hashes, i)) % DIVISOR == 0)
    # two boundaries in a row would leave a chunk of one line, so the second one does not count
    ends = F.filter(F.sequence(F.lit(0), last), lambda i: (i == last) | (chosen(i) & ~F.coalesce(chosen(i - 1), F.lit(False))))
    return F.transform(ends, lambda end, k: F.struct(
        F.when(k == 0, 0).otherwise(F.get(ends, k - 1) + 1).cast("int").alias("first"), end.cast("int").alias("last")))


def _with_spans(rows: DataFrame, wanted: Column | None = None) -> DataFrame:
    """Adds _lines and _spans, each computed once; both null where ``wanted`` is false."""
    only = (lambda c: c) if wanted is None else (lambda c: F.when(wanted, c))
    lines = rows.withColumn("_lines", only(_lines(F.col("text"))))
    hashed = lines.withColumn("_hashes", only(F.transform("_lines", _line_hash)))
    return hashed.withColumn("_spans", only(spans(F.col("_lines"), F.col("_hashes")))).drop("_hashes")


def _chunk(span: Column) -> Column:
    return F.array_join(F.slice(F.col("_lines"), span["first"] + 1, span["last"] - span["first"] + 1), "\n")


def _row_key() -> Column:
    return F.xxhash64("doc_id", "text")


def removed_chunks(docs: DataFrame) -> DataFrame:
    """doc_id, _row, and the numbers of the chunks to remove, one row per affected document (a saved stage)."""
    rows = docs.select("doc_id", "text", _row_key().alias("_row")).filter("text is not null")
    spanned = _with_spans(rows)
    found = spanned.select("doc_id", "_row", F.posexplode(F.transform("_spans", lambda s: F.when(s["last"] > s["first"], F.xxhash64(_chunk(s))))).alias("no", "hash"))
    narrow = save_stage(found.filter("hash is not null"), "lines-hashes")
    repeated = narrow.groupBy("hash").count().filter("count > 1").drop("count")
    suspects = save_stage(narrow.join(repeated, "hash", "left_semi").groupBy("doc_id", "_row").agg(F.collect_set("no").alias("nos")), "lines-suspects")

    side = small_side(suspects.select(F.col("doc_id").alias("_id"), F.col("_row").alias("_r"), "nos"), F.size("nos") * 8 + 48)
    looked = rows.join(side, rows["doc_id"].eqNullSafe(side["_id"]) & (rows["_row"] == side["_r"])).drop("_id", "_r")
    texts = _with_spans(looked).select("doc_id", "_row", F.explode("nos").alias("no"), "_lines", "_spans").select(
        "doc_id", "_row", "no", _chunk(F.get(F.col("_spans"), F.col("no"))).alias("chunk"))
    texts = save_stage(texts.withColumn("hash", F.xxhash64("chunk")), "lines-chunks")
    place = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "_row", "no")
    keepers = texts.groupBy("hash", "chunk").agg(F.count("*").alias("n"), F.min(place).alias("keeper")).filter("n > 1")
    gone = texts.join(keepers, ["hash", "chunk"]).filter(
        ~((F.col("no") == F.col("keeper.no")) & (F.col("_row") == F.col("keeper._row")) & F.col("doc_id").eqNullSafe(F.col("keeper.doc_id"))))
    return save_stage(gone.groupBy("doc_id", "_row").agg(F.collect_set("no").alias("gone")), "lines-removed")


def dedup_lines(docs: DataFrame) -> DataFrame:
    """``docs`` with its text after removal, and n_lines, lines_removed, chunks_removed (longs)."""
    gone = removed_chunks(docs)
    side = small_side(gone.select(F.col("doc_id").alias("_id"), F.col("_row").alias("_r"), F.col("gone").alias("_gone")), F.size("_gone") * 8 + 48)
    given = docs.drop("n_lines", "lines_removed", "chunks_removed")
    rows, carried = set_aside(given, "doc_id", "text")
    rows = rows.withColumn("_row", _row_key())
    rows = rows.join(side, rows["doc_id"].eqNullSafe(side["_id"]) & (rows["_row"] == side["_r"]), "left").drop("_id", "_r")
    touched = F.col("_gone").isNotNull()
    rows = _with_spans(rows, touched).withColumn("_stays", F.filter("_spans", lambda s, k: ~F.array_contains("_gone", k)))
    kept = F.aggregate("_stays", F.lit(0), lambda n, s: n + s["last"] - s["first"] + 1)
    n_lines = F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1
    return rows.select(
        *[column for column, name in zip(carried, given.columns) if name != "text"],
        F.when(touched, F.array_join(F.transform("_stays", _chunk), "\n")).otherwise(F.col("text")).alias("text"),
        F.coalesce(n_lines, F.lit(0)).cast("long").alias("n_lines"),
        F.when(touched, F.size("_lines") - kept).otherwise(0).cast("long").alias("lines_removed"),
        F.when(touched, F.size("_gone")).otherwise(0).cast("long").alias("chunks_removed"))


def _words(line: Column) -> Column:
    return F.regexp_count(line, F.lit(r"\S+"))


def _windows(lines: Column) -> Column:
    """Array of the windows: (no, lines); number 2i is the pair of lines i and i + 1, 2i + 1 the long line i."""
    numbers = F.sequence(F.lit(0), F.size(lines) - 1)
    pairs = F.transform(F.slice(numbers, 1, F.size(lines) - 1), lambda i: F.struct((i * 2).alias("no"), F.slice(lines, i + 1, 2).alias("lines")))
    # a line of so many words has as many separators
    long = lambda i: F.when(F.length(F.get(lines, i)) > 2 * RUN_WORDS, _words(F.get(lines, i)) > RUN_WORDS).otherwise(False)
    singles = F.transform(F.filter(numbers, long), lambda i: F.struct((i * 2 + 1).alias("no"), F.slice(lines, i + 1, 1).alias("lines")))
    return F.concat(pairs, singles)


def removed_runs(docs: DataFrame) -> DataFrame:
    """doc_id, _row, and the runs to remove as (first, last) lines, one row per affected document (a saved stage)."""
    rows = docs.select("doc_id", "text", _row_key().alias("_row")).filter("text is not null")
    split = rows.withColumn("_lines", _lines(F.col("text")))
    hashed = F.transform(_windows(F.col("_lines")), lambda w: F.struct(w["no"].alias("no"), F.xxhash64(F.array_join(w["lines"], "\n")).alias("hash")))
    narrow = save_stage(split.select("doc_id", "_row", F.inline(hashed)), "runs-hashes")
    repeated = save_stage(narrow.groupBy("hash").count().filter("count > 1").drop("count"), "runs-repeated")
    suspects = narrow.join(small_side(repeated, 16), "hash", "left_semi").groupBy("doc_id", "_row").agg(F.collect_set("no").alias("nos"))
    suspects = save_stage(suspects, "runs-suspects")

    side = small_side(suspects.select(F.col("doc_id").alias("_id"), F.col("_row").alias("_r"), "nos"), F.size("nos") * 8 + 48)
    looked = rows.join(side, rows["doc_id"].eqNullSafe(side["_id"]) & (rows["_row"] == side["_r"])).drop("_id", "_r")
    looked = looked.withColumn("_lines", _lines(F.col("text"))).select("doc_id", "_row", "_lines", F.explode("nos").alias("no"))
    window = F.slice("_lines", F.floor(F.col("no") / 2).cast("int") + 1, F.when(F.col("no") % 2 == 0, 2).otherwise(1))
    texts = looked.select("doc_id", "_row", "no", window.alias("w")).select(
        "doc_id", "_row", "no", F.array_join("w", "\n").alias("window"), _words(F.get("w", F.lit(0))).alias("words"), F.coalesce(_words(F.get("w", F.lit(1))), F.lit(0)).alias("after"))
    texts = save_stage(texts.withColumn("hash", F.xxhash64("window")), "runs-windows")
    place = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "_row", "no")
    keepers = save_stage(texts.groupBy("hash", "window").agg(F.count("*").alias("n"), F.min(place).alias("keeper")).filter("n > 1").drop("n"), "runs-keepers")
    gone = texts.join(keepers, ["hash", "window"]).filter(
        ~((F.col("no") == F.col("keeper.no")) & (F.col("_row") == F.col("keeper._row")) & F.col("doc_id").eqNullSafe(F.col("keeper.doc_id"))))
    # windows in a row have one difference of line number and place among the windows of the document
    kind, line = (F.col("no") % 2).alias("kind"), F.floor(F.col("no") / 2).cast("int").alias("line")
    gone = gone.select("doc_id", "_row", kind, line, "words", "after").distinct()  # rows that repeat id and text
    among = Window.partitionBy("doc_id", "_row", "kind").orderBy("line")
    island = F.when(F.col("kind") == 0, F.col("line") - F.row_number().over(among)).otherwise(F.col("line"))
    runs = gone.withColumn("island", island).groupBy("doc_id", "_row", "kind", "island").agg(
        F.min("line").alias("first"), (F.max("line") + 1 - F.col("kind")).cast("int").alias("last"),
        (F.sum("words") + F.max_by("after", "line")).alias("words"))
    runs = runs.filter(F.col("words") > RUN_WORDS).groupBy("doc_id", "_row").agg(F.collect_list(F.struct("first", "last")).alias("runs"))
    return save_stage(runs, "runs-removed")


def dedup_passages(docs: DataFrame) -> DataFrame:
    """``docs`` with its text after removal of repeated chunks and runs, and n_lines, lines_removed (longs)."""
    gone, runs = removed_chunks(docs), removed_runs(docs)
    both = gone.withColumnRenamed("gone", "_gone").withColumn("_runs", F.array().cast("array<struct<first:int,last:int>>")).unionByName(
        runs.select("doc_id", "_row", F.array().cast("array<int>").alias("_gone"), F.col("runs").alias("_runs")))
    both = save_stage(both.groupBy(F.col("doc_id").alias("_id"), F.col("_row").alias("_r")).agg(
        F.flatten(F.collect_list("_gone")).alias("_gone"), F.flatten(F.collect_list("_runs")).alias("_runs")), "passages-removed")
    side = small_side(both, F.size("_gone") * 8 + F.size("_runs") * 16 + 64)
    given = docs.drop("n_lines", "lines_removed")
    rows, carried = set_aside(given, "doc_id", "text")
    rows = rows.withColumn("_row", _row_key())
    rows = rows.join(side, rows["doc_id"].eqNullSafe(side["_id"]) & (rows["_row"] == side["_r"]), "left").drop("_id", "_r")
    touched = F.col("_gone").isNotNull()
    numbers = lambda s: F.sequence(s["first"], s["last"])
    of_chunks = F.flatten(F.transform("_gone", lambda k: numbers(F.get(F.col("_spans"), k))))
    lost = F.array_union(of_chunks, F.flatten(F.transform("_runs", numbers)))
    rows = _with_spans(rows, touched).withColumn("_stays", F.when(touched, F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), lost)))
    n_lines = F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1
    return rows.select(
        *[column for column, name in zip(carried, given.columns) if name != "text"],
        F.when(touched, F.array_join(F.transform("_stays", lambda i: F.get(F.col("_lines"), i)), "\n")).otherwise(F.col("text")).alias("text"),
        F.coalesce(n_lines, F.lit(0)).cast("long").alias("n_lines"),
        F.when(touched, F.size("_lines") - F.size("_stays")).otherwise(0).cast("long").alias("lines_removed"))
