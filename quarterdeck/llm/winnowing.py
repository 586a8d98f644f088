r"""Benchmark passages in training texts, by winnowed fingerprints.

Words are the runs ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` of a text whose A-Z are lower-cased.
A window is ``WINDOW`` consecutive words of an item, or all words of a shorter one. Of each
window of a text the k-gram with the smallest hash is kept (the last of equal ones), so
neighbouring windows mostly keep the same one, and windows of equal words keep the
same wherever they occur: every shared span of ``WINDOW`` words shares a fingerprint. k is
``GRAM`` words, or all of a window shorter than that.

1. Items give their distinct windows with their fingerprints, as a saved table; a bitmap of a
   measured, bounded size is or-ed together from the fingerprints by Spark.
2. One pass over the texts keeps their fingerprints, drops those that the bitmap excludes and
   extends the others to the windows that kept them.
3. Windows are joined to those of the items on fingerprint and words, so equal hashes never
   decide. The items' side is broadcast only if its measured bytes are small.
4. Hit windows of a text are merged to spans; their distinct words name the items.

The bitmap only saves work: it never excludes a window that occurs. With more distinct windows
than ``MOST_BITS`` the texts' windows are joined unfiltered, which is slower and as right.

Defined results: null and empty texts have no words; items without words have no window;
items that repeat an id are one item whose windows are those of all its rows; items without an id hit
words but are neither counted nor named. Rows that repeat an id are rows of their own; an
empty table of texts gives no rows, one of items no hits. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..session import save_stage
from .common import small_side

WINDOW, GRAM = 10, 5
BITS_A_WINDOW, LEAST_BITS, MOST_BITS = 64, 1 << 16, 1 << 26
#: bytes of texts whose words are found together
PIECE = 1 << 20

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.zeros(256, dtype=bool)
for _low, _high in ((0x30, 0x3A), (0x41, 0x5B), (0x61, 0x7B), (0x80, 0x100)):
    _WORD[_low:_high] = True
_STEP = 0x9E3779B97F4A7C15
_MIX = np.uint64(0xD6E8FEB86659FD93)
_GRAM_STEPS = np.array([0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x9FB21C651E98DF25, 0xA0761D6478BD642F], dtype=np.uint64)


def _powers(step: int, n: int) -> np.ndarray:
    out = np.ones(n, dtype=np.uint64)
    out[1:] = np.uint64(step)
    return np.cumprod(out, dtype=np.uint64)


class Words:
    """Starts, ends, hashes and text numbers of the words of texts given as bytes."""

    # hashes are sums of byte * step ** place; dividing by step ** start makes them independent of the place
    up, down = _powers(_STEP, PIECE + 1), _powers(pow(_STEP, -1, 1 << 64), PIECE + 1)

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        """Text k is data[offsets[k]:offsets[k + 1]]."""
        self.codes = _LOWER[data]
        inside = _WORD[data]
        begins = inside.copy()
        begins[1:] &= ~inside[:-1]
        bounds = offsets[:-1][offsets[:-1] < len(data)]
        begins[bounds] |= inside[bounds]
        self.starts = np.flatnonzero(begins)
        stops = inside.copy()
        stops[:-1] &= ~inside[1:] | begins[1:]
        self.ends = np.flatnonzero(stops) + 1
        self.text = np.searchsorted(offsets, self.starts, side="right") - 1
        self.hashes = self._hashes(inside)

    def _hashes(self, inside: np.ndarray) -> np.ndarray:
        out, n = np.empty(len(self.starts), dtype=np.uint64), len(self.starts)
        first = 0
        while first < n:  # whole words, PIECE bytes at a time
            begin = self.starts[first]
            last = max(first + 1, int(np.searchsorted(self.ends, begin + PIECE, side="right")))
            end = self.ends[last - 1]
            up, down = (self.up, self.down) if end - begin <= PIECE else (_powers(_STEP, end - begin), _powers(pow(_STEP, -1, 1 << 64), end - begin))
            values = np.where(inside[begin:end], self.codes[begin:end], 0).astype(np.uint64)
            values *= up[:end - begin]
            at = self.starts[first:last] - begin
            out[first:last] = np.add.reduceat(values, at) * down[at]
            first = last
        return out ^ (out >> np.uint64(31))

    def counts(self, texts: int) -> np.ndarray:
        return np.bincount(self.text, minlength=texts)

    def spelled(self, first: int, n: int) -> str:
        codes, starts, ends = self.codes, self.starts, self.ends
        return b" ".join([codes[starts[i]:ends[i]].tobytes() for i in range(first, first + n)]).decode("utf-8", "replace")

    def kept(self, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Windows of ``length`` words inside one text: their first words, and the place and hash of the k-gram each keeps."""
        n = len(self.starts) - length + 1
        if n <= 0:
            return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64)
        k = min(GRAM, length)
        grams = np.full(len(self.starts) - k + 1, np.uint64(length))
        for j in range(k):
            grams += self.hashes[j:j + len(grams)] * _GRAM_STEPS[j]
        grams ^= grams >> np.uint64(29)
        grams *= _MIX
        grams ^= grams >> np.uint64(32)
        least, place = grams[:n].copy(), np.arange(n)
        for j in range(1, length - k + 1):
            here = grams[j:j + n]
            smaller = here <= least
            least[smaller] = here[smaller]
            place[smaller] = np.flatnonzero(smaller) + j
        whole = np.flatnonzero(self.text[:n] == self.text[length - 1:length - 1 + n])
        return whole, place[whole], least[whole]


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Parts of batches whose last column has about PIECE bytes of texts, with these bytes and their offsets."""
    for batch in batches:
        column = batch.column(batch.num_columns - 1).cast(pa.large_binary())
        offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset:column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
        data = np.frombuffer(column.buffers()[2], dtype=np.uint8) if len(column) and column.buffers()[2] is not None else np.empty(0, np.uint8)
        begin = 0
        while begin < len(column):
            end = max(begin + 1, int(np.searchsorted(offsets, offsets[begin] + PIECE, side="right")) - 1)
            yield batch.slice(begin, end - begin), data[offsets[begin]:offsets[end]], offsets[begin:end + 1] - offsets[begin]
            begin = end


def _text(df: DataFrame) -> Column:
    return F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text")


def item_windows(items: DataFrame) -> DataFrame:
    """item_id, length, words and print of the distinct windows of every item."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in _texts(batches):
            words = Words(data, offsets)
            lengths = np.minimum(words.counts(part.num_rows), WINDOW)
            rows: list[tuple] = []
            for length in np.unique(lengths[lengths > 0]).tolist():
                first, _, prints = words.kept(length)
                mine = lengths[words.text[first]] == length
                rows += [(int(words.text[f]), length, words.spelled(f, length), p) for f, p in zip(first[mine].tolist(), prints[mine].view(np.int64).tolist())]
            owners, sizes, shown, prints = zip(*rows) if rows else ((),) * 4
            yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(owners, pa.int64())), pa.array(sizes, pa.int32()), pa.array(shown, pa.string()), pa.array(prints, pa.int64())],
                                             ["item_id", "length", "words", "print"])

    rows = items.select(F.col("item_id").cast("string").alias("item_id"), _text(items))
    return rows.mapInArrow(run, "item_id string, length int, words string, print long").distinct()


def bitmap(windows: DataFrame) -> np.ndarray:
    """Bits of the fingerprints in ``windows``; at most MOST_BITS, whatever the table's size."""
    wanted, bits = windows.count() * BITS_A_WINDOW, LEAST_BITS
    while bits < min(wanted, MOST_BITS):
        bits *= 2
    slot = F.col("print").bitwiseAND(bits - 1)
    cells = windows.select(F.shiftright(slot, 5).alias("cell"), F.expr(f"shiftleft(1L, CAST(print & 31 AS INT))").alias("bit"))
    found = cells.groupBy("cell").agg(F.bit_or("bit").alias("bit")).toArrow()  # at most MOST_BITS / 32 rows
    out = np.zeros(bits // 32, dtype=np.uint32)
    out[found["cell"].to_numpy()] = found["bit"].to_numpy()
    return out


def marked(docs: DataFrame, windows: DataFrame) -> DataFrame:
    """uid, doc_id, n_words and the windows (start, length, words, print) of each text that the items' fingerprints allow."""
    lengths = sorted(r["length"] for r in windows.select("length").distinct().collect())  # at most WINDOW
    shared = docs.sparkSession.sparkContext.broadcast((lengths, bitmap(windows)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes, bits = shared.value
        last = np.uint64(len(bits) * 32 - 1)
        for part, data, offsets in _texts(batches):
            words = Words(data, offsets)
            counts = words.counts(part.num_rows)
            firsts = np.cumsum(counts) - counts
            rows: list[tuple] = []
            for length in sizes:
                first, place, prints = words.kept(length)
                if not len(first):
                    continue
                fresh = np.append(True, place[1:] != place[:-1])  # one fingerprint for all windows that keep it
                slot = prints[fresh] & last
                allowed = (bits[(slot >> np.uint64(5)).astype(np.int64)] >> (slot & np.uint64(31)).astype(np.uint32)) & 1
                for k in np.flatnonzero(allowed[np.cumsum(fresh) - 1]).tolist():
                    f = int(first[k])
                    owner = int(words.text[f])
                    rows.append((owner, f - int(firsts[owner]), length, words.spelled(f, length), int(prints[k].view(np.int64))))
            rows.sort()
            ends = np.searchsorted(np.array([r[0] for r in rows], dtype=np.int64), np.arange(part.num_rows + 1))
            owners, starts, sized, shown, told = zip(*rows) if rows else ((),) * 5
            inner = pa.StructArray.from_arrays([pa.array(starts, pa.int32()), pa.array(sized, pa.int32()), pa.array(shown, pa.string()), pa.array(told, pa.int64())],
                                               ["start", "length", "words", "print"])
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(counts, pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), inner)],
                                             ["uid", "doc_id", "n_words", "windows"])

    rows = docs.select(F.monotonically_increasing_id().alias("uid"), F.col("doc_id").cast("long").alias("doc_id"), _text(docs))
    return rows.mapInArrow(run, "uid long, doc_id long, n_words long, windows array<struct<start:int,length:int,words:string,print:long>>")


def contamination(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, n_words, spans (first word, end) that windows of items cover, and items (ids as sorted strings) of every text."""
    windows = save_stage(item_windows(items), "leaks-items")
    known = save_stage(windows.select("length", "words", "print").distinct(), "leaks-windows")
    texts = save_stage(marked(docs, known), "leaks-texts")
    width = F.octet_length("words") + 32
    found = texts.filter(F.size("windows") > 0).select("uid", F.explode("windows").alias("w")).select("uid", "w.*")
    hits = save_stage(found.join(small_side(known, width), ["print", "length", "words"], "left_semi"), "leaks-hits")
    # one text's windows, one for each of its words at most
    end = F.col("start") + F.col("length")
    spans = hits.groupBy("uid").agg(F.array_sort(F.collect_list(F.struct("start", end.alias("end")))).alias("covered"))
    named = windows.filter("item_id is not null").select("item_id", "print", "length", "words")
    names = (hits.select("uid", "print", "length", "words").distinct().join(small_side(named, width + F.octet_length("item_id")), ["print", "length", "words"])
             .groupBy("uid").agg(F.array_sort(F.collect_set("item_id")).alias("items")))
    found = save_stage(spans.join(names, "uid", "left"), "leaks-found")
    merged = F.aggregate(
        "covered", F.array().cast("array<struct<start:int,end:int>>"),
        lambda done, x: F.when((F.size(done) > 0) & (x["start"] <= F.element_at(done, -1)["end"]), F.concat(
            F.slice(done, 1, F.size(done) - 1), F.array(F.struct(F.element_at(done, -1)["start"].alias("start"), F.greatest(x["end"], F.element_at(done, -1)["end"]).alias("end")))))
        .otherwise(F.concat(done, F.array(F.struct(x["start"].alias("start"), x["end"].alias("end"))))))
    told = found.select("uid", merged.alias("spans"), "items")
    return texts.drop("windows").join(told, "uid", "left").select(
        "doc_id", "n_words", F.coalesce("spans", F.array().cast("array<struct<start:int,end:int>>")).alias("spans"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def digests(found: DataFrame) -> DataFrame:
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda total, s: total + (s["end"] - s["start"]))
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))
