r"""Runs of periodic words, by a harmonic grid of longest common extensions.

A run is a stretch of consecutive words with smallest period q that no neighbour extends
keeping q, at least ``TIMES`` * q and ``LEAST`` words long. Its words that equal the one q
further on form a stretch of at least ``(TIMES - 1) * q`` places. So on the grid of every
``(TIMES - 1) * q``-th word, for q up to a ``TIMES``-th of the text, one word lies in each such stretch, and
n * log n pairs (i, i + q) find all runs. A pair whose words are equal, and those of enough
neighbouring multiples of q too, is extended to both sides.

Extensions (:class:`CoverExtensions`) come from a difference cover: only the suffixes at
places whose number modulo ``COVER_MODULUS`` is in ``COVER`` are sorted, by doubling. For
any two places there is a shift below the modulus that leads to two sorted suffixes; the
words up to there are compared one by one, what follows is a range minimum over the
common prefixes of neighbours in the sorted order, by a sparse table. The same over the
reversed words extends to the left. By the theorem of Fine and Wilf two periods of one
stretch are multiples, so of equal stretches the smallest period stays.

The work is a map over rows: nothing is shuffled or collected; texts are taken together up to
``BATCH_WORDS`` words, pairs in slabs of ``SLAB``, so memory follows a batch or the longest text.

Defined results: words are split at ``[\x20\x09-\x0D]``; null texts have none, no run and an empty collapsed
text; repeated rows give repeated rows; an empty table gives no rows. Other columns than
doc_id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

LEAST, TIMES = 6, 4
#: words searched together, and pairs of the grid held at once
BATCH_WORDS, SLAB, QUERIES = 1 << 16, 1 << 20, 1 << 13
#: a set whose differences give every number modulo 31 once
COVER_MODULUS, COVER = 31, (1, 5, 11, 24, 25, 27)


def _shifts() -> np.ndarray:
    """For each difference d: an element of the cover whose sum with d is in the cover too."""
    out = np.zeros(COVER_MODULUS, dtype=np.int64)
    for a in COVER:
        for b in COVER:
            out[(b - a) % COVER_MODULUS] = a
    return out


class CoverExtensions:
    """Longest common prefixes of suffixes; the last word of ``words`` must occur nowhere else."""

    SHIFTS = _shifts()

    def __init__(self, words: np.ndarray):
        v, c = COVER_MODULUS, len(COVER)
        self.n = len(words)
        self.words = np.concatenate([words, np.zeros(2 * v, dtype=words.dtype)])
        self.place = np.full(v, -1)
        self.place[list(COVER)] = np.arange(c)
        blocks = -(-self.n // v)
        starts = (np.arange(blocks)[:, None] * v + np.array(COVER)).ravel()
        starts = starts[starts < self.n]
        wide = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(self.words, v)[starts].astype(">u4"))
        rank = np.unique(wide.view(f"S{4 * v}").ravel(), return_inverse=True)[1].reshape(-1).astype(np.int64)
        ladder, step = [rank], c  # ranks by 1, 2, 4, ... blocks; a suffix one block on is c entries on
        while rank.max(initial=0) + 1 < len(rank):
            later = np.full(len(rank), -1)
            later[:-step or None] = rank[step:]
            rank = np.unique(rank * (len(rank) + 1) + later + 1, return_inverse=True)[1].reshape(-1)
            ladder.append(rank)
            step *= 2
        self.rank = rank
        order = np.argsort(rank)
        a, b = order[:-1].copy(), order[1:].copy()
        common = np.zeros(len(a), dtype=np.int64)
        for k in range(len(ladder) - 2, -1, -1):
            inside = np.maximum(a, b) < len(rank)
            same = inside.copy()
            same[inside] = ladder[k][a[inside]] == ladder[k][b[inside]]
            a[same] += c << k
            b[same] += c << k
            common[same] += v << k
        at, other = starts[order[:-1]] + common, starts[order[1:]] + common
        for some in np.array_split(np.arange(len(at)), len(at) // QUERIES + 1):
            common[some] += self._compared(at[some], other[some], np.full(len(some), v))
        self.table = [common]
        while 2 << len(self.table) - 1 <= len(common):
            last, half = self.table[-1], 1 << len(self.table) - 1
            self.table.append(np.minimum(last[:-half], last[half:]))

    def _compared(self, i: np.ndarray, j: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Number of equal words from i and j on, up to ``most``."""
        along = np.arange(COVER_MODULUS)
        end = len(self.words) - 1
        differ = self.words[np.minimum(i[:, None] + along, end)] != self.words[np.minimum(j[:, None] + along, end)]
        differ |= along >= most[:, None]
        found = differ.argmax(axis=1)
        return np.where(differ[np.arange(len(i)), found], found, COVER_MODULUS)

    def _index(self, at: np.ndarray) -> np.ndarray:
        return at // COVER_MODULUS * len(COVER) + self.place[at % COVER_MODULUS]

    def __call__(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Length of the longest common prefix of the suffixes at i and at j, which differ."""
        shift = (self.SHIFTS[(j - i) % COVER_MODULUS] - i) % COVER_MODULUS
        out = self._compared(i, j, shift)
        on = np.flatnonzero(out == shift)
        if len(on):
            x, y = self.rank[self._index(i[on] + shift[on])], self.rank[self._index(j[on] + shift[on])]
            low, width = np.minimum(x, y), np.abs(x - y)
            level = np.frexp(width)[1] - 1
            least = np.empty(len(on), dtype=np.int64)
            for k in np.unique(level):
                here = level == k
                least[here] = np.minimum(self.table[k][low[here]], self.table[k][low[here] + width[here] - (1 << k)])
            out[on] += least
        return out


def _grid(lengths: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Text number, period and place of every pair of the grid, in slabs."""
    periods = lengths // TIMES
    text = np.repeat(np.arange(len(lengths)), periods)
    period = np.arange(len(text)) - np.repeat(np.cumsum(periods) - periods, periods) + 1
    stride = (TIMES - 1) * period
    counts = -(-(lengths[text] - period) // stride)
    ends = np.cumsum(counts)
    begin = 0
    while begin < len(text):
        done = ends[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(ends, done + SLAB, side="right")))
        some, n = slice(begin, end), counts[begin:end]
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        yield np.repeat(text[some], n), np.repeat(period[some], n), at * np.repeat(stride[some], n)
        begin = end


def runs(texts: list[np.ndarray]) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of every run of each text (word numbers), by start and period."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    lengths = np.array([len(t) for t in texts], dtype=np.int64)
    if not lengths.sum():
        return out
    words = np.concatenate(texts)
    firsts = np.cumsum(lengths) - lengths
    found = []
    for text, period, at in _grid(lengths):
        first, n = firsts[text], lengths[text]
        equal = np.flatnonzero(words[first + at] == words[first + at + period])
        text, period, at, first, n = text[equal], period[equal], at[equal], first[equal], n[equal]

        def match(times: int) -> np.ndarray:
            x = at + times * period
            fine = (x >= 0) & (x + period < n)
            x = np.where(fine, first + x, 0)
            return fine & (words[x] == words[np.where(fine, x + period, 0)])

        # a stretch of three periods holds three multiples of the period in a row
        left, right = match(-1), match(1)
        keep = (left & right) | (left & match(-2)) | (right & match(2))
        found.append(np.stack([text[keep], period[keep], at[keep]]))
    text, period, at = np.concatenate(found, axis=1) if found else np.empty((3, 0), dtype=np.int64)
    if not len(text):
        return out
    used = np.unique(text)  # only these texts are sorted; each is closed by a word of its own
    largest, parts, moved, length = int(words.max()), [np.array([0])], np.zeros(len(texts), dtype=np.int64), 1
    for k, t in enumerate(used.tolist()):
        moved[t] = length
        parts += [texts[t] + 1, np.array([largest + 2 + k])]
        length += len(texts[t]) + 1
    parts[0] = np.array([largest + 2 + len(used)])
    joined = np.concatenate(parts)
    forward, backward = CoverExtensions(joined), CoverExtensions(joined[::-1])
    for some in np.array_split(np.arange(len(text)), len(text) // QUERIES + 1):
        t, p = text[some], period[some]
        i = moved[t] + at[some]
        ahead, behind = forward(i, i + p), backward(length - i, length - i - p)
        size = ahead + behind + p
        fine = size >= np.maximum(LEAST, TIMES * p)
        for row in np.unique(np.stack([t, at[some] - behind, size, p])[:, fine], axis=1).T.tolist():
            out[row[0]].append(tuple(row[1:]))
    for t in used.tolist():  # the smallest period of each stretch
        smallest: dict[tuple[int, int], int] = {}
        for start, size, p in out[t]:
            smallest[start, size] = min(p, smallest.get((start, size), p))
        out[t] = sorted(((start, size, p) for (start, size), p in smallest.items()), key=lambda r: (r[0], r[2]))
    return out


def kept_words(n: int, found: list[tuple[int, int, int]]) -> np.ndarray:
    """Places of the words that no run repeats: those in no run, and the first period of runs."""
    change = np.zeros(n + 1, dtype=np.int64)
    for start, size, p in found:
        change[start + p] += 1
        change[start + size] -= 1
    return np.flatnonzero(np.cumsum(change[:n]) == 0)


def find_runs(docs: DataFrame, rewrite: Callable[[int | None, int], np.ndarray | None] | None = None) -> DataFrame:
    """doc_id, n_words, runs (start, length, period) and collapsed (the text's words without the repeats of runs).

    ``rewrite`` may give, from a row's id and number of words, the places of the words that are searched in place of the text's.
    """
    def searched(ids: list, words: list[list[bytes]]) -> Iterator[pa.RecordBatch]:
        numbers: dict[bytes, int] = {}
        texts = []
        for k, (doc_id, row) in enumerate(zip(ids, words)):
            coded = np.array([numbers.setdefault(w, len(numbers)) for w in row], dtype=np.int64)
            places = rewrite(doc_id, len(row)) if rewrite else None
            if places is not None:
                coded, words[k] = coded[places], [row[i] for i in places.tolist()]
            texts.append(coded)
        found = runs(texts)
        collapsed = [b" ".join([row[i] for i in kept_words(len(row), f).tolist()] if f else row).decode("utf-8", "surrogatepass") for row, f in zip(words, found)]
        told = [[{"start": s, "length": n, "period": p} for s, n, p in f] for f in found]
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([len(w) for w in words], pa.int64()),
                                          pa.array(told, pa.list_(_RUN)), pa.array(collapsed, pa.string())], ["doc_id", "n_words", "runs", "collapsed"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, words, n = [], [], 0
        for batch in batches:
            for row in range(batch.num_rows):
                words.append(batch.column(1)[row].as_py().split())
                ids.append(batch.column(0)[row].as_py())
                n += len(words[-1])
                if n >= BATCH_WORDS or len(ids) >= 4096:
                    yield from searched(ids, words)
                    ids, words, n = [], [], 0
        if ids:
            yield from searched(ids, words)

    # bytes split at white space exactly as asked
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")


_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def repeated_tail(doc_id: int | None, n: int) -> np.ndarray | None:
    """Every tenth text by the crc of its id ends in repeats of some of its words; places of the words then."""
    from zlib import crc32
    h = crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    i = np.arange(n)
    return np.where(i >= a, a + (i - a) % p, i)


def digests(found: DataFrame) -> DataFrame:
    """doc_id, n_runs, the longest run and digests of all runs and of the collapsed text."""
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("back"), (-r["period"]).alias("short"))))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")))
    shown = found.withColumns({"longest": longest, "lines": F.concat(F.array_join(lines, "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))})
    length, period = F.col("longest.length"), -F.col("longest.short")
    return shown.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("longest.back")).alias("start"), length.alias("length"), period.alias("period"),
        F.floor(1000 * length / period).cast("long").alias("exponent_milli"), F.sha2("lines", 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
