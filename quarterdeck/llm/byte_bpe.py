"""Byte-level BPE by segment trees over byte positions.

A pre-token starts as its bytes. A segment tree over the byte positions stores, for every
live position, the rank of the pair that starts there; its root is the leftmost pair of
the smallest rank. A merge joins that pair, and updates the leaves of the merged position,
its live left neighbour and the swallowed position, each on its path to the root only.
Short pre-tokens of a batch are merged together, one tree per row of an array; long ones
use one tree each. A pre-token that is a token itself is that token, as the library has it.

Texts are cut at single spaces between characters that are not white space, which is always
a pre-token boundary; every distinct piece is then matched by the pattern and encoded once
per worker while it stays in a bounded cache. The work is a map over rows: no shuffle,
nothing is collected, and a lost task is simply run again.

Defined results: null texts count as empty and give no ids; ids are packed as little-endian
unsigned 32-bit integers; repeated rows give repeated rows; an empty table gives no rows.
Memory of a task follows its longest text. Only doc_id is carried over from the input.
"""

from __future__ import annotations

import base64
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: pre-tokens of at most so many bytes are merged together in arrays
SHORT = 64
#: pieces kept per worker, and the longest kept piece in characters
CACHED, CACHED_CHARS = 150_000, 48
#: characters of text handled at a time
SLICE_CHARS = 1 << 20
NONE = np.int32(2**31 - 1)
_SLOT_BITS = 21
#: trees merged at a time, so that they stay in the processor's cache
TREES = 4096
_CUT = re.compile(r"(?<=\S)(?= \S)")


@lru_cache(maxsize=2)
def token_bytes(path: str) -> list[bytes]:
    """Token bytes by id."""
    with open(path, "rb") as lines:
        ranks = {int(rank): base64.b64decode(token) for token, rank in (line.split() for line in lines if line.strip())}
    return [ranks.get(rank, b"") for rank in range(max(ranks) + 1)]


class Vocabulary:
    """Token bytes by id, and the id that each pair of ids merges into."""

    def __init__(self, path: str):
        self.tokens = token_bytes(path)
        self.ranks = {token: rank for rank, token in enumerate(self.tokens) if token}
        self.bytes = np.array([self.ranks[bytes([b])] for b in range(256)], dtype=np.int64)
        keys, merged = array("q"), array("i")
        for token, rank in self.ranks.items():
            for cut in range(1, len(token)):
                a, b = self.ranks.get(token[:cut]), self.ranks.get(token[cut:])
                if a is not None and b is not None:
                    keys.append((a << 32) | b)
                    merged.append(rank)
        order = np.argsort(np.array(keys))
        self.keys, self.merged = np.array(keys)[order], np.array(merged)[order]
        # most pairs are found, or found missing, at their hash; the rest by binary search
        self.slots = np.full(1 << _SLOT_BITS, -1, dtype=np.int32)
        self.slots[_slot(self.keys)] = np.arange(len(self.keys), dtype=np.int32)
        pair = np.arange(1 << 16)
        self.byte_pairs = self.pair_ranks(self.bytes[pair >> 8], self.bytes[pair & 255])

    def pair_ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Id that each pair merges into, -1 for none; b may be -1 for no neighbour."""
        key = (a.astype(np.int64) << 32) | b
        at = self.slots[_slot(key)]
        unlike = (at >= 0) & (self.keys[at] != key)
        if unlike.any():
            at[unlike] = np.minimum(np.searchsorted(self.keys, key[unlike]), len(self.keys) - 1)
        return np.where((at >= 0) & (self.keys[at] == key) & (b >= 0), self.merged[at], -1)


def _slot(key: np.ndarray) -> np.ndarray:
    return (key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - _SLOT_BITS)


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def merge_long(vocab: Vocabulary, data: bytes) -> list[int]:
    """Ids of one pre-token of any length; logarithmic time for each merge."""
    n = len(data)
    size = 1 << max(1, (n - 1).bit_length())
    ids, after, before = [int(vocab.bytes[b]) for b in data], list(range(1, n + 1)), list(range(-1, n - 1))
    none, get, tokens = (1 << 62), vocab.ranks.get, vocab.tokens
    tree = [none] * (2 * size)

    def leaf(i: int) -> int:
        j = after[i]
        rank = get(tokens[ids[i]] + tokens[ids[j]]) if j < n else None
        return none if rank is None else rank * size + i

    def put(i: int, value: int) -> None:
        node = size + i
        tree[node] = value
        node >>= 1
        while node:
            a, b = tree[2 * node], tree[2 * node + 1]
            low = a if a < b else b
            if tree[node] == low:
                return
            tree[node] = low
            node >>= 1

    for i in range(n):
        tree[size + i] = leaf(i)
    for node in range(size - 1, 0, -1):
        tree[node] = min(tree[2 * node], tree[2 * node + 1])
    while tree[1] < none:
        rank, i = divmod(tree[1], size)
        j = after[i]
        ids[i], ids[j] = rank, -1
        after[i] = after[j]
        if after[j] < n:
            before[after[j]] = i
        put(j, none)
        put(i, leaf(i))
        if before[i] >= 0:
            put(before[i], leaf(before[i]))
    return [x for x in ids if x >= 0]


def merge_short(vocab: Vocabulary, words: list[bytes], width: int) -> np.ndarray:
    """Array of ids of words of at most ``width`` bytes (a power of two), -1 where nothing is left; a tree per row.

    Arrays are flat; a position is row * stride + column, and column 0 and the last one stand for "no neighbour".
    """
    n, stride = len(words), width + 2
    raw = np.frombuffer(b"".join([w.ljust(width, b"\0") for w in words]), dtype=np.uint8).reshape(n, width).astype(np.int32)
    lengths = np.fromiter(map(len, words), dtype=np.int32, count=n)[:, None]
    place = np.arange(width, dtype=np.int32)
    table = np.full((n, stride), -1, dtype=np.int32)
    table[:, 1:-1] = np.where(place < lengths, vocab.bytes[raw], -1)
    ids = table.ravel()
    column = np.arange(n * stride, dtype=np.int32)
    after, before = column + 1, column - 1
    tree = np.full((n, 2 * width), NONE, dtype=np.int32)
    ranks = vocab.byte_pairs[(raw[:, :-1] << 8) | raw[:, 1:]]
    tree[:, width:-1] = np.where((ranks >= 0) & (place[1:] < lengths), ranks * width + place[:-1], NONE)
    level = width
    while level > 1:
        half = level // 2
        tree[:, half:level] = np.minimum(tree[:, level:2 * level:2], tree[:, level + 1:2 * level:2])
        level = half
    nodes, roots = tree.ravel(), tree[:, 1]
    rows = np.flatnonzero(roots < NONE).astype(np.int32)
    while len(rows):
        rank, column = np.divmod(roots[rows], np.int32(width))
        i = rows * stride + column + 1
        j = after[i]
        k = after[j]  # the last column is never live and has id -1
        ids[i], ids[j] = rank, -1
        after[i], before[k] = k, i
        left = before[i]
        right = vocab.pair_ranks(rank, ids[k])
        leftward = np.where(ids[left] >= 0, vocab.pair_ranks(np.maximum(ids[left], 0), rank), -1)
        base, first = rows * (2 * width), rows * stride + 1
        own = base + width + column
        gone = base + width + (j - first)
        nodes[gone] = NONE
        nodes[own] = np.where(right >= 0, right * width + column, NONE)
        linked = ids[left] >= 0
        at = (left - first)[linked]
        nodes[(base + width)[linked] + at] = np.where(leftward[linked] >= 0, leftward[linked] * width + at, NONE)
        base = np.concatenate([base, base, base[linked]])
        node = width + np.concatenate([column, j - first, at])
        while node[0] > 1:
            node >>= 1
            spot = base + node
            child = spot + node
            nodes[spot] = np.minimum(nodes[child], nodes[child + 1])
        rows = rows[roots[rows] < NONE]
    return table[:, 1:-1]


def encode_words(vocab: Vocabulary, words: list[bytes]) -> list[bytes]:
    """Packed ids of each pre-token."""
    out: list[bytes] = [b""] * len(words)
    widths: dict[int, list[int]] = {}
    for at, word in enumerate(words):
        rank = vocab.ranks.get(word)
        if rank is not None:
            out[at] = rank.to_bytes(4, "little")
        elif len(word) > SHORT:
            out[at] = np.array(merge_long(vocab, word), dtype="<u4").tobytes()
        else:
            widths.setdefault(1 << max(1, (len(word) - 1).bit_length()), []).append(at)
    runs = [(width, places[at:at + TREES]) for width, places in widths.items() for at in range(0, len(places), TREES)]
    for width, places in runs:
        ids = merge_short(vocab, [words[at] for at in places], width)
        live = ids >= 0
        packed, ends = ids[live].astype("<u4").tobytes(), np.cumsum(live.sum(1)) * 4
        begin = 0
        for at, end in zip(places, ends.tolist()):
            out[at] = packed[begin:end]
            begin = end
    return out


class Encoder:
    """Encodes texts; keeps what distinct pieces gave, up to a bound.

    ``known`` has the ids of pieces that follow one space, by the piece without that space.
    """

    def __init__(self, path: str, pattern: str):
        import regex
        self.vocab, self.match, self.known = vocabulary(path), regex.compile(pattern).findall, {}

    def _ids(self, pieces: list[str]) -> list[bytes]:
        """Packed ids of pieces that begin and end at pre-token boundaries."""
        words = [self.match(piece) for piece in pieces]
        known, distinct, ids = self.known, [], {}
        for word in {word for found in words for word in found}:
            packed = known.get(word[1:]) if word[0] == " " else None
            if packed is None:
                distinct.append(word)
            else:
                ids[word] = packed
        ids.update(zip(distinct, encode_words(self.vocab, [word.encode() for word in distinct])))
        return [ids[found[0]] if len(found) == 1 else b"".join([ids[word] for word in found]) for found in words]

    def __call__(self, texts: list[str]) -> list[bytes]:
        if len(self.known) > CACHED:
            self.known = {}
        known = self.known
        cut = [text.split(" ") for text in texts]
        new = {piece for pieces in cut for piece in pieces}.difference(known)
        # a space that follows white space or ends the text is no boundary; texts that have one are cut more slowly
        uneven = {piece for piece in new if not piece or piece[-1].isspace()}
        if uneven:
            for at, pieces in enumerate(cut):
                if not uneven.isdisjoint(pieces):
                    head, *rest = _CUT.split(texts[at])
                    cut[at] = [head, *[piece[1:] for piece in rest]]
            new = {piece for pieces in cut for piece in pieces[1:]}.difference(known)
        heads, rests = [pieces[0] for pieces in cut], [pieces[1:] for pieces in cut]
        new = list(new)
        found = self._ids(heads + [" " + piece for piece in new])
        fresh = dict(zip(new, found[len(heads):]))
        out = []
        for head, rest in zip(found, rests):
            try:
                out.append(head + b"".join(map(known.__getitem__, rest)))
            except KeyError:  # some pieces are new
                out.append(head + b"".join([known[piece] if piece in known else fresh[piece] for piece in rest]))
        known.update((piece, packed) for piece, packed in fresh.items() if len(piece) <= CACHED_CHARS)
        return out


def sliced(texts: list[str | None]) -> Iterator[tuple[int, list[str]]]:
    """The texts of a batch in slices of bounded length: first index and texts, null as empty."""
    first, held, chars = 0, [], 0
    for at, text in enumerate(texts):
        held.append(text or "")
        chars += len(held[-1])
        if chars >= SLICE_CHARS:
            yield first, held
            first, held, chars = at + 1, [], 0
    if held:
        yield first, held


#: rows of a batch that are Python objects at a time
ROWS = 256


def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, list[str]]]:
    """Ids and texts of bounded parts of the batches."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            part = batch.slice(at, ROWS)
            for first, texts in sliced(part.column(1).to_pylist()):
                yield part.column(0).slice(first, len(texts)), texts


def decoded(tokens: list[bytes], packed: list[bytes]) -> list[bytes]:
    look = tokens.__getitem__
    return [b"".join(map(look, np.frombuffer(ids or b"", dtype="<u4").tolist())) for ids in packed]


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and ids (binary, 4 bytes an id) of every whole text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path, pattern)
        for ids, texts in parts(batches):
            yield pa.RecordBatch.from_arrays([ids, pa.array(encoder(texts), pa.binary())], ["doc_id", "ids"])

    return _rows(docs).mapInArrow(run, "doc_id long, ids binary")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, ids and the decoded bytes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                texts = decoded(token_bytes(path), part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.binary())], ["doc_id", "ids", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids binary, decoded binary")


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, ids and what they decode to, in one pass by one worker a task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path, pattern)
        for doc_ids, texts in parts(batches):
            packed = encoder(texts)
            yield pa.RecordBatch.from_arrays([doc_ids, pa.array(packed, pa.binary()), pa.array(decoded(encoder.vocab.tokens, packed), pa.binary())], ["doc_id", "ids", "decoded"])

    return _rows(docs).mapInArrow(run, "doc_id long, ids binary, decoded binary")


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens and the SHA-256 of the packed ids and of the bytes they decode to."""
    return round_trip(docs, path, pattern).select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
