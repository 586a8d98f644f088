"""N-gram Jaccard join by chosen paths.

A text is its set of five-word shingles (lower-cased, split at white space; a text of one
to four words is one shingle). Texts of the same words in the same order form one class
member; a copy is never compared.

1. Every run and level of the recursion samples about ``PICKS`` shingles of a set by a
   hash of the shingle, so two sets sample the same ones of their common shingles. A node
   is a path of sampled shingles; texts meet in the node of every path they share.
   Nodes of more than ``SMALL`` texts are split by the next level's shingles.
2. Small nodes are searched by brute force on 128-bin one-permutation minhash sketches,
   well below the threshold (``DOUBT``), which links candidates; nodes that are still
   large after the last level are searched in tiles of ``SMALL`` rows.
3. Linked candidates form clusters. Every cluster is compared exactly, all pairs of
   its tiles, by products of shingle incidence matrices: a pair is linked when
   intersection >= 0.8 * union. Texts are read again for clusters only.

The number of runs follows from ``RECALL``: a pair at the threshold shares a sampled
shingle on one level with probability 1 - exp(-0.8 * PICKS), on all levels with its
power. Levels grow with the logarithm of the number of rows. Tiles emit one link count
per row and tree edges, not pairs; the time for a cluster of n different texts that are
all alike grows with n squared, as its links do, spread over tiles.

Defined results: one row per document row: doc_id, class_id (the smallest doc_id of its
class), n_links (rows linked with it, copies included) . Null and empty texts have no
shingles, link to nothing and are their own class, as are rows with a null id (class
null). Rows that repeat an id, with one text or several, are linked like any rows but share the id. Empty table: no
rows. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..session import save_stage
from .common import small_side
from .components import components

WORDS = 5
#: shares of a link: intersection * 5 >= union * 4
NUMERATOR, DENOMINATOR = 4, 5
PICKS, RECALL = 3.0, 0.999
SMALL = 512
BINS, DOUBT = 128, 0.62
#: rows of a tile of the exact comparison, and shingles per matrix product
TILE, COLUMNS = 256, 4096
_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != "")


def _keys(w: Column) -> list[Column]:
    """key1, key2 of a word sequence."""
    return [F.xxhash64(w).alias("key1"), F.hash(w, F.size(w)).cast("long").alias("key2")]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX
    return (x ^ (x >> np.uint64(27))) * _ODD


def shingle_sets(offsets: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each list of word hashes, and their offsets."""
    n = len(offsets) - 1
    lengths = np.diff(offsets)
    at = np.arange(len(hashes))
    owner = np.repeat(np.arange(n), lengths)
    left = offsets[owner + 1] - at  # words from here to the end of the text
    h = np.zeros(len(hashes), dtype=np.uint64)
    for k in range(WORDS):
        here = at + k < len(hashes)
        word = np.zeros(len(hashes), dtype=np.uint64)
        word[here] = hashes[at[here] + k]
        word[left <= k] = np.uint64(k + 1)  # beyond the end: only in texts of under WORDS words
        h = _mix(h * _ODD + word)
    use = (left >= WORDS) | ((lengths[owner] < WORDS) & (at == offsets[owner]))
    h, owner = h[use], owner[use]
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    new = np.append(True, (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])) if len(h) else np.empty(0, dtype=bool)
    h, owner = h[new], owner[new]
    return h, np.searchsorted(owner, np.arange(n + 1))


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    offsets = column.offsets.to_numpy()
    return (offsets - offsets[0]).astype(np.int64), column.flatten().to_numpy(zero_copy_only=False).view(np.uint64)


def _list_array(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values.view(np.int64), pa.int64()))


def plan(n_rows: int) -> tuple[int, int]:
    """Runs and levels for a table of so many rows."""
    levels = max(2, math.ceil(math.log(max(2, n_rows / SMALL)) / math.log(50)))
    once = (1 - math.exp(-NUMERATOR / DENOMINATOR * PICKS)) ** levels
    return math.ceil(math.log(1 - RECALL) / math.log(1 - once)), levels


def signatures(docs: DataFrame, runs: int, levels: int) -> DataFrame:
    """doc_id, key1, key2 (of the word sequence), n (shingles), sketch, and the sampled shingles of each (run, level) slot."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                sets, cuts = shingle_sets(*_lists(part.column(1)))
                sizes = np.diff(cuts)
                owner = np.repeat(np.arange(part.num_rows), sizes)
                # one-permutation sketch: the smallest hash of each bin, by its low bits; 0: no hash
                bin_of = owner * BINS + (sets >> np.uint64(57)).astype(np.int64)
                first = np.flatnonzero(np.append(True, bin_of[1:] != bin_of[:-1])) if len(sets) else np.empty(0, dtype=np.int64)
                sketch = np.zeros(part.num_rows * BINS, dtype=np.uint8)
                sketch[bin_of[first]] = 1 + (sets[first] & np.uint64(0xFFFF)) % np.uint64(255)
                sketches = [row.tobytes() for row in sketch.reshape(-1, BINS)]
                bound = (np.minimum(PICKS / np.maximum(sizes, 1), 1.0) * float(2**64 - 2**12)).astype(np.uint64)[owner]
                picked = []
                for slot in range(runs * levels):
                    hit = np.flatnonzero(_mix(sets ^ np.uint64((slot + 1) * int(_MIX) % 2**64)) <= bound)
                    picked.append((owner[hit], (sets[hit] & ~np.uint64(255)) | np.uint64(slot)))
                who = np.concatenate([p[0] for p in picked])
                order = np.argsort(who, kind="stable")
                token = np.concatenate([p[1] for p in picked])[order]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(2), part.column(3), pa.array(sizes, pa.int32()), pa.array(sketches, pa.binary()),
                     _list_array(token, np.searchsorted(who[order], np.arange(part.num_rows + 1)))], ["doc_id", "key1", "key2", "n", "sketch", "picks"])

    split = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(words(F.col("text")), F.array().cast("array<string>")).alias("w"))
    hashed = split.select("doc_id", F.transform("w", lambda x: F.xxhash64(x)).alias("h"), *_keys(F.col("w")))
    return hashed.mapInArrow(run, "doc_id long, key1 long, key2 long, n int, sketch binary, picks array<long>")


def _nodes(rows: DataFrame, runs: int, levels: int) -> list[DataFrame]:
    """Per level: id, node, size of the texts that share a node to be searched (a row for each text and node)."""
    slot = lambda token: token.bitwiseAND(F.lit(255))
    found, open_nodes = [], None
    for level in range(levels):
        token = F.explode(F.filter("picks", lambda t: slot(t) % levels == level))
        here = rows.select("id", token.alias("token"))
        if open_nodes is None:
            here = here.select("id", F.xxhash64("token").alias("node"), F.floor(slot(F.col("token")) / levels).alias("run"))
        else:  # the children of a large node: its texts by their next sampled shingle of the same run
            here = open_nodes.join(here.withColumn("run", F.floor(slot(F.col("token")) / levels)), ["id", "run"]).select(
                "id", F.xxhash64("node", "token").alias("node"), "run")
        here = save_stage(here, "paths-level")
        sizes = here.groupBy("node").agg(F.count("*").alias("size")).filter("size > 1")
        here = save_stage(here.join(sizes, "node"), "paths-shared")
        large = F.col("size") > SMALL
        last = level == levels - 1
        found.append(here if last else here.filter(~large))
        if last or here.filter(large).isEmpty():
            break
        open_nodes = here.filter(large).select("id", "node", "run")
    return found


def _tiled(rows: DataFrame, key: str, size: Column, tile: int) -> DataFrame:
    """Adds tile (x, y) and side: a text of block b is on the first side of tiles (b, y >= b) and on the second of (x < b, b).

    Groups of at most ``tile`` rows are one tile (0, 0).
    """
    blocks = F.ceil(size / F.lit(tile)).cast("int")
    block = F.pmod(F.xxhash64("id"), blocks).cast("int")
    others = F.sequence(F.lit(0), blocks - 1)
    return rows.withColumn("_b", block).withColumn("_o", F.explode(others)).select(
        *rows.columns, F.least("_b", "_o").alias("x"), F.greatest("_b", "_o").alias("y"), (F.col("_b") > F.col("_o")).alias("second"))


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pd.DataFrame]:
    """Whole groups of rows that arrive sorted by their keys; a group is a tile, so bounded."""
    held = None
    for batch in batches:
        rows = batch.to_pandas()
        if not len(rows):
            continue
        rows = rows if held is None else pd.concat([held, rows], ignore_index=True)
        new = (rows[keys] != rows[keys].shift()).any(axis=1).to_numpy()
        starts = np.flatnonzero(new)
        yield from (rows.iloc[a:b] for a, b in zip(starts[:-1], starts[1:]))
        held = rows.iloc[starts[-1]:]
    if held is not None:
        yield held


def _tree(edges: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[int, int]]:
    """Edges to the root of each component of the given ones: fewer than there are nodes."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in edges:
        for x, y in zip(a.tolist(), b.tolist()):
            x, y = root(x), root(y)
            if x != y:
                parent[max(x, y)] = min(x, y)
    return [(x, root(x)) for x in parent if root(x) != x]


def _merging(inside: list[tuple[np.ndarray, np.ndarray]], across: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[int, int]]:
    """The links of ``across`` that join components which those of ``inside`` and the ones before leave apart."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    kept = []
    for told, links in ((False, inside), (True, across)):
        for a, b in links:
            for x, y in zip(a.tolist(), b.tolist()):
                p, q = root(x), root(y)
                if p != q:
                    parent[max(p, q)] = min(p, q)
                    if told:
                        kept.append((x, y))
    return kept


def _sketch_links(shared: DataFrame, rows: DataFrame) -> DataFrame:
    """Candidate links a, b found by brute force on the sketches of each node.

    Blocks of a large node are searched first, each in one tile. What their links and those of all other
    nodes join stays together, so only texts of different components are compared across blocks: texts that
    are all alike are not tiled at all, and the others meet the largest component without its own tiles.
    """
    large = F.col("size") > SMALL
    first = shared.withColumn("x", F.when(large, F.pmod(F.xxhash64("id"), F.ceil(F.col("size") / F.lit(SMALL)))).otherwise(0).cast("int"))
    links = _searched(first.withColumns({"y": F.col("x"), "second": F.lit(False), "root": F.col("id")}), rows)
    wide = shared.filter(large)
    if wide.isEmpty():
        return links
    links = save_stage(links, "paths-links-inside")
    found = components(links).withColumnRenamed("node", "id")
    wide = save_stage(wide.select("id", "node").join(found, "id", "left").withColumn("root", F.coalesce("root", "id")), "paths-wide")
    parts = save_stage(wide.groupBy("node", "root").agg(F.count("*").alias("n")), "paths-parts")
    most = parts.groupBy("node").agg(F.max(F.struct("n", "root")).alias("most"), F.sum("n").alias("size"), F.count("*").alias("parts"))
    left = save_stage(wide.join(most.filter("parts > 1"), "node").select(
        "id", "node", "root", (F.col("root") == F.col("most.root")).alias("joined"), F.col("most.n").alias("n"), (F.col("size") - F.col("most.n")).alias("others")), "paths-left")
    return links.union(_searched(_across(left), rows)).distinct()


def _across(left: DataFrame) -> DataFrame:
    """Tiles of the texts outside a node's largest component: with each other, and with that component's (on the second side).

    ``left`` has id, node, root (of its component), joined (is in the largest component), n (its texts) and others (the texts outside).
    """
    blocks, far = F.ceil(F.col("others") / F.lit(SMALL)).cast("int"), F.ceil(F.col("n") / F.lit(SMALL)).cast("int")
    outside = left.filter(~F.col("joined"))
    own = _tiled(outside.select("id", "node", "root", "others"), "node", F.col("others"), SMALL).drop("others")
    met = left.withColumn("_b", F.pmod(F.xxhash64("id"), F.when(F.col("joined"), far).otherwise(blocks)).cast("int"))
    # blocks of the component are numbered below 0
    to = met.withColumn("_o", F.explode(F.sequence(F.lit(0), F.when(F.col("joined"), blocks).otherwise(far) - 1)))
    across = to.select("id", "node", "root", F.when(F.col("joined"), -1 - F.col("_b")).otherwise(-1 - F.col("_o")).alias("x"),
                       F.when(F.col("joined"), F.col("_o")).otherwise(F.col("_b")).alias("y"), F.col("joined").alias("second"))
    return own.unionByName(across)


def _searched(tiles: DataFrame, rows: DataFrame) -> DataFrame:
    """Links within the tiles (node, x, y) that join texts of different roots; of a tile of two blocks those that join components of the blocks."""
    tiles = tiles.select("id", "node", "x", "y", "second", "root").join(rows.select("id", "n", "sketch"), "id")
    keys = ["node", "x", "y"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out_a, out_b = [], []
        for tile in _groups(batches, keys):
            if len(tile) < 2:
                continue
            ids, n, second = tile["id"].to_numpy(), tile["n"].to_numpy(), tile["second"].to_numpy()
            sketch = np.frombuffer(b"".join(tile["sketch"]), dtype=np.uint8).reshape(-1, BINS)
            split = tile["x"].iat[0] != tile["y"].iat[0]
            if split and second.all() | ~second.any():
                continue
            inside, across, known = [], [], [(ids, tile["root"].to_numpy())]
            for i in range(len(tile)):
                to = np.arange(i + 1, len(tile))
                to = to[np.minimum(n[to], n[i]) * DENOMINATOR >= np.maximum(n[to], n[i]) * NUMERATOR]
                if len(to):
                    same = ((sketch[to] == sketch[i]) & (sketch[i] > 0)).sum(axis=1)
                    both = ((sketch[to] > 0) | (sketch[i] > 0)).sum(axis=1)
                    to = to[same >= DOUBT * both]
                    for links, chosen in ((inside, to[second[to] == second[i]]), (across, to[second[to] != second[i]])):
                        if len(chosen):
                            links.append((np.full(len(chosen), ids[i]), ids[chosen]))
            for a, b in _merging(known + inside, across) if split else _merging(known, inside):
                out_a.append(a)
                out_b.append(b)
            if len(out_a) > 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], ["a", "b"])
                out_a, out_b = [], []
        yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], ["a", "b"])

    dealt = tiles.select(*keys, "second", "root", "id", "n", "sketch").repartition(*keys).sortWithinPartitions(*keys, "id")
    return dealt.mapInArrow(run, "a long, b long").distinct()


def pair_counts(sets: list[np.ndarray]) -> np.ndarray:
    """Matrix of intersection sizes."""
    n = len(sets)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    tokens, column = np.unique(np.concatenate(sets), return_inverse=True)
    out = np.zeros((n, n), dtype=np.float64)
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    for begin in range(0, len(tokens), COLUMNS):
        a, b = np.searchsorted(column, [begin, begin + COLUMNS])
        block = np.zeros((n, min(COLUMNS, len(tokens) - begin)), dtype=np.float32)
        block[owner[a:b], column[a:b] - begin] = 1
        out += block @ block.T
    return out.astype(np.int64)


def _exact_links(clusters: DataFrame, docs: DataFrame) -> DataFrame:
    """id, linked (rows, copies counted), root (of a tree edge, or null) from exact comparisons within clusters.

    ``clusters`` has id (of the member), doc_id, key1, key2, copies, cluster and size.
    """
    side = small_side(clusters, 64)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), words(F.col("text")).alias("w")).filter(F.size("w") > 0)
    # of a doc_id with several texts, the text of the class member is the one with its keys
    texts = texts.select("doc_id", "w", *_keys(F.col("w"))).join(side, ["doc_id", "key1", "key2"]).select(
        "id", "copies", "cluster", "size", F.transform("w", lambda x: F.xxhash64(x)).alias("h")).dropDuplicates(["id"])
    tiles = _tiled(texts, "cluster", F.col("size"), TILE)
    keys = ["cluster", "x", "y"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for tile in _groups(batches, keys):
            if len(tile) < 2:
                continue
            ids, copies, second = tile["id"].to_numpy(), tile["copies"].to_numpy(), tile["second"].to_numpy()
            lengths = np.array([len(h) for h in tile["h"]])
            sets, cuts = shingle_sets(np.append(0, np.cumsum(lengths)), np.concatenate(list(tile["h"])).astype(np.int64).view(np.uint64))
            sets = [sets[a:b] for a, b in zip(cuts[:-1], cuts[1:])]
            both = pair_counts(sets)
            sizes = np.diff(cuts)
            linked = both * DENOMINATOR >= (sizes[:, None] + sizes[None] - both) * NUMERATOR
            np.fill_diagonal(linked, False)
            if tile["x"].iat[0] != tile["y"].iat[0]:
                linked &= second[:, None] != second[None]
            number = linked @ copies
            a, b = np.nonzero(np.triu(linked))
            roots = dict(_tree([(ids[a], ids[b])]))
            out += [(i, c, roots.get(i)) for i, c in zip(ids.tolist(), number.tolist()) if c]
            if len(out) > 50_000:
                yield _told(out)
                out = []
        yield _told(out)

    def _told(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], pa.int64()) for k in range(3)], ["id", "linked", "root"])

    dealt = tiles.select(*keys, "second", "id", "copies", "h").repartition(*keys).sortWithinPartitions(*keys, "id")
    return dealt.mapInArrow(run, "id long, linked long, root long")


def jaccard_join(docs: DataFrame, row_keys: bool = False) -> DataFrame:
    """doc_id, class_id and n_links of every row.

    With ``row_keys`` also key1 and key2, which tell apart texts that share an id, and stays: whether the row is
    its class's one row (or rows, if they repeat id and text), or has no part in any class.
    """
    runs, levels = plan(docs.count())
    signed = save_stage(signatures(docs, runs, levels), "paths-signatures")
    some = signed.filter("n > 0 and doc_id is not null")
    members = some.groupBy("key1", "key2").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies"))
    # a doc_id with several texts has several members, so a member's id is a hash of its doc_id and keys
    members = save_stage(members.withColumn("id", F.xxhash64("least", "key1", "key2")), "paths-members")
    # a row of each class member; rows that repeat doc_id and text give one row
    rows = some.join(members, ["key1", "key2"]).filter("doc_id = least").select(
        "id", "doc_id", "key1", "key2", "copies", "n", "sketch", "picks").dropDuplicates(["id"])
    rows = save_stage(rows, "paths-rows")
    nodes = reduce(DataFrame.unionByName, _nodes(rows, runs, levels))
    candidates = components(_sketch_links(nodes, rows))
    sizes = candidates.groupBy("root").agg(F.count("*").alias("size"))
    clusters = candidates.join(sizes, "root").select(F.col("node").alias("id"), F.col("root").alias("cluster"), "size")
    clusters = save_stage(clusters.join(rows.select("id", "doc_id", "key1", "key2", "copies"), "id"), "paths-clusters")
    links = save_stage(_exact_links(clusters, docs), "paths-links")
    classes = components(links.filter("root is not null").select(F.col("id").alias("a"), F.col("root").alias("b")))
    classes = save_stage(classes.select(F.col("node").alias("id"), "root").join(members.select("id", "least"), "id"), "paths-classes")
    names = save_stage(classes.groupBy("root").agg(F.min(F.struct("least", "id")).alias("first")).select("root", F.col("first.least").alias("name"), F.col("first.id").alias("first")), "paths-names")
    classes = classes.join(small_side(names, 24), "root").select("id", "name", "first")
    counted = links.groupBy("id").agg(F.sum("linked").alias("linked"))
    told = save_stage(members.join(counted, "id", "left").join(classes, "id", "left").select(
        "key1", "key2", "least", (F.coalesce("first", "id") == F.col("id")).alias("leads"), F.coalesce("name", "least").alias("class_id"), (F.coalesce("linked", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "paths-told")
    plain = signed.filter("n = 0 or doc_id is null").select(
        "doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), "key1", "key2", F.lit(True).alias("stays"))
    out = some.select("doc_id", "key1", "key2").join(told, ["key1", "key2"]).select(
        "doc_id", "class_id", "n_links", "key1", "key2", (F.col("leads") & (F.col("doc_id") == F.col("least"))).alias("stays")).unionByName(plain)
    return out if row_keys else out.select("doc_id", "class_id", "n_links")


def row_keys(text: Column) -> list[Column]:
    """key1 and key2 of a text, as :func:`jaccard_join` tells them."""
    return _keys(F.coalesce(words(text), F.array().cast("array<string>")))
