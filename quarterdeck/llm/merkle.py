"""Merkle manifest of a dataset: persistent trees whose tampered versions share what was not touched.

Leaves of a source, in order of their ids, form a tree of fan-out ``FAN``; the subroots of
all sources, in order of their names, form one more. Positions come from a range sort and
counts of its parts, so a source of any size spreads over many tasks. Every
``FAN ** LEVELS`` consecutive nodes (a power of the fan-out, so blocks are aligned with the runs of the
tree) are one block, which fits any task; block roots are the nodes of the next tier.
Tiers are built upwards until each source has one node, and the paths above the blocks
are handed down again, one row a block.

A block's tree (:class:`Versions`) is persistent: replacing a leaf appends the copied
ancestors and leaves every other node to all versions. The version then continues through
the path above its block in the same task, so the upper tiers of all versions are as
spread as the leaves.

Defined results: a null column stands as ``-`` in a leaf; rows without a source form a
source of their own, which comes first; rows without an id come first in their source and
are never tampered with by :func:`without_line_ends`; rows that repeat an id are ordered
by their leaves, and equal rows are leaves like any others. A source with one row has its
leaf as subroot; without siblings anywhere the proof is the digest of nothing. An empty
table gives no rows. Columns other than the leaf's and the id are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import save_stage
from .common import small_side

FAN, LEVELS = 3, 6
LEAF_COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
GROUP = ("named", "source")
NODE = "named boolean, source string, n long, pos long, digest string"
TOP = "named boolean, source string, pos long, path array<string>, subroot string, root string"


def digest(text: str) -> str:
    return sha256(text.encode()).hexdigest()


class Versions:
    """A tree over the nodes of one block, and versions of it; nodes are appended and never changed."""

    def __init__(self, leaves: list[str], height: int):
        self.digests, self.children, self.height = list(leaves), [()] * len(leaves), height
        level = list(range(len(leaves)))
        for _ in range(height):
            level = [self._new(tuple(level[at:at + FAN])) for at in range(0, len(level), FAN)]
        self.root = level[0]

    def _new(self, children: tuple[int, ...]) -> int:
        self.digests.append(digest("".join([self.digests[c] for c in children])))
        self.children.append(children)
        return len(self.digests) - 1

    def _trail(self, leaf: int) -> list[tuple[int, int]]:
        """Nodes above a leaf and the child taken at each, from the leaf's parent to the root."""
        node, out = self.root, []
        for level in range(self.height - 1, -1, -1):
            taken = leaf // FAN ** level % FAN
            out.append((node, taken))
            node = self.children[node][taken]
        return out[::-1]

    def path(self, leaf: int) -> list[str]:
        """Siblings to the left and to the right of the leaf and of each node above it, two strings a level."""
        out = []
        for node, taken in self._trail(leaf):
            shown = [self.digests[c] for c in self.children[node]]
            out += ["".join(shown[:taken]), "".join(shown[taken + 1:])]
        return out

    def replaced(self, leaf: int, new: str) -> int:
        """Root of the version with another leaf: copies of its ancestors, which share all their other children."""
        self.digests.append(new)
        self.children.append(())
        node = len(self.digests) - 1
        for parent, taken in self._trail(leaf):
            old = self.children[parent]
            node = self._new((*old[:taken], node, *old[taken + 1:]))
        return node


def continued(node: str, path: list[str]) -> str:
    """The root above a node by the siblings of ``path``."""
    for left, right in zip(path[::2], path[1::2]):
        node = digest(left + node + right)
    return node


def tree_of(rows: list[dict], levels: int) -> Versions:
    """The tree over one block; that of a source with one block ends at its only root."""
    height, n = 0, rows[0]["n"]
    while n > 1 and height < levels:
        n, height = -(-n // FAN), height + 1
    return Versions([r["digest"] for r in rows], height)


# ---- leaves and positions ---------------------------------------------------------------------
def leaf(**changed: Column) -> Column:
    """Digest of a row's columns, each with its length in bytes."""
    parts = []
    for name in LEAF_COLUMNS:
        value = changed.get(name, F.col(name)).cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-")))
    return F.sha2(F.concat(*parts), 256)


def without_line_ends() -> tuple[Column, Column]:
    """Which rows are tampered with, and the leaf that they then have."""
    picked = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.lit(False))
    return picked, leaf(text=F.replace(F.col("text").cast("string"), F.lit("\n"), F.lit("")))


def numbered(rows: DataFrame, group: tuple[str, ...], order: tuple[str, ...], label: str) -> DataFrame:
    """``rows`` with pos, from 0 in each group, and n, the group's size."""
    keys = [F.col(c).asc_nulls_first() for c in (*group, *order)]
    placed = save_stage(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("at", F.monotonically_increasing_id()), label)
    placed = placed.withColumns({"part": F.shiftright("at", 33), "inside": F.col("at").bitwiseAND((1 << 33) - 1)}).drop("at")
    counts = placed.groupBy(*group, "part").agg(F.count("*").alias("rows"), F.min("inside").alias("first"))
    along = Window.partitionBy(*group).orderBy("part")  # one row for each part that a group touches
    before = F.coalesce(F.sum("rows").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = save_stage(counts.select(*group, "part", "first", before.alias("before"), F.sum("rows").over(Window.partitionBy(*group)).alias("n")), f"{label}-parts")
    width = F.octet_length("source") + 48 if "source" in group else F.lit(48)
    return placed.join(small_side(counts, width), [*group, "part"]).withColumn("pos", F.col("inside") - F.col("first") + F.col("before")).drop("part", "inside", "first", "before")


# ---- tiers ------------------------------------------------------------------------------------
def _blocks(rows: DataFrame) -> DataFrame:
    """Rows (with their block) brought together by block, in order."""
    return rows.repartition(*GROUP, "block").sortWithinPartitions(*GROUP, "block", "pos")


def _each_block(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    """Rows of one block after another; a block may go on in the next batch."""
    held, key = [], None
    for batch in batches:
        for row in batch.to_pylist():
            at = (row["named"], row["source"], row["block"])
            if held and at != key:
                yield held
                held = []
            key = at
            held.append(row)
    if held:
        yield held


def _told(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(column), field.type) for column, field in zip(zip(*held), schema)], schema=schema)

    for row in rows:
        held.append(row)
        if len(held) >= 2000:
            yield batch()
            held.clear()
    if held:
        yield batch()


_NODE = pa.schema([("named", pa.bool_()), ("source", pa.string()), ("n", pa.int64()), ("pos", pa.int64()), ("digest", pa.string())])
_TOP = pa.schema([("named", pa.bool_()), ("source", pa.string()), ("pos", pa.int64()), ("path", pa.list_(pa.string())), ("subroot", pa.string()), ("root", pa.string())])


def ascend(nodes: DataFrame, levels: int = LEVELS) -> DataFrame:
    """The block roots of a tier, which are the nodes of the next."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def roots() -> Iterator[tuple]:
            for rows in _each_block(batches):
                tree = tree_of(rows, levels)
                yield rows[0]["named"], rows[0]["source"], -(-rows[0]["n"] // FAN ** levels), rows[0]["block"], tree.digests[tree.root]
        yield from _told(roots(), _NODE)

    rows = nodes.select(*GROUP, "n", "pos", "digest").withColumn("block", F.floor(F.col("pos") / FAN ** levels))
    return _blocks(rows).mapInArrow(run, NODE)


def tiers(nodes: DataFrame, label: str, levels: int = LEVELS) -> list[DataFrame]:
    """Saved tiers above ``nodes``; the last has one node for each group."""
    out = [save_stage(ascend(nodes, levels), label)]
    while (out[-1].agg(F.max("n")).first()[0] or 0) > 1:
        out.append(save_stage(ascend(out[-1], levels), label))
    return out


def _with_tops(nodes: DataFrame, tops: DataFrame, levels: int) -> DataFrame:
    """Nodes by block behind the row (pos -1) that says what is above their block."""
    rows = nodes.withColumn("block", F.floor(F.col("pos") / FAN ** levels))
    above = tops.select(*GROUP, F.col("pos").alias("block"), F.lit(-1).cast("long").alias("pos"), "path", "subroot", "root")
    return _blocks(rows.unionByName(above, allowMissingColumns=True))


def descend(nodes: DataFrame, tops: DataFrame, levels: int = LEVELS) -> DataFrame:
    """What is above each node of a tier, given what is above each of its blocks."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def paths() -> Iterator[tuple]:
            for top, *rows in _each_block(batches):
                tree = tree_of(rows, levels)
                for k, r in enumerate(rows):
                    yield r["named"], r["source"], r["pos"], tree.path(k) + top["path"], top["subroot"], top["root"]
        yield from _told(paths(), _TOP)

    return _with_tops(nodes.select(*GROUP, "n", "pos", "digest"), tops, levels).mapInArrow(run, TOP)


def tops_of(found: list[DataFrame], tops: DataFrame, label: str, levels: int = LEVELS) -> DataFrame:
    """What is above each node of the first tier, given what is above the only node of the last."""
    for nodes in reversed(found[:-1]):
        tops = save_stage(descend(nodes, tops, levels), label)
    return tops


# ---- the manifest -----------------------------------------------------------------------------
def manifest(docs: DataFrame, tampering: tuple[Column, Column] | None = None, levels: int = LEVELS) -> DataFrame:
    """doc_id, leaf, subroot, root, path (siblings from the leaf to the root), version and folded_root of every row.

    ``tampering`` says which rows get another leaf and which one; ``version`` is the subroot's block root in the
    version with that leaf, ``folded_root`` the root that the leaf and the row's original siblings give.
    """
    picked, other = tampering or (F.lit(False), F.lit(None).cast("string"))
    rows = docs.select(F.col("source").isNotNull().alias("named"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"),
                       F.col("doc_id").cast("long").alias("doc_id"), leaf().alias("digest"), F.when(picked, other).alias("tampered"))
    rows = save_stage(rows.withColumn("uid", F.monotonically_increasing_id()), "merkle-leaves")
    leaves = save_stage(numbered(rows, GROUP, ("doc_id", "digest", "uid"), "merkle-order").drop("uid"), "merkle-numbered")
    found = tiers(leaves, "merkle-tier", levels)

    # the subroots are the leaves of one more tree, whose only group is named by nothing
    subroots = numbered(found[-1].select(*GROUP, "digest"), (), GROUP, "merkle-sources")
    subroots = save_stage(subroots.withColumnsRenamed({"named": "of_named", "source": "of_source"}), "merkle-subroots")
    one = subroots.select(F.lit(True).alias("named"), F.lit("").alias("source"), "n", "pos", "digest")
    over = tiers(one, "merkle-upper", levels)
    nothing = F.array().cast("array<string>")
    root = over[-1].select(*GROUP, "pos", nothing.alias("path"), F.lit(None).cast("string").alias("subroot"), F.col("digest").alias("root"))
    above = descend(one, tops_of(over, root, "merkle-upper-paths", levels), levels)
    by_source = above.select("pos", "path", "root").join(subroots, "pos").select(
        F.col("of_named").alias("named"), F.col("of_source").alias("source"), F.lit(0).cast("long").alias("pos"), "path", F.col("digest").alias("subroot"), "root")
    tops = tops_of(found, save_stage(by_source, "merkle-source-paths"), "merkle-paths", levels)

    schema = pa.schema([("doc_id", pa.int64()), ("leaf", pa.string()), ("subroot", pa.string()), ("root", pa.string()),
                        ("path", pa.list_(pa.string())), ("version", pa.string()), ("folded_root", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def proofs() -> Iterator[tuple]:
            for top, *rows in _each_block(batches):
                tree = tree_of(rows, levels)
                for k, r in enumerate(rows):
                    version = tree.digests[tree.replaced(k, r["tampered"] or r["digest"])]
                    yield r["doc_id"], r["digest"], top["subroot"], top["root"], tree.path(k) + top["path"], version, continued(version, top["path"])
        yield from _told(proofs(), schema)

    return _with_tops(leaves, tops, levels).mapInArrow(run, "doc_id long, leaf string, subroot string, root string, path array<string>, version string, folded_root string")


def verdicts(proofs: DataFrame) -> DataFrame:
    """The manifest with the digest of each row's siblings in place of them, and whether the row's root is the right one."""
    return proofs.select("doc_id", "leaf", "subroot", "root", F.sha2(F.array_join("path", ""), 256).alias("proof_sha256"), "folded_root",
                         (F.col("folded_root") == F.col("root")).alias("verified"))
