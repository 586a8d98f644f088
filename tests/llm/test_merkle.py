"""The manifest against trees built plainly, on odd rows and with small blocks."""

from hashlib import sha256
from zlib import crc32

import pytest

from quarterdeck.llm import merkle

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, named string, pos int, digest string"


def H(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf_of(row, text):
    values = [row[0], row[1], row[2], row[3], text]
    return H(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([H(*out[-1][i:i + 3]) for i in range(0, len(out[-1]), 3)])
    return out


def siblings(tree, k):
    out = []
    for level in tree[:-1]:
        first = k // 3 * 3
        out.append((level[first:k], level[k + 1:first + 3]))
        k //= 3
    return out


def plain(rows):
    sources = {}
    for row in rows:
        sources.setdefault(row[1], []).append(row)
    order = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in order:
        sources[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r, r[4])))
        trees[s] = levels([leaf_of(r, r[4]) for r in sources[s]])
    upper = levels([trees[s][-1][0] for s in order])
    root, out = upper[-1][0], []
    for at, s in enumerate(order):
        for k, row in enumerate(sources[s]):
            path = siblings(trees[s], k) + siblings(upper, at)
            text = row[4]
            if row[0] is not None and crc32(str(row[0]).encode()) % 2 == 0 and text is not None:
                text = text.replace("\n", "")
            node = leaf_of(row, text)
            for left, right in path:
                node = H(*left, node, *right)
            out.append((row[0], leaf_of(row, row[4]), trees[s][-1][0], root, H(*[x for pair in path for side in pair for x in side]), node, node == root))
    return out


ODD = [(1, "a", "en", 3, "x\ny"), (2, "a", None, None, None), (3, None, "en", 0, ""), (None, "a", "é", 1, "\n"), (None, None, None, None, None),
       (1, "a", "en", 3, "x\ny"), (1, "a", "en", 3, "other\n"), (7, "", "en", 1, "z"), (8, "Ä", "en", 5, "é\n" * 3000), (-4, "only", "en", 1, "\n\n")]


@pytest.mark.parametrize("levels_a_tier", [2, 6])
def test_manifest_against_plain_trees(spark, levels_a_tier):
    many = [(i, "hot" if i % 3 else f"s{i % 7}", "en", i, f"line {i}\nnext" if i % 4 else "flat") for i in range(100, 190)]
    rows = ODD + many
    from quarterdeck.llm.common import ship_code
    ship_code(spark)
    df = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], SCHEMA).repartition(3)
    got = merkle.verdicts(merkle.manifest(df, merkle.without_line_ends(), levels_a_tier))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(plain(rows), key=str)


def test_one_row_and_none(spark):
    one = spark.createDataFrame([(5, "a", "en", 1, "t", "x", 1, "y")], SCHEMA)
    assert [tuple(r) for r in merkle.verdicts(merkle.manifest(one)).collect()] == [
        (5, leaf_of((5, "a", "en", 1), "t"), *[leaf_of((5, "a", "en", 1), "t")] * 2, H(), leaf_of((5, "a", "en", 1), "t"), True)]
    assert merkle.verdicts(merkle.manifest(one.limit(0), merkle.without_line_ends())).count() == 0


def test_versions_share_untouched_nodes():
    tree = merkle.Versions([str(i) for i in range(20)], 3)
    before = list(tree.digests), list(tree.children)
    old = tree.root
    new = tree.replaced(7, "other")
    assert (tree.digests[:len(before[0])], tree.children[:len(before[1])]) == before  # nothing written before has changed
    assert len(tree.digests) - len(before[0]) == 1 + tree.height  # the leaf and its ancestors
    assert sum(a != b for a, b in zip(tree.children[old], tree.children[new])) == 1
    assert merkle.continued("other", tree.path(7)) == tree.digests[new]
