"""Contaminated words against a plain search for every window."""

import random
import re
from hashlib import sha256

import numpy as np

from quarterdeck.llm import winnowing

PATTERN = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UPPER = {c: c + 32 for c in range(65, 91)}


def words_of(text):
    return PATTERN.findall((text or "").translate(UPPER))


def plain(doc_id, text, items):
    w, hit, named = words_of(text), set(), set()
    for item_id, item in items:
        v = words_of(item)
        size = min(10, len(v))
        if not size:
            continue
        windows = {tuple(v[i:i + size]) for i in range(len(v) - size + 1)}
        for i in range(len(w) - size + 1):
            if tuple(w[i:i + size]) in windows:
                hit.update(range(i, i + size))
                if item_id is not None:
                    named.add(str(item_id))
    return doc_id, len(w), len(hit), len(named), sha256(",".join(sorted(named)).encode()).hexdigest(), bool(hit)


def texts(seed, n, vocabulary, most):
    rnd = random.Random(seed)
    return [" ".join(rnd.choice(vocabulary) for _ in range(rnd.randint(0, most))) for _ in range(n)]


VOCABULARY = ["The", "cat", "é", "漢字", "x1", "x-y", "ÄÖ", "don't", "9", "a.b"]


def test_contamination_against_plain_search(spark, docs):
    items = [(i, t) for i, t in enumerate(texts(3, 12, VOCABULARY, 40))]
    items += [(100, None), (101, ""), (102, " . "), (103, "THE cat"), (104, "x1 x1 x1 x1 9 9 9"), (3, "same id other words"), (None, "no id here cat"), (105, "a b c d e f g h i j k l"), (106, "A b, c D e f g h i j!")]
    rows = [*enumerate(texts(5, 60, VOCABULARY, 80)), (900, None), (901, ""), (902, "... \x00"), (903, "c d e f g h i j k l"), (904, "a b c d e f g h i"),
            (905, "no-id here\x7fcat"), (3, items[5][1]), (3, items[5][1]), (None, items[7][1]), (906, "q " * 9000 + (items[2][1] or "") + " q" * 9000), (907, "the" * 5000 + " cat")]
    table = spark.createDataFrame([(*r, "x") for r in items], "item_id long, text string, words string").repartition(3)
    got = [tuple(r) for r in winnowing.digests(winnowing.contamination(docs(rows), table)).collect()]
    assert sorted(got, key=str) == sorted((plain(*r, items) for r in rows), key=str)


def test_without_broadcasts_and_with_a_full_bitmap(spark, docs, monkeypatch):
    monkeypatch.setattr(winnowing, "MOST_BITS", 1 << 16)
    monkeypatch.setattr("quarterdeck.llm.common.BROADCAST_BYTES", -1)
    items = list(enumerate(texts(8, 30, VOCABULARY[:4], 40)))
    rows = list(enumerate(texts(9, 80, VOCABULARY[:4], 60)))
    table = spark.createDataFrame(items, "item_id long, text string")
    got = [tuple(r) for r in winnowing.digests(winnowing.contamination(docs(rows), table)).collect()]
    assert sorted(got) == sorted(plain(*r, items) for r in rows)


def test_empty_tables(spark, docs):
    none = spark.createDataFrame([], "item_id long, text string")
    got = winnowing.digests(winnowing.contamination(docs([(1, "a b")]), none)).collect()
    assert [tuple(r) for r in got] == [(1, 2, 0, 0, sha256(b"").hexdigest(), False)]
    assert winnowing.contamination(docs([]), none).count() == 0


def test_every_shared_window_keeps_the_same_fingerprint():
    rnd = random.Random(1)
    shared = " ".join(rnd.choice("abcdefgh") for _ in range(10))
    for _ in range(50):
        a, b = (" ".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(0, 9))) for _ in "ab")
        data = np.frombuffer(f"{a} {shared} {b}".encode(), dtype=np.uint8)
        words = winnowing.Words(data, np.array([0, len(data)]))
        first, place, prints = words.kept(10)
        at = [k for k in range(len(first)) if words.spelled(int(first[k]), 10) == shared]
        alone = np.frombuffer(shared.encode(), dtype=np.uint8)
        only = winnowing.Words(alone, np.array([0, len(alone)])).kept(10)[2]
        assert at and all(prints[k] == only[0] for k in at)


def test_hashes_do_not_depend_on_place_or_piece(monkeypatch):
    text = " ".join(texts(2, 40, VOCABULARY, 60)).encode()
    data = np.frombuffer(text, dtype=np.uint8)
    whole = winnowing.Words(data, np.array([0, len(data)]))
    monkeypatch.setattr(winnowing, "PIECE", 5)
    monkeypatch.setattr(winnowing.Words, "up", winnowing.Words.up[:6])
    monkeypatch.setattr(winnowing.Words, "down", winnowing.Words.down[:6])
    pieces = winnowing.Words(data, np.array([0, len(data)]))
    assert (whole.hashes == pieces.hashes).all()
    spelled = [whole.spelled(i, 1) for i in range(len(whole.starts))]
    assert len({(w, h) for w, h in zip(spelled, whole.hashes.tolist())}) == len(set(spelled)) == len(set(whole.hashes.tolist()))
    assert spelled == words_of(text.decode())
