"""Runs against a scan of every period, and the query's digests against plain code."""

import random
import re
from hashlib import sha256
from zlib import crc32

import numpy as np

from quarterdeck.llm import periodic


def plain_runs(w):
    n, out = len(w), {}
    for p in range(1, n // 4 + 1):
        i = 0
        while i + p < n:
            begin = i
            while i + p < n and w[i] == w[i + p]:
                i += 1
            if i - begin + p >= max(6, 4 * p) and i > begin:
                out.setdefault((begin, i - begin + p), p)
            i += 1 if i == begin else 0
    return sorted(((s, n, p) for (s, n), p in out.items()), key=lambda r: (r[0], r[2]))


def test_cover_gives_every_difference():
    assert {(b - a) % periodic.COVER_MODULUS for a in periodic.COVER for b in periodic.COVER} == set(range(periodic.COVER_MODULUS))


def test_extensions_against_plain_comparison():
    rnd = random.Random(2)
    for k in (1, 2, 5):
        w = [rnd.randrange(k) for _ in range(300)] * 2 + [99]
        lce = periodic.CoverExtensions(np.array(w))
        pairs = [(rnd.randrange(601), rnd.randrange(601)) for _ in range(400)]
        pairs = [(i, j) for i, j in pairs if i != j]
        want = []
        for i, j in pairs:
            n = 0
            while max(i, j) + n < 601 and w[i + n] == w[j + n]:
                n += 1
            want.append(n)
        got = lce(np.array([i for i, _ in pairs]), np.array([j for _, j in pairs]))
        assert got.tolist() == want


def test_runs_against_plain_scan(monkeypatch):
    rnd = random.Random(1)
    for trial in range(150):
        monkeypatch.setattr(periodic, "SLAB", rnd.choice([5, 100, 1 << 20]))
        texts = []
        for _ in range(rnd.randint(0, 6)):
            n, k = rnd.choice([0, 1, 5, 6, 7, 20, 60, 300]), rnd.choice([1, 2, 3, 10])
            t = [rnd.randrange(k) for _ in range(n)]
            if n and rnd.random() < 0.6:
                a = rnd.randrange(n)
                p = 1 + (n - a) // rnd.randint(3, 10)
                t = [t[a + (i - a) % p] if i >= a else t[i] for i in range(n)]
            texts.append(t)
        assert periodic.runs([np.array(t, dtype=np.int64) for t in texts]) == [plain_runs(t) for t in texts]


def plain(doc_id, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(w)
    h = crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[a + (i - a) % p] if i >= a else w[i] for i in range(n)]
    found = plain_runs(w)
    dropped = {i for s, size, p in found for i in range(s + p, s + size)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2])) if found else None
    kept = " ".join(x for i, x in enumerate(w) if i not in dropped)
    return (doc_id, len(found), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None,
            sha256("".join(f"{s},{size},{p}\n" for s, size, p in found).encode()).hexdigest(), sha256(kept.encode()).hexdigest())


def test_query_digests_against_plain_code(docs):
    rnd = random.Random(4)
    texts = [None, "", " \n", "a", "a " * 7, "a b a b\x1ca b", "x y z " * 40, "x\ty\x0bx y\rx y\nx y x y q " * 9, "w " * 30000, "one two three"]
    texts += [" ".join(rnd.choice("abcdef") for _ in range(rnd.randint(0, 120))) for _ in range(120)]
    rows = [*enumerate(texts), (3, None), (3, "b " * 9), (None, "c " * 8), (None, None)]
    got = [tuple(r) for r in periodic.digests(periodic.find_runs(docs(rows), periodic.repeated_tail)).collect()]
    assert sorted(got, key=str) == sorted((plain(*r) for r in rows), key=str)
    assert any(crc32(str(i).encode()) % 10 == 0 for i, _ in enumerate(texts))
    assert periodic.digests(periodic.find_runs(docs([]))).count() == 0


def test_given_documents_against_plain_code(spark, given, docs):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{given}/documents.parquet").select("doc_id", "text").collect()]
    got = [tuple(r) for r in periodic.digests(periodic.find_runs(spark.read.parquet(f"{given}/documents.parquet"), periodic.repeated_tail)).collect()]
    assert sorted(got) == sorted(plain(*r) for r in rows)
