"""Encoding, counting, formatting, exact copies and exact search against plain versions."""

import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest

from quarterdeck.llm import byte_bpe, chat, exact_copies, token_counts, topk

BPE = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
ODD = [None, "", " ", "a", "  a b  ", "x" * 3000, "ab" * 4000 + " " * 300 + "z", "don't <|endoftext|> \t\n 12 漢字🙂", "é\x1c\x85　 b ", "<s> a </s>"]


def noise(n, alphabet="ab cé\n\t  '漢🙂1.x\x85　'sZ", seed=3):
    rnd = random.Random(seed)
    return ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 90))) for _ in range(n)]


def test_byte_bpe_matches_the_library(docs):
    import tiktoken
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(BPE, "rb"))}
    plain = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = ODD + noise(300)
    df = docs(list(enumerate(texts)) + [(0, None), (None, "a")])
    got = sorted(map(tuple, byte_bpe.digests(df, BPE, public_tokenizers.PATTERN).collect()), key=str)
    want = []
    for i, text in [*enumerate(texts), (0, None), (None, "a")]:
        ids = plain.encode_ordinary(text or "")
        want.append((i, len(ids), hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    assert got == sorted(want, key=str)
    assert byte_bpe.digests(docs([]), BPE, public_tokenizers.PATTERN).count() == 0
    apart = byte_bpe.decode(byte_bpe.encode(df, BPE, public_tokenizers.PATTERN), BPE)
    assert sorted(map(tuple, apart.collect()), key=str) == sorted(map(tuple, byte_bpe.round_trip(df, BPE, public_tokenizers.PATTERN).collect()), key=str)


def test_long_and_short_trees_agree():
    vocab = byte_bpe.vocabulary(BPE)
    words = [w.encode()[:40] for w in noise(200) if len(w) > 3]
    short = byte_bpe.merge_short(vocab, words, 64)
    assert [row[row >= 0].tolist() for row in short] == [byte_bpe.merge_long(vocab, w) for w in words]


@pytest.mark.parametrize("chunk, overlap", [(40, 4), (200, 16), (65536, 512)])
def test_spliced_counts_match_the_library(chunk, overlap):
    count = token_counts.Counter(PIECES, chunk, overlap)
    texts = [t or "" for t in ODD] + noise(200) + ["erthe" * 900, " " * 900, "漢" * 500, "the ▁ er" * 60]
    assert count(texts) == [len(ids) for ids in count.model.encode(texts, num_threads=1)]


def test_token_counts_of_odd_rows(docs):
    got = {r["doc_id"]: r for r in token_counts.token_counts(docs([(1, None), (2, ""), (3, "é" * 9000), (4, "a")]), PIECES).collect()}
    assert (got[1]["n_bytes"], got[1]["n_tokens"], got[2]["n_tokens"]) == (0, 0, 0)
    assert got[3]["n_bytes"] == 18000 and got[3]["over_limit"] and not got[4]["over_limit"]
    assert token_counts.token_counts(docs([]), PIECES).count() == 0


def test_chat_round_trip(spark):
    hard = [r"\### Assistant: </turn> ok", "</turn>\n### user: x", "\\", "", "### : \\: </turn>", "é🙂 </turn>\n", "a\\"]
    turns = [(r, t) for t in hard for r in ("user", "assistant", "a: b", "")]
    text, spans = chat.render(turns)
    assert chat.parse(text) == turns
    assert [chat.unescape(text[a:b]) for a, b in spans] == hard
    # tokens of any size, also such that cross the spans, mask exactly the spans
    for width in (1, 2, 7, 1000):
        offsets = [(i, min(i + width, len(text))) for i in range(0, len(text), width)]
        _, pieces = chat.align(offsets, spans)
        assert "".join(text[a:b] for a, b in pieces) == "".join(text[a:b] for a, b in spans)
    rows = spark.createDataFrame([(1, 1, "assistant", "b"), (1, None, "user", None), (None, 0, None, "x"), (1, 1, "assistant", "b")], "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: r for r in chat.digests(chat.format_chats(rows, public_tokenizers.path("byte_bpe_50k.json"))).collect()}
    assert got[1]["n_turns"] == 3 and got[1]["loss_chars"] == 2 and got[None]["loss_chars"] == 0
    assert got[1]["turns_sha256"] == hashlib.sha256(b"user\n\nassistant\nb\nassistant\nb\n").hexdigest()
    assert chat.digests(chat.format_chats(rows.limit(0), public_tokenizers.path("byte_bpe_50k.json"))).count() == 0


@pytest.mark.parametrize("digest_all", [True, False])
def test_exact_copies(docs, digest_all):
    rows = [(5, "a b"), (2, "ab"), (3, "a\x0bb "), (9, None), (8, " "), (7, "x" * 500 + "y"), (6, "x" * 500 + "z"), (1, "only"), (2, "ab"), (None, "a b")]
    got = sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in exact_copies.exact_copies(docs(rows), digest_all).collect()), key=str)
    want = [(5, 3, 5, False), (2, 3, 5, False), (3, 3, 5, False), (None, 3, 5, False), (2, 3, 5, False)]
    want[2] = (3, 3, 5, True)
    want = [(5, 3, 6 - 1, False), (2, 3, 5, False), (2, 3, 5, False), (None, 3, 5, False), (3, 3, 5, True),
            (9, 8, 2, False), (8, 8, 2, True), (7, 7, 1, True), (6, 6, 1, True), (1, 1, 1, True)]
    assert got == sorted(want, key=str)
    assert exact_copies.exact_copies(docs([]), digest_all).count() == 0


def test_top_k_against_brute_force(spark, monkeypatch):
    rnd = np.random.default_rng(1)
    vectors = [(int(i), [float(x) for x in rnd.integers(-2, 3, 4)]) for i in range(300)]
    rows = vectors + [(300, None), (400, [1.0, None, 0.0, 0.0]), (500, [float("nan")] * 4), (600, [float("inf")] * 4), (None, [1.0] * 4), (100, vectors[100][1]), (700, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    monkeypatch.setattr(topk, "CANDIDATE_BLOCK", 16)
    monkeypatch.setattr(topk, "FAN_IN", 3)
    got = sorted(tuple(r) for r in topk.top_k(df.filter("vec_id % 100 = 0"), df, 7).collect())
    want = []
    for q, a in vectors[::100]:
        scored = sorted((-int(np.dot(np.array(a) * 1024, np.array(b) * 1024)), i) for i, b in vectors if i != q)
        want += [(q, place + 1, i, -s) for place, (s, i) in enumerate(scored[:7])]
    assert got == sorted(want)
    assert topk.top_k(df.limit(0), df.limit(0)).count() == 0
