"""Cases that once went wrong, and operators against plain versions of their method."""

import itertools
import random

import numpy as np

import corpus_pipeline
from quarterdeck.llm import language_id, token_counts, topk, toxicity
from test_long_runs import restorer


def test_top_k_of_components_beyond_exact_products(spark):
    rnd = random.Random(3)
    rows = [(i, [rnd.choice([3e6, -2.5e6, 1e12, 0.5, -1.0]) for _ in range(3)]) for i in range(200)]
    rows += [(200, [1e18, 1e18, 1e18]), (300, [1e300, 1.0, 1.0]), (400, [1e306, 1.0, 1.0])]  # the last is no double any more when scaled
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(tuple(r) for r in topk.top_k(df.filter("vec_id % 100 = 0"), df, 5).collect())
    vectors = {i: [int(np.floor(1024 * x)) for x in v] for i, v in rows if i != 400}
    want = []
    for q in (0, 100, 200, 300):
        scored = sorted((-min(max(sum(a * b for a, b in zip(vectors[q], v)), topk.LEAST), topk.MOST), i) for i, v in vectors.items() if i != q)
        want += [(q, place + 1, i, -s) for place, (s, i) in enumerate(scored[:5])]
    assert got == sorted(want)


def test_language_of_long_texts_only_is_learned(docs):
    rnd = random.Random(1)
    english, french = "the river house was near and quiet that evening".split(), "la maison du fleuve est une nuit sous les pluies".split()
    rows = [(i, " ".join(rnd.choices(english, k=6000)), "en") for i in range(40)]
    rows += [(100 + i, " ".join(rnd.choices(french, k=30)), "fr") for i in range(40)]
    df = docs(rows)
    model = language_id.fit(df)
    told = {r["doc_id"]: r["lang_pred"] for r in language_id.identify(df, model).collect()}
    assert model["names"] == ["en", "fr"] and all(told[i] == "en" for i in range(40)) and all(told[100 + i] == "fr" for i in range(40))
    lengths = [r[0] for r in language_id.learnable(df).filter("lang = 'en'").selectExpr("length(text)").collect()]
    assert lengths and set(lengths) == {language_id.TRAIN_CHARS}


def test_pooled_embeddings_and_softmax_against_a_plain_loop():
    rng = np.random.default_rng(0)
    table = rng.normal(size=(language_id.BUCKETS, 3))
    texts = ["", "12 3", "The CAT, the dog!", "é漢字 x", "a" * 5, "word " * 9000]
    sums, counts = language_id.pooled(texts, table)
    for text, total, n in zip(texts, sums, counts):
        plain = "".join(c if c.isalpha() else " " for c in text.lower())
        codes = [32, *map(ord, plain), 32, 32, 32, 32]
        want, number = np.zeros(3), 0
        for size in (2, 3, 4):
            for at in range(len(codes) - size + 1):
                gram = codes[at:at + size]
                if any(c == 32 for c in gram[1:-1]) or gram == [32, 32]:
                    continue
                h = 0
                for j, c in enumerate(gram):
                    h = (h + c * int(language_id._MULTIPLIERS[j])) % 2 ** 64
                h ^= h >> 29
                want += table[h * int(language_id._MULTIPLIERS[0]) % 2 ** 64 >> 48]
                number += 1
        assert number == n and np.allclose(want, total)
    logits = rng.normal(size=(4, 3))
    plain = [[np.exp(x) / sum(np.exp(y) for y in row) for x in row] for row in logits]
    assert np.allclose(language_id.softmax(logits), plain)


def every_path(reader, token):
    """Scores of all readings of a token, by listing the lattice's paths."""
    parts = [reader.choices(run[1], run.end() - run.start()) for run in toxicity._RUN.finditer(token)]
    out = {}
    for path in itertools.product(*parts):
        score, a, b, shown = 0.0, 0, 0, ""
        for emitted, cost in path:
            score -= cost
            for char in emitted:
                c = toxicity._CODE.get(char, 0 if char == " " else 1)
                if c == 0 and b == 0:
                    continue
                score += reader.logs[a][b][c]
                a, b, shown = b, c, shown + char
        out[shown] = max(out.get(shown, -1e9), score + reader.logs[a][b][0])
    return out


def test_decoding_against_all_paths():
    reader = toxicity.Restorer(restorer())
    for token in ("1d1ot", "th3", "r|v3r", "h0u$e", "iiddiioott", "nnear", "t-h-e", "w@s", "1-d", "aab1"):
        scores = every_path(reader, token)
        assert scores[reader.decode(token)] >= max(scores.values()) - 1e-4, token


def test_tokens_without_letters_and_of_doubled_letters_meet_the_lattice():
    words = toxicity.Words(restorer())
    assert words.restored("1d10t") == ["idiot"] and words.restored("iiddiioott") == ["idiot"] and words.restored("7#3") == ["the"]
    for number in ("2019", "17", "1,500", "3.5", "100000", "$5", "12:30", "+49"):
        assert words.restored(number) == [], number
    assert words.restored("house") == ["house"] and words.restored("1 2 3".replace(" ", toxicity.SEPARATOR)) == []


def test_near_copies_of_one_id_with_several_texts(spark, docs):
    rnd = random.Random(5)
    base = " ".join(rnd.choice(["river", "house", "road", "night", "stone", "wind"]) + str(rnd.randrange(50)) for _ in range(80))
    other = " ".join("other" + str(rnd.randrange(60)) for _ in range(80))
    near = base.rsplit(" ", 1)[0] + " changed"
    stage = dict(corpus_pipeline.STAGES)["ngram_jaccard_join"]
    kept = sorted((r["doc_id"], r["text"]) for r in stage(spark, docs([(1, base), (2, base), (2, other)]), "").select("doc_id", "text").collect())
    assert kept == sorted([(1, base), (2, other)])
    # two near copies under one id, that has the smallest number
    kept = [(r["doc_id"], r["text"]) for r in stage(spark, docs([(1, base), (1, near), (3, near), (None, base)]), "").select("doc_id", "text").collect()]
    assert len(kept) == 2 and (None, base) in kept and {k for k, _ in kept} == {None, 1}


def test_given_texts_are_spliced(spark, given):
    texts = [r["text"] or "" for r in spark.read.parquet(f"{given}/documents.parquet").select("text").collect()]
    count = token_counts.counter(__import__("public_tokenizers").path("piece_bpe_32k.model"))
    long = [t for t in texts if len(t) > token_counts.CHUNK]
    assert len(long) > 1 and count.count_long(long[0]) == len(count.model.encode(long[0]))
    assert count(texts) == [len(ids) for ids in count.model.encode(texts, num_threads=1)]


def test_links_of_a_large_node_follow_its_texts_and_not_their_square(spark, monkeypatch):
    from quarterdeck.llm import chosen_path, components

    monkeypatch.setattr(chosen_path, "SMALL", 8)
    n = 160  # twenty blocks of texts of two kinds: 210 tiles
    kinds = [bytes([1 + k]) * chosen_path.BINS for k in (0, 1)]
    rows = spark.createDataFrame([(i, 10, bytearray(kinds[i % 2])) for i in range(n)], "id long, n int, sketch binary")
    shared = spark.createDataFrame([(i, 5, n) for i in range(n)], "id long, node long, size long")
    links = chosen_path._sketch_links(shared, rows).collect()
    assert len(links) <= n + 2 * 190
    found = components.components(spark.createDataFrame(links, "a long, b long"))
    assert {r.node: r.root for r in found.collect()} == {i: i % 2 for i in range(n)}


def test_texts_that_are_all_alike_are_not_dealt_to_pairs_of_blocks(spark, monkeypatch):
    from quarterdeck.llm import chosen_path, components

    monkeypatch.setattr(chosen_path, "SMALL", 8)
    n = 160
    kinds = [bytes([1 + k]) * chosen_path.BINS for k in (0, 1)]
    # eight nodes of texts of one kind, whose blocks differ by chance of their ids, and one text of another kind
    texts = [(i, 10, bytearray(kinds[i == 7])) for i in range(n)]
    rows = spark.createDataFrame(texts, "id long, n int, sketch binary")
    shared = spark.createDataFrame([(i, k, n) for i in range(n) for k in range(8)], "id long, node long, size long")
    # a path from block to block, as the blocks of other nodes give it
    pairs = spark.createDataFrame([(i, 100 + i // 4, 4) for i in range(n)] + [(i, 200 + (i + 2) // 4, 4) for i in range(n)], "id long, node long, size long")
    plans = []
    run = chosen_path._searched
    monkeypatch.setattr(chosen_path, "_searched", lambda tiles, rows: plans.append(tiles.count()) or run(tiles, rows))
    links = chosen_path._sketch_links(shared.union(pairs), rows).collect()
    found = components.components(spark.createDataFrame(links, "a long, b long"))
    assert {r.node: r.root for r in found.collect()} == {i: 0 for i in range(n) if i != 7}
    assert sum(plans) <= 3 * (8 + 2) * n  # before: 8 n rows in each of 20 blocks
