"""Near copies, line passages, mixing, language, toxicity and the pipeline on small fixtures."""

import random
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from quarterdeck.llm import chosen_path, components, language_id, line_chunks, mixing, stages, toxicity
from quarterdeck.llm.common import held_out


def sentence(rnd, n, words="red blue green stone river cloud seven apple wind light dark moon".split()):
    return " ".join(rnd.choice(words) + str(rnd.randint(0, 40)) for _ in range(n))


def brute_classes(rows):
    """Class and number of links by comparing all pairs."""
    def shingles(text):
        w = (text or "").lower().split()
        return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) > 4 else ({tuple(w)} if w else set())
    sets = [shingles(t) for _, t in rows]
    links = defaultdict(set)
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            if i != j and a and b and 5 * len(a & b) >= 4 * len(a | b):
                links[i].add(j)
    out = []
    for i in range(len(rows)):
        seen, todo = {i}, [i]
        while todo:
            new = links[todo.pop()] - seen
            seen |= new
            todo += new
        out.append((rows[i][0], min(rows[k][0] for k in seen), len(links[i])))
    return sorted(out)


def test_jaccard_join_against_all_pairs(docs, monkeypatch):
    rnd = random.Random(5)
    common = sentence(rnd, 30)
    rows, n = [], 0
    for g in range(12):
        base = sentence(rnd, 120).split()
        for k in range(rnd.choice([1, 2, 3, 25])):
            copy = list(base)
            for _ in range(rnd.randint(0, 4)):
                copy[rnd.randrange(len(copy))] = "new" + str(rnd.randint(0, 999))
            rows.append((n, ("  " if k % 3 == 0 else " ").join(copy) + (" " + common if g % 2 else "")))
            n += 1
    rows += [(n, None), (n + 1, ""), (n + 2, "four words of text"), (n + 3, "Four words of  text"), (n + 4, "one")]
    monkeypatch.setattr(chosen_path, "SMALL", 8)  # hot nodes and clusters are split into tiles
    monkeypatch.setattr(chosen_path, "TILE", 6)
    got = sorted(tuple(r) for r in chosen_path.jaccard_join(docs(rows)).collect())
    assert got == brute_classes(rows)
    assert chosen_path.jaccard_join(docs([])).count() == 0


def test_jaccard_join_of_repeated_and_unnamed_rows(docs):
    text = "a b c d e f g"
    got = sorted(map(tuple, chosen_path.jaccard_join(docs([(1, text), (1, text), (None, text), (2, text)])).collect()), key=str)
    assert got == sorted([(1, 1, 2), (1, 1, 2), (2, 1, 2), (None, None, 0)], key=str)


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (101, 100), (7, 7)], "a long, b long")
    roots = {r["node"]: r["root"] for r in components.components(edges).collect()}
    assert set(roots[i] for i in range(61)) == {0} and roots[101] == 100


def test_repeated_passages_go_and_clean_lines_stay(docs):
    passage = "\n".join(f"shared line number {i} of the passage" for i in range(30))
    rows = [(i, f"own {i} one\nown {i} two\n{passage}\nend {i} a\nend {i} b") for i in range(5)]
    rows += [(10, None), (11, ""), (12, "single"), (13, "single"), (14, "x\ny\nx\ny\nx\ny"), (None, rows[0][1])]
    out = {r["doc_id"]: r for r in line_chunks.dedup_lines(docs(rows)).collect()}
    assert out[0]["text"] == rows[0][1] and out[10]["text"] is None and out[11]["text"] == "" and out[13]["text"] == "single"
    for i in range(1, 5):
        left = out[i]["text"].split("\n")
        assert {f"own {i} one", f"end {i} b"} <= set(left) and out[i]["lines_removed"] >= 20
        assert out[i]["n_lines"] == len(left) + out[i]["lines_removed"] or out[i]["text"] == ""
    assert out[None]["lines_removed"] >= 30 and out[1]["size"] == 1  # extra columns stay
    assert line_chunks.dedup_lines(docs([])).count() == 0


def test_rates_meet_the_targets(spark, docs):
    rnd = random.Random(2)
    kinds = {0: "good fine clear", 1: "spam junk blah", 2: "vile nasty awful"}
    rows = [(i, " ".join(rnd.choice(kinds[i % 3].split() + ["plain", "word"]) for _ in range(20 + i % 30))) for i in range(240)] + [(900, None), (901, "")]
    labels = spark.createDataFrame([(i, 0 if i % 3 == 1 else 1, int(i % 3 == 2)) for i in range(0, 240, 2)] + [(0, None, None), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = mixing.mix(docs(rows), labels, keep=("doc_id",)).toPandas()
    assert len(got) == len(rows) and (got.rate >= 0).all()
    want = np.array([mixing.TARGETS[d] for d in mixing.DOMAINS]) * got.n_tokens.sum()
    assert np.allclose([(got.rate * got.n_tokens * got[f"p_{d}"]).sum() for d in mixing.DOMAINS], want, rtol=2e-3)
    alone = mixing.mix(docs(rows), labels.limit(0), keep=("doc_id",)).toPandas()
    assert np.allclose(alone.rate, 1.0)
    assert mixing.mix(docs([]), labels).count() == 0


def test_language_of_held_out_rows(spark, given):
    rows = spark.read.parquet(f"{given}/documents.parquet")
    model = language_id.fit(rows)
    told = language_id.identify(rows, model).filter(held_out(F.col("doc_id"))).toPandas()
    assert (told.lang == told.lang_pred).mean() > 0.9 and not told.rejected.mean() > 0.1


def test_language_of_odd_rows(docs):
    model = language_id.fit(docs([(i, f"the cat {i} sat", "en") for i in range(1, 60)] + [(i, f"le chien {i} dort", "fr") for i in range(60, 120)]))
    got = {r["doc_id"]: r for r in language_id.identify(docs([(1, None), (2, "12 ..."), (3, "the cat " * 30_000), (4, "le chien 𝒳"), (3, "")]), model).collect() if r["text"] != ""}
    assert [got[i]["lang_pred"] for i in (1, 2, 3, 4)] == ["und", "und", "en", "fr"] and got[1]["score"] == 0 and got[1]["rejected"]
    none = language_id.identify(docs([(1, "the cat")]), language_id.fit(docs([(1, "the cat")])))
    assert none.first()["lang_pred"] == "und" and language_id.identify(docs([]), model).count() == 0


def test_restored_and_scored_texts(spark, docs):
    rnd = random.Random(4)
    rows, marks = [], []
    for i in range(700):
        bad = i % 5 == 0
        text = sentence(rnd, 30, "the house of that river was near and they went with her".split()) + " the house was near "
        text = "".join(c for c in text if not c.isdigit())
        rows.append((i, text + (rnd.choice(["idiot", "stupid", "moron"]) if bad else "river")))
        marks.append((i, int(bad), 1))
    planted = [(5000, "the house was 1d1ot near"), (5001, "they went i d i o t with"), (5002, "stuuuuupid river"), (5003, "the m0r0n was"), (5004, "the house was near"), (5005, None), (5006, "")]
    labels = spark.createDataFrame(marks + [(1, None, None), (None, 1, 1)], "doc_id long, toxic int, quality int")
    got = {r["doc_id"]: r for r in toxicity.score(docs(rows + planted), labels).collect()}
    assert all(got[i]["predicted"] == 1 for i in (5000, 5001, 5002, 5003)) and all(got[i]["predicted"] == 0 for i in (5004, 5005, 5006))
    test = [i for i, _ in rows if got[i]]
    assert np.mean([got[i]["predicted"] == (i % 5 == 0) for i in test]) > 0.98
    assert {r["score"] for r in toxicity.score(docs(planted), labels.limit(0)).collect()} == {got_none for got_none in [toxicity.score(docs(planted[:1]), labels.limit(0)).first()["score"]]}
    assert toxicity.score(docs([]), labels).count() == 0


def test_pipeline_stages(spark, given):
    import corpus_pipeline
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "ngram_jaccard_join", "mixing", "byte_bpe"]
    rows = spark.read.parquet(f"{given}/documents.parquet")
    kept = stages.known_language(spark, rows, given)
    assert kept.columns == rows.columns and kept.count() > 0.95 * rows.count()
    unique = stages.one_of_near_copies(spark, rows, given).select("doc_id", "text").collect()
    want = {i for i, root, _ in brute_classes([(r["doc_id"], r["text"]) for r in rows.collect()]) if i == root}
    assert {r["doc_id"] for r in unique} == want
    drawn = stages.mixed(spark, rows, given)
    assert drawn.columns == rows.columns and drawn.count() > 0
    assert corpus_pipeline.run(spark, given).count() > 0
