"""Every pipeline stage on odd rows, empty tables and clashing columns; the last stage against the library."""

import base64
import hashlib
import inspect
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

import corpus_pipeline
from quarterdeck.llm import mixing

STAGES = dict(corpus_pipeline.STAGES)
#: names that the operators use for themselves or give their results
CLASHES = ("lang_pred", "score", "rejected", "_row", "_id", "_r", "_gone", "_lines", "_spans", "_stays", "n_lines", "lines_removed",
           "class_id", "n_links", "id", "key1", "_w", "_x", "_p", "_y", "n_tokens", "p_high", "rate", "_copy", "ids", "decoded")
ENGLISH = "the house near the river was quiet and nobody came along the road that evening"
PASSAGE = "\n".join(f"line {i} that many documents share" for i in range(12))


@pytest.fixture(scope="module")
def odd(spark, docs):
    """Rows with nulls in every column, empty and very long texts, repeats, and a column of every clashing name."""
    rows = [(i, f"{ENGLISH} number {i}\nand {i} more\n{PASSAGE}", "en") for i in range(40)]
    rows += [(100 + i, f"la maison {i} du fleuve dort sous la pluie et le vent de la nuit", "fr") for i in range(40)]
    rows += [(200, None), (201, ""), (202, "12 34"), (203, "the river and the house " * 40_000, "en"), (204, "x" * 300_000), (None, ENGLISH), (None, None)]
    rows += [rows[0], rows[0]]
    df = docs(rows).unionByName(docs([(300, "the river")]).selectExpr(
        "CAST(NULL AS LONG) doc_id", "CAST(NULL AS STRING) text", "lang", "CAST(NULL AS STRING) source", "CAST(NULL AS LONG) n_chars", "size", "hash", "n", "id"))
    return df.selectExpr("*", *(f"concat('{name}', doc_id) AS {name}" for name in CLASHES if name not in df.columns))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("labels"))
    rows = [(i, int(i % 3 > 0), int(i % 7 == 0)) for i in range(0, 140)] + [(1, None, None), (None, 1, 0), (9999, 1, 1)]
    spark.createDataFrame(rows, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


@pytest.mark.parametrize("name", [name for name, _ in corpus_pipeline.STAGES[:-1]])
def test_stage_keeps_the_columns_it_was_given(spark, odd, folder, name):
    out = STAGES[name](spark, odd, folder)
    assert out.dtypes == odd.dtypes
    given = {tuple(r) for r in odd.drop("text", "n_chars").collect()}
    assert {tuple(r) for r in out.drop("text", "n_chars").collect()} <= given
    assert STAGES[name](spark, odd.limit(0), folder).count() == 0


def test_language_stage_keeps_readable_rows(spark, odd, folder):
    kept = {r["doc_id"] for r in STAGES["language_id"](spark, odd, folder).select("doc_id").collect()}
    assert set(range(40)) | set(range(100, 140)) | {203} <= kept and not kept & {200, 201, 202}


def test_line_stage_keeps_every_row_and_removes_the_passage(spark, odd, folder):
    out = STAGES["line_dedup"](spark, odd, folder).select("doc_id", "text", "n_chars").collect()
    assert Counter(r["doc_id"] for r in out) == Counter(r["doc_id"] for r in odd.select("doc_id").collect())
    assert all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in out)
    assert sum(PASSAGE in (r["text"] or "") for r in out if r["doc_id"] in range(1, 40)) == 0


def test_near_copy_stage_keeps_one_of_each_group(spark, odd, folder):
    out = Counter(r["doc_id"] for r in STAGES["ngram_jaccard_join"](spark, odd, folder).select("doc_id").collect())
    assert out[None] == 3 and {200, 201, 202, 203, 204} <= set(out) and set(range(100, 140)) <= set(out)


def test_mixing_stage_draws_whole_copies_at_the_rates(spark, odd, folder):
    rates = {}
    for row in mixing.mix(odd, spark.read.parquet(f"{folder}/labels.parquet"), keep=("doc_id",)).collect():
        rates[row["doc_id"]] = row["rate"]
    out = Counter(r["doc_id"] for r in STAGES["mixing"](spark, odd, folder).select("doc_id").collect())
    times = Counter(r["doc_id"] for r in odd.select("doc_id").collect())
    for doc_id, n in times.items():
        if doc_id is not None:
            assert n * int(rates[doc_id]) <= out[doc_id] <= n * (int(rates[doc_id]) + 1)


def test_encoding_stage_matches_the_library(spark, odd, folder):
    import tiktoken
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    plain = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = Counter()
    for row in odd.filter("doc_id IS NULL OR doc_id <> 204").select("doc_id", "text").collect():
        ids = plain.encode_ordinary(row["text"] or "")
        want[(row["doc_id"], len(ids), hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest(), hashlib.sha256((row["text"] or "").encode()).hexdigest())] += 1
    got = STAGES["byte_bpe"](spark, odd, folder)
    assert Counter(map(tuple, got.filter("doc_id IS NULL OR doc_id <> 204").collect())) == want
    long = got.filter("doc_id = 204").first()  # one pre-token of 300,000 bytes, which decodes to itself
    assert long["decoded_sha256"] == hashlib.sha256(b"x" * 300_000).hexdigest()
    assert STAGES["byte_bpe"](spark, odd.limit(0), folder).count() == 0


def test_stages_take_the_three_arguments():
    assert all(list(inspect.signature(stage).parameters) == ["spark", "docs", "sf_dir"] for stage in STAGES.values())
