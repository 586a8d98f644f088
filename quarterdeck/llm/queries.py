"""The registered queries of the corpus operators and their SQL twins."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import byte_bpe, chat, chosen_path, exact_copies, language_id, line_chunks, merkle, mixing, periodic, token_counts, topk, toxicity, winnowing
from .common import held_out, read, ship_code

QUERIES, TWINS = {}, {}


def query(name: str, twin: str | None = None):
    def register(run):
        def with_code(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship_code(spark)
            return run(spark, sf_dir)
        QUERIES[name] = with_code
        if twin:
            TWINS[name] = twin
        return run
    return register


# one conversation beside the given ones, whose texts hold every control string of the template
PLANTED_CONVERSATION = (-7, r"\### Assistant: </turn> ok")

_ESCAPED = r"replace(replace(replace({}, '\', '\\'), '###', '\###'), '</turn>', '\</turn>')"


@query("op1_chat_formatting", rf"""
WITH said AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{PLANTED_CONVERSATION[1]}' UNION ALL SELECT -7, 1, 'assistant', '{PLANTED_CONVERSATION[1]}')
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length('### ' || replace({_ESCAPED.format('role')}, ':', '\:') || ': ' || {_ESCAPED.format('text')} || ' </turn>' || chr(10))) AS BIGINT) AS formatted_chars
FROM said GROUP BY conv_id
""")
def chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    conv, text = PLANTED_CONVERSATION
    planted = spark.range(2).select(F.lit(conv).alias("conv_id"), F.col("id").alias("turn"),
                                    F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(text).alias("text"))
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(planted)
    return chat.digests(chat.format_chats(rows, public_tokenizers.path("byte_bpe_50k.json"))).drop("n_tokens")


@query("op4_line_dedup", f"""
WITH RECURSIVE lines AS (
  SELECT doc_id, i - 1 AS i, split[i] AS line, len(split) AS n FROM (
    SELECT doc_id, split, unnest(range(1, len(split) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS split FROM documents WHERE text IS NOT NULL))),
hashed AS (SELECT *, CAST('0x' || substr(md5(line), 1, 7) AS BIGINT) AS v FROM lines),
picked AS (
  SELECT *, i >= 1 AND (lag(v) OVER w * {line_chunks.OLDER} + v) % {line_chunks.DIVISOR} = 0 AS chosen FROM hashed WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
ended AS (SELECT *, i = n - 1 OR (chosen AND NOT coalesce(lag(chosen) OVER w, FALSE)) AS closes FROM picked WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
numbered AS (SELECT *, coalesce(sum(CAST(closes AS INT)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS no FROM ended),
chunks AS (SELECT doc_id, no, string_agg(line, chr(10) ORDER BY i) AS chunk, count(*) AS size FROM numbered GROUP BY 1, 2),
placed AS (SELECT *, CASE WHEN size > 1 THEN row_number() OVER (PARTITION BY chunk ORDER BY doc_id NULLS LAST, no) ELSE 1 END AS place FROM chunks)
SELECT d.doc_id, CASE WHEN text IS NULL THEN NULL ELSE coalesce(left_text, '') END AS text, CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines,
       CAST(coalesce(lines_removed, 0) AS BIGINT) AS lines_removed, CAST(coalesce(chunks_removed, 0) AS BIGINT) AS chunks_removed
FROM documents d LEFT JOIN (
  SELECT doc_id, string_agg(chunk, chr(10) ORDER BY no) FILTER (place = 1) AS left_text, sum(size) AS n_lines,
         sum(size) FILTER (place > 1) AS lines_removed, count(*) FILTER (place > 1) AS chunks_removed FROM placed GROUP BY 1) p USING (doc_id)
""")
def line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_chunks.dedup_lines(read(spark, sf_dir, "documents").select("doc_id", "text"))


@query("op4_passage_dedup")
def passage_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks as in op4_line_dedup, whose twin fixes its results, and whole runs besides."""
    return line_chunks.dedup_passages(read(spark, sf_dir, "documents").select("doc_id", "text"))


@query("op6_exact_dedup", r"""
WITH rows AS (SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM documents),
placed AS (SELECT *, row_number() OVER w AS place, first(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size
           FROM rows WINDOW w AS (PARTITION BY text_sha256 ORDER BY n DESC, doc_id NULLS LAST))
SELECT doc_id, keep_id, group_size, place = 1 AS kept, text_sha256 FROM placed
""")
def exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_copies.exact_copies(read(spark, sf_dir, "documents"), digest_all=True)


@query("op10_exact_topk", """
WITH v AS (SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS w FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND vec_id IS NOT NULL),
scored AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.w, c.w) AS BIGINT) AS score
           FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.w) = len(c.w) WHERE q.vec_id % 100 = 0)
SELECT query_id, CAST(place AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS place FROM scored) WHERE place <= 10
""")
def exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings")
    return topk.top_k(vectors.filter("vec_id % 100 = 0"), vectors)


@query("op3_ngram_jaccard_join", r"""
WITH RECURSIVE split AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '\s+'), lambda w: w <> '') AS w FROM documents WHERE text IS NOT NULL),
sets AS (SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) BETWEEN 1 AND 4 THEN [array_to_string(w, ' ')]
           ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END)) AS s FROM split),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY 1),
shared AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS n_common FROM sets a JOIN sets b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT x, y FROM shared JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 5 * n_common >= 4 * (p.n + q.n - n_common)),
reach AS (SELECT x, y FROM links UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x)
SELECT d.doc_id, least(d.doc_id, coalesce(c.root, d.doc_id)) AS class_id, coalesce(k.n, 0) AS n_links FROM documents d
LEFT JOIN (SELECT x, min(y) AS root FROM reach GROUP BY 1) c ON c.x = d.doc_id LEFT JOIN (SELECT x, count(*) AS n FROM links GROUP BY 1) k ON k.x = d.doc_id
""")
def ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chosen_path.jaccard_join(read(spark, sf_dir, "documents"))


@query("op5_toxicity")
def toxicity_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity.score(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


@query("op7_byte_bpe")
def bpe_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.digests(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


@query("op8_token_counts")
def piece_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(read(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@query("op9_language_id")
def languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = language_id.fit(docs)
    told = language_id.identify(docs.select("doc_id", "text"), model)
    return told.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")


@query("op2_mixing")
def mixing_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"), keep=("doc_id",))


def _leaf_sql(text: str) -> str:
    told = ", ".join(f"coalesce(CAST(strlen(CAST({c} AS VARCHAR)) AS VARCHAR) || ':' || CAST({c} AS VARCHAR), '-')" for c in ("doc_id", "source", "lang", "n_chars", text))
    return f"sha256(concat({told}))"


# crc32 of a decimal number, bit by bit
_CRC_SQL = """xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: ord(c)::BIGINT)),
  lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)), lambda d, k: xor(d >> 1, 3988292384 * (d & 1)))))"""


def _tree_sql(name: str, base: str) -> str:
    """Nodes of all levels of the trees of ``base`` (tree, pos, n, digest), and the siblings of each."""
    return f"""
{name} AS (
  SELECT tree, 0 AS level, pos, n, digest FROM {base}
  UNION ALL SELECT tree, level + 1, pos // 3, (n + 2) // 3, sha256(string_agg(digest, '' ORDER BY pos)) FROM {name} WHERE n > 1 GROUP BY tree, level, n, pos // 3),
{name}_sides AS (
  SELECT a.tree, a.level, a.pos, coalesce(string_agg(b.digest, '' ORDER BY b.pos) FILTER (b.pos < a.pos), '') AS before,
         coalesce(string_agg(b.digest, '' ORDER BY b.pos) FILTER (b.pos > a.pos), '') AS after
  FROM {name} a JOIN {name} b ON a.tree = b.tree AND a.level = b.level AND a.pos // 3 = b.pos // 3 WHERE a.n > 1 GROUP BY a.tree, a.level, a.pos)"""


@query("op11_merkle_manifest", f"""
WITH RECURSIVE leaves AS (
  SELECT doc_id, CASE WHEN source IS NULL THEN '' ELSE '+' || source END AS tree, {_leaf_sql('text')} AS digest,
         CASE WHEN {_CRC_SQL} % 2 = 0 THEN {_leaf_sql("replace(text, chr(10), '')")} END AS other FROM documents),
placed AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, digest) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS n FROM leaves),
{_tree_sql('nodes', 'placed')},
subroots AS (SELECT tree AS of, 'all' AS tree, row_number() OVER (ORDER BY tree) - 1 AS pos, count(*) OVER () AS n, digest FROM nodes WHERE n = 1),
{_tree_sql('upper', 'subroots')},
folded AS (
  SELECT doc_id, tree, pos AS leaf_pos, 0 AS level, pos, coalesce(other, digest) AS node, '' AS proof FROM placed
  UNION ALL SELECT f.doc_id, f.tree, leaf_pos, f.level + 1, f.pos // 3, sha256(before || node || after), proof || before || after
  FROM folded f JOIN nodes_sides s ON s.tree = f.tree AND s.level = f.level AND s.pos = f.pos),
whole AS (
  SELECT doc_id, of, leaf_pos, 0 AS level, r.pos, node, proof FROM (SELECT *, row_number() OVER (PARTITION BY tree, leaf_pos ORDER BY level DESC) AS top FROM folded) f
  JOIN subroots r ON r.of = f.tree WHERE top = 1
  UNION ALL SELECT w.doc_id, of, leaf_pos, w.level + 1, w.pos // 3, sha256(before || node || after), proof || before || after
  FROM whole w JOIN upper_sides s ON s.level = w.level AND s.pos = w.pos)
SELECT p.doc_id, p.digest AS leaf, r.digest AS subroot, u.digest AS root, sha256(w.proof) AS proof_sha256, w.node AS folded_root, w.node = u.digest AS verified
FROM (SELECT *, row_number() OVER (PARTITION BY of, leaf_pos ORDER BY level DESC) AS top FROM whole) w
JOIN placed p ON p.tree = w.of AND p.pos = w.leaf_pos JOIN subroots r ON r.of = w.of JOIN upper u ON u.n = 1 WHERE w.top = 1
""")
def merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.verdicts(merkle.manifest(read(spark, sf_dir, "documents"), merkle.without_line_ends()))


@query("op12_periodic_runs")
def periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.digests(periodic.find_runs(read(spark, sf_dir, "documents"), periodic.repeated_tail))


_WORDS_SQL = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


@query("op13_benchmark_contamination", f"""
WITH items AS (SELECT CAST(item_id AS VARCHAR) AS item_id, w, least(10, len(w)) AS size FROM (SELECT item_id, {_WORDS_SQL} AS w FROM benchmark WHERE text IS NOT NULL) WHERE len(w) > 0),
windows AS (SELECT DISTINCT item_id, size, array_to_string(w[s:s + size - 1], ' ') AS words FROM (SELECT *, unnest(range(1, len(w) - size + 2)) AS s FROM items)),
texts AS (SELECT doc_id, {_WORDS_SQL} AS w FROM documents WHERE text IS NOT NULL),
placed AS (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS s FROM texts CROSS JOIN (SELECT DISTINCT size FROM windows) WHERE len(w) >= size),
hits AS (SELECT doc_id, s, size, words FROM (SELECT doc_id, s, size, array_to_string(w[s:s + size - 1], ' ') AS words FROM placed) JOIN (SELECT DISTINCT size, words FROM windows) USING (size, words)),
covered AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(s, s + size)) AS p FROM hits) GROUP BY 1),
named AS (SELECT doc_id, count(*) AS n, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM hits JOIN windows USING (size, words) WHERE item_id IS NOT NULL) GROUP BY 1)
SELECT d.doc_id, CAST(coalesce(len(t.w), 0) AS BIGINT) AS n_words, CAST(coalesce(c.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(n.n, 0) AS BIGINT) AS n_items,
       sha256(coalesce(n.ids, '')) AS items_sha256, coalesce(c.n, 0) > 0 AS contaminated
FROM documents d LEFT JOIN texts t USING (doc_id) LEFT JOIN covered c USING (doc_id) LEFT JOIN named n USING (doc_id)
""")
def benchmark_contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnowing.digests(winnowing.contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")))
