"""The registered queries of this folder: thin digests of the operators' outputs."""

from __future__ import annotations

import re

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.llm import bpe, chat_format, decontamination, html_extraction, jaccard_join, language_id, line_dedup, line_quality, lm_scoring, prefix_trie, quality, spelling, token_counts
from lectern.llm.common import fold_is, forget, stored, table


def tokenizer_path(name: str) -> str:
    """Where a public vocabulary file lies; the files are never part of this repository."""
    return public_tokenizers.path(name)


#: Score from which a document counts as good.
LEAST_QUALITY = 0.3
WORD_BPE = "word_bpe_49k.json"
PIECES = "piece_bpe_32k.model"


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.contaminated_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return decontamination.digest(found)


def proximity_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The other half of op1's results: windows whose words stand near each other in any order."""
    return decontamination.near_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), tokenizer_path(WORD_BPE))


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), fold_is(docs.doc_id, 5, 1).alias("held_out"), "text")
    return lm_scoring.score_documents(docs, tokenizer_path(PIECES))


def op4_bpe_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_digests(table(spark, sf_dir, "documents"), tokenizer_path(WORD_BPE))


def language_model(docs: DataFrame) -> language_id.Model:
    """Learned from the documents of the training folds alone."""
    return language_id.train(docs.filter(~fold_is(docs.doc_id, 5, 0)), tokenizer_path(PIECES))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = language_id.identify(docs, language_model(docs))
    return found.select("doc_id", fold_is(found.doc_id, 5, 0).alias("held_out"), "lang_pred", "score")


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.deduplicated(table(spark, sf_dir, "documents").select("doc_id", "text"), drop_empty=False)
    return found.select("doc_id", "n_lines", "n_cut", F.char_length("text").cast("long").alias("n_chars_left"), F.sha2("text", 256).alias("text_sha256"))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.similar_documents(table(spark, sf_dir, "documents"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judged(table(spark, sf_dir, "documents"))


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text")
    probe = [(-1, n, role, "</s>[INST] ok [/INST]") for n, role in enumerate(("user", "assistant"))]
    rows = rows.unionByName(spark.createDataFrame(probe, "conv_id long, turn long, role string, text string"))
    # Each turn answers the one before it.
    number = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text")).cast("long")
    rows = rows.select(F.col("conv_id").alias("conv"), number.alias("msg"), (number - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))
    return chat_format.digest(chat_format.format_branches(chat_format.branches(rows)))


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extraction.extract_pages(table(spark, sf_dir, "pages"))


def op11_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = line_quality.train(docs.filter(~fold_is(docs.doc_id, 5, 0)), table(spark, sf_dir, "labels"))
    found = line_quality.score_documents(docs, model)
    return found.select("doc_id", fold_is(found.doc_id, 5, 0).alias("held_out"), "score", (F.col("score") >= LEAST_QUALITY).cast("int").alias("predicted"))


def rebuilt_paths(paths: DataFrame) -> DataFrame:
    """conv, steps: up to h turns of the conversation c - c % 5, then what conversation c has after its own first h."""
    base = paths.select(F.col("conv").alias("base"), F.slice("steps", 1, 8).alias("head"))
    h = (F.crc32(F.col("conv").cast("string").cast("binary")) % 9).cast("int")
    head = F.coalesce(F.slice("head", F.lit(1), h), F.slice("steps", 1, 0))
    tail = F.slice("steps", h + 1, F.greatest(F.size("steps") - h, F.lit(0)))
    return paths.join(base, F.col("conv") - F.col("conv") % 5 == F.col("base"), "left").select("conv", F.concat(head, tail).alias("steps"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = stored(prefix_trie.conversation_paths(table(spark, sf_dir, "conversations")), "paths")
    rebuilt = stored(rebuilt_paths(own), "rebuilt")
    nodes = prefix_trie.prefix_nodes(rebuilt)
    forget(own, rebuilt)
    return nodes.toDF("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = spelling.word_counts(table(spark, sf_dir, "documents"))
    found = spelling.variants(words)
    forget(words)
    return found


QUERIES = {
    "op1_decontamination": op1_decontamination,
    "op2_token_counts": op2_token_counts,
    "op3_lm_scoring": op3_lm_scoring,
    "op4_bpe_encoding": op4_bpe_encoding,
    "op5_line_dedup": op5_line_dedup,
    "op6_jaccard_join": op6_jaccard_join,
    "op7_quality_rules": op7_quality_rules,
    "op8_chat_format": op8_chat_format,
    "op9_language_id": op9_language_id,
    "op10_html_extraction": op10_html_extraction,
    "op11_quality_classifier": op11_quality_classifier,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_spelling_variants": op13_spelling_variants,
    "proximity_matches": proximity_matches,
}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = f"regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
_TOKENS = f"regexp_extract_all({_LOWER}, '[^\\x20\\x09-\\x0D]+')"
_SHINGLE = " || ' ' || ".join(["word", *(f"lead(word, {i}) OVER t" for i in range(1, jaccard_join.WIDTH))])
_CONTROLS = "|".join(map(re.escape, chat_format.CONTROL)).replace("'", "''")



def _crc32(codes: str) -> str:
    """The unsigned CRC-32 of a list of byte values."""
    step = "CASE WHEN u & 1 = 1 THEN xor(u >> 1, 3988292384) ELSE u >> 1 END"
    byte = f"list_reduce(list_prepend(xor(x, y), range(8)), lambda u, v: {step})"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {codes}), lambda x, y: {byte}), 4294967295)"


ORACLE_SQL: dict[str, str] = {
    "op1_decontamination": f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
i AS (SELECT item_id, w, unnest(range(greatest(len(w) - 9, 1))) AS pos0 FROM b WHERE len(w) > 0),
q AS (SELECT DISTINCT item_id::VARCHAR AS item, w[pos0 + 1 : pos0 + 10] AS win FROM i),
n AS (SELECT DISTINCT len(win) AS n FROM q),
p AS (SELECT doc_id, w, n, unnest(range(len(w) - n + 1)) AS pos0 FROM d, n WHERE len(w) >= n),
h AS (SELECT doc_id, pos0, n, item FROM (SELECT doc_id, pos0, n, w[pos0 + 1 : pos0 + n] AS win FROM p) JOIN q USING (win)),
k AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(pos0, pos0 + n)) AS pos FROM h) GROUP BY doc_id),
m AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN k USING (doc_id) LEFT JOIN m USING (doc_id)""",
    "op6_jaccard_join": f"""
WITH RECURSIVE d AS (SELECT doc_id, {_TOKENS} AS w FROM documents),
p AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM d WHERE len(w) >= {jaccard_join.WIDTH}),
g AS (SELECT doc_id, {_SHINGLE} AS shingle FROM p WINDOW t AS (PARTITION BY doc_id ORDER BY pos)),
s AS (SELECT DISTINCT doc_id, shingle FROM g WHERE shingle IS NOT NULL
  UNION ALL SELECT doc_id, array_to_string(w, ' ') FROM d WHERE len(w) BETWEEN 1 AND {jaccard_join.WIDTH - 1}),
k AS (SELECT doc_id, count(*) AS n, md5(string_agg(shingle, chr(10) ORDER BY shingle)) AS key FROM s GROUP BY doc_id),
r AS (SELECT key, min(doc_id) AS rep, any_value(n) AS n FROM k GROUP BY key),
e AS (SELECT rep, n, shingle FROM r JOIN s ON s.doc_id = r.rep),
l AS (SELECT a.rep AS a, b.rep AS b FROM e a JOIN e b ON a.shingle = b.shingle AND a.rep <> b.rep GROUP BY a.rep, b.rep, a.n, b.n HAVING 100 * count(*) >= {jaccard_join.PERCENT} * (a.n + b.n - count(*))),
c(node, reached) AS (SELECT rep, rep FROM r UNION SELECT c.node, l.b FROM c JOIN l ON l.a = c.reached),
m AS (SELECT node, min(reached) AS component_id FROM c GROUP BY node)
SELECT d.doc_id, coalesce(k.n, 0)::BIGINT AS n_shingles, coalesce(m.component_id, d.doc_id) AS component_id
FROM d LEFT JOIN k ON k.doc_id = d.doc_id LEFT JOIN r ON r.key = k.key LEFT JOIN m ON m.node = r.rep""",
    "op8_chat_format": f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')) v(conv_id, turn, role, text))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum({len(chat_format.START) + len(chat_format.STOP) + 2} + length(role) + length(text) + length(text) - length(replace(text, '\\', '')) + len(regexp_extract_all(text, '{_CONTROLS}')))::BIGINT AS formatted_chars
FROM t GROUP BY conv_id""",
    "op12_prefix_trie": f"""
WITH t AS (SELECT conv_id, turn, md5(concat(strlen(coalesce(role, '')), ':', coalesce(role, ''), coalesce(text, ''))) AS k, strlen(coalesce(text, '')) AS b FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, k) AS n, k, b FROM t),
c AS (SELECT conv_id, {_crc32("list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)")} % 9 AS h FROM (SELECT DISTINCT conv_id FROM t)),
r AS (SELECT c.conv_id, n, k, b FROM c JOIN o ON o.conv_id = c.conv_id - c.conv_id % 5 AND n <= h UNION ALL SELECT c.conv_id, n, k, b FROM c JOIN o ON o.conv_id = c.conv_id AND n > h),
p AS (SELECT conv_id, row_number() OVER w AS d, string_agg(k, '') OVER w AS key, b FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY n) UNION ALL SELECT conv_id, 0, '', 0 FROM c),
e AS (SELECT key, sha256(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id)) AS ends FROM (SELECT conv_id, max_by(key, d) AS key FROM p GROUP BY conv_id) GROUP BY key),
g AS (SELECT key, d, min(conv_id) AS conv_id, count(*) AS n, (count(*) - 1) * any_value(b) AS saved FROM p GROUP BY key, d),
i AS (SELECT g.*, left(key, 32 * (d - 1)::INT) AS up, count(*) OVER (PARTITION BY CASE WHEN d > 0 THEN left(key, 32 * (d - 1)::INT) END) AS siblings FROM g),
f AS (SELECT up AS key, any_value(siblings) AS children FROM i WHERE d > 0 GROUP BY up),
s AS (SELECT p.key, sum(saved) AS saved, count(*) FILTER (f.key IS NULL) AS leaves FROM i LEFT JOIN f USING (key) JOIN p ON p.conv_id = i.conv_id AND p.d <= i.d GROUP BY p.key)
SELECT i.conv_id, i.d AS depth, a.conv_id AS parent_conv_id, i.n AS n_convs, coalesce(f.children, 0)::BIGINT AS n_children, s.leaves AS n_leaves, s.saved::BIGINT AS saved_tokens, coalesce(e.ends, sha256('')) AS ends_sha256
FROM i JOIN s USING (key) LEFT JOIN f USING (key) LEFT JOIN e USING (key) LEFT JOIN i a ON i.d > 0 AND a.key = i.up""",
    "op13_spelling_variants": f"""
WITH RECURSIVE t AS (SELECT coalesce(doc_id::VARCHAR, '') || ':' AS doc, unnest(regexp_extract_all({_LOWER}, '[a-z\u00C0-\u00FF]{{{spelling.LEAST_LENGTH},}}')) AS run FROM documents),
k AS (SELECT run, count(*) AS n, hex(encode(doc || run)) AS x FROM t GROUP BY doc, run),
h AS (SELECT run, n, {_crc32("list_transform(range(1, length(x), 2), lambda i: ('0x' || x[i : i + 1])::BIGINT)")} AS h FROM k),
w AS (SELECT CASE WHEN h % {spelling.DROP} = 0 THEN run[: h % length(run)] || run[h % length(run) + 2 :] ELSE run END AS word, sum(n)::BIGINT AS n FROM h GROUP BY 1 HAVING length(word) >= {spelling.LEAST_LENGTH} AND sum(n) >= {spelling.LEAST_COUNT}),
d AS (SELECT word, pos, word[: pos - 1] || word[pos + 1 :] AS rest FROM (SELECT word, unnest(range(1, length(word) + 1)) AS pos FROM w)),
p AS (SELECT d.word AS a, w.word AS b FROM d JOIN w ON w.word = d.rest UNION SELECT w.word, d.word FROM d JOIN w ON w.word = d.rest UNION SELECT x.word, y.word FROM d x JOIN d y ON x.rest = y.rest AND x.pos = y.pos AND x.word <> y.word),
b AS (SELECT a AS word, count(*) AS n_near, first(b ORDER BY n DESC, b) AS near, max(n) AS near_n FROM p JOIN w ON w.word = b GROUP BY a),
f AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= {spelling.TIMES} * w.n THEN near END AS form, CASE WHEN near_n >= {spelling.TIMES} * w.n THEN near_n END AS form_n FROM w LEFT JOIN b USING (word)),
r(word, root, form) AS (SELECT word, word, form FROM f UNION ALL SELECT r.word, f.word, f.form FROM r JOIN f ON f.word = r.form)
SELECT f.word, f.form, r.root, f.n, f.n_near, f.form_n FROM f JOIN r ON r.word = f.word AND r.form IS NULL""",
}
