"""The queries of this subpackage, and SQL for those that SQL can express.

Each takes (spark, sf_dir), works on the whole table with production parameters, and gives the digest
columns of its operator's results.
"""

from __future__ import annotations

import os

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import warc
from .align import align_documents
from .bpe import encode_documents
from .chat import format_preferences, swapped_pairs, turns_of
from .common import new_path, read_table
from .decontaminate import contamination
from .divergence import divergence
from .embeddings import near_vectors
from .langid import cross_identify
from .lm import cross_entropy_difference
from .mixing import longer, mix
from .quality import LANGUAGES, quality_rules
from .simhash import near_duplicates
from .suffix_dedup import remove_repeats


def tokenizer(name: str) -> str:
    """The file of a public tokeniser; ``TOKENIZERS_DIR`` names another folder of them."""
    folder = os.environ.get("TOKENIZERS_DIR")
    return f"{folder}/{name}" if folder else str(public_tokenizers.path(name))


BYTE_BPE = tokenizer("byte_bpe_50k.json")
PIECES = tokenizer("piece_bpe_32k.model")


def op1_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all vectors."""
    return near_vectors(read_table(spark, sf_dir, "embeddings"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash classes of all documents."""
    return near_duplicates(read_table(spark, sf_dir, "documents")).drop("group")


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encodes and decodes every document with the byte-level vocabulary."""
    return encode_documents(read_table(spark, sf_dir, "documents"), BYTE_BPE, keep=["doc_id"], keep_ids=False)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of all documents, learned from two thirds of them."""
    return cross_identify(read_table(spark, sf_dir, "documents"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words a mix of all documents takes of each; within a source longer documents are preferred."""
    mixed = mix(read_table(spark, sf_dir, "documents"), prefer=longer(F.col("text")))
    return mixed.select("doc_id", F.col("__size").alias("size"), F.col("__source_size").alias("source_size"), F.col("__target").alias("target"), F.col("__taken").alias("taken"))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of each document without repeated strings of 200 bytes."""
    return remove_repeats(read_table(spark, sf_dir, "documents"))


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cross-entropy difference of all documents; the target are those labelled good and not toxic."""
    target = read_table(spark, sf_dir, "labels").where("quality = 1 and toxic = 0").select("doc_id")
    return cross_entropy_difference(read_table(spark, sf_dir, "documents"), target)


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompt and completions of all conversations, each paired with a swapped last answer."""
    pairs = swapped_pairs(turns_of(read_table(spark, sf_dir, "conversations")))
    done = format_preferences(pairs, ["conv_id", "rejected_from"])
    trained = [F.aggregate(f"{c}_trained", F.lit(0), lambda n, s: n + s["stop"] - s["start"]).cast("long").alias(f"{c}_trained_chars") for c in ("chosen", "rejected")]
    return done.select("conv_id", "rejected_from", F.col("n_prompt_turns").cast("long").alias("n_prompt_turns"), *[F.sha2(c, 256).alias(f"{c}_sha256") for c in ("prompt", "chosen_completion", "rejected_completion")], *trained)


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Structural counts and fertility verdict of every document."""
    out = quality_rules(read_table(spark, sf_dir, "documents"), PIECES, keep=["doc_id"], lang="lang", bands=LANGUAGES)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("chars_per_token", 6).alias("chars_per_token"), F.round("byte_share", 6).alias("byte_share"), F.round("token_entropy", 6).alias("token_entropy"), "band")


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archives of all pages, written into the shared folder and read back; a quarantined gap in them fails."""
    path = new_path(spark, "archives")
    warc.write(read_table(spark, sf_dir, "pages"), path)
    found = warc.read(spark, path, payloads=False)
    lost = F.raise_error(F.concat_ws(" ", "file", "offset", "gap")).cast("long")
    return found.select(F.when(F.col("gap").isNotNull(), lost).otherwise(warc.page_of(F.col("record_id"))).alias("page_id"), "payload_bytes", "payload_digest", "record_type", warc.page_of(F.col("refers_to")).alias("refers_to"))


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances of the sources of each language, and the terms each source uses more than its language."""
    return divergence(read_table(spark, sf_dir, "documents"))


def op12_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that lie in windows of ten words of the benchmark, and whose windows they are."""
    found = contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    items = F.array_sort(F.transform("items", lambda x: x.cast("string")))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join(items, ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op13_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the tokens of two vocabularies cover each other in every document, and how usual its links are."""
    return align_documents(read_table(spark, sf_dir, "documents"), BYTE_BPE, PIECES, keep=["doc_id"])


QUERIES = {
    "op1_embeddings": op1_embeddings,
    "op2_simhash": op2_simhash,
    "op3_bpe": op3_bpe,
    "op4_language_id": op4_language_id,
    "op5_mixing": op5_mixing,
    "op6_suffix_dedup": op6_suffix_dedup,
    "op7_lm_scoring": op7_lm_scoring,
    "op8_chat_format": op8_chat_format,
    "op9_quality_rules": op9_quality_rules,
    "op10_warc": op10_warc,
    "op11_divergence": op11_divergence,
    "op12_decontaminate": op12_decontaminate,
    "op13_align": op13_align,
}

#: Brute force over all pairs of vectors with the same label.
OP1_SQL = """
WITH RECURSIVE good AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0
    AND len([x for x in embedding if x <> 0]) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b
  ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE list_cosine_similarity(a.v, b.v) >= 0.93
), reach(a, b) AS (
  SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a
), least AS (SELECT a, min(b) AS b FROM reach GROUP BY a),
counts AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, least(vec_id, coalesce(l.b, vec_id)) AS component_id,
  vec_id = least(vec_id, coalesce(l.b, vec_id)) AS kept
FROM embeddings e LEFT JOIN counts c ON c.a = e.vec_id LEFT JOIN least l ON l.a = e.vec_id
"""

#: The last answers are swapped along blocks of 64 conversations in order; the common prefix is all turns before.
OP8_SQL = r"""
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role,
    regexp_replace(coalesce(text, ''), '<\|(im_start|im_end)\|>', '<\1>', 'g') AS text, coalesce(text, '') AS raw,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS k
  FROM conversations
), c AS (
  SELECT conv_id, count(*) AS n, max(CASE WHEN role = 'assistant' THEN k END) AS a FROM t GROUP BY conv_id
), own AS (
  SELECT c.conv_id, n, a, t.text, t.raw FROM c LEFT JOIN t ON t.conv_id = c.conv_id AND t.k = c.a
), placed AS (
  SELECT *, CASE WHEN a IS NOT NULL THEN least((row_number() OVER (PARTITION BY a IS NOT NULL ORDER BY conv_id) - 1) // 64, greatest(count(*) OVER (PARTITION BY a IS NOT NULL) // 64 - 1, 0)) END AS block FROM own
), nxt AS (
  SELECT *, CASE WHEN a IS NOT NULL THEN coalesce(lead(conv_id) OVER w, first(conv_id) OVER b) END AS other
  FROM placed WINDOW w AS (PARTITION BY block ORDER BY conv_id),
    b AS (PARTITION BY block ORDER BY conv_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)
), p AS (
  SELECT x.conv_id, x.other, x.n, x.a, y.text AS other_text,
    CASE WHEN x.a IS NULL THEN x.n WHEN x.raw = y.raw THEN x.a ELSE x.a - 1 END AS np
  FROM nxt x LEFT JOIN own y ON y.conv_id = x.other
), r AS (
  SELECT t.conv_id, k, role, text, '<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10) AS turn FROM t
), s AS (
  SELECT p.conv_id,
    coalesce(string_agg(turn, '' ORDER BY k) FILTER (k <= np), '') AS prompt,
    coalesce(string_agg(turn, '' ORDER BY k) FILTER (k > np), '') AS chosen,
    coalesce(sum(length(text) + 10) FILTER (k > np AND role = 'assistant'), 0) AS chosen_chars
  FROM p JOIN r ON r.conv_id = p.conv_id GROUP BY p.conv_id
)
SELECT p.conv_id, p.other AS rejected_from, CAST(np AS BIGINT) AS n_prompt_turns, sha256(prompt) AS prompt_sha256,
  sha256(chosen) AS chosen_completion_sha256,
  sha256(CASE WHEN np = a - 1 THEN '<|im_start|>assistant' || chr(10) || other_text || '<|im_end|>' || chr(10) ELSE '' END) AS rejected_completion_sha256,
  CAST(chosen_chars AS BIGINT) AS chosen_trained_chars,
  CAST(CASE WHEN np = a - 1 THEN length(other_text) + 10 ELSE 0 END AS BIGINT) AS rejected_trained_chars
FROM p JOIN s USING (conv_id)
"""

#: Every group against every kept term of its language, in 128-bit integers.
OP11_SQL = r"""
WITH d AS (
  SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS words
  FROM documents
), g AS (SELECT DISTINCT lang, source FROM d),
kept AS (SELECT lang, term FROM (SELECT lang, unnest(list_distinct(words)) AS term FROM d) GROUP BY ALL HAVING count(*) >= 30),
counted AS (SELECT lang, source, term, count(*) AS n FROM (SELECT lang, source, unnest(words) AS term FROM d) SEMI JOIN kept USING (lang, term) GROUP BY ALL),
v AS (SELECT lang, count(term) AS v FROM (SELECT DISTINCT lang FROM g) LEFT JOIN kept USING (lang) GROUP BY lang),
whole AS (
  SELECT lang, source, term, n, 1 + (1000000000::HUGEINT * (n + 5)) // (sum(n) OVER (PARTITION BY lang, source) + 5 * v) AS p,
    1 + (1000000000::HUGEINT * (sum(n) OVER (PARTITION BY lang, term) + 5)) // (sum(n) OVER (PARTITION BY lang) + 5 * v) AS q
  FROM (SELECT lang, source, term, coalesce(n, 0)::HUGEINT AS n FROM g JOIN kept USING (lang) LEFT JOIN counted USING (lang, source, term)) JOIN v USING (lang)
), distance AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM whole a JOIN whole b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pair AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN distance d ON d.lang = a.lang AND d.source = a.source AND d.item = b.source),
term AS (SELECT lang, source, 'term' AS part, term AS item, p - q AS value FROM whole WHERE n > 0 AND p > q)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
FROM (FROM pair UNION ALL FROM term) QUALIFY part = 'pair' OR row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) <= 50
"""

#: Every window of every item against every window of every document.
OP12_SQL = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS k,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark
), w AS (
  SELECT item_id, array_to_string(words[i + 1 : i + least(10, len(words))], ' ') AS gram, least(10, len(words)) AS size
  FROM (SELECT *, unnest(range(greatest(1, len(words) - 9))) AS i FROM b WHERE len(words) > 0)
), sizes AS (SELECT DISTINCT size FROM w),
p AS (SELECT k, i, size, array_to_string(words[i + 1 : i + size], ' ') AS gram FROM (SELECT k, words, size, unnest(range(len(words) - size + 1)) AS i FROM d, sizes WHERE len(words) >= size)),
m AS (SELECT DISTINCT k, i, w.size, item_id FROM p JOIN w USING (gram, size)),
hit AS (SELECT k, count(*) AS n_hit FROM (SELECT DISTINCT k, i + unnest(range(size)) AS at FROM m) GROUP BY k),
items AS (SELECT k, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS items FROM (SELECT DISTINCT k, item_id FROM m) GROUP BY k)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN hit USING (k) LEFT JOIN items USING (k)
"""

ORACLE_SQL: dict[str, str] = {"op1_embeddings": OP1_SQL, "op8_chat_format": OP8_SQL, "op11_divergence": OP11_SQL, "op12_decontaminate": OP12_SQL}
