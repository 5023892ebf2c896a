"""One query per operator over the given tables, and SQL twins where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigraft.llm.bpe import BpeModel, decode_ids, encode_texts
from lexigraft.llm.common import read_table
from lexigraft.llm.conversation_repair import repair_conversations
from lexigraft.llm.decontamination import find_contained
from lexigraft.llm.hard_negatives import mine_hard_negatives
from lexigraft.llm.html_density import extract_main_text
from lexigraft.llm.license_scan import BLOCK_WORDS, PHRASES, TEMPLATES, THRESHOLD, scan_licenses, words_of
from lexigraft.llm.line_dedup import EDITS, without_repeated_lines
from lexigraft.llm.near_duplicates import near_duplicate_classes
from lexigraft.llm.quality_rules import judge_quality
from lexigraft.llm.sequence_packing import pack_documents
from lexigraft.llm.suffix_repeats import without_repeats
from lexigraft.llm.token_counts import count_tokens, read_pieces
from lexigraft.llm.warc import MIN_REVISIT, archive_pages, read_records


def op1_suffix_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of every document that stand in an earlier repeat, and a digest of the others."""
    cut = without_repeats(read_table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"])
    return cut.select(
        "doc_id",
        "n_bytes",
        removed.alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words and unigram tokens of every document."""
    scores = read_pieces(public_tokenizers.path("piece_bpe_32k.model"))
    return count_tokens(read_table(spark, sf_dir, "documents"), scores)


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items that documents contain."""
    return find_contained(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence phrases and templates of every document."""
    found = scan_licenses(read_table(spark, sf_dir, "documents"))
    base = F.array_sort(F.array_distinct("places.label"))
    return found.select(
        "doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min("places.word").alias("first_word"),
        F.array_max("places.word").alias("last_word"),
        F.array_join(base, ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("places.label", "blocks.label")), ",").alias("labels"),
        F.coalesce(F.array_max("blocks.containment"), F.lit(0.0)).alias("score"),
    )


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of every document."""
    return judge_quality(read_table(spark, sf_dir, "documents")).drop("char_distance", "word_distance")


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component of near duplicates of every document."""
    return near_duplicate_classes(read_table(spark, sf_dir, "documents"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of every document that repeat an earlier line, and a digest of what is left."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    kept = F.sha2(F.coalesce("kept_text", F.lit("")), 256).alias("kept_sha256")
    return without_repeated_lines(docs, edits=EDITS).select("doc_id", "n_lines", "n_removed", "n_near", kept)


def op8_html_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    texts = extract_main_text(read_table(spark, sf_dir, "pages"))
    return texts.withColumn("n_chars", F.length("text").cast("long"))


def op9_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encodes every text, decodes the ids, and returns digests of both."""
    model = BpeModel.load(public_tokenizers.path("word_bpe_49k.json"))
    decoded = decode_ids(encode_texts(read_table(spark, sf_dir, "documents"), model), model)
    return decoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op10_warc_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes all pages to archives and reads all records back through the index."""
    back = read_records(archive_pages(read_table(spark, sf_dir, "pages")), payloads=False)
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op11_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents and their places in the sequences they are packed in."""
    packed = pack_documents(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return packed.select(
        "doc_id",
        "piece",
        "start",
        F.col("length").cast("long").alias("length"),
        F.crc32("ids").alias("ids_crc32"),
        "sequence_id",
        "offset",
    )


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth vector, with some labels moved on by one."""
    rows = read_table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine_hard_negatives(rows.withColumn("label", moved), F.col("vec_id") % 100 == 0)


def damaged_conversations(rows: DataFrame) -> DataFrame:
    """Messages dropped, emptied, stripped of sentence ends, repeated or given to the user, by a hash of their place."""
    id_, turn, role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn", "role", "text"))
    harm = F.crc32(F.concat(id_, F.lit(":"), turn)) % 20
    changed = F.when(harm == 1, "").when(harm == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text)
    copies = F.explode(F.array_repeat(F.lit(0), F.when(harm == 3, 2).otherwise(1)))
    return rows.where(harm != 0).select(
        "conv_id", "turn", F.when(harm == 4, "user").otherwise(role).alias("role"), changed.alias("text"), copies.alias("copy")
    )


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults of damaged conversations and their cheapest repair."""
    rows = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    found = repair_conversations(damaged_conversations(rows)).withColumnRenamed("conv_id", "_conv")
    every = rows.select("conv_id").distinct()
    counts = [F.coalesce(c, F.lit(0)).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return every.join(found, F.col("conv_id").eqNullSafe(F.col("_conv")), "left").select(
        "conv_id",
        *counts,
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_suffix_repeats": op1_suffix_repeats,
    "op2_token_counts": op2_token_counts,
    "op3_decontamination": op3_decontamination,
    "op4_license_scan": op4_license_scan,
    "op5_quality_rules": op5_quality_rules,
    "op6_near_duplicates": op6_near_duplicates,
    "op7_line_dedup": op7_line_dedup,
    "op8_html_density": op8_html_density,
    "op9_bpe_round_trip": op9_bpe_round_trip,
    "op10_warc_archives": op10_warc_archives,
    "op11_best_fit_packing": op11_best_fit_packing,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_conversation_repair": op13_conversation_repair,
}


def _op4_sql() -> str:
    """Words and blocks as lists; every block against every template."""
    pattern, half = "'[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'", BLOCK_WORDS // 2
    at = []
    for phrase, label in sorted(PHRASES.items()):
        same = " AND ".join(f"w[i + {k}] = '{x}'" for k, x in enumerate(phrase.split()))
        at.append(f"[{{'label': '{label}', 'word': i - 1}} FOR i IN range(1, len(w) + 1) IF {same}]")
    values = []
    for t in TEMPLATES:
        tokens = sorted({w.decode() for w in words_of(t.notice)})
        marks = [f" {' '.join(w.decode() for w in words_of(m))} " for m in t.marks]
        values.append(f"('{t.label}', {tokens}, {marks})")
    return f"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
w AS (SELECT r, doc_id, regexp_extract_all(t, {pattern}) AS w FROM d),
p AS (SELECT r, doc_id, w, {" || ".join(at)} AS places FROM w),
tpl(label, tokens, marks) AS (VALUES {", ".join(values)}),
s AS (SELECT r, w, unnest(range(0, greatest(1, len(w) - {half}), {half})) AS i FROM w),
b AS (SELECT r, list_distinct(w[i + 1 : i + {BLOCK_WORDS}]) AS tokens,
             ' ' || array_to_string(w[i + 1 : i + {BLOCK_WORDS}], ' ') || ' ' AS block FROM s),
m AS (SELECT r, label, len(list_intersect(b.tokens, tpl.tokens)) / len(tpl.tokens) AS part FROM b, tpl
      WHERE len(list_intersect(b.tokens, tpl.tokens)) >= {THRESHOLD} * len(tpl.tokens)
        AND len([x FOR x IN marks IF contains(block, x)]) > 0),
g AS (SELECT r, list(DISTINCT label) AS labels, max(part) AS score FROM m GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(places) AS BIGINT) AS n_base,
       list_min([x.word FOR x IN places]) AS first_word, list_max([x.word FOR x IN places]) AS last_word,
       array_to_string(list_sort(list_distinct([x.label FOR x IN places])), ',') AS base_labels,
       array_to_string(list_sort(list_distinct([x.label FOR x IN places] || coalesce(labels, []))), ',') AS labels,
       coalesce(score, 0.0) AS score
FROM p LEFT JOIN g USING (r)"""


_OP10_SQL = f"""
WITH p AS (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes,
                  sha1(coalesce(html, '')) AS payload_digest FROM pages),
g AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS first FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= {MIN_REVISIT} AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= {MIN_REVISIT} AND page_id <> first THEN first END AS refers_to
FROM g"""

_OP3_SQL = """
WITH d AS (SELECT doc_id AS id, text FROM documents), i AS (SELECT item_id AS id, text FROM benchmark),
words AS (SELECT id, [x FOR x IN regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
          'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+') IF x <> ''] AS w, kind
          FROM (SELECT *, 'd' AS kind FROM d UNION ALL SELECT *, 'i' FROM i)),
sh AS (SELECT DISTINCT kind, id, unnest([array_to_string(w[j : j + 4], ' ') FOR j IN range(1, greatest(len(w) - 3, 2))]) AS s
       FROM words WHERE len(w) > 0),
n AS (SELECT id, count(*) AS n FROM sh WHERE kind = 'i' GROUP BY id),
m AS (SELECT d.id AS doc_id, i.id AS item_id, count(*) AS n_shared FROM sh d JOIN sh i ON d.s = i.s
      WHERE d.kind = 'd' AND i.kind = 'i' GROUP BY 1, 2)
SELECT doc_id, item_id, n_shared, n AS n_item_shingles, n_shared / n AS containment
FROM m JOIN n ON n.id = item_id WHERE n_shared >= 0.75 * n"""

_OP6_SQL = """
WITH RECURSIVE words AS (SELECT doc_id, [x FOR x IN regexp_split_to_array(translate(coalesce(text, ''),
          'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+') IF x <> ''] AS w FROM documents),
sh AS (SELECT DISTINCT doc_id AS d, unnest([array_to_string(w[j : j + 4], ' ') FOR j IN range(1, greatest(len(w) - 3, 2))]) AS s
       FROM words WHERE len(w) > 0),
n AS (SELECT d, count(*) AS n FROM sh GROUP BY d),
m AS (SELECT a.d AS u, b.d AS v, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.d <> b.d GROUP BY 1, 2),
l AS (SELECT u, v FROM m JOIN n a ON a.d = u JOIN n b ON b.d = v WHERE 100 * c >= 75 * (a.n + b.n - c)),
r AS (SELECT d AS u, d AS v FROM n UNION SELECT r.u, l.v FROM r JOIN l ON r.v = l.u),
k AS (SELECT u, min(v) AS component_id FROM r GROUP BY u)
SELECT doc_id, coalesce(n, 0) AS n_shingles, coalesce(component_id, doc_id) AS component_id,
       doc_id = coalesce(component_id, doc_id) AS kept
FROM documents LEFT JOIN n ON n.d = doc_id LEFT JOIN k ON k.u = doc_id"""

_OP12_SQL = """
WITH v AS (SELECT row_number() OVER () AS r, vec_id, CAST(CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS BIGINT) AS label,
                  [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS q
           FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
             AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT a.r AS ar, a.vec_id AS anchor_id, x.vec_id, a.label = x.label AS same,
             CAST(list_sum([p[1] * p[2] FOR p IN list_zip(a.q, x.q)]) AS BIGINT) AS score
      FROM v a JOIN v x ON a.vec_id % 100 = 0 AND a.r <> x.r),
p AS (SELECT ar, anchor_id, vec_id AS positive_id, score AS positive_score,
             row_number() OVER (PARTITION BY ar ORDER BY score DESC, vec_id) AS k FROM s WHERE same),
n AS (SELECT p.ar, p.anchor_id, positive_id, positive_score, k, s.vec_id AS negative_id, s.score AS negative_score,
             row_number() OVER (PARTITION BY p.ar, k ORDER BY s.score DESC, s.vec_id) AS rank
      FROM p JOIN s ON s.ar = p.ar AND NOT same AND 80 * positive_score <= 100 * s.score AND s.score <= positive_score
      WHERE k <= 5)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5"""

ORACLE: dict[str, str] = {"op12_hard_negatives": _OP12_SQL, "op6_near_duplicates": _OP6_SQL, "op3_decontamination": _OP3_SQL, "op10_warc_archives": _OP10_SQL, "op4_license_scan": _op4_sql()}
