"""The registered queries of the operators, over their whole tables, and DuckDB SQL where it can state them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradelens.llm import (alignment, byte_bpe, decontaminate, embed_quality, html_wrapper, langid, license_scan, line_dedup, quality_rules,
                           setsketch, token_counts, warc_merkle, whitening)
from gradelens.llm.shared import table

#: Vocabulary files of the token queries (a parameter of the operators).
COUNT_TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
BPE_RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN
ALIGN_A = public_tokenizers.path("byte_bpe_50k.json")
ALIGN_B = public_tokenizers.path("piece_bpe_32k.model")


def fold_of(n: int):
    """crc32 of the id as text, modulo ``n``."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % n


def op1_html_wrapper(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page by wrapper induction."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return html_wrapper.extract(pages).select("page_id", "url", "text", "n_chars")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document; learned from the folds other than 0."""
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs.where(fold_of(5) != 0))
    out = langid.predict(docs.select("doc_id", "text"), model)
    return out.select("doc_id", (fold_of(5) == 0).alias("held_out"), "lang_pred", "score", "accepted")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of five documents or more stay in the largest document id alone."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


OP3_SQL = r"""
WITH doc AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
line AS (
  SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS n FROM doc),
keyed AS (
  SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM line),
repeats AS (
  SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
marked AS (
  SELECT k.*, r.key IS NOT NULL AND k.doc_id < r.keeper AS gone FROM keyed k LEFT JOIN repeats r ON k.key = r.key)
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (gone) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


def replicas(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two replicas of WARC files of a thousand page ids each, written from all pages in id order.

    The second has altered payloads (page ids whose md5 starts with 00 or 01) and lost file ends (the last ten ids of files whose
    md5 starts with 0 to 3).
    """
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    named = pages.withColumn("file", F.concat(F.lit("pages-"), F.lpad(F.floor(F.col("page_id") / 1000).cast("string"), 8, "0"), F.lit(".warc")))
    hit = F.substring(F.md5(F.col("page_id").cast("string").cast("binary")), 1, 2).isin("00", "01")
    lost = F.substring(F.md5(F.col("file").cast("binary")), 1, 1).isin("0", "1", "2", "3") & (F.pmod("page_id", F.lit(1000)) >= 990)

    def records(payload, keep):
        raw = warc_merkle.record_bytes(F.col("url"), payload)
        rows = named.where(keep).select("file", "page_id", F.octet_length(raw).cast("long").alias("length"), F.sha2(raw, 256).alias("digest"))
        return warc_merkle.with_offsets(rows, "file", ["page_id"], "length")

    return records(F.col("html"), F.lit(True)), records(F.when(hit, F.translate("html", "<", "{")).otherwise(F.col("html")), ~lost)


def op4_warc_merkle_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records on which two WARC replicas of all pages differ, found by descending unequal tree branches."""
    mine, theirs = replicas(spark, sf_dir)
    return warc_merkle.audit(warc_merkle.stored(mine, "warc-replica"), warc_merkle.stored(theirs, "warc-replica"))


OP4_SQL = r"""
WITH named AS (
  SELECT page_id, coalesce(url, '') AS url, coalesce(html, '') AS html,
         'pages-' || lpad(CAST(page_id // 1000 AS VARCHAR), 8, '0') || '.warc' AS file FROM pages),
both_ AS (
  SELECT 1 AS side, file, page_id, url, html FROM named
  UNION ALL
  SELECT 2, file, page_id, url, CASE WHEN substr(md5(CAST(page_id AS VARCHAR)), 1, 2) IN ('00', '01') THEN translate(html, '<', '{') ELSE html END
  FROM named WHERE NOT (substr(md5(file), 1, 1) IN ('0', '1', '2', '3') AND page_id % 1000 >= 990)),
raw AS (
  SELECT side, file, page_id, 'WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10) || 'WARC-Target-URI: ' || url
         || chr(13) || chr(10) || 'Content-Type: text/html' || chr(13) || chr(10) || 'Content-Length: ' || strlen(html)
         || chr(13) || chr(10) || chr(13) || chr(10) || html || chr(13) || chr(10) || chr(13) || chr(10) AS rec FROM both_),
placed AS (
  SELECT side, file, strlen(rec) AS length, sha256(rec) AS digest,
         coalesce(CAST(sum(strlen(rec)) OVER (PARTITION BY side, file ORDER BY page_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0) AS "offset"
  FROM raw)
SELECT coalesce(a.file, b.file) AS file, coalesce(a."offset", b."offset") AS "offset", a.length, a.digest,
       b.length AS other_length, b.digest AS other_digest,
       CASE WHEN b.file IS NULL THEN 'missing' WHEN a.file IS NULL THEN 'extra' ELSE 'changed' END AS status
FROM (SELECT * FROM placed WHERE side = 1) a FULL JOIN (SELECT * FROM placed WHERE side = 2) b ON a.file = b.file AND a."offset" = b."offset"
WHERE a.digest IS DISTINCT FROM b.digest OR a.length IS DISTINCT FROM b.length
"""


def op5_embedding_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document; labels learned from the folds other than 2."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").where(fold_of(4) != 2)
    model = embed_quality.fit(docs, labels)
    return embed_quality.score(docs, model).select("doc_id", (fold_of(4) == 2).alias("held_out"), "score", "predicted")


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that lie inside benchmark windows, and the items hit."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = decontaminate.scan(docs, table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
                      F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


OP6_SQL = r"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
iw AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark),
sized AS (SELECT *, least(len(words), 10) AS k FROM iw WHERE len(words) > 0),
items AS (
  SELECT DISTINCT item, k, array_to_string(words[i:i + k - 1], ' ') AS win
  FROM (SELECT *, unnest(range(1, len(words) - k + 2)) AS i FROM sized)),
ks AS (SELECT DISTINCT k FROM sized),
wins AS (
  SELECT doc_id, k, i, array_to_string(words[i:i + k - 1], ' ') AS win
  FROM (SELECT doc_id, words, k, unnest(range(1, len(words) - k + 2)) AS i FROM dw, ks)),
hits AS (SELECT doc_id, k, i, item FROM wins JOIN items USING (k, win)),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM hits) GROUP BY doc_id),
found AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
SELECT dw.doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN covered ON dw.doc_id = covered.doc_id LEFT JOIN found ON dw.doc_id = found.doc_id
"""


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and verdict of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality_rules.fit(docs, table(spark, sf_dir, "labels"))
    return quality_rules.apply_rules(docs, model).select("doc_id", *quality_rules.COUNTS, "base_failed", "quality", "kept")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts.count_tokens(docs, COUNT_TOKENIZER).select("doc_id", "n_bytes", "n_tokens", "over_limit")


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document and the bytes they decode to, as digests."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return byte_bpe.round_trip(docs, BPE_RANKS, PATTERN).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op10_setsketch_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose sets of word pairs are similar at 0.8 or more."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return setsketch.near_duplicates(docs, k=2, percent=80).select("doc_id", "n_shingles", "component_id", "kept")


OP10_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS words FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) = 1 THEN [words[1]]
                      ELSE list_distinct(list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1])) END AS s FROM w),
el AS (SELECT doc_id, len(s) AS n, unnest(s) AS e FROM sets),
pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM el a JOIN el b ON a.e = b.e AND a.doc_id < b.doc_id
  AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
links AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs),
reach(a, b) AS (SELECT doc_id, doc_id FROM sets UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, min(r.b) AS component_id, s.doc_id = min(r.b) AS kept
FROM sets s JOIN reach r ON r.a = s.doc_id GROUP BY s.doc_id, len(s.s)
"""

def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every embedding on the whitened components of the distinct integer vectors."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    model = whitening.fit(rows)
    explained = F.array(*[F.lit(float(x)) for x in model.explained]).cast("array<double>")
    out = whitening.whiten(rows, model).select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return out.select("vec_id", (F.col("at") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), F.col("deviation").try_cast("long").alias("deviation"),
                      "whitened", F.get(explained, F.col("at")).alias("explained"), F.lit(model.identity_error).alias("identity_error"))


def op12_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and signatures of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    places = F.col("base_places")
    return license_scan.scan(docs).select(
        "doc_id", "n_words", F.size(places).cast("long").alias("n_base"), F.get(places, F.lit(0))["start"].cast("long").alias("first_word"),
        F.get(places, F.size(places) - 1)["start"].cast("long").alias("last_word"), F.array_join("base_labels", ",").alias("base_labels"),
        F.array_join("labels", ",").alias("labels"), "score")


def op13_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token groups and links of two tokenizers over every document, with the links' counts over all documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return alignment.scored_links(docs, ALIGN_A, ALIGN_B, pattern=PATTERN).select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (
    op1_html_wrapper, op2_language_id, op3_line_dedup, op4_warc_merkle_audit, op5_embedding_quality, op6_decontaminate,
    op7_quality_rules, op8_token_counts, op9_byte_bpe, op10_setsketch_dedup, op11_embedding_whitening, op12_license_scan,
    op13_tokenizer_alignment)}
ORACLES: dict[str, str] = {"op3_line_dedup": OP3_SQL, "op4_warc_merkle_audit": OP4_SQL, "op6_decontaminate": OP6_SQL,
                           "op10_setsketch_dedup": OP10_SQL}
