"""The corpus pipeline: quality rules, line dedup, near-dedup, benchmark decontamination, byte-level BPE.

Each stage takes (spark, docs, sf_dir) and works on all documents that its predecessor kept.  All but the last return the columns
of ``documents``; a stage that changes texts sets ``n_chars`` to their new length.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradelens.llm import byte_bpe, decontaminate, line_dedup, quality_rules, setsketch
from gradelens.llm.queries import BPE_RANKS, PATTERN
from gradelens.llm.shared import stored, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: documents that the base rules or the classifier reject go."""
    labels = table(spark, sf_dir, "labels")
    return quality_rules.apply_rules(docs, quality_rules.fit(docs, labels)).where("kept").select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: lines of five documents or more stay in one; documents left without a line that says anything go."""
    out = line_dedup.dedup_lines(docs)
    left = (F.col("n_dropped") == 0) | F.col("kept_text").rlike(r"[^\x20\x09-\x0D]")
    return out.where(left).select("doc_id", F.col("kept_text").alias("text"), "lang", "source", F.length("kept_text").cast("long").alias("n_chars"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10 on its two-word shingles at 0.8: one document of each group stays."""
    return setsketch.drop_duplicates(docs, k=2, percent=80).select(*COLUMNS)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: documents with a benchmark window go."""
    return decontaminate.remove_documents(decontaminate.scan(docs, table(spark, sf_dir, "benchmark"))).select(*COLUMNS)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: ids of each text, and the digests of ids and decoded bytes."""
    return byte_bpe.round_trip(docs.select("doc_id", "text"), BPE_RANKS, PATTERN, keep_ids=True).select(
        "doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "token_ids")


STAGES = [("quality rules", quality), ("line dedup", lines), ("near-dedup", near_dedup), ("decontamination", decontaminated),
          ("byte-level BPE", encoded)]

#: Learned quality rules are not expressible in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
