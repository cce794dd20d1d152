"""From raw documents to encoded training text: quality rules, line dedup, near-dedup, decontamination, encoding.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textreg.llm.batches import stage
from textreg.llm.decontaminate import find_contamination
from textreg.llm.lines import dedup_lines
from textreg.llm.near_dup import near_duplicates
from textreg.llm.quality import WORD, quality_rules
from textreg.llm.sentence_pieces import encode

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the base rules or a certified cutoff reject. Null texts go; ids may be null or repeat."""
    judged = quality_rules(docs, _table(spark, sf_dir, "labels"))
    bad = judged.filter("NOT kept").select(F.col("doc_id").alias("bad_id"), "text_hash").distinct()
    same = F.col("doc_id").eqNullSafe(F.col("bad_id")) & (F.xxhash64(F.coalesce("text", F.lit(""))) == F.col("text_hash"))
    return docs.join(bad, same, "left_anti").select(COLUMNS)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Delete later copies of lines. Documents that had a word and have none left go; ``n_chars`` is counted anew."""
    clean = dedup_lines(docs, carry=["lang", "source"])
    left = clean.filter((F.col("n_removed") == 0) | F.col("kept_text").rlike(WORD))
    return left.select(
        "doc_id", F.col("kept_text").alias("text"), "carried.lang", "carried.source",
        F.char_length("kept_text").cast("bigint").alias("n_chars"),
    )


def _text_hash() -> Column:
    return F.xxhash64(F.coalesce("text", F.lit("")))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the least id of each group of near duplicates. Rows without an id stay.

    Texts that share an id are documents of their own; the hash of the text orders them. Rows equal in both stay together.
    """
    repeated = stage(
        docs.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min(_text_hash()).alias("low"), F.max(_text_hash()).alias("high"))
        .filter("low != high").select(F.col("doc_id").alias("repeated_id")),
        "repeated",
    )
    if repeated.isEmpty():
        gone = near_duplicates(docs).filter("NOT kept").select("doc_id").distinct()
        return docs.join(gone, "doc_id", "left_anti").select(COLUMNS)
    vertex = F.when(F.col("repeated_id").isNull(), F.col("doc_id")).otherwise(F.xxhash64("doc_id", _text_hash()))
    rows = stage(docs.join(repeated, F.col("doc_id") == F.col("repeated_id"), "left").select(*COLUMNS, vertex.alias("vertex")), "vertices")
    judged = near_duplicates(rows, id_col="vertex").filter("vertex IS NOT NULL").select("vertex", "component_id").distinct()
    named = stage(judged.join(rows.select("vertex", "doc_id").distinct(), "vertex"), "judged")
    first = named.groupBy("component_id").agg(F.min(F.struct("doc_id", "vertex")).alias("first"))
    gone = named.join(first, "component_id").filter("vertex != first.vertex").select("vertex")
    return rows.join(gone, "vertex", "left_anti").select(COLUMNS)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop contaminated documents, each by its own text: ids may be null or repeat."""
    found = find_contamination(docs, _table(spark, sf_dir, "benchmark"))
    bad = found.filter("contaminated").select(F.col("doc_id").alias("bad_id"), "text_hash").distinct()
    same = F.col("doc_id").eqNullSafe(F.col("bad_id")) & (_text_hash() == F.col("text_hash"))
    return docs.join(bad, same, "left_anti").select(COLUMNS)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every document."""
    return encode(docs).select("doc_id", "text", "n_words", "pieces")


STAGES = [
    ("quality_rules", quality_stage),
    ("line_dedup", line_stage),
    ("minhash_near_dedup", near_duplicate_stage),
    ("benchmark_decontamination", decontamination_stage),
    ("sentencepiece", encoding_stage),
]

#: The encoder's lattice and the connected components of near duplicates have no SQL form here; tests hold run() to brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage keeps is written to the shared folder and read by the next one."""
    docs = _table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
