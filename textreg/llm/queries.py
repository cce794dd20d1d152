"""One query per operator over its whole table, with production parameters, and SQL twins where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textreg.functions.text import bound
from textreg.llm import sql
from textreg.llm.chat import format_chats, read_back
from textreg.llm.decontaminate import find_contamination
from textreg.llm.hard_negatives import mine_hard_negatives
from textreg.llm.lines import dedup_lines
from textreg.llm.near_dup import near_duplicates
from textreg.llm.periodic import periodic_runs
from textreg.llm.pii import replace_personal_data
from textreg.llm.quality import quality_rules
from textreg.llm.sentence_pieces import decode, encode
from textreg.llm.spans import dedup_spans
from textreg.llm.token_counts import token_counts
from textreg.llm.toxicity import score_toxicity
from textreg.llm.warc import read_records, write_archives

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

#: Key of the registered query; a real job passes its own secret.
_DEMO_KEY = b"registered query"


def _query(name: str, twin: str | None = None):
    def register(build: Query) -> Query:
        QUERIES[name] = build
        if twin is not None:
            ORACLES[name] = twin
        return build

    return register


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


@_query("op1_minhash_near_dedup", sql.NEAR_DUPLICATES)
def op1_minhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(_table(spark, folder, "documents"), width=3, percent=85)


@_query("op2_benchmark_decontamination", sql.CONTAMINATION)
def op2_benchmark_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    found = find_contamination(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))
    names = F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ",")
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
        F.sha2(names, 256).alias("items_sha256"), "contaminated",
    )


@_query("op4_quality_rules", sql.QUALITY)
def op4_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    judged = quality_rules(_table(spark, folder, "documents"), _table(spark, folder, "labels"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


@_query("op6_line_dedup", sql.LINES)
def op6_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return dedup_lines(_table(spark, folder, "documents")).select("doc_id", "n_lines", "n_removed", "kept_text")


@_query("op7_substring_dedup")
def op7_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return dedup_spans(_table(spark, folder, "documents"))


@_query("op10_warc_index", sql.ARCHIVES)
def op10_warc_index(spark: SparkSession, folder: str) -> DataFrame:
    where, index = write_archives(_table(spark, folder, "pages"))
    return read_records(where, index).select(
        F.col("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


@_query("op3_chat_formatting")
def op3_chat_formatting(spark: SparkSession, folder: str) -> DataFrame:
    chats = _table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    marked = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", marked), (-7, 1, "assistant", marked)], chats.schema)
    back = read_back(format_chats(chats.unionByName(extra)))
    return back.select(
        "conv_id", "n_turns", F.sha2("turns", 256).alias("turns_sha256"),
        F.char_length("learned").cast("bigint").alias("loss_chars"), F.sha2("learned", 256).alias("loss_sha256"), "formatted_chars",
    )


@_query("op8_token_counts")
def op8_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts(_table(spark, folder, "documents"))


@_query("op5_sentencepiece")
def op5_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    coded = decode(encode(_table(spark, folder, "documents")))
    same = F.coalesce(F.col("decoded") == F.translate(F.coalesce("text", F.lit("")), "\u2581", " "), F.lit(False))
    return coded.select(
        "doc_id", "n_words", F.size("pieces").cast("bigint").alias("n_pieces"), "pieces", same.alias("round_trip")
    )


@_query("op9_pii_surrogates")
def op9_pii_surrogates(spark: SparkSession, folder: str) -> DataFrame:
    return replace_personal_data(_table(spark, folder, "documents"), _DEMO_KEY)


@_query("op11_toxicity")
def op11_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return score_toxicity(_table(spark, folder, "documents"), _table(spark, folder, "labels"))


@_query("op12_hard_negatives", sql.HARD_NEGATIVES)
def op12_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    shifted = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = _table(spark, folder, "embeddings").withColumn("label", shifted)
    return mine_hard_negatives(rows, F.col("vec_id") % 100 == 0)


def _with_planted_runs(docs: DataFrame) -> DataFrame:
    """The texts of the query: of every tenth id by hash, the words from a hashed place on repeat with a hashed period."""
    h = F.crc32(F.col("doc_id").cast("string"))
    g = F.floor(h / 10)

    def planted(words: Column) -> Column:
        n = F.size(words)
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        repeated = F.transform(words, lambda w, i: F.when(i < a, w).otherwise(F.get(words, (a + (i - a) % p).cast("int"))))
        return F.when(n > 0, F.array_join(repeated, " ")).otherwise("")

    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    return docs.select("doc_id", F.when((h % 10 == 0) & F.col("text").isNotNull(), bound(words, planted)).otherwise(F.col("text")).alias("text"))


@_query("op13_periodic_runs")
def op13_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    found = periodic_runs(_with_planted_runs(_table(spark, folder, "documents")))
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("n"), (-r["start"]).alias("s"), (-r["period"]).alias("p"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    written = F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise("")
    return found.withColumn("top", longest).select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), (-F.col("top.s")).alias("start"), F.col("top.n").alias("length"),
        (-F.col("top.p")).alias("period"), F.floor(1000 * F.col("top.n") / -F.col("top.p")).alias("exponent_milli"),
        F.sha2(written, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
