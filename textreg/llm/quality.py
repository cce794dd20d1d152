"""Quality rules whose cutoffs are certified on labelled documents. DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textreg.functions.text import bound
from textreg.llm.batches import stage

BLANKS = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
WORD = r"[^\x20\x09-\x0D]"
REPEAT_WINDOW = 5

#: Rule: (bad part, whole, cutoffs per thousand from strict to lax). A text fails when 1000 * part > cutoff * whole.
RULES = {
    "symbols": ("n_symbols", "word_chars", (50, 100, 150, 200, 300, 400)),
    "dup_lines": ("n_dup_lines", "n_lines", (100, 200, 300, 500, 700)),
    "repeats": ("n_repeat_words", "n_words", (50, 100, 150)),
    "word_length": ("word_chars", "n_words", (10_000, 12_000, 15_000, 20_000)),
}
#: Share of good documents that all rules together may reject per stratum, and the chance that this fails anywhere.
FALSE_REJECTION = 0.02
CONFIDENCE_GAP = 0.05

_TAIL_TERMS = 4096
_FEW_STRATA = 10_000


def words(text: Column) -> Column:
    return F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")


def repeated_words(ws: Column, size: int = REPEAT_WINDOW) -> Column:
    """Words inside windows of ``size`` words that occur twice or more in the list, the first one included.

    Windows are compared by a 64-bit hash. Only texts with a repeated window sort their windows.
    """

    def hashes(w: Column) -> Column:
        starts = F.sequence(F.lit(0), F.size(w) - size)
        return F.transform(starts, lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(size)]))

    def covered(h: Column) -> Column:
        placed = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def starts(s: Column) -> Column:
            nothing = F.lit(None).cast("array<int>")
            twins = F.zip_with(
                s, F.slice(s, 2, F.size(s)), lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])).otherwise(nothing)
            )
            return F.array_sort(F.array_distinct(F.flatten(F.filter(twins, lambda t: t.isNotNull()))))

        def length(p: Column) -> Column:
            # The last start has no successor; least() then leaves the whole window.
            gaps = F.zip_with(p, F.slice(p, 2, F.size(p)), lambda a, b: F.least(F.lit(size), b - a))
            return F.aggregate(gaps, F.lit(0), lambda acc, g: acc + g)

        return bound(bound(placed, starts), length)

    counted = bound(hashes(ws), lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(covered(h)))
    return F.when(F.size(ws) < size, 0).otherwise(counted)


def measures(docs: DataFrame, id_col: str, text_col: str, stratum: str) -> DataFrame:
    """``id``, ``stratum`` and the counts of each text; a null text counts as empty, a null stratum is one of its own."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    base = docs.select(F.col(id_col).alias("id"), F.col(stratum).cast("string").alias("stratum"), text.alias("text"))
    removed = lambda chars: F.char_length("text") - F.char_length(F.translate("text", chars, ""))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(WORD))
    found = bound(words(F.col("text")), lambda w: F.struct(F.size(w).alias("n"), repeated_words(w).alias("r")))
    seen = bound(lines, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("d")))
    return base.select(
        "id", "stratum", F.xxhash64("text").alias("text_hash"), found.alias("w"), seen.alias("l"),
        F.char_length(F.translate("text", BLANKS, "")).alias("word_chars"), removed(SYMBOLS).alias("n_symbols"),
    ).select(
        "id", "stratum", "text_hash", *[
            c.cast("bigint").alias(n) for n, c in {
                "n_words": F.col("w.n"), "word_chars": F.col("word_chars"), "n_symbols": F.col("n_symbols"),
                "n_dup_lines": F.col("l.d"), "n_repeat_words": F.col("w.r"), "n_lines": F.col("l.n"),
            }.items()
        ],
    ).withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))


def _log_factorial(n: Column) -> Column:
    """ln(n!) by Stirling's series at n + 9."""
    z = n.cast("double") + 9
    series = (z - 0.5) * F.ln(z) - z + F.lit(0.5 * math.log(2 * math.pi)) + 1 / (12 * z) - 1 / (360 * z * z * z)
    for k in range(1, 9):
        series = series - F.ln(n.cast("double") + k)
    return series


def binomial_tail(n: Column, k: Column, p: float) -> Column:
    """P(X <= k) for X ~ Bin(n, p) with k < n * p, summed from the largest term down.

    Past ``_TAIL_TERMS`` terms the rest is bounded by its geometric series, so the value is never too low.
    """
    top = F.exp(
        _log_factorial(n) - _log_factorial(k) - _log_factorial(n - k) + k * math.log(p) + (n - k) * math.log1p(-p)
    )
    ratio = lambda j: j * F.lit((1 - p) / p) / (n - j + 1)
    steps = F.when(k > 0, F.sequence(k, F.greatest(F.lit(1).cast("bigint"), k - _TAIL_TERMS), F.lit(-1).cast("bigint")))
    start = F.struct(F.lit(1.0).alias("sum"), F.lit(1.0).alias("term"))
    done = F.aggregate(
        F.coalesce(steps, F.array().cast("array<bigint>")), start,
        lambda a, j: F.struct((a["sum"] + a["term"] * ratio(j)).alias("sum"), (a["term"] * ratio(j)).alias("term")),
    )
    rest = k - _TAIL_TERMS - 1
    left = F.when(rest > 0, done["term"] * ratio(rest) / (1 - ratio(rest))).otherwise(0.0)
    return top * (done["sum"] + left)


def cutoffs(measured: DataFrame, good: DataFrame, false_rejection: float, gap: float) -> DataFrame:
    """The strictest certified cutoff of each rule per stratum (null: none), from the documents labelled good.

    Every stratum, rule and cutoff is one exact binomial test of "this cutoff rejects more than its share of good
    documents"; the chance of any wrong certificate is at most ``gap`` (Bonferroni over all tests). The share is
    ``false_rejection`` split over the rules, so all rules together stay within it.
    """
    held = measured.filter("NOT base_failed").join(good, "id", "left_semi")
    rejected = [
        F.sum((1000 * F.col(part) > c * F.col(whole)).cast("bigint")).alias(f"{rule}_{c}")
        for rule, (part, whole, grid) in RULES.items() for c in grid
    ]
    counts = held.groupBy("stratum").agg(F.count("*").alias("n"), *rejected)
    tested = [(rule, c) for rule, (_, _, grid) in RULES.items() for c in grid]
    # One row per stratum; their number is a one-row aggregate.
    counts = stage(counts, "label-counts")
    strata = counts.crossJoin(F.broadcast(counts.agg(F.count("*").alias("strata"))))
    share = false_rejection / len(RULES)

    def certified(rule: str, c: int) -> Column:
        n, k = F.col("n"), F.col(f"{rule}_{c}")
        enough = binomial_tail(n, k, share) <= gap / (F.col("strata") * len(tested))
        return F.when((k < n * share) & enough, F.lit(c).cast("bigint"))

    return strata.select(
        "stratum", *[F.coalesce(*[certified(r, c) for c in grid]).alias(f"cut_{r}") for r, (_, _, grid) in RULES.items()]
    )


def quality_rules(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    stratum: str = "lang",
    label_col: str = "quality",
    false_rejection: float = FALSE_REJECTION,
    gap: float = CONFIDENCE_GAP,
) -> DataFrame:
    """Judge documents by fixed base rules and by cutoffs certified per ``stratum``.

    Returns one row per document: ``id_col``, ``stratum``, ``text_hash``, ``n_words``, ``word_chars``, ``n_symbols``,
    ``n_dup_lines``, ``n_repeat_words``, ``n_lines``, ``base_failed``, ``rejected_by`` (rules with a certified cutoff
    that the text fails) and ``kept``.

    With probability ``1 - gap`` no stratum loses more than ``false_rejection`` of its good documents to the
    certified rules, provided the labelled documents are drawn like the others. A stratum with too few labels gets no
    cutoff and only the base rules apply. The texts are read once; their counts are written and reused.

    Null texts count as empty (and fail the base rules). A null stratum is a stratum. A document is good if all its
    labels are 1; null labels and labels without a document are ignored. Rows without an id are judged like others.
    Repeated rows stay. Other columns are ignored. Without labels nothing is certified; no documents, no rows.
    """
    measured = stage(measures(docs, id_col, text_col, stratum), "measures")
    good = labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("y")).filter(
        "id IS NOT NULL AND y IS NOT NULL"
    ).groupBy("id").agg(F.min("y").alias("y")).filter("y = 1").select("id")
    found = stage(cutoffs(measured, good, false_rejection, gap), "cutoffs")
    found = found.withColumnRenamed("stratum", "of")
    side = F.broadcast(found) if found.limit(_FEW_STRATA + 1).count() <= _FEW_STRATA else found
    judged = measured.join(side, F.col("stratum").eqNullSafe(F.col("of")), "left").drop("of")
    failed = F.array_compact(F.array(*[
        F.when(1000 * F.col(part) > F.col(f"cut_{rule}") * F.col(whole), F.lit(rule))
        for rule, (part, whole, _) in RULES.items()
    ]))
    return (
        judged.withColumn("rejected_by", failed)
        .withColumn("kept", ~F.col("base_failed") & (F.size("rejected_by") == 0))
        .drop(*[f"cut_{r}" for r in RULES]).withColumnRenamed("id", id_col)
    )
