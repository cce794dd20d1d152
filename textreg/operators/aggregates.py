"""Counts, group summaries and scores. Every group is reduced on the map side before it is shuffled."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textreg.functions.numeric import percent
from textreg.functions.tokens import tokenize_words
from textreg.plans.quantiles import group_quantiles, quantiles_of_counts, stored_counts
from textreg.plans.skew import lookup_join


def value_counts(df: DataFrame, *keys: str, name: str = "count") -> DataFrame:
    """Rows per key combination, largest first."""
    return df.groupBy(*keys).agg(F.count("*").alias(name)).orderBy(F.desc(name), *keys)


def distinct_counts(df: DataFrame, id_col: str, *keys: str, name: str = "len") -> DataFrame:
    """Distinct ids (null counts as one) per key combination, largest first."""
    pairs = df.select(id_col, *keys).distinct()
    return pairs.groupBy(*keys).agg(F.count("*").alias(name)).orderBy(F.desc(name), *keys)


def mean_per(df: DataFrame, keys: Sequence[str], *values: str) -> DataFrame:
    """Mean per key combination; per (article, class) it undoes the copies an explode made."""
    return df.groupBy(*keys).agg(*[F.avg(v).alias(v) for v in values])


def median_order(df: DataFrame, key: str, value: str) -> DataFrame:
    """Exact median per group, largest first: the display order of box plots."""
    return group_quantiles(df, key, value, {"median": 0.5}).orderBy(F.desc("median"), key)


def boxplot_summary(df: DataFrame, key: str, value: str) -> DataFrame:
    """Quartiles, whiskers (extreme values within 1.5 IQR of the box) and outlier count per group; null is a group."""
    counted = stored_counts(df, key, value)
    quartiles = quantiles_of_counts(counted, key, value, {"q1": 0.25, "median": 0.5, "q3": 0.75})
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    inside = F.col(value).between(F.col("q1") - reach, F.col("q3") + reach)
    boxes = quartiles.withColumnRenamed(key, "__of")
    with_box = counted.join(boxes, F.col(key).eqNullSafe(F.col("__of")))
    return with_box.groupBy(key, "q1", "median", "q3").agg(
        F.min(F.when(inside, F.col(value))).alias("whisker_low"),
        F.max(F.when(inside, F.col(value))).alias("whisker_high"),
        F.sum(F.when(inside, 0).otherwise(F.col("n"))).alias("n_outliers"),
    )


def relative_efficiency(df: DataFrame, id_col: str, key: str, gain: str, log_size: str) -> DataFrame:
    """Mean over articles of gain per geometric-mean size, per class, in percent, largest first."""
    per_article = mean_per(df, [id_col, key], gain, log_size)
    ratio = F.col(gain) / F.exp(F.col(log_size))
    per_class = per_article.groupBy(key).agg(F.avg(ratio).alias("relative_efficiency"))
    return per_class.withColumn("relative_efficiency", percent("relative_efficiency")).orderBy(
        F.desc("relative_efficiency"), key
    )


def relative_efficiency_pairs(df: DataFrame, id_col: str, x: str, y: str, gain: str, log_size: str) -> DataFrame:
    """Same ratio per article and (x, y), rounded before the mean: the cells of the efficiency heat map."""
    per_article = mean_per(df, [id_col, x, y], gain, log_size)
    ratio = F.round(F.col(gain) / F.exp(F.col(log_size)) * 100, 2)
    return per_article.select(x, y, ratio.alias("relative_efficiency"))


def collect_categories(df: DataFrame, category: str) -> DataFrame:
    """One row per combination of all other columns with its categories as ``array<struct<category, n>>``.

    The list of a group is kept as counts, so a group of many copies costs one entry per category;
    :func:`category_list` expands it. Rows whose other columns are all equal group together, null
    with null.
    """
    others = [c for c in df.columns if c != category]
    counted = df.groupBy(*others, category).agg(F.count("*").alias("n"))
    entry = F.struct(F.col(category).alias("category"), "n")
    return counted.groupBy(*others).agg(F.array_sort(F.collect_list(entry)).alias("categories"))


def category_list(categories: str | Column) -> Column:
    c = F.col(categories) if isinstance(categories, str) else categories
    return F.flatten(F.transform(c, lambda e: F.array_repeat(e["category"], e["n"].cast("int"))))


def ordered_concat(
    df: DataFrame, keys: Sequence[str], order_by: str, text: str, sep: str = "\n\n", chunk: int = 4096
) -> DataFrame:
    """Texts of each group joined in the order of the integer ``order_by``.

    Joined by chunks of ``chunk`` order values first, so a long group is put together by many tasks
    and the last step only joins its few chunk texts.
    """
    quoted = sep.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n")
    pieces = df.groupBy(*keys, F.expr(f"`{order_by}` div {chunk}").alias("__chunk")).agg(
        F.expr(f"listagg(`{text}`, '{quoted}') WITHIN GROUP (ORDER BY `{order_by}`)").alias("__piece")
    )
    return pieces.groupBy(*keys).agg(
        F.expr(f"listagg(__piece, '{quoted}') WITHIN GROUP (ORDER BY __chunk)").alias(text)
    )


def or_joined(df: DataFrame, key: str, text: str, order_by: str, name: str = "query") -> DataFrame:
    """``(s1) OR (s2) ...`` of the strings per key in the order of ``order_by``, repeats included.

    The result is one string per key, so a key's strings have to fit into one row.
    """
    parts = df.select(key, F.concat(F.lit("("), F.col(text), F.lit(")")).alias("__s"), F.col(order_by).alias("__o"))
    return parts.groupBy(key).agg(F.expr("listagg(__s, ' OR ') WITHIN GROUP (ORDER BY __o)").alias(name))


def cv_summary(scores: DataFrame) -> DataFrame:
    """Mean and sample deviation of the scores per (dataset, strategy, model)."""
    return scores.groupBy("dataset_name", "embedding_strategy", "model_name").agg(
        F.avg("rmse").alias("rmse_mean"),
        F.stddev_samp("rmse").alias("rmse_std"),
        F.avg("r2").alias("r2_mean"),
        F.stddev_samp("r2").alias("r2_std"),
    )


def regression_scores(df: DataFrame, y: str, prediction: str, *keys: str) -> DataFrame:
    """``rmse`` and ``r2`` per key combination in one aggregation."""
    err = F.col(y) - F.col(prediction)
    return df.groupBy(*keys).agg(
        F.sqrt(F.avg(err * err)).alias("rmse"),
        (1 - F.sum(err * err) / F.regr_syy(F.col(y), F.col(y))).alias("r2"),
    )


def word_counts(df: DataFrame, text: str, stops: Sequence[str]) -> DataFrame:
    """``(word, count)``: tokens reduced to ``a-z``, without stop words.

    Tokens are counted as they are first; cleaning runs once per different token.
    """
    tokens = df.select(F.explode_outer(tokenize_words(text)).alias("token")).groupBy("token").count()
    cleaned = tokens.select(F.regexp_replace("token", "[^a-z]", "").alias("word"), "count")
    # Judged beside the sum, not filtered on the key: a filter would move down to every single token.
    unwanted = F.bool_or((F.col("word") == "") | F.col("word").isin(list(stops))).alias("unwanted")
    summed = cleaned.groupBy("word").agg(F.sum("count").alias("count"), unwanted)
    return summed.filter(~F.col("unwanted")).drop("unwanted")


def term_frequencies(
    counts: DataFrame, base_forms: DataFrame | None = None, top: int = 150, min_count: int = 2
) -> DataFrame:
    """Most frequent ``term`` of word counts, after each word took its base form in ``base_forms(word, base)``."""
    if base_forms is not None:
        counts = lookup_join(counts, base_forms.select("word", "base"), "word", "left").select(
            F.coalesce("base", "word").alias("word"), "count"
        )
    terms = counts.groupBy(F.col("word").alias("term")).agg(F.sum("count").alias("count"))
    return terms.filter(F.col("count") >= min_count).orderBy(F.desc("count"), "term").limit(top)


def funnel_counts(df: DataFrame, stages: Mapping[str, Column]) -> DataFrame:
    """Rows left after each stage, as ``(step, stage, n)``; step 0 is the input. One pass over the data."""
    kept = F.lit(True)
    counts = [F.count("*").alias("s0")]
    for i, condition in enumerate(stages.values(), 1):
        kept = kept & F.coalesce(condition, F.lit(False))
        counts.append(F.count_if(kept).alias(f"s{i}"))
    names = ["input", *stages]
    row = F.array(*[
        F.struct(F.lit(i).alias("step"), F.lit(n).alias("stage"), F.col(f"s{i}").alias("n"))
        for i, n in enumerate(names)
    ])
    return df.agg(*counts).select(F.inline(row))


def max_list_length(df: DataFrame, column: str) -> DataFrame:
    return df.agg(F.max(F.size(column)).alias("max_length"))
