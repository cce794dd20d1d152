"""Tables behind the charts of the literature review: one function per chart kind."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textreg.functions.text import extract_digits_number, replace_first, strip, to_titlecase
from textreg.operators.aggregates import (
    boxplot_summary, distinct_counts, mean_per, median_order, relative_efficiency, relative_efficiency_pairs,
)
from textreg.operators.reshape import crosstab, crosstab_distinct, pair_counts, protect_then_split, split_explode
from textreg.operators.shaping import class_of

# Columns of the coded sheet.
CODE = "Código do artigo (ex: A01, A02)."
COLUMNS = {
    "domain": "Domínio",
    "target": "Target",
    "model_class": "Classe modelo",
    "embedding": "Embeddings",
    "strategy": "Estratégia",
    "metric": "Métricas",
    "limitation": "Limitações",
    "advantage": "Vantagens",
    "contribution": "Contribuições",
    "nationality": "Nacionalidade Autores",
    "language": "Idioma Dataset",
    "size": "Tamanho Dataset",
    "gain": "Ganho Relativo ao Baseline",
}
# Spellings in the coded sheet that are rewritten.
PROTECTED_CLASS = "(Sequential, Recurrent, & Attention)"
LANGUAGE_NOTE = r"\s*\(Inferred from dataset sources like Amazon/Yelp/Boston/UCI\)\.?"
LEMMA_NOTE, PLURAL, SINGULAR, NO_METRIC = "(Lemmatized Word)", "Documents", "Document", "RMSE"


def coded_articles(sheet: DataFrame) -> DataFrame:
    """Articles that were coded, under short column names and ``article``."""
    names = {column: name for name, column in COLUMNS.items() if column in sheet.columns}
    return sheet.filter(F.col(COLUMNS["domain"]).isNotNull()).withColumnsRenamed({**names, CODE: "article"})


def _strategies(df: DataFrame) -> DataFrame:
    noted = replace_first(replace_first("strategy", LEMMA_NOTE, "", literal=True), PLURAL, SINGULAR, literal=True)
    parts = split_explode(df.withColumn("strategy", noted), "strategy")
    return parts.withColumn("strategy", replace_first("strategy", " & ", ", ", literal=True))


def _languages(df: DataFrame) -> DataFrame:
    parts = split_explode(df, "language")
    cleaned = replace_first(replace_first("language", r"and\s+", ""), LANGUAGE_NOTE, "")
    return parts.withColumn("language", strip(cleaned))


_MAKERS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "model_class": lambda df: protect_then_split(df, "model_class", PROTECTED_CLASS),
    "strategy": _strategies,
    "language": _languages,
    "metric": lambda df: split_explode(df, "metric").fillna(NO_METRIC, subset=["metric"]),
    "advantage": lambda df: split_explode(df, "advantage").withColumn("advantage", to_titlecase("advantage")),
}


def explode_field(df: DataFrame, field: str, classes: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """One row per value of a multi-valued field; ``classes`` turns targets into their class."""
    out = _MAKERS.get(field, lambda d: split_explode(d, field))(df)
    return out.withColumn(field, class_of(field, classes)) if classes else out


def with_log_size(df: DataFrame) -> DataFrame:
    """One row per positive dataset size with ``log_size``; the other rows drop out."""
    parts = split_explode(df.withColumn("size", replace_first("size", ";", ",", literal=True)), "size", "size")
    sized = parts.withColumn("size", extract_digits_number("size")).filter("size > 0")
    return sized.withColumn("log_size", F.log("size"))


def publications_by(df: DataFrame, field: str, classes=None) -> DataFrame:
    """Distinct articles per value: the bar charts."""
    return distinct_counts(explode_field(df.select("article", field), field, classes), "article", field)


def publications_heatmap(df: DataFrame, x: str, y: str, classes: Mapping[str, Mapping[str, Sequence[str]]] | None = None) -> DataFrame:
    """Distinct articles per (x, y). Each field is exploded on its own copy of the two columns it needs."""
    classes = classes or {}
    rows = explode_field(explode_field(df.select("article", x, y), x, classes.get(x)), y, classes.get(y))
    return crosstab_distinct(rows, "article", x, y)


def nationality_language(df: DataFrame) -> DataFrame:
    """Rows (not distinct articles) per author nationality and dataset language."""
    rows = explode_field(explode_field(df.select("nationality", "language"), "nationality"), "language")
    return crosstab(pair_counts(rows, "nationality", "language"), "nationality", "language", "len")


def log_size_by(df: DataFrame, field: str, classes=None) -> tuple[DataFrame, DataFrame]:
    """(box plot numbers, display order) of the mean log size per article and value."""
    rows = with_log_size(explode_field(df.select("article", field, "size"), field, classes))
    means = mean_per(rows, ["article", field], "log_size")
    return boxplot_summary(means, field, "log_size"), median_order(means, field, "log_size")


def gain_by(df: DataFrame, field: str, classes=None) -> tuple[DataFrame, DataFrame]:
    """(box plot numbers, display order) of the mean relative gain per article and value, in percent."""
    means = mean_per(explode_field(df.select("article", field, "gain"), field, classes), ["article", field], "gain")
    percents = means.withColumn("gain", F.round(F.col("gain") * 100, 2))
    return boxplot_summary(percents, field, "gain"), median_order(percents, field, "gain")


def gain_heatmap(df: DataFrame, x: str, y: str) -> DataFrame:
    rows = explode_field(explode_field(df.select("article", x, y, "gain"), x), y)
    return crosstab(mean_per(rows, ["article", x, y], "gain"), x, y, "gain", "mean")


def efficiency_by(df: DataFrame, field: str) -> DataFrame:
    rows = with_log_size(explode_field(df.select("article", field, "gain", "size"), field))
    return relative_efficiency(rows, "article", field, "gain", "log_size")


def efficiency_heatmap(df: DataFrame, x: str, y: str) -> DataFrame:
    rows = with_log_size(explode_field(explode_field(df.select("article", x, y, "gain", "size"), x), y))
    cells = relative_efficiency_pairs(rows, "article", x, y, "gain", "log_size")
    return crosstab(cells, x, y, "relative_efficiency", "mean")
