"""Typing, flagging, labelling and unifying rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textreg.plans.skew import EACH_ROW, lookup_join


def left_join_fill_zero(df: DataFrame, features: DataFrame, key: str) -> DataFrame:
    """Left join a wide feature table (unique ``key``) and fill only the joined columns with 0."""
    added = [c for c in features.columns if c != key]
    return lookup_join(df, features, key, "left", spread_by=EACH_ROW).fillna(0, subset=added)


def at_or_after_first(df: DataFrame, date: str | Column, reference: DataFrame, reference_date: str | Column) -> DataFrame:
    """Rows dated at or after the earliest ``reference_date``; the bound is one value, so it reaches the scan."""
    first = reference.agg(F.min(reference_date)).first()[0]
    date = F.col(date) if isinstance(date, str) else date
    return df.filter(date >= F.lit(first))


def all_criteria(include: Sequence[str | Column], exclude: Sequence[str | Column]) -> Column:
    """True when every inclusion flag is true and every exclusion flag is false."""
    flags = [F.coalesce(_c(c), F.lit(False)) for c in include] + [F.coalesce(~_c(c), F.lit(False)) for c in exclude]
    verdict = F.lit(True)
    for flag in flags:
        verdict = verdict & flag
    return verdict


def first_failing_step(
    include: Sequence[tuple[str | Column, str]], exclude: Sequence[tuple[str | Column, str]], passed: str = "Included"
) -> Column:
    """Label of the first inclusion flag that is false, else of the first exclusion flag that is true."""
    step = F.lit(passed)
    for flag, label in reversed(exclude):
        step = F.when(_c(flag), F.lit(label)).otherwise(step)
    for flag, label in reversed(include):
        step = F.when(~_c(flag), F.lit(label)).otherwise(step)
    return step


def class_of(value: str | Column, classes: Mapping[str, Sequence[str]]) -> Column:
    """First class, in the order given, that lists the value; null when none does."""
    first: dict[str, str] = {}
    for name, members in classes.items():
        for member in members:
            first.setdefault(member, name)
    pairs = [F.lit(x) for pair in first.items() for x in pair]
    return F.try_element_at(F.create_map(*pairs), _c(value))


def label_sets(df: DataFrame, train: DataFrame, test: DataFrame, key: str) -> DataFrame:
    """Add ``set``: ``train`` or ``test`` by membership of ``key`` (train first), else ``unknown``."""
    marked = df
    for name, side in (("train", train), ("test", test)):
        keys = side.select(key).distinct().withColumn(f"__{name}", F.lit(True))
        marked = lookup_join(marked, keys, key, "left", spread_by=EACH_ROW)
    label = F.when(F.col("__train"), "train").when(F.col("__test"), "test").otherwise("unknown")
    return marked.withColumn("set", label).drop("__train", "__test")


# The common article layout.
ARTICLE_LAYOUT = {
    "title": "string",
    "year": "int",
    "citations": "int",
    "link": "string",
    "pdf_link": "string",
    "category": "string",
    "source": "string",
}


def to_article_layout(df: DataFrame, mapping: Mapping[str, str | Column], source: str) -> DataFrame:
    """Map columns to the article layout; unmapped citations are -1 and any other unmapped column is null."""
    missing = {"citations": F.lit(-1), "source": F.lit(source)}
    columns = {**missing, **{name: _c(c) for name, c in mapping.items()}}
    return df.select(
        *[columns.get(name, F.lit(None)).cast(dtype).alias(name) for name, dtype in ARTICLE_LAYOUT.items()]
    )


def union_article_sources(*sources: DataFrame) -> DataFrame:
    out = sources[0]
    for other in sources[1:]:
        out = out.unionByName(other, allowMissingColumns=True)
    return out


def inner_join_on_keys(left: DataFrame, right: DataFrame, keys: Sequence[str], suffix: str) -> DataFrame:
    """Inner join on keys that are not null; other columns of ``right`` that collide get ``suffix``."""
    taken = set(left.columns) - set(keys)
    renamed = right.withColumnsRenamed({c: c + suffix for c in right.columns if c in taken}).dropna(subset=list(keys))
    return lookup_join(left.dropna(subset=list(keys)), renamed, list(keys), "inner", spread_by=EACH_ROW)


def _c(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c
