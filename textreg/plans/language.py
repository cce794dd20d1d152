"""Corpus statistics per group of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def top_weighted_terms(docs: DataFrame, group: str, tokens: str = "tokens", top: int = 20, digits: int = 6) -> DataFrame:
    """The ``top`` terms of each group by TF-IDF weight summed over its documents.

    The sum of ``tf * idf`` over a group is its term count times idf, so documents are reduced to one
    count per (group, term) before the shuffle, and idf is applied to those counts.
    """
    both = docs.select(group, F.posexplode(F.array(F.col(tokens), F.array_distinct(tokens))).alias("is_doc", "terms"))
    marks = both.select(group, "is_doc", F.explode_outer("terms").alias("term")).filter(F.col("term").isNotNull())
    per_group = marks.groupBy(group, "term").agg(
        F.count_if(F.col("is_doc") == 0).alias("n"), F.sum("is_doc").alias("df")
    )
    # At most one row per group for a term.
    df = F.sum("df").over(Window.partitionBy("term"))
    idf = F.log(F.lit(1.0 + docs.count()) / (1 + df)) + 1.0
    weighted = per_group.select(group, "term", F.round(F.col("n") * idf, digits).alias("weight"))
    order = Window.partitionBy(group).orderBy(F.desc("weight"), "term")
    return weighted.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
