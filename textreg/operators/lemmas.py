"""Base forms of nouns as a relation: endings are detached by rules, and a lexicon decides which results are words."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textreg.plans.skew import lookup_join
from textreg.plans.stage import write_stage

# Endings of plural nouns and what stands in their place, in the order they are tried.
DETACHMENTS = [("s", ""), ("ses", "s"), ("ves", "f"), ("xes", "x"), ("zes", "z"), ("ches", "ch"), ("shes", "sh"), ("men", "man"), ("ies", "y")]


def base_forms(words: DataFrame, lexicon: DataFrame, exceptions: DataFrame | None = None) -> DataFrame:
    """``word, base`` of every distinct word that has a base form other than itself.

    ``lexicon(word)`` holds the words that are base forms, ``exceptions(word, base)`` irregular ones, which come before any rule. Candidates are
    the word itself and the results of all rules whose ending it has; those in the lexicon remain, and the shortest wins, of equal
    ones the earlier rule. A word without any is its own base form and has no row.
    """
    distinct = write_stage(words.select("word").distinct().filter("word IS NOT NULL AND word != ''"), "lemma-words")
    fits = [
        F.when(
            F.col("word").endswith(old),
            F.struct(F.lit(k + 1).alias("rule"), F.concat(F.expr(f"left(word, char_length(word) - {len(old)})"), F.lit(new)).alias("base")),
        )
        for k, (old, new) in enumerate(DETACHMENTS)
    ]
    own = F.struct(F.lit(0).alias("rule"), F.col("word").alias("base"))
    candidates = distinct.select("word", F.explode_outer(F.array_compact(F.array(own, *fits))).alias("c")).select("word", "c.rule", "c.base")
    known = lookup_join(candidates, lexicon.select(F.col("word").alias("base")).distinct(), "base", "left_semi", spread_by="word")
    regular = known.groupBy("word").agg(F.min(F.struct(F.char_length("base").alias("n"), "rule", "base")).alias("best"))
    chosen = regular.select("word", "best.base")
    if exceptions is not None:
        irregular = exceptions.groupBy("word").agg(F.min_by("base", F.struct(F.char_length("base"), F.col("base"))).alias("irregular"))
        # An exception needs no place in the lexicon.
        chosen = distinct.join(chosen, "word", "left").join(irregular, "word", "left").select("word", F.coalesce("irregular", "base").alias("base"))
    return chosen.filter("base IS NOT NULL AND base != word")
