"""Sentence ends learned from a corpus: abbreviations, sentence starters and collocations by log-likelihood ratios, then spelling.

No labels are needed. A word that mostly stands with a dot, and is short, is an abbreviation; whether the dot behind one, behind an initial or behind a number
ends a sentence follows from how the next word is spelled elsewhere and from what it usually follows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textreg.plans.skew import lookup_join
from textreg.plans.stage import write_stage

# The least scores of an abbreviation, a sentence starter and a collocation, and the share of dots that an abbreviation is expected to have.
ABBREVIATION, STARTER, COLLOCATION, WITH_DOT = 0.3, 30.0, 7.88, 0.99
# A piece of text with the white space behind it, quotes and brackets around a word, and what counts as a number.
PIECE, AROUND = r"\S+\s*", r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}.]+$"
NUMBER, INITIAL, CLOSED = r"^[0-9][0-9.,]*$", r"^\p{L}$", "[\"')\\]»”’]*$"
# White space behind a piece, and a word of letters only, which needs no look for marks.
BLANKS, LETTERS = " \t\n\x0b\f\r", r"^(?:[a-zA-Z]++|\p{L})++$"


def _log(c: Column) -> Column:
    return F.log(F.greatest(c, F.lit(1e-300)))


def association(a: Column, b: Column, both: Column, n: Column) -> Column:
    """Log-likelihood ratio of two events, of ``a`` and ``b`` in ``n`` places, that fall together ``both`` times, against independence."""
    p, p1, p2 = b / n, both / a, (b - both) / F.greatest(n - a, F.lit(1))
    fit = lambda k, m, q: k * _log(q) + (m - k) * _log(1 - q)
    apart = fit(both, a, p) + fit(b - both, n - a, p)
    together = F.when(a == both, 0.0).otherwise(fit(both, a, p1)) + F.when(b == both, 0.0).otherwise(fit(b - both, n - a, p2))
    return -2 * (apart - together)


def abbreviation_score(word: Column, n: Column, dotted: Column, all_dotted: Column, total: Column) -> Column:
    """How much likelier the dots of a word are those of an abbreviation than sentence ends; long words and words without a dot count against it."""
    p = all_dotted / total
    chance = dotted * _log(p) + (n - dotted) * _log(1 - p)
    fixed = dotted * _log(F.lit(WITH_DOT)) + (n - dotted) * _log(F.lit(1 - WITH_DOT))
    letters = F.char_length(F.replace(word, F.lit("."), F.lit("")))
    dots = F.char_length(word) - letters + 1
    return -2 * (chance - fixed) * F.exp(-letters) * dots * F.pow(letters.cast("double"), -(n - dotted).cast("double"))


def sentence_tokens(docs: DataFrame, text: str = "text", row: str = "row_index") -> DataFrame:
    """One row per word of a text with its neighbours: ``row, pos, piece, word, dotted, ends, first, number, next_word, next_first, last``.

    ``word`` is lower-cased, without the marks around it and its final dot; numbers are ``#``. ``ends`` is the mark (``.``, ``!``, ``?`` or
    ``...``) that could end a sentence, ``first`` the case of the first letter (``U``, ``L`` or empty).
    """
    pieces = docs.select(row, F.posexplode_outer(F.regexp_extract_all(text, F.lit(PIECE), F.lit(0))).alias("pos", "piece")).filter("piece IS NOT NULL")
    token, letters = F.rtrim("piece", F.lit(BLANKS)), F.col("token").rlike(LETTERS)
    bare = F.when(F.col("letters"), F.col("token")).otherwise(F.regexp_replace("token", AROUND, ""))
    marks = F.when(F.col("letters"), "").otherwise(F.regexp_extract("token", r"([.!?]+)" + CLOSED, 1))
    lower = F.when(F.col("letters"), F.lower("token")).otherwise(F.lower(F.regexp_replace("bare", r"\.+$", "")))
    pieces = pieces.withColumn("token", token).withColumn("letters", letters).withColumns({"bare": bare, "marks": marks}).withColumn("lower", lower)
    marks = F.col("marks")
    spelled = pieces.select(
        row, "pos", "piece", F.when(~F.col("letters") & F.col("lower").rlike(NUMBER), "#").otherwise(F.col("lower")).alias("word"),
        (~F.col("letters") & F.col("bare").endswith(".")).alias("dotted"),
        F.when(marks == "", "").when(marks.rlike("[!?]"), F.substring(marks, -1, 1)).when(marks == ".", ".").when(marks.rlike(r"^\.\.+$"), "...")
        .otherwise("").alias("ends"),
        F.when(F.col("bare").rlike(r"^\p{Lu}"), "U").when(F.col("bare").rlike(r"^\p{Ll}"), "L").otherwise("").alias("first"),
    )
    order = Window.partitionBy(row).orderBy("pos")
    ahead = F.lead(F.struct("word", "first")).over(order)
    return spelled.withColumn("ahead", ahead).select(
        "*", F.col("ahead.word").alias("next_word"), F.col("ahead.first").alias("next_first"), F.col("ahead").isNull().alias("last")
    ).drop("ahead")


@dataclass(frozen=True)
class SentenceModel:
    """``words(word, n, dotted, score, lower, upper_inside, starts, starter_score)`` and ``pairs(word, next_word, n, score)`` with their verdicts."""

    words: DataFrame
    pairs: DataFrame


def telling(tokens: DataFrame) -> DataFrame:
    """What ``fit_sentences`` reads of the tokens: ``word, dotted, ends, first, next_word, next_first``.

    The next word is kept only behind a mark, or if it is capitalized: elsewhere it tells nothing, and most words are not stored twice.
    """
    tells = (F.col("ends") != "") | (F.col("next_first") == "U")
    return tokens.select("word", "dotted", "ends", "first", *[F.when(tells, F.col(c)).alias(c) for c in ("next_word", "next_first")])


def fit_sentences(tokens: DataFrame) -> SentenceModel:
    """Learn from ``sentence_tokens``: one count per word, then one per word after a likely end, then one per pair.

    Words are reduced before they are shuffled, and everything a later step needs is a table of distinct words. Only words with a dot meet the
    abbreviations; they alone are written out.
    """
    counts = tokens.filter("word != ''").groupBy("word").agg(
        F.count("*").alias("n"), F.count_if("dotted").alias("dotted"), F.count_if(F.col("first") == "L").alias("lower")
    )
    counts = write_stage(counts, "word-counts")
    whole = counts.agg(F.sum("n").alias("total"), F.sum("dotted").alias("all_dotted")).first()
    total, all_dotted = F.lit(float(whole["total"] or 1)), F.lit(float(whole["all_dotted"] or 0))
    score = F.when((F.col("dotted") > 0) & F.col("word").rlike(r"\p{L}"), abbreviation_score(F.col("word"), F.col("n"), F.col("dotted"), all_dotted, total))
    scored = write_stage(counts.withColumn("score", F.coalesce(score, F.lit(0.0))), "abbreviations")
    short = scored.filter(F.col("score") >= ABBREVIATION).select("word", F.lit(True).alias("abbreviation"))
    told = telling(tokens).filter("ends != '' OR next_first = 'U'").select("word", "ends", "next_word", "next_first")
    dots = lookup_join(told.filter("ends = '.'"), short, "word", "left", spread_by=["next_word", "next_first"])
    dots = write_stage(dots.withColumn("abbreviation", F.coalesce("abbreviation", F.lit(False))), "dots")
    known = dots.withColumn("likely_end", ~F.col("abbreviation")).unionByName(
        told.filter("ends != '.'").withColumns({"abbreviation": F.lit(False), "likely_end": F.col("ends").isin("!", "?")})
    )
    # Per word, whether it stands behind a likely end, and behind what; the last words of the texts, which have none behind them, count as ends.
    plain = ~F.col("word").rlike(INITIAL) & (F.col("word") != "#")
    places = write_stage(known.groupBy("next_word").agg(
        F.count_if(~F.col("likely_end") & (F.col("next_first") == "U")).alias("upper_inside"), F.count_if(F.col("likely_end") & plain).alias("starts"),
        F.count_if("likely_end").alias("ends"),
    ), "places")
    ends = float(places.agg(F.sum("ends")).first()[0] or 0)
    places = places.filter("next_word != ''").select(F.col("next_word").alias("word"), "upper_inside", "starts")
    joined = scored.join(places, "word", "left").fillna(0, subset=["upper_inside", "starts"])
    starter = F.when(
        (F.col("starts") > 0) & F.col("word").rlike(r"^\p{L}+$") & (total / F.lit(max(ends, 1.0)) > F.col("n") / F.col("starts")),
        association(F.lit(ends), F.col("n").cast("double"), F.col("starts").cast("double"), total),
    )
    words = write_stage(joined.withColumn("starter_score", F.coalesce(starter, F.lit(0.0))), "words")
    open_dots = dots.filter((F.col("next_word") != "") & (F.col("abbreviation") | ~plain))
    pairs = open_dots.groupBy("word", "next_word").agg(F.count("*").alias("n")).filter("n > 1")
    sized = pairs.join(scored.select("word", F.col("n").alias("a")), "word").join(scored.select(F.col("word").alias("next_word"), F.col("n").alias("b")), "next_word")
    bound = F.when(total / F.col("a") > F.col("b") / F.col("n"), association(*(F.col(c).cast("double") for c in ("a", "b", "n")), total))
    return SentenceModel(words, write_stage(sized.select("word", "next_word", "n", F.coalesce(bound, F.lit(0.0)).alias("score")), "pairs"))


def split_sentences(tokens: DataFrame, model: SentenceModel, row: str = "row_index") -> DataFrame:
    """``row, sentences``: the sentences of each text in order, as they stand, without the white space behind them.

    ``!`` and ``?`` before white space end a sentence. So does a dot, but for: a known collocation; an abbreviation or ellipsis, unless the next
    word is capitalized and either is only capitalized at sentence starts, or often starts sentences; an initial or number, if the next word is lower
    case, or (after an initial) capitalized and never seen in lower case.
    """
    facts = model.words.select(
        "word", (F.col("score") >= ABBREVIATION).alias("abbreviation"), (F.col("starter_score") >= STARTER).alias("starter"),
        (F.col("lower") > 0).alias("has_lower"), (F.col("upper_inside") > 0).alias("has_upper_inside"),
    )
    bound = model.pairs.filter(F.col("score") >= COLLOCATION).select("word", "next_word", F.lit(True).alias("bound"))
    # Only dots before another word have anything to decide.
    dots = tokens.filter("ends IN ('.', '...') AND NOT last").select(row, "pos", "word", "ends", "next_word", "next_first")
    here = lookup_join(dots, facts.select("word", "abbreviation"), "word", "left", spread_by=[row, "pos"])
    ahead = facts.select(F.col("word").alias("next_word"), "starter", "has_lower", "has_upper_inside")
    seen = lookup_join(lookup_join(here, ahead, "next_word", "left", spread_by=[row, "pos"]), bound, ["word", "next_word"], "left", spread_by=[row, "pos"])
    flag = lambda c: F.coalesce(c, F.lit(False))
    upper, lower = F.col("next_first") == "U", F.col("next_first") == "L"
    begins = upper & flag("has_lower") & ~flag("has_upper_inside")
    initial = F.col("word").rlike(INITIAL)
    ends = (
        F.when(flag("bound"), False)
        .when(flag("abbreviation") | (F.col("ends") == "..."), begins | (~initial & upper & flag("starter")))
        .when(initial | (F.col("word") == "#"), ~(lower | (initial & upper & ~flag("has_lower"))))
        .otherwise(True)
    )
    # Pieces of a text in order, and behind a piece that ends a sentence a mark as a row of its own; each end opens the next sentence.
    rows = tokens.select(row, "pos", F.lit(0).alias("behind"), "piece", F.col("ends").isin("!", "?").alias("end")).unionByName(
        seen.filter(ends).select(row, "pos", F.lit(1).alias("behind"), F.lit("").alias("piece"), F.lit(True).alias("end"))
    )
    listed = rows.groupBy(row).agg(F.array_sort(F.collect_list(F.struct("pos", "behind", "piece", "end"))).alias("p"))
    joined = F.array_join(F.transform("p", lambda x: F.concat(x["piece"], F.when(x["end"], "\0").otherwise(""))), "")
    parts = F.transform(F.split(joined, "\0"), lambda s: F.regexp_replace(s, r"\s+$", ""))
    return listed.select(row, F.filter(parts, lambda s: s != "").alias("sentences"))
