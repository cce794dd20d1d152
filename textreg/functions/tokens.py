"""Tokenizing, all as array expressions inside one projection."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from textreg.functions.stopwords import stop_words
from textreg.functions.text import _col, bound

# A word is a run of letters, digits and "_"; every other character that is no white space of any kind is its own token.
TOKEN_PATTERN = r"(?U)[\p{L}\p{N}_]++|\S"
# A sentence ends at ".", "!" or "?" before white space.
SENTENCE_END = r"(?U)(?<=[.!?])\s+"


def tokenize_words(c: str | Column) -> Column:
    """Lower-cased words and punctuation marks, in order."""
    return F.regexp_extract_all(F.lower(_col(c)), F.lit(TOKEN_PATTERN), F.lit(0))


# Endings that are words of their own, and words that hide two.
ENDINGS = r"(?:n't|'(?:s|m|d|ll|re|ve))(?![\p{L}\p{N}])"
HIDDEN = (("can", "not"), ("gon", "na"), ("wan", "na"), ("got", "ta"), ("gim", "me"), ("lem", "me"))
BREAK = "|".join(rf"(?<=(?<![\p{{L}}\p{{N}}]){a})(?={b}(?![\p{{L}}\p{{N}}]))" for a, b in HIDDEN)
# Marks that stand alone: ellipses, dashes, brackets and the like, commas and colons unless a digit follows, and the last dot of a text.
ALONE = r"""\.{3,}|--|[;@#$%&?!\[\](){}<>"]|[,:](?![0-9])|(?<!\.)\.(?=["'\])}>»”’\s]*$)"""
WORD_RULES = rf"{ALONE}|{ENDINGS}|\S(?:(?!{ALONE}|{ENDINGS}|{BREAK})\S)*"


def tokenize_by_rules(c: str | Column) -> Column:
    """Lower-cased words as a treebank has them: ``don't`` gives ``do``, ``n't``; ``3.14`` and ``U.S.`` stay whole, the last dot of a text does not.

    All rules are one pattern, read in one scan.
    """
    return F.regexp_extract_all(F.lower(_col(c)), F.lit(WORD_RULES), F.lit(0))


def tokenize_sentences(c: str | Column) -> Column:
    return F.filter(F.split(_col(c), SENTENCE_END), lambda s: s != "")


def remove_stopwords(tokens: str | Column, language: str = "english") -> Column:
    """Drop tokens whose lower form is a stop word."""
    stops = stop_words(language)
    return F.filter(_col(tokens), lambda t: ~F.lower(t).isin(stops))


def _words_without_stops(c: str | Column, stops: list[str]) -> Column:
    """Words come lower-cased, so they meet the stop words as they are."""
    return F.filter(tokenize_words(c), lambda t: ~t.isin(stops))


def tokenize_by_strategy(c: str | Column, strategy: str = "document", language: str = "english") -> Column:
    """Stop-word-free tokens; ``sentence`` tokenizes each sentence on its own and joins the lists."""
    kind, stops = strategy.strip().lower(), stop_words(language)
    if kind == "sentence":
        return F.flatten(F.transform(tokenize_sentences(c), lambda s: _words_without_stops(s, stops)))
    if kind in ("token", "document"):
        return _words_without_stops(c, stops)
    raise ValueError("strategy must be one of: 'sentence', 'token', 'document'")


def ngrams(tokens: str | Column, n: int = 2) -> Column:
    """Runs of ``n`` consecutive tokens joined by a blank; none for shorter lists."""
    if n < 2:
        raise ValueError("n must be >= 2")

    def grams(t: Column) -> Column:
        starts = F.when(F.size(t) >= n, F.sequence(F.lit(1), F.size(t) - n + 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.array_join(F.slice(t, i, n), " "))

    return bound(tokens, grams)


def truncate_tokens(tokens: str | Column, max_length: int = 512) -> Column:
    if max_length < 1:
        raise ValueError("max_length must be >= 1")
    return F.slice(_col(tokens), 1, max_length)
