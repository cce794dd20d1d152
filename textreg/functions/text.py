"""Text, date and JSON scalars."""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def bound(c: str | Column, build: Callable[[Column], Column]) -> Column:
    """``build(c)`` with ``c`` computed once per row, however often ``build`` uses it (also inside lambdas)."""
    return F.transform(F.array(_col(c)), build)[0]


# Letters that decomposition leaves whole but a plain-Latin spelling replaces.
LATIN_SPELLINGS = {
    "ß": "ss",
    "æ": "ae",
    "œ": "oe",
    "ø": "o",
    "đ": "d",
    "ł": "l",
    "þ": "th",
    "ð": "d",
}


@functools.cache
def _accent_table() -> tuple[str, str]:
    """(letters, replacements) for ``translate``: each BMP letter whose decomposition is one letter and marks.

    Bare combining marks come last without a replacement, which is how ``translate`` deletes them.
    """
    letters, plain, marks = [], [], []
    for code in range(0x80, 0x10000):
        ch = chr(code)
        if unicodedata.category(ch) == "Mn":
            marks.append(ch)
            continue
        rest = [c for c in unicodedata.normalize("NFD", ch) if unicodedata.category(c) != "Mn"]
        if len(rest) == 1 and rest[0] != ch and ord(rest[0]) < 0x10000:
            letters.append(ch)
            plain.append(rest[0])
    return "".join(letters + marks), "".join(plain)


def strip_accents(c: str | Column) -> Column:
    """Drop the marks of decomposed letters (``ação`` -> ``acao``) and bare combining marks."""
    letters, plain = _accent_table()
    return F.translate(_col(c), letters, plain)


# Punctuation that plain text writes with ASCII marks.
PLAIN_MARKS = {"-": "‐‑‒–—―−", "'": "‘’‚‛′", '"': "“”„‟«»″", "...": "…"}


@functools.cache
def _compatible_table() -> tuple[str, str]:
    """(signs, replacements) for ``translate``: BMP signs that stand for one plain letter or digit, such as raised ones."""
    pairs = []
    for code in range(0x80, 0x10000):
        plain = unicodedata.normalize("NFKC", chr(code))
        if len(plain) == 1 and plain.isascii() and plain.isalnum():
            pairs.append((chr(code), plain.lower()))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


# Letters of other scripts and signs, each before its spelling. Capitals, letters with marks and katakana follow by rule.
CYRILLIC = "а a б b в v г g д d е e ж zh з z и i к k л l м m н n о o п p р r с s т t у u ф f х kh ц ts ч ch ш sh щ shch ы y э e ю iu я ia є ie і i ґ g"
GREEK = "α a β b γ g δ d ε e ζ z η e θ th ι i κ k λ l μ m ν n ξ x ο o π p ρ r σ s ς s τ t υ u φ ph χ kh ψ ps ω o"
HEBREW = "ב b ג g ד d ה h ו v ז z ח kh ט t י y כ k ך k ל l מ m ם m נ n ן n ס s פ p ף p צ ts ץ ts ק q ר r ש sh ת t"
ARABIC = "ا a ب b ت t ث th ج j ح h خ kh د d ذ dh ر r ز z س s ش sh ص s ض d ط t ظ z غ gh ف f ق q ك k ل l م m ن n ه h و w ي y"
KANA = (
    "あ a い i う u え e お o か ka き ki く ku け ke こ ko さ sa し shi す su せ se そ so た ta ち chi つ tsu て te と to な na に ni ぬ nu ね ne の no "
    "は ha ひ hi ふ fu へ he ほ ho ま ma み mi む mu め me も mo や ya ゆ yu よ yo ら ra り ri る ru れ re ろ ro わ wa を wo ん n が ga ぎ gi ぐ gu げ ge ご go "
    "ざ za じ ji ず zu ぜ ze ぞ zo だ da ぢ ji づ zu で de ど do ば ba び bi ぶ bu べ be ぼ bo ぱ pa ぴ pi ぷ pu ぺ pe ぽ po"
)
SIGNS = "€ EUR £ GBP ¥ JPY © (c) ® (r) ™ tm ° deg ½ 1/2 ¼ 1/4 ¾ 3/4 × x ÷ / № No. § SS µ u • * ¿ ? ¡ !"


@functools.cache
def spellings() -> dict[str, str]:
    """Every code point that ``transliterate`` replaces, with what it writes instead."""

    def pairs(text: str) -> dict[str, str]:
        parts = text.split(" ")
        return dict(zip(parts[::2], parts[1::2], strict=True))

    letters = pairs(f"{CYRILLIC} {GREEK} {HEBREW} {ARABIC}")
    kana = pairs(KANA)
    found = letters | kana | {chr(ord(k) + 0x60): v for k, v in kana.items()} | pairs(SIGNS)
    for code in range(0x370, 0x2000):
        ch = chr(code)
        base = [c for c in unicodedata.normalize("NFD", ch) if unicodedata.category(c) != "Mn"]
        if ch not in found and len(base) == 1 and base[0].lower() in letters and (len(ch.lower()) == 1):
            spelled = letters[base[0].lower()]
            found[ch] = spelled.capitalize() if base[0] != base[0].lower() else spelled
    return found


def transliterate(c: str | Column) -> Column:
    """Letters of other scripts and signs in Latin letters: ``Привет`` -> ``Privet``, ``€`` -> ``EUR``, ``カナ`` -> ``kana``.

    Only the runs of such letters are rewritten, and within them letters with one Latin letter in one pass; the text between stays as it is.
    """
    table = spellings()
    single = {k: v for k, v in table.items() if len(v) == 1}
    longer = sorted((k for k, v in table.items() if len(v) > 1), key=lambda k: -len(table[k]))
    # ``translate`` drops letters beyond the replacements, which come in the order of falling lengths.
    parts = [[table[k][i] for k in longer if len(table[k]) > i] for i in range(len(table[longer[0]]))]

    def spelled(letter: Column) -> Column:
        every = F.concat(*[F.translate(letter, "".join(longer), "".join(p)) for p in parts])
        return F.when(F.contains(F.lit("".join(longer)), letter), every).otherwise(letter)

    def rewritten(run: Column) -> Column:
        latin = F.translate(run, "".join(single), "".join(single.values()))
        return F.array_join(F.transform(F.regexp_extract_all(latin, F.lit(rf"(?:[\x00-\x7F]++|[^{apart}])++|[{apart}]"), F.lit(0)), spelled), "")

    # ASCII first: a run of it is read without a look at the ranges.
    apart, foreign = _ranges(longer), _ranges(table)
    runs = F.regexp_extract_all(_col(c), F.lit(rf"(?:[\x00-\x7F]++|[^{foreign}])++|[{foreign}]++"), F.lit(0))
    return F.array_join(F.transform(runs, lambda run: F.when(run.rlike(f"^[{foreign}]"), rewritten(run)).otherwise(run)), "")


def _ranges(letters: Iterable[str], gap: int = 4) -> str:
    """Few ranges of code points, for a pattern, that hold all of ``letters``, and others only within ``gap`` of two of them."""
    codes = sorted(map(ord, letters))
    starts = [0, *[i for i in range(1, len(codes)) if codes[i] - codes[i - 1] > gap], len(codes)]
    return "".join(f"\\x{{{codes[a]:x}}}-\\x{{{codes[b - 1]:x}}}" for a, b in zip(starts, starts[1:], strict=False))


def to_plain_latin(c: str | Column) -> Column:
    """``transliterate`` and ``strip_accents`` plus spelled-out letters such as ``ß``, raised digits and letters, dashes and quotes (lower-case input)."""
    signs, plain = _compatible_table()

    def rest(c: Column) -> Column:
        out = F.translate(c, signs, plain)
        for mark, others in PLAIN_MARKS.items():
            out = F.regexp_replace(out, f"[{others}]", mark)
        for letter, spelling in LATIN_SPELLINGS.items():
            out = F.replace(out, F.lit(letter), F.lit(spelling))
        return out

    # Every step changes letters beyond ASCII only.
    unless_ascii = lambda c, step: bound(c, lambda t: F.when(t.rlike(r"[^\x00-\x7F]"), step(t)).otherwise(t))
    return unless_ascii(unless_ascii(c, lambda t: strip_accents(transliterate(t))), rest)


# The characters that count as white space at the ends of a text.
WHITE_SPACE = "".join(
    chr(c) for c in (*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
)


def strip(c: str | Column) -> Column:
    """Remove white space of any kind at both ends (plain ``trim`` removes blanks only)."""
    return F.btrim(_col(c), F.lit(WHITE_SPACE))


def strip_lower(c: str | Column) -> Column:
    return F.lower(strip(c))


def normalize_feature_name(c: str | Column) -> Column:
    """Lower, drop innermost parenthesized notes, strip, plain Latin, blanks to ``_``."""
    noteless = F.regexp_replace(F.lower(_col(c)), r"(?U)\s*\([^()]*\)", "")
    return F.regexp_replace(to_plain_latin(strip(noteless)), r"(?U)\s+", "_")


def flag_name(name: str | Column, word: str | Column, prefix: str = "fg_has_") -> Column:
    return F.concat(F.lit(prefix), normalize_feature_name(name), F.lit("_"), normalize_feature_name(word))


# Separators that end a title key, in the order they are tried.
TITLE_SEPARATORS = [" - ", " / ", " \\ ", " | "]


def title_key(c: str | Column) -> Column:
    """Join key of a title: text before the first separator kind present, unaccented, ``_`` for blanks, lower."""
    title = _col(c)
    head = title
    for sep in reversed(TITLE_SEPARATORS):
        head = F.when(F.contains(title, F.lit(sep)), F.substring_index(title, sep, 1)).otherwise(head)
    return F.when(F.length(title) > 0, F.lower(F.replace(strip_accents(head), F.lit(" "), F.lit("_"))))


def replace_first(c: str | Column, pattern: str, replacement: str, literal: bool = False) -> Column:
    """Replace only the first match; Spark's ``regexp_replace`` and ``replace`` replace every match."""
    text = _col(c)
    around = F.split(text, f"\\Q{pattern}\\E" if literal else pattern, 2)
    return F.when(F.size(around) == 2, F.concat(around[0], F.lit(replacement), around[1])).otherwise(text)


def to_titlecase(c: str | Column) -> Column:
    """Upper-case the first character of every letter-or-digit run, lower-case the rest."""
    runs = F.regexp_extract_all(F.lower(_col(c)), F.lit(r"[\p{L}\p{N}]+|[^\p{L}\p{N}]+"), F.lit(0))
    return F.array_join(F.transform(runs, F.initcap), "")


def method_slug(c: str | Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(_col(c)), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def category_from_filename(c: str | Column) -> Column:
    """Last ``_`` part of a file name, without ``.csv``."""
    return F.replace(F.substring_index(_col(c), "_", -1), F.lit(".csv"), F.lit(""))


def extract_digits_number(c: str | Column) -> Column:
    """Remove the first run of non-digits and double quotes, then read a whole number (null if not one)."""
    return F.replace(replace_first(c, r"[^\d]+", ""), F.lit('"'), F.lit("")).try_cast("bigint")


def strip_tag_prefix(c: str | Column) -> Column:
    """Drop one leading ``[PDF]``-like tag."""
    return F.regexp_replace(_col(c), r"^\[.*?\]\s*", "")


def last_year_in_text(c: str | Column) -> Column:
    years = F.regexp_extract_all(_col(c), F.lit(r"\b(19\d{2}|20\d{2})\b"), F.lit(0))
    return F.coalesce(F.try_element_at(years, F.lit(-1)), F.lit(""))


def first_integer(c: str | Column) -> Column:
    """First digit run as a number, 0 when there is none."""
    return F.coalesce(F.regexp_extract(_col(c), r"(\d+)", 1).try_cast("bigint"), F.lit(0).cast("bigint"))


def view_count(c: str | Column) -> Column:
    """First word with thousands dots removed (``1.234 views`` -> 1234), 0 when it is not a number."""
    word = F.regexp_extract(_col(c), r"^\s*(\S+)", 1)
    return F.coalesce(F.replace(word, F.lit("."), F.lit("")).try_cast("bigint"), F.lit(0).cast("bigint"))


def local_date(c: str | Column, zone: str = "America/Sao_Paulo") -> Column:
    """Calendar date in ``zone`` of an ISO ``...Z`` text; independent of the session time zone."""
    utc = F.to_timestamp_ntz(_col(c), F.lit("yyyy-MM-dd'T'HH:mm:ss'Z'"))
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), utc).cast("date")


def dayfirst_date(c: str | Column) -> Column:
    return F.try_to_timestamp(_col(c), F.lit("dd/MM/yyyy")).cast("date")


def encoder_payload(c: str | Column, max_chars: int = 10_000) -> Column:
    """White-space runs to one blank; of a longer text the last ``max_chars // 2`` characters; never empty."""
    text = F.regexp_replace(_col(c), r"(?U)\s+", " ")
    text = F.when(F.length(text) > max_chars, F.right(text, F.lit(max_chars // 2))).otherwise(text)
    return F.when(text == "", F.lit(" ")).otherwise(text)


def concat_text(*columns: str) -> Column:
    """Columns as text, null as empty, joined by a blank and stripped."""
    return strip(F.concat_ws(" ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]))


def verdicts(c: str | Column, expected: int) -> Column:
    """``struct<verdicts: map<string,boolean>, error: string>`` of ``{"results": {criterion: true|false}}``.

    Exactly one of the two is null: a text that is not JSON, lacks ``results`` or has other than
    ``expected`` boolean criteria keeps its row with the reason instead of failing the job.
    """

    def judge(parsed: Column) -> Column:
        # In brackets, so that text after the object is no longer one value.
        found = F.try_variant_get(parsed, "$[0].results", "variant")
        results = F.try_variant_get(parsed, "$[0].results", "map<string,variant>")
        item = lambda i: F.try_variant_get(parsed, f"$[{i}]", "variant")
        only = item(0).isNotNull() & item(1).isNull()

        def verdict(flags: Column) -> Column:
            error = (
                F.when(~only, F.lit("not valid JSON"))
                .when(found.isNull(), F.lit("missing results"))
                .when(flags.isNull() | (F.size(flags) != expected), F.lit("wrong number of criteria"))
                .when(~F.forall(F.map_values(flags), lambda v: F.schema_of_variant(v) == "BOOLEAN"), F.lit("not boolean"))
            )
            return bound(error, lambda e: F.struct(
                F.when(e.isNull(), F.transform_values(flags, lambda _, v: F.try_variant_get(v, "$", "boolean"))).alias("verdicts"),
                e.alias("error"),
            ))

        return bound(results, verdict)

    return bound(F.try_parse_json(F.concat(F.lit("["), _col(c), F.lit("]"))), judge)
