"""Personal data replaced by keyed surrogates of the same kind: one surrogate per entity across the corpus, never two alike."""

from __future__ import annotations

import functools
import hashlib
import ipaddress
import re
import string
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textreg.llm.batches import stage

_PATTERNS = {
    "email": ("@", re.compile(r"(?<![\w.+-])[\w.+-]+@[\w-]+(?:\.[\w-]+)+")),
    "access_key": ("", re.compile(r"\bAKIA[0-9A-Z]{16}\b|\b(?:sk|pk|ghp|gho|xoxb|xoxp)[-_][A-Za-z0-9_-]{16,}")),
    "secret": ("", re.compile(r"(?i)\b(?:password|passwd|pwd|token|secret|api[_-]?key)\s*[=:]\s*[\"']?(?P<value>[^\s\"']{6,})")),
    "ip": (".", re.compile(r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?!\.?\d)")),
    "iban": ("", re.compile(r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b")),
    "ssn": ("-", re.compile(r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])")),
    "card": ("", re.compile(r"(?<!\d)\d(?:[ -]?\d){12,18}(?!\d)")),
    "phone": ("", re.compile(
        r"(?<![\w.])(?:"
        r"\+\d{9,15}"
        r"|\+\d{1,4}[ .-]?(?:\(\d{1,5}\)[ .-]?)?\d{1,8}(?:[ .-]\d{2,8}){1,4}"
        r"|(?:\+\d{1,4}[ .-]?)?\(\d{1,5}\)[ .-]?\d{2,12}(?:[ .-]\d{2,8}){0,4}"
        r"|\d{2,4}(?:[ .-]\d{2,8}){2,4}"
        # Two groups: blanks and hyphens only, and a long second group, so decimals and postal codes are none.
        r"|\d{2,5}[ -]\d{6,8}"
        r")(?![\w.-]*\d)"
    )),
    # Candidates; ``ipaddress`` decides.
    "ipv6": (":", re.compile(r"(?<![\w:.])[0-9A-Fa-f]{0,4}(?::[0-9A-Fa-f]{0,4}){2,7}(?::\d{1,3}(?:\.\d{1,3}){3}|(?:\.\d{1,3}){3})?(?![\w:])")),
}
_DIGIT = re.compile(r"\d")
# Titles that announce a name, with the gender they tell.
_TITLES = {
    "f": ("Mrs", "Ms", "Miss", "Frau", "Mme", "Madame", "Señora", "Sra", "Doña", "Госпожа", "Κυρία"),
    "m": ("Mr", "Sir", "Herr", "Monsieur", "Señor", "Sr", "Don", "Господин", "Κύριος"),
    "n": ("Dr", "Prof", "Professor"),
}
_GENDER = {t: g for g, titles in _TITLES.items() for t in titles}
_NAME_PART = r"[^\W\d_a-zà-öø-ÿа-яά-ώ](?:[^\W\d_]+(?:[-'’][^\W\d_]+)*|(?:[-'’][^\W\d_]+)+)"
_NAME = re.compile(rf"\b({'|'.join(sorted(_GENDER, key=len, reverse=True))})\b\.?[  ]+({_NAME_PART}(?:[  ]{_NAME_PART}){{0,2}})")
# Given names per script and gender. Family names are built from syllables.
_GIVEN = {
    "latin": {
        "f": "Anna Clara Elena Emma Julia Laura Maria Nora Sofia Vera".split(),
        "m": "Adrian Daniel David Felix Hugo Jonas Lucas Martin Oscar Viktor".split(),
        "n": "Alex Andrea Charlie Dominique Kim Mika Noel Robin Sascha Toni".split(),
    },
    "cyrillic": {
        "f": "Анна Вера Елена Ирина Мария Ольга Софья".split(), "m": "Антон Виктор Иван Максим Олег Павел Фёдор".split(),
        "n": "Женя Саша Валя Слава".split(),
    },
    "greek": {"f": "Άννα Ελένη Μαρία Σοφία".split(), "m": "Γιάννης Νίκος Πέτρος Σπύρος".split(), "n": "Άλεξ Σάσα".split()},
}
# Endings of built given names per script and gender.
_ENDINGS = {
    "latin": {"f": ("a", "ina", "ela"), "m": ("an", "us", "or"), "n": ("i", "y", "is")},
    "cyrillic": {"f": ("а", "ина", "ия"), "m": ("ан", "ор", "ил"), "n": ("и", "о")},
    "greek": {"f": ("α", "η"), "m": ("ος", "ας", "ης"), "n": ("ι", "υ")},
}
_SYLLABLES = {
    "latin": ("b c d f g h k l m n p r s t v w".split(), "a e i o u".split()),
    "cyrillic": ("б в г д ж з к л м н п р с т".split(), "а е и о у".split()),
    "greek": ("β γ δ κ λ μ ν π ρ σ τ".split(), "α ε ι ο".split()),
}

def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def _script(text: str) -> str:
    """The script of the first letter; scripts without a table of names are ``other``."""
    for c in text:
        if "Ѐ" <= c <= "ӿ":
            return "cyrillic"
        if "Ͱ" <= c <= "Ͽ" or "ἀ" <= c <= "῿":
            return "greek"
        if c.isalpha():
            return "latin" if c < "ɐ" or "Ḁ" <= c <= "ỿ" else "other"
    return "latin"


@functools.cache
def _alike(c: str) -> str:
    """Letters near ``c`` of its script (the first word of its Unicode name) and case."""
    size = 4096 if c >= "⺀" else 256
    first = ord(c) - ord(c) % size
    script = unicodedata.name(c, "").split(" ")[0]
    near = (x for x in map(chr, range(first, first + size)) if x.isalpha() and unicodedata.name(x, "").split(" ")[0] == script)
    return "".join(x for x in near if x.islower() == c.islower() and x.isupper() == c.isupper()) or c


def _ascii_digits(text: str) -> str:
    """Digits of any script as ASCII ones."""
    return text if text.isascii() else _DIGIT.sub(lambda m: str(int(m[0])), text)


def _ipv6(value: str) -> str | None:
    """An IPv6 address written out in full; None for what is none, such as ``::`` or ``a::b`` of a program."""
    try:
        digits = f"{int(ipaddress.IPv6Address(value)):032x}"
    except ValueError:
        return None
    return ":".join(re.findall("....", digits)) if _DIGIT.search(value) or value.count(":") == 7 else None


def detect(text: str) -> list[tuple[int, int, str, str]]:
    """``(start, end, kind, entity)`` of the personal data in a text, without overlaps: the first and longest wins.

    Each word of a name is an entity: ``family``, or ``given`` with its gender before a colon.
    """
    found: list[tuple] = []
    has_digit = _DIGIT.search(text) is not None
    for kind, (needs, pattern) in _PATTERNS.items():
        if needs not in text or not (has_digit or kind in ("email", "secret", "access_key", "ipv6")):
            continue
        for m in pattern.finditer(text):
            a, b = m.span("value") if kind == "secret" else m.span()
            value = text[a:b]
            if kind == "ip" and any(int(x) > 255 for x in value.split(".")):
                continue
            if kind == "email":
                entity = value.lower()
            elif kind == "ip":
                entity = _ascii_digits(value)
            elif kind == "ipv6":
                entity = _ipv6(value)
                if entity is None:
                    continue
            elif kind in ("phone", "card", "ssn"):
                entity = _ascii_digits(re.sub(r"\D", "", value))
                if kind == "phone" and not 9 <= len(entity) <= 15:
                    continue
            elif kind == "iban":
                entity = _ascii_digits(value.replace(" ", ""))
            else:
                entity = value
            found.append((a, b, "ip" if kind == "ipv6" else kind, entity))
    names = [m for m in _NAME.finditer(text)]
    found += [(*m.span(2), "name", m) for m in names]
    out: list[tuple[int, int, str, str]] = []
    order = {k: i for i, k in enumerate(_PATTERNS)}
    for x in sorted(found, key=lambda x: (x[0], -x[1], order.get(x[2], 99))):
        if not out or x[0] >= out[-1][1]:
            out.append(x)
    return [y for x in out for y in (_name_parts(x[3]) if x[2] == "name" else [x])]


def _name_parts(found: re.Match) -> list[tuple[int, int, str, str]]:
    """The words of a name: the last is a family name, the others are given names with the gender that the title tells."""
    words = [(found.start(2) + w.start(), found.start(2) + w.end(), w[0].casefold()) for w in re.finditer(r"[^  ]+", found.group(2))]
    gender = _GENDER[found.group(1)]
    return [(a, b, "given", f"{gender}:{w}") for a, b, w in words[:-1]] + [(a, b, "family", w) for a, b, w in words[-1:]]


_ALNUM = string.ascii_letters + string.digits
#: From this attempt on the shape of an entity no longer bounds its surrogates, from the next on no corpus can fill their space.
WIDE, LONG = 4, 8
#: Kinds that are words of a name; no two of them may look alike.
NAMES = ("given", "family")
#: Symbols that surrogates are longer by, from attempt ``LONG`` on.
MORE = 24


class _Draws:
    """An endless keyed stream of small numbers."""

    def __init__(self, key: bytes, *parts: object):
        self.key, self.label, self.n, self.pool = key, "\x00".join(map(str, parts)).encode("utf-8", "surrogatepass"), 0, b""

    def below(self, n: int) -> int:
        if len(self.pool) < 4:
            self.pool += hashlib.blake2b(self.label + self.n.to_bytes(8, "big"), key=self.key).digest()
            self.n += 1
        value, self.pool = int.from_bytes(self.pool[:4], "big"), self.pool[4:]
        return value % n

    def symbols(self, n: int, among: str = _ALNUM) -> str:
        return "".join(among[self.below(len(among))] for _ in range(n))


def _letter(c: str, draws: _Draws) -> str:
    """Another letter of the same script, case and sound class; other characters stay."""
    if c.isdigit():
        return str(draws.below(10)) if c.isascii() else c
    if not c.isalpha():
        return c
    if _script(c) == "other":
        return _alike(c)[draws.below(len(_alike(c)))]
    hard, soft = _SYLLABLES[_script(c)]
    pool = soft if c.lower() in "aeiouàáâãäåèéêëìíîïòóôõöùúûüаеёиоуыэюяαεηιουωάέήίόύώ" else hard
    new = pool[draws.below(len(pool))]
    return new.upper() if c.isupper() else new


def _name(kind: str, word: str, gender: str, draws: _Draws, attempt: int) -> str:
    """Another name of the script: a family name of syllables, a given name of the gender, from a list at first and then built.

    Scripts without tables keep the length of the word.
    """
    script = _script(word)
    if script == "other":
        return "".join(_letter(c, draws) for c in word) + "".join(_letter(word[0], draws) for _ in range(attempt // 4))
    if kind == "given" and attempt == 0:
        return _GIVEN[script][gender][draws.below(len(_GIVEN[script][gender]))].casefold()
    hard, soft = _SYLLABLES[script]
    syllables = [hard[draws.below(len(hard))] + soft[draws.below(len(soft))] for _ in range(2 + draws.below(2) + attempt // 8)]
    if kind == "family":
        return "".join(syllables)
    endings = _ENDINGS[script][gender]
    return "".join(syllables)[:-1] + endings[draws.below(len(endings))]


def surrogate(kind: str, entity: str, key: bytes, attempt: int, gender: str = "n") -> str:
    """A keyed stand-in of the same kind and shape. The same key, entity and attempt give the same one.

    Names are drawn by the name alone, so it has one stand-in wherever it stands; ``gender`` only chooses among names.

    Shapes with few values can all be taken: from attempt ``WIDE`` on addresses and secrets leave theirs, from ``LONG`` on
    all kinds but names (which grow by themselves) are longer by ``MORE`` symbols, so a free value is sure to be met.
    """
    draws = _Draws(key, kind, entity, attempt)
    if kind in NAMES:
        return _name(kind, entity, gender, draws, attempt)
    if attempt >= LONG:
        return _long(kind, entity, draws)
    if kind == "email":
        local, _, domain = entity.rpartition("@")
        host, _, top = domain.rpartition(".")
        # The host depends on itself alone: addresses of one host stay together.
        host_draws = _Draws(key, "host", host, attempt if attempt > 8 else 0)
        new = "".join(_letter(c, draws) for c in local) + "@" + "".join(_letter(c, host_draws) for c in host) + "." + top
        # Marks alone have nothing to redraw.
        return new if attempt < WIDE and _drawn(local + host) else draws.symbols(8, string.ascii_lowercase) + new
    if kind == "ip" and ":" in entity:
        # Groups of zeros stay, so the address can be written as short; the first digit, not 0, keeps a group's length.
        hexes = "0123456789abcdef"
        groups = [g.lstrip("0") for g in entity.split(":")]
        if attempt >= WIDE:
            groups = [groups[0] or "fd00", *["ffff"] * 7]
        return ":".join(
            (draws.symbols(1, hexes[1:]) + draws.symbols(len(g) - 1, hexes)).rjust(4, "0") if g else "0000" for g in groups
        )
    if kind == "ip":
        if attempt >= WIDE:
            private = [int(x) for x in entity.split(".")][0] in (10, 127)
            return ".".join(str(x) for x in (10 if private else 11 + draws.below(212), *(draws.below(256) for _ in range(3))))
        limits = {1: (0, 10), 2: (10, 90), 3: (100, 156)}
        return ".".join(str(lo + draws.below(n)) for lo, n in (limits[len(x)] for x in entity.split(".")))
    if kind == "card":
        body = entity[0] + "".join(str(draws.below(10)) for _ in entity[2:])
        if not _luhn(entity):
            return body + str(draws.below(10))
        return body + next(d for d in "0123456789" if _luhn(body + d))
    if kind == "phone":
        keep = max(0, len(entity) - 10)
        return entity[:keep] + "".join(str(draws.below(10)) for _ in entity[keep:])
    if kind in ("access_key", "secret") and (attempt >= WIDE or not _drawn(entity[4:])):
        return (entity[:4] if kind == "access_key" else "") + draws.symbols(len(entity) - 4 * (kind == "access_key"))
    if kind == "access_key":
        at = 4 if entity.startswith("AKIA") else re.match(r"[a-z]+[-_]", entity).end()
        return entity[:at] + "".join(_symbol(c, draws) for c in entity[at:])
    if kind == "iban":
        return entity[:2] + "".join(_symbol(c, draws) for c in entity[2:])
    if re.fullmatch(r"[0-9a-f]*[a-f][0-9a-f]*", entity) and kind == "secret":
        return "".join("0123456789abcdef"[draws.below(16)] for _ in entity)
    return "".join(_symbol(c, draws) for c in entity)


def _drawn(text: str) -> bool:
    """Whether a text has characters that a draw replaces: letters and ASCII digits."""
    return any(c.isalpha() or (c.isascii() and c.isdigit()) for c in text)


def _long(kind: str, entity: str, draws: _Draws) -> str:
    if kind == "email":
        return f"{draws.symbols(MORE, string.ascii_lowercase)}@{draws.symbols(8, string.ascii_lowercase)}.{entity.rpartition('.')[2]}"
    if kind == "ip":
        return ":".join(["fd" + draws.symbols(2, "0123456789abcdef"), *(draws.symbols(4, "0123456789abcdef") for _ in range(7))])
    digits = kind in ("phone", "card", "ssn")
    new = "".join(str(draws.below(10)) if digits else draws.symbols(1) for _ in entity)
    return (entity[:4] + new[4:] if kind in ("access_key", "iban") else new) + draws.symbols(MORE, string.digits if digits else _ALNUM)


def _symbol(c: str, draws: _Draws) -> str:
    if c.isascii() and c.isdigit():
        return str(draws.below(10))
    if c.isascii() and c.isalpha():
        new = chr(97 + draws.below(26))
        return new.upper() if c.isupper() else new
    return _letter(c, draws)


def render(kind: str, seen: str, stand_in: str) -> str:
    """The surrogate in the format of the occurrence: its separators and its case."""
    if kind in NAMES:
        return stand_in.upper() if seen.isupper() and len(seen) > 1 else stand_in.capitalize()
    if kind in ("phone", "card", "ssn", "iban"):
        new = iter(stand_in)
        return "".join(_as_digit(next(new), c) if c.isalnum() else c for c in seen) + "".join(new)
    if kind == "ip" and ":" in stand_in:
        short = ":" not in seen or "::" in seen or len(seen) < 39
        drawn = ipaddress.IPv6Address(stand_in).compressed if short else stand_in
        return drawn.upper() if any("A" <= c <= "F" for c in seen) else drawn
    if kind == "ip" and len(seen) == len(stand_in):
        return "".join(map(_as_digit, stand_in, seen))
    if kind == "email" and len(seen) == len(stand_in):
        return "".join(b.upper() if a.isupper() else b for a, b in zip(seen, stand_in, strict=True))
    return stand_in


def _as_digit(new: str, seen: str) -> str:
    """A digit in the script of the one seen; other characters as they are."""
    return chr(ord(seen) - int(seen) + int(new)) if new.isdigit() and seen.isdecimal() and not seen.isascii() else new


_SPOTS = "id bigint, copy bigint, start int, stop int, kind string, entity string"


def _detect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        columns: list[list] = [[] for _ in range(6)]
        for id_, copy, text in zip(*batch.columns, strict=True):
            for spot in detect(text.as_py() or ""):
                for column, value in zip(columns, (id_.as_py(), copy.as_py(), *spot), strict=True):
                    column.append(value)
        types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.string()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["id", "copy", "start", "stop", "kind", "entity"]
        )


def _draw(key: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*[c.to_pylist() for c in batch.columns], strict=True)
            stand_ins = [surrogate(kind, entity, key, attempt, gender or "n") for kind, entity, gender, attempt in rows]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(stand_ins, pa.string())], names=["kind", "entity", "gender", "attempt", "stand_in"]
            )

    return run


def assign_surrogates(entities: DataFrame, key: bytes, rounds: int = 60) -> DataFrame:
    """``kind, entity`` to ``kind, entity, attempt, stand_in``, such that no two entities of a kind share a surrogate and
    no surrogate is an entity of the corpus. Words of names count as one kind, given or family, and whatever their gender.

    All entities draw; of those that drew alike the least keeps its draw, the others and those that drew a real entity
    draw again, in wider spaces after a few attempts and then in ones that no corpus fills, so all come to an end. The
    table has one row per distinct entity and stays distributed. More than ``rounds`` rounds would be a broken hash. ``gender`` is
    optional; of several of a name the least letter counts.
    """
    types = "kind string, entity string, gender string, attempt int, stand_in string"
    gender = F.min("gender") if "gender" in entities.columns else F.lit(None).cast("string")
    space = lambda: F.when(F.col("kind").isin(*NAMES), "name").otherwise(F.col("kind")).alias("space")
    real = stage(entities.groupBy("kind", "entity").agg(gender.alias("gender")), "entities")
    drawn = stage(real.withColumn("attempt", F.lit(0)).mapInArrow(_draw(key), types), "surrogates")
    taken = real.select(space(), F.col("entity").alias("stand_in"), F.lit(True).alias("real")).distinct()
    for _ in range(rounds):
        spaced = drawn.withColumn("space", space())
        first = spaced.groupBy("space", "stand_in").agg(F.min(F.struct("kind", "entity")).alias("owner"))
        judged = spaced.join(first, ["space", "stand_in"]).join(taken, ["space", "stand_in"], "left").withColumn(
            "again", (F.col("owner") != F.struct("kind", "entity")) | F.col("real").isNotNull()
        )
        judged = stage(judged.select("kind", "entity", "gender", "attempt", "stand_in", "again"), "judged")
        again = judged.filter("again")
        if again.isEmpty():
            return drawn.drop("gender")
        redrawn = again.select("kind", "entity", "gender", (F.col("attempt") + 1).alias("attempt")).mapInArrow(_draw(key), types)
        drawn = stage(judged.filter("NOT again").drop("again").unionByName(redrawn), "surrogates")
    raise ValueError(f"{again.count()} entities have no surrogate of their own after {rounds} rounds")


_OUT = pa.schema([("id", pa.int64()), ("n_entities", pa.int64()), ("kinds", pa.list_(pa.string())), ("text", pa.string())])


def _replace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 1000):
            rows = []
            for id_, text, spots in zip(*[c.to_pylist() for c in batch.slice(at, 1000).columns], strict=True):
                spots = sorted(spots or [], key=lambda s: s["start"])
                parts, done = [], 0
                for s in spots:
                    parts += [text[done : s["start"]], render(s["kind"], text[s["start"] : s["stop"]], s["stand_in"])]
                    done = s["stop"]
                new = text if not spots else "".join([*parts, text[done:]])
                # A name is one entity, whatever its words.
                kinds = ["name" if s["kind"] == "family" else s["kind"] for s in spots if s["kind"] != "given"]
                rows.append({"id": id_, "n_entities": len(kinds), "kinds": sorted(set(kinds)), "text": new})
            yield pa.RecordBatch.from_pylist(rows, schema=_OUT)


def replace_personal_data(docs: DataFrame, key: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Replace personal data by surrogates: ``id_col``, ``n_entities``, ``kinds``, ``text_col``; one row per document.

    Kinds: e-mail addresses, phone and card numbers, IP addresses (of both versions), IBANs, social security numbers, access keys, secrets
    after ``password=`` and the like, and names after a title. Surrogates come from a keyed hash of the entity, so an
    entity has the same one everywhere and, with the same key, in every run; they keep length, separators, case, script and
    sound class, network and check digit of a card, host groups of addresses, and the gender a title tells. Given and family names
    are replaced each by its own, so ``Mr. John Smith`` and ``Dr Smith`` share the latter. Where a shape has
    too few values for the corpus, or nothing to redraw (``********``), length and characters are not kept. Different
    entities get different surrogates, none of which occurs in the corpus.

    Null texts stay null, empty ones empty. Null ids and repeated rows need no care: documents meet their spots by id and
    a hash of the text. Other columns are ignored. A very frequent entity is one row of the mapping; Spark splits the
    other side.
    """
    docs = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
    docs = docs.withColumn("copy", F.xxhash64("text"))
    found = docs.select("id", "copy", "text").mapInArrow(_detect, _SPOTS).distinct()
    given = F.col("kind") == "given"
    spots = stage(found.withColumns({
        "gender": F.when(given, F.substring("entity", 1, 1)), "entity": F.when(given, F.expr("substring(entity, 3)")).otherwise(F.col("entity")),
    }), "spots")
    named = spots.join(assign_surrogates(spots, key).drop("attempt"), ["kind", "entity"])
    marked = named.groupBy("id", "copy").agg(
        F.collect_list(F.struct("start", "stop", "kind", "stand_in")).alias("spots")
    ).select(F.col("id").alias("of"), F.col("copy").alias("of_copy"), "spots")
    same = F.col("id").eqNullSafe(F.col("of")) & F.col("copy").eqNullSafe(F.col("of_copy"))
    return docs.join(marked, same, "left").select("id", "text", "spots").mapInArrow(
        _replace, "id bigint, n_entities bigint, kinds array<string>, text string"
    ).withColumnsRenamed({"id": id_col, "text": text_col})
