"""A SentencePiece vocabulary, and the rules that encoder, decoder and token counts share.

A text is read with a blank put before it and every blank written as U+2581. Its words are runs of blanks with what
follows up to the next blank or line break, and the line breaks. Words are cut into units between a letter and a mark
that no piece of the vocabulary has beside a letter, which changes no segmentation. A unit is segmented into the
pieces with the highest sum of scores; a character in no piece becomes its UTF-8 bytes, each a byte piece.
"""

from __future__ import annotations

import functools
import math
import re
from collections.abc import Iterable

DEFAULT_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
BLANK = "▁"
#: Units of more code points are segmented one by one, from left to right, and not kept; they are never cut.
UNIT_CHARS = 256
_WORD = re.compile(rf"\n|{BLANK}*[^{BLANK}\n]+|{BLANK}+")
MARKS = ".,;:!?|()\"$%&*#"
#: Score of a byte piece: below any piece, so bytes are used only where no piece fits.
BYTE_SCORE = -40.0
#: Scores closer than this are ties; they go to the segmentation whose last piece is longer, from the end on.
DIGITS = 6


@functools.cache
def vocabulary(model: str = DEFAULT_MODEL) -> tuple[tuple[int, str, float, int], ...]:
    """``(id, piece, score, byte)`` of the normal and byte pieces (byte: its value, or -1).

    A unigram model's scores are log probabilities and used as they are. A BPE model has merge ranks instead: a piece
    of rank r gets ``-ln(r + 2)``, the log frequency of rank r by Zipf's law. Scores are whole multiples of 10^-6.
    """
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    size = range(sp.get_piece_size())
    plain = [i for i in size if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) or sp.is_byte(i))]
    merges = all(sp.get_score(i).is_integer() for i in plain)
    rows = [(i, sp.id_to_piece(i), BYTE_SCORE, int(sp.id_to_piece(i)[3:5], 16)) for i in size if sp.is_byte(i)]
    for i in plain:
        score = -math.log(min(-sp.get_score(i), 10**6) + 2) if merges else sp.get_score(i)
        rows.append((i, sp.id_to_piece(i), round(score, DIGITS), -1))
    return tuple(rows)


def cut_pattern(pieces: Iterable[str]) -> re.Pattern:
    """Where words are cut into units: between letters and the marks that no piece has beside a letter."""
    pieces = list(pieces)
    # Word characters of the vocabulary that are numbers, such as a raised 2, are not letters.
    numbers = "".join(sorted({re.escape(c) for p in pieces for c in p if c.isnumeric() and not c.isalpha()}))
    letter = rf"[^\W\d_{numbers}]"
    is_letter = functools.cache(lambda c: re.fullmatch(letter, c) is not None)
    pairs = [ab for p in pieces for ab in zip(p, p[1:], strict=False)]
    beside = {b if is_letter(a) else a for a, b in pairs if is_letter(a) != is_letter(b)}
    loose = "".join(re.escape(m) for m in MARKS if m not in beside) or r"\n"
    return re.compile(rf"(?<={letter})(?=[{loose}])|(?<=[{loose}])(?={letter})")


def words(text: str | None) -> list[str]:
    return _WORD.findall(BLANK + text.replace(" ", BLANK)) if text else []


def units(found: Iterable[str], cut: re.Pattern) -> dict[str, list[str]]:
    """The units of each word."""
    return {w: cut.split(w) for w in found}


def ends_of_pieces(scores: dict[str, int]) -> dict[str, int | bool]:
    """Every suffix of a piece: its score if it is a piece itself, else True."""
    out: dict[str, int | bool] = {p[k:]: True for p in scores for k in range(1, len(p))}
    return out | scores


def best_pieces(unit: str, ends: dict[str, int | bool], ids: dict[str, int], byte_ids: list[int]) -> list[int]:
    """Ids of the best segmentation of one unit of any length; time and memory grow in proportion to it."""
    get, by_byte = ends.get, round(BYTE_SCORE * 10**DIGITS)
    best, back = [0], [0]
    for end in range(1, len(unit) + 1):
        top, at = best[end - 1] + len(unit[end - 1].encode()) * by_byte, -1
        start = end - 1
        while start >= 0:
            s = get(unit[start:end])
            if s is None:
                break
            if s is not True and best[start] + s >= top:
                top, at = best[start] + s, start
            start -= 1
        best.append(top)
        back.append(at)
    out, end = [], len(unit)
    while end:
        if back[end] < 0:
            out += [byte_ids[b] for b in reversed(unit[end - 1].encode())]
            end -= 1
        else:
            out.append(ids[unit[back[end] : end]])
            end = back[end]
    return out[::-1]
