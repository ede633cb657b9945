"""Text expressions. White space is Unicode's, as it is for the texts' producers."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"[\s\x1c-\x1f]"
SPACES = "".join(c for c in map(chr, range(0x3001)) if c.isspace())
MATH_SYMBOLS = "∑∏∫√∞≈≠≤≥±×÷∂∇∈∉⊂⊃∪∩∀∃αβγδεζηθλμνξπρστφχψωΓΔΘΛΞΠΣΦΨΩ^"
OPERATORS = "=+-*/^_{}\\"
MARKUP = ("**", "<u>", "~~", "\n#", "<b>", "<strong>", "<em>")


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(SPACES))


def rstrip(c: Column) -> Column:
    return F.rtrim(c, F.lit(SPACES))


def lstrip(c: Column) -> Column:
    return F.ltrim(c, F.lit(SPACES))


def collapse(c: Column) -> Column:
    return F.regexp_replace(c, rf"(?U){SPACE}+", " ")


# -- profile ---------------------------------------------------------------------------------

_SPACE, _MATH, _OPERATOR = 1, 2, 4


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """What a character is, by its code point."""
    table = np.zeros(1 << 16, np.uint8)
    for bit, characters in ((_SPACE, SPACES), (_MATH, MATH_SYMBOLS), (_OPERATOR, OPERATORS)):
        for ch in characters:
            table[ord(ch)] |= bit
    return table


def _wide(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Place, length and class of the characters of two and three bytes that have a class."""
    lead = np.flatnonzero((data >= 0xC2) & (data < 0xF0))
    three = data[lead] >= 0xE0
    b = [data[np.minimum(lead + k, len(data) - 1)].astype(np.int64) for k in range(3)]
    code = np.where(three, (b[0] & 15) << 12 | (b[1] & 63) << 6 | b[2] & 63, (b[0] & 31) << 6 | b[1] & 63)
    kind = _classes()[code]
    hit = kind > 0
    return lead[hit], np.where(three[hit], 3, 2), kind[hit]


def profile_bytes(data: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
    """For UTF-8 texts one after the other: characters without outer white space, words, characters
    that are no white space, and characters of formulas (those of both lists count twice)."""
    ends = ends.astype(np.int64)
    begins = np.r_[0, ends[:-1]] if len(ends) else ends

    def per_text(places: np.ndarray) -> np.ndarray:
        return np.searchsorted(places, ends) - np.searchsorted(places, begins)

    kind = np.where(data < 128, _classes()[data], 0).astype(np.uint8)
    at, width, wide = _wide(data)
    for k in range(3):
        on = width > k
        kind[at[on] + k] = wide[on]
    inner = (data & 0xC0) == 0x80  # not the first byte of a character
    space = (kind & _SPACE) > 0
    solid = np.flatnonzero(~space)
    continued = np.flatnonzero(inner)
    first, last = np.searchsorted(solid, begins), np.searchsorted(solid, ends) - 1
    some = last >= first
    whole = lambda a, b: (b - a) - (np.searchsorted(continued, b) - np.searchsorted(continued, a))
    chars, letters = np.zeros(len(ends), np.int64), whole(begins, ends) - per_text(np.flatnonzero(space & ~inner))
    chars[some] = whole(solid[first[some]], solid[last[some]] + 1)
    fresh = ~space
    fresh[1:] &= space[:-1]
    opening = begins[begins < ends]  # a text begins a word whatever ends the one before it
    fresh[opening] = ~space[opening]
    formula = per_text(np.flatnonzero((kind & _MATH > 0) & ~inner)) + per_text(np.flatnonzero((kind & _OPERATOR > 0) & ~inner))
    return [chars, per_text(np.flatnonzero(fresh)), letters, formula]


_LOT = 4 << 20


def text_profile(text: Column) -> Column:
    """struct<chars, words, letters, hits>, as ``profile_bytes`` has them; one pass over the bytes in vector
    arithmetic, where five passes of expressions take ten times as long. NULL counts as empty."""

    @F.arrow_udf("struct<chars: int, words: int, letters: int, hits: int>")
    def profile(batch: pa.Array) -> pa.Array:
        found = [np.zeros((4, 0), np.int64)]
        ends = np.cumsum(pc.binary_length(batch).fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
        at = 0
        while at < len(batch):
            begun = int(ends[at - 1]) if at else 0
            stop = max(at + 1, int(np.searchsorted(ends, begun + _LOT, "right")))
            raw = b"".join(batch.slice(at, stop - at).fill_null("").cast(pa.binary()).to_numpy(zero_copy_only=False))
            found.append(np.stack(profile_bytes(np.frombuffer(raw, np.uint8), ends[at:stop] - begun)))
            at = stop
        return pa.StructArray.from_arrays([pa.array(x, pa.int32()) for x in np.concatenate(found, axis=1)], ["chars", "words", "letters", "hits"])

    return profile(text)


# -- markup and keys -------------------------------------------------------------------------


def has_markup(c: Column) -> Column:
    """Whether a page is blank or carries markup already, so that nothing is to be recovered."""
    any_of = F.lit(False)
    for m in MARKUP:
        any_of = any_of | F.contains(c, F.lit(m))
    return any_of | (strip(c) == "") | F.startswith(lstrip(c), F.lit("#"))


def sanitize(text: str) -> str:
    """``text`` without lone surrogates. It is for text on its way into a DataFrame, which would
    turn them into replacement characters."""
    return "".join(ch for ch in text if not 0xD800 <= ord(ch) <= 0xDFFF)


_FOLD = str.maketrans({"­": None, "’": "'", "‘": "'", "“": '"', "”": '"', "—": "-", "–": "-"})


def match_key(text: str) -> str:
    """The form in which a span is looked for: compatibility-normalised, quotes and dashes folded,
    white space collapsed, caseless. Neither engine has these as SQL functions."""
    return " ".join(unicodedata.normalize("NFKC", text).translate(_FOLD).split()).casefold()


def collapse_with_offsets(text: str) -> tuple[str, list[int]]:
    """Collapsed text and, for each of its characters, the place in ``text``. White space at the
    start goes, one blank at the end stays."""
    out, places, gap = [], [], True
    for i, ch in enumerate(text):
        blank = ch.isspace()
        if not (blank and gap):
            out.append(" " if blank else ch)
            places.append(i)
        gap = blank
    return "".join(out), places
