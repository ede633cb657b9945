"""Texts to token ids by way of their distinct words, in Arrow and vector arithmetic.

Texts are cut at blanks, which the split pattern of the byte-level vocabularies never joins
across, but where a blank has white space on both sides. Arrow finds the distinct words of a lot
of texts; only those are encoded, and the ids of all words are gathered from theirs. Texts with a
blank between white space are encoded whole.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: White space as the split pattern has it.
_WS = r"[\t\n\x0b\x0c\r\x1c-\x1f \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
LOT_BYTES = 8 << 20

#: Words -> their ids one after the other, and how many each has.
Encoded = tuple[np.ndarray, np.ndarray]


def lots(texts: pa.Array, size: int = LOT_BYTES) -> Iterator[pa.Array]:
    """``texts`` in slices of about ``size`` bytes; a longer text is a slice by itself."""
    n = np.cumsum(pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(texts):
        stop = int(np.searchsorted(n, (n[at - 1] if at else 0) + size, "right"))
        stop = max(stop, at + 1)
        yield texts.slice(at, stop - at)
        at = stop


def gathered(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The runs of ``values`` that begin at ``starts``, one after the other."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    at = np.arange(total)
    at += np.repeat(starts - (ends - lengths), lengths)
    return values[at]


def tokenise(texts: pa.Array, words: Callable[[pa.Array], Encoded], head: Callable[[list[str]], list[bytes]], whole: Callable[[str], bytes]) -> Encoded:
    """Ids of all texts one after the other and the number of each text's ids.

    ``words`` encodes distinct words with the blank before them, ``head`` those that begin a text,
    ``whole`` a text as it is; NULL has no ids.
    """
    texts = texts.fill_null("")
    odd = pc.match_substring_regex(texts, f"{_WS} {_WS}")
    strange = np.flatnonzero(odd.to_numpy(zero_copy_only=False))
    plain = pc.if_else(odd, "", texts) if len(strange) else texts
    lists = pc.split_pattern(plain, " ")
    n_words = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = lists.flatten()
    first = np.cumsum(n_words) - n_words
    coded = flat.dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False)
    ids, lengths = words(coded.dictionary)
    # words that begin a text have no blank before them
    begin = flat.take(pa.array(first)).dictionary_encode()
    packed = head(begin.dictionary.to_pylist())
    own = np.array([len(p) >> 2 for p in packed], np.int64)
    ids = np.concatenate([ids, np.frombuffer(b"".join(packed), np.int32)])
    lengths = np.concatenate([lengths, own])
    codes = codes.astype(np.int64)
    codes[first] = begin.indices.to_numpy(zero_copy_only=False) + len(coded.dictionary)
    each = lengths[codes]
    out = gathered(ids, (np.cumsum(lengths) - lengths)[codes], each)
    sizes = np.add.reduceat(each, first) if len(first) else each
    if len(strange):
        parts, at, ends = [], 0, np.cumsum(sizes)
        for i in strange.tolist():
            more = np.frombuffer(whole(texts[i].as_py()), np.int32)
            parts += [out[at : ends[i]], more]
            at = int(ends[i])
            sizes[i] = len(more)
        out = np.concatenate([*parts, out[at:]])
    return out, sizes


def in_one_call(words: pa.Array, encode: Callable[[str], list[int] | np.ndarray], token_bytes: np.ndarray) -> Encoded:
    """Distinct words encoded by one call over all of them, joined by blanks; the ids of each are told
    apart by the bytes of the tokens. A word that begins and ends with white space is encoded by itself."""
    begins, ends = (pc.match_substring_regex(words, p).to_numpy(zero_copy_only=False) for p in (f"^{_WS}", f"{_WS}$"))
    alone = (begins & ends) | (pc.binary_length(words).to_numpy(zero_copy_only=False) == 0)
    # no two words with white space at the blank between them: those that begin with it come first
    together = np.r_[np.flatnonzero(begins & ~alone), np.flatnonzero(~begins & ~alone)]
    counts = np.zeros(len(words), np.int64)
    chosen = words.take(pa.array(together))
    joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(chosen)], pa.int32()), chosen), " ")[0].as_py()
    ids = np.array(encode(" " + joined) if len(chosen) else [], np.int32)
    borders = np.cumsum(pc.binary_length(chosen).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
    upto = np.searchsorted(np.cumsum(token_bytes[ids]), borders, "right")
    counts[together] = np.diff(np.r_[0, upto])
    singles = np.flatnonzero(alone)
    more = [encode(" " + words[i].as_py()) for i in singles.tolist()]
    counts[singles] = [len(m) for m in more]
    order = np.r_[together, singles]
    every = np.concatenate([ids, *(np.array(m, np.int32) for m in more)]) if more else ids
    in_order = counts[order]
    starts = np.zeros(len(words), np.int64)
    starts[order] = np.cumsum(in_order) - in_order
    return gathered(every, starts, counts), counts
