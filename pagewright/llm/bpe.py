"""Byte-level BPE by prefix dynamic programming.

For a byte string there is exactly one token that can end the encoding of each of its
prefixes. Storing that *last token* for every prefix gives the encoding by walking back,
makes an append exact (known prefixes keep their token), and lets an edit be re-encoded
from the touched piece only. A token ``t`` may follow the last token ``p`` of the prefix
before it iff the encoder, run on the bytes of ``p`` and ``t`` together, would give back
``p, t``; this is decided by undoing merges around the border (``Vocabulary.follows``).

A worker keeps the ids of the pieces that it met lately, within a fixed number of entries.
Vocabulary files are read on the driver
(their path is a parameter) and sent with the task; their size does not depend on the data.

Edge cases: NULL text gives NULL ids, the empty text an empty array, NULL ids and arrays that
hold a NULL decode to NULL. Ids that form no valid UTF-8 are decoded with U+FFFD in place of the bad bytes; an
id outside the vocabulary is an error. Texts of any length are taken whole. Other columns
pass through; an input column named like an output column is replaced.
"""

from __future__ import annotations

import base64
from array import array
from functools import cached_property, lru_cache
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.llm.common import fresh, give_back, q, require, take_turn, without
from pagewright.llm.prefix import PrefixTables
from pagewright.llm.words import gathered, in_one_call, lots, tokenise

DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
MULTI_VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: The published split pattern of the byte-level vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Entries that a worker's tables may hold before they are emptied; results do not depend on it.
CACHE_ENTRIES = 150_000
#: Pieces longer than this are encoded by a scan with its own prefix table.
LONG_PIECE = 96
#: Bytes of text whose ids are made, and decoded, at once.
LOT_BYTES = 2 << 20
#: Bytes of distinct pieces whose prefixes are settled at once.
PIECE_BYTES = 128 << 10


class Vocabulary:
    """Tokens by rank, their splits, and the rule for which token may follow which."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.token = {i: b for b, i in ranks.items()}
        self.longest = max(map(len, ranks))
        self._split: dict[int, tuple[int, int]] = {}
        self._merge: dict[tuple[int, int], int] = {}
        for token, rank in sorted(ranks.items(), key=lambda kv: kv[1]):
            if len(token) > 1:
                parts = self._last_merge(token, rank)
                self._split[rank] = parts
                if parts[0] != rank:
                    self._merge[parts] = rank
            else:
                self._split[rank] = (rank, rank)
        self.length = {i: len(b) for i, b in self.token.items()}
        self.base = max(self.token) + 1
        self.by_id = np.array([self.token.get(i, b"") for i in range(self.base)], object)
        self.bytes = np.frombuffer(b"".join(self.by_id), np.uint8)
        self.n_bytes = np.fromiter(map(len, self.by_id), np.int64, self.base)
        self.bytes_from = np.cumsum(self.n_bytes) - self.n_bytes
        #: Pairs that ``follows`` has decided, by left * base + right.
        self.known: dict[int, bool] = {}
        self.tables = PrefixTables(ranks, self._split, self._merge)

    @cached_property
    def automaton(self) -> ahocorasick.Automaton:
        """For pieces that are taken one by one: long ones, and those of a text that is edited."""
        out = ahocorasick.Automaton()
        for token, rank in self.ranks.items():
            out.add_word(token.decode("latin-1"), rank)
        out.make_automaton()
        return out

    def _last_merge(self, token: bytes, rank: int) -> tuple[int, int]:
        """The two parts that the merge to ``token`` joins; (rank, rank) if merges never reach it."""
        ranks = self.ranks
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            best, at = rank, -1
            for i in range(len(parts) - 1):
                r = ranks.get(parts[i] + parts[i + 1], rank)
                if r < best:
                    best, at = r, i
            if at < 0:
                return rank, rank
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return ranks[parts[0]], ranks[parts[1]]

    def follows(self, left: int, right: int) -> bool:
        """Whether ``left, right`` is how the bytes of both are encoded together."""
        key = left * self.base + right
        known = self.known.get(key)
        if known is None:
            if len(self.known) > CACHE_ENTRIES:
                self.known.clear()
            known = self.known[key] = self._check(left, right)
        return known

    def _check(self, left: int, right: int) -> bool:
        # Undo the later of the two border tokens, again and again. Were the tokens at the
        # border ever mergeable at a rank before the one that was undone last, the encoder
        # would have crossed the border.
        split, limit = self._split, 1 << 62
        while True:
            merged = self._merge.get((left, right))
            if merged is not None and merged < limit:
                return False
            whole_l, whole_r = split[left][0] == left, split[right][0] == right
            if whole_l and whole_r:
                return True
            if whole_r or (not whole_l and left > right):
                limit, left = left, split[left][1]
            else:
                limit, right = right + 1, split[right][0]


def vocabulary(data: bytes) -> dict[bytes, int]:
    """Token bytes -> rank."""
    pairs = (line.split() for line in data.splitlines() if line.strip())
    return {base64.b64decode(a): int(b) for a, b in pairs}


@lru_cache(maxsize=4)
def _vocabulary(data: bytes) -> Vocabulary:
    return Vocabulary(vocabulary(data))


@lru_cache(maxsize=4)
def read_vocabulary(path: str) -> bytes:
    """The bytes of a rank file: one ``base64-token rank`` a line."""
    with open(path, "rb") as f:
        return f.read()


class PrefixEncoder:
    """Encodes texts piece by piece, each by its table of last tokens."""

    def __init__(self, vocabulary: Vocabulary, pattern: str = PATTERN):
        self.v = vocabulary
        if pattern != PATTERN:
            raise ValueError("chunks are cut for the published pattern only")
        self.split = regex.compile(pattern).findall
        self.chunks = _Chunks(self)
        self.first = _FirstChunks(self)
        # a blank with white space on both sides: only there may cutting at blanks differ from the pattern
        self._odd = regex.compile(r"\s \s").search
        # line feeds between words: each is a piece, and what is around it can be cut on its own
        self.lines = regex.compile(r"(?<=\S)\n(?=\S)").split

    def clear(self) -> None:
        """Empty all tables that grow with the texts."""
        for table in (self.chunks, self.first, self.chunks.older, self.first.older, self.v.known):
            table.clear()

    # -- one piece ---------------------------------------------------------
    def piece_prefixes(self, piece: bytes, known: list[int] | None = None) -> list[int]:
        """The last token of each non-empty prefix; ``known`` holds those of a beginning."""
        length, follows, check, base = self.v.length, self.v.known, self.v.follows, self.v.base
        last = list(known or ())
        have = len(last)
        back = max(0, have - self.v.longest)  # tokens that end later begin after this
        shift = back + 1
        for at, t in self.v.automaton.iter(piece[back:].decode("latin-1")):
            end = at + shift
            if end <= have:
                continue
            if end > have + 1:
                break
            start = end - length[t]
            if not start:
                last.append(t)
                have = end
                continue
            p = last[start - 1]
            ok = follows.get(p * base + t)
            if ok or (ok is None and check(p, t)):
                last.append(t)
                have = end
        if have < len(piece):
            raise ValueError(f"no token ends the prefix {piece[: have + 1][-20:]!r}: the vocabulary lacks bytes")
        return last

    def ids_from_prefixes(self, last: list[int]) -> list[int]:
        out, end, length = [], len(last), self.v.length
        while end:
            t = last[end - 1]
            out.append(t)
            end -= length[t]
        return out[::-1]

    def piece_ids(self, piece: bytes) -> list[int]:
        whole = self.v.ranks.get(piece)
        return self.ids_from_prefixes(self.piece_prefixes(piece)) if whole is None else [whole]

    # -- whole texts -------------------------------------------------------
    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_packed(text), np.int32).tolist()

    def encode_packed(self, text: str) -> bytes:
        """The ids as little-endian 32-bit integers."""
        if self._odd(text):
            return b"".join(map(self.chunks.pack, self.split(text)))
        head, *rest = text.split(" ")
        return self.first[head] + b"".join(map(self.chunks.__getitem__, rest))

    def encode_array(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and the number of each text's ids."""
        return tokenise(texts, self._words, self._heads, self.encode_packed)

    def _words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        return in_one_call(words, lambda text: self._pieces(self.split(text))[0], self.v.n_bytes)

    def _heads(self, words: list[str]) -> list[bytes]:
        pieces = [self.split(w) for w in words]
        ids, counts = self._pieces(list(chain.from_iterable(pieces)))
        upto = np.r_[0, np.cumsum(counts)][np.r_[0, np.cumsum([len(p) for p in pieces])].astype(np.int64)]
        return [ids[a:b].astype("<i4").tobytes() for a, b in zip(upto, upto[1:])]

    def _pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all pieces one after the other, and how many each has: distinct ones are encoded together, the
        long ones one by one."""
        coded = pa.array(pieces, pa.string()).dictionary_encode()
        distinct = coded.dictionary
        n = pc.binary_length(distinct).to_numpy(zero_copy_only=False).astype(np.int64)
        short, long_ = np.flatnonzero(n <= LONG_PIECE), np.flatnonzero(n > LONG_PIECE)
        made, at, ends = [], 0, np.cumsum(n[short])
        while at < len(short):
            stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PIECE_BYTES)))
            data = b"".join(distinct.take(pa.array(short[at:stop])).cast(pa.binary()).to_numpy(zero_copy_only=False))
            made.append(self.v.tables.encode(np.frombuffer(data, np.uint8), n[short[at:stop]]))
            at = stop
        more = [self.piece_ids(distinct[i].as_py().encode("utf-8")) for i in long_.tolist()]
        ids = np.concatenate([*(m[0] for m in made), *(np.array(m, np.int32) for m in more), np.zeros(0, np.int32)])
        counts = np.zeros(len(n), np.int64)
        counts[short] = np.concatenate([*(m[1] for m in made), np.zeros(0, np.int64)])
        counts[long_] = [len(m) for m in more]
        starts = np.zeros(len(n), np.int64)
        order = np.r_[short, long_]
        starts[order] = np.cumsum(counts[order]) - counts[order]
        codes = coded.indices.to_numpy(zero_copy_only=False)
        return gathered(ids, starts[codes], counts[codes]), counts[codes]

    def decode_bytes(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of all ids."""
        return gathered(self.v.bytes, self.v.bytes_from[ids], self.v.n_bytes[ids])

    def decode(self, ids) -> str:
        """The text of a list or array of ids."""
        ids = np.asarray(ids, np.int64)
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.v.by_id)):
            raise ValueError("an id is outside the vocabulary")
        return b"".join(self.v.by_id[ids].tolist()).decode("utf-8", "replace")


class _FirstChunks(dict):
    """Chunk at the start of a text -> packed ids. When full, what was used of late stays."""

    lead = ""

    def __init__(self, encoder: PrefixEncoder):
        super().__init__()
        self.e = encoder
        self.older: dict[str, bytes] = {}

    def __missing__(self, chunk: str) -> bytes:
        if len(self) > CACHE_ENTRIES:
            self.older = dict(self)
            self.clear()
        packed = self.older.get(chunk)
        if packed is None:
            if chunk.isalpha():  # as most are: one piece
                packed = self.pack(self.lead + chunk)
            elif chunk[:-1].isalpha() and chunk[-1] in ".,":
                packed = self[chunk[:-1]] + self.pack(chunk[-1])
            else:
                line, *rest = self.e.lines(chunk) if "\n" in chunk else (chunk,)
                if rest:
                    return self.pack("\n").join([self[line], *map(self.e.first.__getitem__, rest)])
                packed = b"".join(map(self.pack, self.e.split(self.lead + chunk)))
        if len(chunk) <= LONG_PIECE:
            self[chunk] = packed
        return packed

    def pack(self, piece: str) -> bytes:
        """``piece_ids``, packed; written out once more, as most of the time goes here."""
        v = self.e.v
        raw = piece.encode("utf-8")
        whole = v.ranks.get(raw)
        if whole is not None:
            return array("i", (whole,)).tobytes()
        length, follows, base = v.length, v.known.get, v.base
        last = [-1]
        have = 0
        for at, t in v.automaton.iter(piece if len(raw) == len(piece) else raw.decode("latin-1")):
            if at < have:  # the prefix that ends here has its token
                continue
            if at > have:
                break
            p = last[at + 1 - length[t]]
            if p < 0 or follows(p * base + t) or (follows(p * base + t) is None and v.follows(p, t)):
                last.append(t)
                have += 1
        if have < len(raw):
            raise ValueError(f"no token ends the prefix {raw[: have + 1][-20:]!r}: the vocabulary lacks bytes")
        out = []
        while have:
            t = last[have]
            out.append(t)
            have -= length[t]
        out.reverse()
        return array("i", out).tobytes()


class _Chunks(_FirstChunks):
    """Chunk after a blank, that blank included -> packed ids."""

    lead = " "


class TokenBuffer:
    """A text that is edited: each piece keeps the last tokens of its prefixes.

    ``append`` keeps all pieces but the last few, whose known prefixes it goes on from;
    ``replace`` splits again from the edit to the first piece border that the old text has
    too. Both give exactly the ids of encoding the new text from the start.
    """

    #: Pieces before the end that later text may still change ("'", "r" + "e").
    UNSETTLED = 3

    def __init__(self, encoder: PrefixEncoder, text: str = ""):
        self.e, self.text, self.pieces = encoder, "", []
        self.encoded_bytes = 0
        self.append(text)

    def _piece(self, s: str, old: tuple | None = None) -> tuple[str, list[int]]:
        b = s.encode("utf-8")
        known = None
        if old is not None and s.startswith(old[0]):
            known = old[1]
        self.encoded_bytes += len(b) - len(known or ())
        return s, self.e.piece_prefixes(b, known)

    def append(self, more: str) -> TokenBuffer:
        keep = max(0, len(self.pieces) - self.UNSETTLED)
        tail = self.pieces[keep:]
        old = dict(enumerate(tail))
        again = self.e.split("".join(p for p, _ in tail) + more)
        self.pieces[keep:] = [self._piece(s, old.get(i)) for i, s in enumerate(again)]
        self.text += more
        return self

    def replace(self, start: int, end: int, new: str) -> TokenBuffer:
        """Put ``new`` in place of the characters from ``start`` to before ``end``."""
        text = self.text[:start] + new + self.text[end:]
        at, first = 0, 0
        while first < len(self.pieces) and at + len(self.pieces[first][0]) <= start:
            at += len(self.pieces[first][0])
            first += 1
        back = max(0, first - self.UNSETTLED)
        at -= sum(len(p) for p, _ in self.pieces[back:first])
        borders, pos = {}, 0
        for i, (p, _) in enumerate(self.pieces):
            if pos >= end:
                borders[pos + len(new) - (end - start)] = i
            pos += len(p)
        made, resume = [], len(self.pieces)
        for m in regex.finditer(PATTERN, text[at:]):
            here = at + m.start()
            if here >= start + len(new) and here in borders:
                resume = borders[here]
                break
            made.append(self._piece(m.group()))
        self.pieces[back:resume] = made
        self.text = text
        return self

    @property
    def ids(self) -> list[int]:
        return list(chain.from_iterable(self.e.ids_from_prefixes(p) for _, p in self.pieces))


@lru_cache(maxsize=4)
def encoder_for(data: bytes) -> PrefixEncoder:
    """This process's encoder for a vocabulary; its tables serve all batches."""
    return PrefixEncoder(_vocabulary(data))


def encoder_in_turn(data: bytes) -> PrefixEncoder:
    """``encoder_for``, for use in a worker that other operators use too."""
    e = encoder_for(data)
    take_turn("bpe", e.clear)
    return e


def list_array(values: np.ndarray, lengths: np.ndarray, missing: np.ndarray) -> pa.ListArray:
    """Runs of ``values`` as Arrow lists of 32-bit integers."""
    ends = np.cumsum(lengths, dtype=np.int64)
    if len(ends) and ends[-1] >= 1 << 31:
        raise ValueError("over 2^31 ids in one batch: lower spark.sql.execution.arrow.maxRecordsPerBatch")
    offsets = np.zeros(len(ends) + 1, np.int32)
    offsets[1:] = ends
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.ascontiguousarray(values, np.int32)), mask=pa.array(missing, pa.bool_()))


def id_lists(packed: list[bytes | None]) -> pa.ListArray:
    """Packed ids of several texts as Arrow lists."""
    lengths = np.fromiter((0 if p is None else len(p) >> 2 for p in packed), np.int64, len(packed))
    return list_array(np.frombuffer(b"".join(p for p in packed if p), np.int32), lengths, np.array([p is None for p in packed], bool))


def encode_column(text: Column, path: str = DEFAULT_VOCABULARY) -> Column:
    """Token ids of a text column."""
    data = read_vocabulary(path)

    @F.arrow_udf("array<int>")
    def encode_ids(batch: pa.Array) -> pa.Array:
        e = encoder_in_turn(data)
        parts = [e.encode_array(lot) for lot in lots(batch, LOT_BYTES)]
        out = _as_lists(batch, parts)
        give_back()
        return out

    return encode_ids(text)


def _as_lists(texts: pa.Array, parts: list[tuple[np.ndarray, np.ndarray]]) -> pa.ListArray:
    sizes = np.concatenate([*(p[1] for p in parts), np.zeros(0, np.int64)])
    ids = np.concatenate([*(p[0] for p in parts), np.zeros(0, np.int32)], dtype=np.int32)
    parts.clear()  # the ids of a batch are large
    return list_array(ids, sizes, texts.is_null().to_numpy(zero_copy_only=False))


def decode_column(ids: Column, path: str = DEFAULT_VOCABULARY) -> Column:
    """The text of a token id column."""
    data = read_vocabulary(path)

    @F.arrow_udf("string")
    def decode_ids(batch: pa.Array) -> pa.Array:
        e = encoder_in_turn(data)
        return pa.array(_decoded(batch, e), pa.string())

    return decode_ids(ids)


def _decoded(batch: pa.ListArray, e: PrefixEncoder) -> list[str | None]:
    flat = batch.flatten()
    holes = np.flatnonzero(flat.is_null().to_numpy(zero_copy_only=False))
    ids = flat.fill_null(0).to_numpy(zero_copy_only=False)
    out, at = [], 0
    for n in batch.value_lengths().to_pylist():
        whole = n is not None and np.searchsorted(holes, at) == np.searchsorted(holes, at + n)
        out.append(e.decode(ids[at : at + n]) if whole else None)
        at += n or 0
    return out


def same_as_decoded(texts: pa.Array, ids: np.ndarray, sizes: np.ndarray, e: PrefixEncoder) -> np.ndarray:
    """Whether the ids of each text decode to its bytes."""
    had = np.frombuffer(b"".join(texts.fill_null("").cast(pa.binary()).to_numpy(zero_copy_only=False)), np.uint8)
    ends = np.cumsum(pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
    stops = np.cumsum(sizes)
    upto = np.r_[0, np.cumsum(e.v.n_bytes[ids])][stops]
    same = np.zeros(len(texts), bool)
    at = 0
    while at < len(texts):
        byte, token = (int(x[at - 1]) if at else 0 for x in (ends, stops))
        decoded = int(upto[at - 1]) if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, byte + PIECE_BYTES)))
        got, own = e.decode_bytes(ids[token : stops[stop - 1]]), had[byte : ends[stop - 1]]
        a, b = upto[at:stop] - decoded, ends[at:stop] - byte
        if (a == b).all():
            wrong = np.searchsorted(b, np.flatnonzero(got != own), "right")
            same[at:stop] = True
            same[at + wrong] = False
        else:
            same[at:stop] = [got[i:j].tobytes() == own[k:l].tobytes() for i, j, k, l in zip(np.r_[0, a[:-1]], a, np.r_[0, b[:-1]], b)]
        at = stop
    return same


def round_trip_column(text: Column, path: str = DEFAULT_VOCABULARY) -> Column:
    """``token_ids`` and ``round_trip``, whether decoding them gives the text again; both in one
    pass, where two columns would encode twice."""
    data = read_vocabulary(path)

    @F.arrow_udf("struct<token_ids: array<int>, round_trip: boolean>")
    def there_and_back(batch: pa.Array) -> pa.Array:
        e = encoder_in_turn(data)
        parts, same = [], [np.zeros(0, bool)]
        for lot in lots(batch, LOT_BYTES):
            parts.append(e.encode_array(lot))
            same.append(same_as_decoded(lot, *parts[-1], e))
        agree = pa.array(np.concatenate(same), pa.bool_(), mask=batch.is_null().to_numpy(zero_copy_only=False))
        out = pa.StructArray.from_arrays([_as_lists(batch, parts), agree], ["token_ids", "round_trip"])
        give_back()
        return out

    return there_and_back(text)


def encode_and_decode(df: DataFrame, text: str = "text", ids: str = "token_ids", same: str = "round_trip", path: str = DEFAULT_VOCABULARY) -> DataFrame:
    """``df`` with the token ids of ``text`` and whether they decode to it."""
    require(df, text)
    kept = without(df, ids, same).columns
    (r,) = fresh(df, "r")
    coded = df.select(*[q(c) for c in kept], round_trip_column(q(text), path).alias(r))
    return coded.select(*[q(c) for c in kept], q(r)["token_ids"].alias(ids), q(r)["round_trip"].alias(same))


def encode(df: DataFrame, text: str = "text", out: str = "token_ids", path: str = DEFAULT_VOCABULARY) -> DataFrame:
    """``df`` with the token ids of ``text`` in ``out``."""
    require(df, text)
    kept = [q(c) for c in without(df, out).columns]
    return df.select(*kept, encode_column(q(text), path).alias(out))


def decode(df: DataFrame, ids: str = "token_ids", out: str = "text", path: str = DEFAULT_VOCABULARY) -> DataFrame:
    """``df`` with the text of ``ids`` in ``out``."""
    require(df, ids)
    kept = [q(c) for c in without(df, out).columns]
    return df.select(*kept, decode_column(q(ids), path).alias(out))
