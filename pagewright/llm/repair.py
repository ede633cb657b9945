"""Token-id output compressed by Re-Pair grammars.

Documents become token ids and are gathered into shards of about ``shard_tokens`` ids. In each
shard, pairs of neighbouring ids that are frequent are replaced by new ids (nonterminals), again
and again, until no pair is left that occurs ``min_count`` times. Pairs go in batches: a limit
falls from the count of the most frequent pair by factors of ``STEP`` to ``min_count``, and all pairs
that reach it are replaced, those made by the replacements too, before it falls again. Where
two such pairs overlap, the more frequent wins and the other is counted anew. Pairs never reach
across documents, so each document keeps a symbol sequence of its own.

All places of a pair come into being in one turn, when the younger of its two symbols is made, and
only become fewer later. So places are sorted by pair once when they are new, and once more when the limit
has come down to the count that the pair had then; places that have changed meanwhile are left out.

A shard's rules are stored as left and right parts and expansion lengths. With the lengths any
range of tokens is found without expanding what lies before it (``Grammar.slice``).

A shard is a run of documents of one input partition, so nothing is shuffled; to compress by
a shard column instead, rows are grouped by it. Ids are those of the byte-level vocabulary, made
by a public tokenizer library: this operator's subject is the output, ``bpe`` has the encoder.

Output: rows of kind ``document`` (doc_id, n_tokens, symbols) and, for each shard, one of kind
``rules`` (first_rule, lefts, rights, lengths; rule r makes the symbol first_rule + r).

Edge cases: NULL text gives NULL symbols and NULL n_tokens, the empty text an empty sequence. NULL
and repeated ids are kept, each row is a document; ids keep their type. A document longer than a shard fills
one by itself. An empty table gives an empty one. Extra columns are ignored.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from pagewright.llm.bpe import DEFAULT_VOCABULARY, PATTERN, id_lists, list_array, read_vocabulary, vocabulary
from pagewright.llm.common import give_back, q, require
from pagewright.llm.words import LOT_BYTES, in_one_call, lots, tokenise

SHARD_TOKENS = 1_000_000
#: A rule is three numbers, so it pays from four uses on.
MIN_COUNT = 4
STEP = 4


# -- ids -------------------------------------------------------------------------------------


class IdSource:
    """Texts -> ids, by a public tokenizer library; only distinct words are encoded."""

    def __init__(self, data: bytes):
        v = vocabulary(data)
        self.encode = tiktoken.Encoding("ids", pat_str=PATTERN, mergeable_ranks=v, special_tokens={}).encode_ordinary
        self.first_rule = max(v.values()) + 1
        self.token_bytes = np.zeros(self.first_rule, np.int64)
        self.token_bytes[list(v.values())] = list(map(len, v))

    def pack(self, text: str) -> bytes:
        return array("i", self.encode(text)).tobytes()

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        return tokenise(texts, lambda w: in_one_call(w, self.encode, self.token_bytes), lambda h: list(map(self.pack, h)), self.pack)


@lru_cache(maxsize=2)
def id_source(data: bytes) -> IdSource:
    return IdSource(data)


# -- grammar ---------------------------------------------------------------------------------


@dataclass(frozen=True)
class Grammar:
    """Rule r makes symbol ``first + r`` of ``left[r]`` and ``right[r]``, ``length[r]`` tokens long."""

    first: int
    left: np.ndarray
    right: np.ndarray
    length: np.ndarray

    def lengths(self, symbols: np.ndarray) -> np.ndarray:
        out = np.ones(len(symbols), np.int64)
        made = symbols >= self.first
        out[made] = self.length[symbols[made] - self.first]
        return out

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        """All tokens: rules are undone for the whole sequence, newest first by levels."""
        s = np.asarray(symbols, np.int64)
        while len(s):
            made = s >= self.first
            if not made.any():
                break
            out = np.empty(len(s) + int(made.sum()), np.int64)
            at = np.arange(len(s)) + np.cumsum(made) - made
            out[at[~made]] = s[~made]
            r = s[made] - self.first
            out[at[made]], out[at[made] + 1] = self.left[r], self.right[r]
            s = out
        return s

    def slice(self, symbols: np.ndarray, start: int, stop: int) -> np.ndarray:
        """Tokens ``start`` to before ``stop``, expanding only what overlaps them."""
        symbols = np.asarray(symbols, np.int64)
        ends = np.cumsum(self.lengths(symbols))
        total = int(ends[-1]) if len(ends) else 0
        start, stop = max(0, start), min(stop, total)
        if start >= stop:
            return np.zeros(0, np.int64)
        a, b = int(np.searchsorted(ends, start, "right")), int(np.searchsorted(ends, stop, "left"))
        begin = int(ends[a - 1]) if a else 0
        out: list[int] = []
        stack = [(int(x), None) for x in symbols[a : b + 1][::-1]]
        at = begin
        while stack:
            x, _ = stack.pop()
            n = int(self.length[x - self.first]) if x >= self.first else 1
            if at + n <= start or at >= stop:
                at += n
            elif x < self.first:
                out.append(x)
                at += 1
            else:
                r = x - self.first
                stack += [(int(self.right[r]), None), (int(self.left[r]), None)]
        return np.array(out, np.int64)


def compress(ids: np.ndarray, ends: np.ndarray, first: int, min_count: int = MIN_COUNT, step: int = STEP) -> tuple[np.ndarray, np.ndarray, Grammar]:
    """Symbols, the ends of the documents among them, and the grammar. ``ends`` are the documents'
    ends among ``ids``; ``first`` is above all ids."""
    n = len(ids)
    present = np.zeros(first, bool)
    present[ids] = True
    names = np.flatnonzero(present)  # symbols are numbered without gaps: a pair is a small number
    seq = (np.cumsum(present, dtype=np.int32) - 1)[ids]
    begins = np.r_[0, ends[:-1]] if len(ends) else ends
    full = ends > begins
    # the sequence is a linked list: nothing is moved when a symbol goes
    after, before = np.arange(1, n + 1, dtype=np.int64), np.arange(-1, n, dtype=np.int64)
    after[ends[full] - 1], before[begins[full]] = n, -1
    gone_at = np.iinfo(np.int32).max
    changed = np.zeros(n, np.int32)  # the turn that last changed the pair at a place
    taken = np.zeros(n, bool)
    new = np.flatnonzero(after < n)
    lefts, rights = [], []
    base, turn = len(names), 0
    limits: list[int] = []
    put_off: list[list[tuple[int, np.ndarray]]] = []
    level = 0
    while len(new) or level + 1 < len(limits):
        turn += 1
        if not len(new):
            level += 1
            parts = [p[changed[p] <= t] for t, p in put_off[level]]
            put_off[level] = []
            new = np.concatenate(parts) if parts else new
            continue
        key, p = _sorted_pairs(seq[new], seq[after[new]], new, base)
        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        counts = np.diff(np.r_[starts, len(key)])
        if not limits:
            limits = [max(min_count, int(counts.max()) // step)]
            while limits[-1] > min_count:
                limits.append(max(min_count, limits[-1] // step))
            put_off = [[] for _ in limits]
        at_level = np.searchsorted(-np.array(limits), -counts, "left")
        for later in np.unique(at_level[(at_level > level) & (counts >= min_count)]).tolist():
            put_off[later].append((turn, p[np.repeat(at_level == later, counts)]))
        often = at_level <= level
        chosen, many = key[starts[often]], counts[often]
        every = p[np.repeat(often, counts)]
        where, of = _by_place(every, many)
        if (chosen // base == chosen % base).any():  # pairs of one symbol overlap themselves in its runs
            where, of = _runs_apart(where, of, after)
            many = np.bincount(of, minlength=len(chosen))
            where, of = where[many[of] >= 2], of[many[of] >= 2]
        where, of = _apart(where, of, after, many)
        worth = np.bincount(of, minlength=len(chosen)) >= 2
        if not worth.all():
            keep = worth[of]
            where, of = where[keep], of[keep]
        if not len(where):
            new = where
            continue
        name = (np.cumsum(worth) - 1 + base).astype(np.int32)
        lefts.append(chosen[worth] // base)
        rights.append(chosen[worth] % base)
        base += int(worth.sum())
        gone = after[where]
        then = after[gone]
        seq[where] = name[of]
        after[where], before[then] = then, where
        prev = before[where]
        prev = prev[prev >= 0]
        changed[prev] = changed[where] = turn + 1
        changed[gone] = gone_at
        taken[where] = True
        # what lost its place to a pair that then was not worth a rule is looked at again
        new = np.concatenate([where, prev[~taken[prev]], every[changed[every] <= turn]])
        taken[where] = False
        new = new[after[new] < n]
    stay = changed < gone_at
    to_id = np.concatenate([names, np.arange(first, first + base - len(names))])
    none = [np.zeros(0, np.int64)]
    left, right = (to_id[np.concatenate(x or none)] for x in (lefts, rights))
    return to_id[seq[stay]], np.r_[0, np.cumsum(stay)][ends], Grammar(first, left, right, _lengths(first, left, right, [len(x) for x in lefts]))


def _lengths(first: int, left: np.ndarray, right: np.ndarray, turns: list[int]) -> np.ndarray:
    length, at = np.ones(first + len(left), np.int64), 0
    for n in turns:  # the rules of a turn are made of those before it
        length[first + at : first + at + n] = length[left[at : at + n]] + length[right[at : at + n]]
        at += n
    return length[first:]


def _sorted_pairs(a: np.ndarray, b: np.ndarray, place: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs as numbers a * base + b in order, and the place of each."""
    key = a.astype(np.uint64)
    key *= np.uint64(base)
    key += b.astype(np.uint64)
    if base <= 65536 and (not len(place) or int(place.max()) < 1 << 32):  # pair and place fit one word: sorting plain words is fastest
        key <<= np.uint64(32)
        key |= place.astype(np.uint64)
        key.sort()
        return (key >> np.uint64(32)).astype(np.int64), (key & np.uint64(0xFFFFFFFF)).astype(np.int64)
    order = np.lexsort((place, key))
    return key[order].astype(np.int64), place[order]


def _by_place(places: np.ndarray, many: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in order and, for each, which of the pairs (``many`` places each) is there."""
    of = np.repeat(np.arange(len(many)), many)
    if len(places) and int(places.max()) >= 1 << 32:
        order = np.argsort(places, kind="stable")
        return places[order], of[order]
    word = places.astype(np.uint64) << np.uint64(32)
    word |= of.astype(np.uint64)
    word.sort()
    return (word >> np.uint64(32)).astype(np.int64), (word & np.uint64(0xFFFFFFFF)).astype(np.int64)


def _runs_apart(at: np.ndarray, which: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places without those where a pair of one symbol overlaps itself: of a run every second stays."""
    if len(at) < 2:
        return at, which
    follows = np.flatnonzero((which[1:] == which[:-1]) & (at[1:] == after[at[:-1]])) + 1
    if len(follows):
        own = np.arange(len(follows))
        begins = np.r_[True, follows[1:] != follows[:-1] + 1]
        place = own - np.maximum.accumulate(np.where(begins, own, 0))  # 0 for the second of a run
        stay = np.ones(len(at), bool)
        stay[follows[place % 2 == 0]] = False
        at, which = at[stay], which[stay]
    return at, which


def _apart(at: np.ndarray, which: np.ndarray, after: np.ndarray, many: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Those of the places that overlap no better one: of two pairs the more frequent, at a tie the
    one that comes first."""
    if len(at) < 2:
        return at, which
    touch = np.flatnonzero(at[1:] == after[at[:-1]])
    if not len(touch):
        return at, which
    rank = np.empty(len(many), np.int64)
    rank[np.argsort(-many, kind="stable")] = np.arange(len(many))
    first, second = rank[which[touch]], rank[which[touch + 1]]
    good = np.ones(len(at), bool)
    good[touch[first >= second]] = False
    good[touch[second >= first] + 1] = False
    return at[good], which[good]


# -- shards ----------------------------------------------------------------------------------

_REST = "n_tokens bigint, symbols array<int>, first_rule int, lefts array<int>, rights array<int>, lengths array<int>"
_INTS = pa.list_(pa.int32())


def output_schema(id_kind: str = "bigint") -> str:
    return f"shard bigint, kind string, doc_id {id_kind}, {_REST}"


def _shard(shard: int, ids: pa.Array, missing: np.ndarray, tokens: np.ndarray, sizes: np.ndarray, first: int, min_count: int) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in output_schema().split(", ")]
    seq, ends, g = compress(tokens, np.cumsum(sizes), first, min_count)
    n, nothing = len(ids), pa.nulls
    yield pa.RecordBatch.from_arrays([pa.array([shard] * n, pa.int64()), pa.array(["document"] * n), ids, pa.array(sizes, pa.int64(), mask=missing), list_array(seq, np.diff(np.r_[0, ends]), missing), nothing(n, pa.int32()), *[nothing(n, _INTS)] * 3], names)
    rules = [pa.array([x.astype(np.int32)], _INTS) for x in (g.left, g.right, g.length)]
    yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int64()), pa.array(["rules"]), nothing(1, ids.type), nothing(1, pa.int64()), nothing(1, _INTS), pa.array([first], pa.int32()), *rules], names)


class _Shards:
    """Gathers documents until a shard is full."""

    def __init__(self, make: IdSource, shard_tokens: int, min_count: int):
        self.make, self.full, self.min_count = make, shard_tokens, min_count
        self.held: list[tuple] = []
        self.size = 0

    def add(self, ids: pa.Array, texts: pa.Array) -> Iterator[tuple]:
        """The arguments of each shard that became full."""
        at = 0
        for lot in lots(texts, 2 * LOT_BYTES):
            tokens, sizes = self.make(lot)
            missing = lot.is_null().to_numpy(zero_copy_only=False)
            upto = np.cumsum(sizes)
            a = 0  # documents and tokens of the lot that have been handed on
            while a < len(lot):
                begun = int(upto[a - 1]) if a else 0
                b = min(int(np.searchsorted(upto, begun + self.full - self.size, "left")) + 1, len(lot))
                stop = int(upto[b - 1])
                self.held.append((ids.slice(at + a, b - a), missing[a:b], tokens[begun:stop], sizes[a:b]))
                self.size += stop - begun
                a = b
                if self.size >= self.full:
                    yield self.take()
            at += len(lot)

    def take(self) -> tuple:
        ids, missing, tokens, sizes = zip(*self.held)
        self.held, self.size = [], 0
        return pa.concat_arrays(ids), np.concatenate(missing), np.concatenate(tokens), np.concatenate(sizes), self.make.first_rule, self.min_count


def compress_documents(df: DataFrame, text: str = "text", doc_id: str = "doc_id", shard: str | None = None, vocabulary_path: str = DEFAULT_VOCABULARY, shard_tokens: int = SHARD_TOKENS, min_count: int = MIN_COUNT) -> DataFrame:
    """Documents as symbol sequences and the rules of each shard; see the module's text."""
    require(df, text, doc_id, *([shard] if shard else []))
    if min_count < 2:
        raise ValueError("min_count is at least 2")
    data = read_vocabulary(vocabulary_path)
    schema = output_schema(df.select(q(doc_id)).schema[0].dataType.simpleString())

    if shard:
        id_type = to_arrow_type(df.select(q(doc_id)).schema[0].dataType)

        def group(t: pa.Table) -> pa.Table:
            all_ = _Shards(id_source(data), 1 << 62, min_count)
            for b in t.to_batches():
                for _ in all_.add(b.column(1), b.column(2)):
                    pass
            return pa.Table.from_batches(list(_shard(t.column(0)[0].as_py(), *all_.take()))).cast(_arrow(id_type))

        rows = df.select(q(shard).cast("bigint").alias("shard"), q(doc_id).alias("doc_id"), q(text).alias("text"))
        return rows.groupBy("shard").applyInArrow(group, schema)

    def partition(batches):
        gather = _Shards(id_source(data), shard_tokens, min_count)
        number, name = 0, 0
        for b in batches:
            name = b.column(0)[0].as_py() if b.num_rows else name
            for full in gather.add(b.column(1), b.column(2)):
                yield from _shard((name << 32) + number, *full)
                give_back()
                number += 1
        if gather.held:
            yield from _shard((name << 32) + number, *gather.take())
        give_back()

    rows = df.select(F.spark_partition_id().cast("bigint").alias("part"), q(doc_id).alias("doc_id"), q(text).alias("text"))
    return rows.mapInArrow(partition, schema)


def _arrow(id_type: pa.DataType) -> pa.Schema:
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "array<int>": _INTS}
    rest = [(c.split()[0], kinds[c.split()[1]]) for c in _REST.split(", ")]
    return pa.schema([("shard", pa.int64()), ("kind", pa.string()), ("doc_id", id_type), *rest])


def decompress(df: DataFrame) -> DataFrame:
    """``shard``, ``doc_id``, ``token_ids`` from the rows of ``compress_documents``; the rules of a
    shard meet its documents by a join on the shard."""
    docs = df.where("kind = 'document'").select("shard", "doc_id", "symbols")
    rules = df.where("kind = 'rules'").select("shard", "first_rule", "lefts", "rights", "lengths")

    @F.arrow_udf("array<int>")
    def expand(symbols: pa.Array, first: pa.Array, left: pa.Array, right: pa.Array, length: pa.Array) -> pa.Array:
        out = []
        for s, f, *parts in zip(symbols, first, left, right, length):
            if not s.is_valid:
                out.append(None)
                continue
            g = Grammar(f.as_py(), *(np.asarray(p.values, np.int64) for p in parts))
            out.append(g.expand(np.asarray(s.values, np.int64)).astype("<i4").tobytes())
        return id_lists(out)

    return docs.join(rules, "shard").select("shard", "doc_id", expand("symbols", "first_rule", "lefts", "rights", "lengths").alias("token_ids"))
