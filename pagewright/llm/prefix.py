"""The prefix tables of many pieces at once, in vector arithmetic.

For all places of all pieces the tokens that begin there are found by walking a trie, each step for all
places that are still on it. Then the prefixes are settled in order of their length, those of all
pieces together: a token that ends a prefix is its last token iff it may follow the last
token of the prefix before it, and exactly one token does.
"""

from __future__ import annotations

import numpy as np

_ODD = np.uint64(0x9E3779B97F4A7C15)


class Table:
    """Non-negative integers to integers, for arrays of keys: open addressing; -1 for what is not there."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(4, int(2 * len(keys)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.values = np.full(1 << bits, -1, np.int64), np.full(1 << bits, -1, np.int64)
        slot, left = self._slot(keys), np.arange(len(keys))
        while len(left):
            free = left[self.keys[slot[left]] < 0]
            self.keys[slot[free]] = keys[free]  # of several that want a slot the last gets it
            lost = self.keys[slot[left]] != keys[left]
            here = left[~lost]
            self.values[slot[here]] = values[here]
            left = left[lost]
            slot[left] = (slot[left] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * _ODD) >> self.shift).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        slot = self._slot(keys)
        there = self.keys[slot]
        out = np.where(there == keys, self.values[slot], -1)
        left = np.flatnonzero((there != keys) & (there >= 0))
        while len(left):
            slot[left] = (slot[left] + 1) & self.mask
            there, k = self.keys[slot[left]], keys[left]
            same = there == k
            out[left[same]] = self.values[slot[left[same]]]
            left = left[~same & (there >= 0)]
        return out


class PrefixTables:
    """``split`` maps a token to the two that its last merge joins (itself twice if there is none),
    ``merge`` a pair to the token that it becomes."""

    #: Pairs whose answer is kept, in a table of fixed size in which later ones displace earlier ones.
    KEPT = 1 << 20

    def __init__(self, ranks: dict[bytes, int], split: dict[int, tuple[int, int]], merge: dict[tuple[int, int], int]):
        base = max(ranks.values()) + 1
        self.base = base
        self.first, self.second = np.zeros(base, np.int64), np.zeros(base, np.int64)
        for t, (a, b) in split.items():
            self.first[t], self.second[t] = a, b
        self.merge = Table(np.array([a * base + b for a, b in merge], np.int64), np.array(list(merge.values()), np.int64))
        edges: dict[int, int] = {}
        tokens = [-1]
        for token, rank in ranks.items():
            node = 0
            for byte in token:
                node = edges.setdefault(node << 8 | byte, len(tokens))
                if node == len(tokens):
                    tokens.append(-1)
            tokens[node] = rank
        self.token = np.array(tokens, np.int64)
        self.edge = Table(np.array(list(edges), np.int64), np.array(list(edges.values()), np.int64))
        self.one = np.full(256, -1, np.int64)
        self.two = np.full(1 << 16, -1, np.int64)
        for key, node in edges.items():
            if key < 256:
                self.one[key] = node
        pairs = np.arange(1 << 16)
        start = self.one[pairs >> 8]
        self.two[start >= 0] = self.edge(start[start >= 0] << 8 | pairs[start >= 0] & 255)
        self.known, self.answer = np.full(self.KEPT, -1, np.int64), np.zeros(self.KEPT, bool)

    # -- which token may follow which --------------------------------------
    def check(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether ``left, right`` is how the bytes of both are encoded together: the later of the two
        border tokens is undone again and again; were they ever mergeable at a rank before the one that
        was undone last, the encoder would have crossed the border."""
        ok = np.ones(len(left), bool)
        at, limit = np.arange(len(left)), np.full(len(left), 1 << 62)
        while len(at):
            merged = self.merge(left * self.base + right)
            crossed = (merged >= 0) & (merged < limit)
            ok[at[crossed]] = False
            whole_l, whole_r = self.first[left] == left, self.first[right] == right
            go = ~crossed & ~(whole_l & whole_r)
            at, left, right, limit, whole_l, whole_r = (x[go] for x in (at, left, right, limit, whole_l, whole_r))
            undo_left = whole_r | (~whole_l & (left > right))
            limit = np.where(undo_left, left, right + 1)
            left, right = np.where(undo_left, self.second[left], left), np.where(undo_left, right, self.first[right])
        return ok

    def follows(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * self.base + right
        slot = ((key.astype(np.uint64) * _ODD) >> np.uint64(44)).astype(np.int64)
        ok = self.answer[slot]
        ask = np.flatnonzero(self.known[slot] != key)
        if len(ask):
            new, which = np.unique(key[ask], return_inverse=True)
            found = self.check(new // self.base, new % self.base)
            ok[ask] = found[which]
            at = ((new.astype(np.uint64) * _ODD) >> np.uint64(44)).astype(np.int64)
            # written twice: of pairs that share a slot the same one has to win in both arrays
            self.known[at] = new
            mine = self.known[at] == new
            self.answer[at[mine]] = found[mine]
        return ok

    # -- pieces --------------------------------------------------------------
    def tokens_from(self, data: np.ndarray, room: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, length and token of all tokens in ``data`` that end within ``room`` of their start."""
        at = np.arange(len(data))
        single = self.token[self.one[data]]
        found = [(at[single >= 0], 1, single[single >= 0])]
        at = np.flatnonzero(room >= 2)
        node = self.two[data[at].astype(np.int64) << 8 | data[at + 1]]
        n = 2
        while len(at):
            on = node >= 0
            at, node = at[on], node[on]
            t = self.token[node]
            found.append((at[t >= 0], n, t[t >= 0]))
            more = room[at] > n
            at, node = at[more], node[more]
            node = self.edge(node << 8 | data[at + n])
            n += 1
        starts, tokens = (np.concatenate([f[k] for f in found]) for k in (0, 2))
        return starts, np.repeat([f[1] for f in found], [len(f[0]) for f in found]), tokens

    def encode(self, data: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces one after the other, and the number of each piece's ids. ``data`` are the
        pieces' bytes; none is empty."""
        ends = np.cumsum(lengths)
        begins = ends - lengths
        piece = np.repeat(np.arange(len(lengths)), lengths)
        inside = np.arange(len(data)) - begins[piece]
        start, n, token = self.tokens_from(data, ends[piece] - np.arange(len(data)))
        size = (inside[start] + n).astype(np.int32)
        order = np.argsort(size.astype(np.uint16) if len(size) and int(size.max()) < 1 << 16 else size, kind="stable")
        start, n, token = start[order], n[order], token[order]
        borders = np.r_[0, np.cumsum(np.bincount(size))]
        last, count, whence = np.full(len(data), -1, np.int64), np.zeros(len(data), np.int64), np.zeros(len(data), np.int64)
        for a, b in zip(borders[1:-1].tolist(), borders[2:].tolist()):
            s, t = start[a:b], token[a:b]
            end = s + n[a:b] - 1
            opening = inside[s] == 0
            before = last[s - 1]
            ok = opening.copy()
            other = np.flatnonzero(~opening & (before >= 0))
            ok[other] = self.follows(before[other], t[other])
            s, t, end, opening = s[ok], t[ok], end[ok], opening[ok]
            last[end], whence[end] = t, s
            count[end] = np.where(opening, 1, count[s - 1] + 1)
        # a piece that is a token itself is that token
        whole = (inside[start] == 0) & (n == lengths[piece[start]])
        end = start[whole] + n[whole] - 1
        last[end], whence[end], count[end] = token[whole], start[whole], 1
        if (last < 0).any():
            raise ValueError("no token ends a prefix: the vocabulary lacks bytes")
        sizes = count[ends - 1]
        upto = np.cumsum(sizes)
        out = np.empty(int(upto[-1]) if len(upto) else 0, np.int32)
        at, place = ends - 1, upto - 1
        while len(at):
            out[place] = last[at]
            go = whence[at] > begins[piece[at]]
            at, place = whence[at[go]] - 1, place[go] - 1
        return out, sizes
