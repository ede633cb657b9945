"""SimHash near-deduplication by the generalised pigeonhole principle.

Each document gets a 64-bit SimHash over its distinct words (weight: square root of the
count) and a 128-bit one over its distinct word pairs. Two documents are near copies iff the
first differ in at most ``tau`` bits and the second in at most ``tau_pairs``.

All pairs within ``tau`` bits are found, none is left to chance. The bits are ordered so that
correlated ones lie together and cut into m partitions with thresholds t_i >= -1 whose
sum of (t_i + 1) is tau + 1: two hashes within tau bits are then within t_i bits in some
partition i. m and the unequal thresholds come from a dynamic programme that weighs the rows
to shuffle against the candidates to verify; these are estimated from the collisions
counted, over all hashes, in each partition, so that narrow partitions serve small tables and
wide ones large tables. A partition is probed by its values: both partners list the values
within half of t_i bits of their own, and meet in the middle. The lists are shuffled and sorted by
value, and the candidates that meet at one are verified by vector arithmetic on the number
of differing bits; what is left is verified by the word-pair hashes. Two partitions of 32 bits are
what the programme chooses for very many hashes.

A value that ``HOT`` hashes or more have makes all values near it hot: the rows listed there are dealt into
blocks, and each pair of blocks is a task's group of its own, so none gets all rows of a hot value.

Equal hashes are one node, so a thousand exact copies cost no pairs. Groups are the connected
components of the pairs (alternating large-star and small-star, each round written to the
shared folder); of each group the document with the smallest id stays.

Edge cases: documents without a word (NULL, empty, punctuation only) and those with a NULL id
are near to nothing and stay. Rows that share an id are one document, they stay or go
together. Extra columns pass through. An empty table gives an empty one.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.llm.common import fresh, give_back, materialise, q, remove, require, scratch_path, take_turn

BITS = 64
TAU = 9
TAU_PAIRS = 44
PARTITIONS = (2, 3, 4, 5, 6)
#: Relative costs of a row to list and shuffle (about a microsecond), and of a candidate to verify.
COST_ROW, COST_CANDIDATE = 1.0, 0.004
#: Hashes that share a value of a partition from which on it is cut into blocks of so many.
HOT = 20_000
#: Cost units for a task of the probe.
TASK_COST = 2_000_000
#: Ids (some 40 bytes each as a hash table) up to which a table is broadcast.
BROADCAST_ROWS = 500_000
WORD_CACHE = 150_000

_NOT_WORD = re.compile(r"[\W_]+")


class _Words(dict):
    """Blank-separated token -> hash of its letters and digits in lower case; 0 without any."""

    def __missing__(self, token: str) -> int:
        if len(self) > WORD_CACHE:
            self.clear()
        word = token.lower()
        if not word.isalnum():
            word = _NOT_WORD.sub("", word)
        h = xxhash.xxh3_64_intdigest(word.encode("utf-8", "replace")) if word else 0
        if len(token) <= 64:
            self[token] = h
        return h


@lru_cache(maxsize=1)
def _words() -> _Words:
    return _Words()


def _mix(h: np.ndarray, k: int) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(k)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def _majority(hashes: np.ndarray, weights: np.ndarray | None = None) -> np.uint64:
    """Bit b is 1 iff features of more than half the weight have it."""
    bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    if weights is None:
        ones = bits.sum(axis=0, dtype=np.int64) * 2 > len(hashes)
    else:
        ones = weights @ bits * 2 > weights.sum()
    return np.packbits(ones, bitorder="little").view("<u8")[0]


def fingerprint(text: str | None) -> tuple[int, int, int] | None:
    """The word SimHash and the two halves of the word-pair SimHash, as signed 64-bit integers."""
    tokens = text.split() if text else ()
    words = np.fromiter(map(_words().__getitem__, tokens), np.uint64, len(tokens))
    words = words[words != 0]
    if not len(words):
        return None
    distinct, counts = np.unique(words, return_counts=True)
    # integral weights: sums are exact in any order
    s = _majority(distinct, np.floor(np.sqrt(counts) * 256))
    pairs = np.unique(_mix(words[:-1] * np.uint64(0x9E3779B97F4A7C15) + words[1:], 0xBF58476D1CE4E5B9)) if len(words) > 1 else words
    v1, v2 = _majority(pairs), _majority(_mix(pairs, 0xD6E8FEB86659FD93))
    return tuple(int(x.astype(np.int64)) for x in (s, v1, v2))


def fingerprint_column(text: Column) -> Column:
    """``fingerprint`` of a text column, as a struct."""

    @F.arrow_udf("struct<s: bigint, v1: bigint, v2: bigint>")
    def prints(batch: pa.Array) -> pa.Array:
        take_turn("simhash", _words().clear)
        found = []
        for k in range(0, len(batch), 256):
            found += map(fingerprint, batch.slice(k, 256).to_pylist())
        missing = pa.array([f is None for f in found], pa.bool_())
        columns = [pa.array([None if f is None else f[k] for f in found], pa.int64()) for k in range(3)]
        give_back()
        return pa.StructArray.from_arrays(columns, ["s", "v1", "v2"], mask=missing)

    return prints(text)


def differing(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


# -- bits: statistics, order, thresholds -----------------------------------------------------


def bit_statistics(hashes: DataFrame, column: str) -> np.ndarray:
    """How often bits i and j are 1 together, for all i, j, over all rows."""

    def count(batches):
        total = np.zeros((BITS, BITS), np.int64)
        for b in batches:
            h = b.column(0).to_numpy(zero_copy_only=False).astype("<i8")
            for k in range(0, len(h), 65536):
                bits = np.unpackbits(h[k : k + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
                total += (bits.T @ bits).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(range(BITS * BITS)), pa.array(total.ravel())], ["cell", "n"])

    cells = hashes.select(q(column)).mapInArrow(count, "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n"))
    out = np.zeros(BITS * BITS, np.int64)
    for r in cells.collect():  # 4,096 rows at any size of the data
        out[r.cell] = r.n
    return out.reshape(BITS, BITS)


def correlated_order(together: np.ndarray, rows: int) -> list[int]:
    """Bits in an order that puts correlated ones side by side."""
    n = max(rows, 1)
    p = np.diag(together) / n
    cov = together / n - np.outer(p, p)
    sd = np.sqrt(np.clip(p * (1 - p), 1e-9, None))
    corr = np.abs(cov / np.outer(sd, sd))
    np.fill_diagonal(corr, 0)
    order = [int(np.argmax(corr.max(axis=1)))]
    left = set(range(BITS)) - set(order)
    while left:
        near = corr[order[-8:]].mean(axis=0)
        best = max(sorted(left), key=lambda b: near[b])
        order.append(best)
        left.remove(best)
    return order


def widths(m: int) -> list[int]:
    return [BITS // m + (i < BITS % m) for i in range(m)]


def ball(width: int, radius: int) -> int:
    return sum(comb(width, k) for k in range(radius + 1)) if radius >= 0 else 0


def probe_cost(width: int, t: int, rows: float, collisions: float) -> tuple[float, float]:
    """Rows to list and candidates to expect for threshold ``t`` (-1: the partition is not probed)."""
    if t < 0:
        return 0.0, 0.0
    near, far = ball(width, t // 2), ball(width, (t + 1) // 2)
    listed = near if near == far else near + far
    return rows * listed, near * far * collisions * (2 if t % 2 else 1)


def allocate(tau: int, rows: float, collisions: list[float]) -> tuple[float, list[int]]:
    """The thresholds of least cost with sum (t_i + 1) = tau + 1, by dynamic programming."""
    w = widths(len(collisions))
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for width, c in zip(w, collisions):
        after: dict[int, tuple[float, list[int]]] = {}
        for spent, (cost, chosen) in best.items():
            for t in range(-1, min(tau - spent, width - 1) + 1):
                listed, candidates = probe_cost(width, t, rows, c)
                total = cost + COST_ROW * listed + COST_CANDIDATE * candidates
                key = spent + t + 1
                if key <= tau + 1 and (key not in after or total < after[key][0]):
                    after[key] = (total, [*chosen, t])
        best = after
    return best[tau + 1]


@dataclass(frozen=True)
class Plan:
    """``most``: how many hashes share one value, at most."""

    order: list[int]
    thresholds: list[int]
    cost: float = 0.0
    most: int = 0


def make_plan(nodes: DataFrame, tau: int) -> Plan:
    """Bit order, number of partitions and thresholds for the hashes ``s`` of ``nodes``."""
    rows = nodes.count()
    order = correlated_order(bit_statistics(nodes, "s"), rows)
    ordered = nodes.select(permuted(F.col("s"), order).alias("p"))
    keys = [F.lit(m * 64 + i).cast("bigint").bitwiseOR(F.shiftleft(value, 12)) for m in PARTITIONS for i, value in enumerate(part_values(F.col("p"), m))]
    counts = ordered.select(F.explode(F.array(*keys)).alias("key")).groupBy("key").count()
    found = counts.groupBy(F.col("key").bitwiseAND(4095).alias("part")).agg(F.sum(F.col("count").cast("double") * (F.col("count") - 1) / 2).alias("pairs"), F.max("count").alias("most"))
    by_part = {r.part: r for r in found.collect()}  # a row for each partition
    best = []
    for m in PARTITIONS:
        parts = [by_part.get(m * 64 + i) for i in range(m)]
        best.append((*allocate(tau, rows, [p.pairs if p else 0.0 for p in parts]), max(p.most if p else 0 for p in parts)))
    cost, thresholds, most = min(best)
    return Plan(order, thresholds, cost, most)


def permuted(s: Column, order: list[int]) -> Column:
    """The hash with bit ``order[k]`` moved to place k."""
    out = F.lit(0).cast("bigint")
    for k, b in enumerate(order):
        out = out.bitwiseOR(F.shiftleft(F.shiftrightunsigned(s, b).bitwiseAND(F.lit(1).cast("bigint")), k))
    return out


def part_values(p: Column, m: int) -> list[Column]:
    out, at = [], 0
    for w in widths(m):
        out.append(F.shiftrightunsigned(p, at).bitwiseAND(F.lit((1 << w) - 1).cast("bigint")))
        at += w
    return out


def _flips(width: int, radius: int) -> list[int]:
    return [sum(1 << b for b in c) for k in range(radius + 1) for c in combinations(range(width), k)]


# -- pairs and groups ------------------------------------------------------------------------


#: Rows that share a value are compared by shifts up to this number, and block by block beyond.
_SHIFTS = 24
_BLOCK = 2048


def meeting_pairs(key: np.ndarray, side: np.ndarray, s: np.ndarray, tau: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of all pairs with equal key (sorted) and hashes within ``tau`` bits. The two lowest bits of a side say
    who meets: 0 and 1 each other, 2 all; the next two likewise for the blocks of a hot value."""
    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
    sizes = np.diff(np.r_[starts, len(key)])
    left, right = [], []
    short = np.repeat(sizes <= _SHIFTS, sizes)
    at = np.flatnonzero(short)
    k, h, sd, bl = key[at], s[at], side[at] & 3, side[at] >> 2
    for d in range(1, int(sizes[sizes <= _SHIFTS].max(initial=1))):
        hit = np.flatnonzero((k[d:] == k[:-d]) & (np.bitwise_count(h[d:] ^ h[:-d]) <= tau) & ((sd[d:] != sd[:-d]) | (sd[d:] == 2)) & ((bl[d:] != bl[:-d]) | (bl[d:] == 2)))
        left.append(at[hit])
        right.append(at[hit + d])

    def all_with_all(one: np.ndarray, two: np.ndarray) -> None:
        for x in range(0, len(one), _BLOCK):
            for y in range(0, len(two), _BLOCK):
                i, j = np.nonzero(np.bitwise_count(s[one[x : x + _BLOCK], None] ^ s[two[y : y + _BLOCK]]) <= tau)
                left.append(one[i + x])
                right.append(two[j + y])

    for run in np.flatnonzero(sizes > _SHIFTS):
        a = np.arange(starts[run], starts[run] + sizes[run])
        mine, block = side[a] & 3, side[a] >> 2
        if mine[0] == 2 and block[0] == 2:
            for x in range(0, len(a), _BLOCK):
                for y in range(x, len(a), _BLOCK):
                    i, j = np.nonzero(np.bitwise_count(s[a[x : x + _BLOCK], None] ^ s[a[y : y + _BLOCK]]) <= tau)
                    later = i + x < j + y
                    left.append(a[i[later] + x])
                    right.append(a[j[later] + y])
            continue
        for p, q_ in ((2, 2),) if mine[0] == 2 else ((0, 1),):
            if block[0] == 2:
                all_with_all(a[mine == p], a[mine == q_])
            elif p == q_:
                all_with_all(a[block == 0], a[block == 1])
            else:
                all_with_all(a[(mine == 0) & (block == 0)], a[(mine == 1) & (block == 1)])
                all_with_all(a[(mine == 0) & (block == 1)], a[(mine == 1) & (block == 0)])
    none = [np.zeros(0, np.int64)]
    return np.concatenate(left or none), np.concatenate(right or none)


def _flipped(flips: Column, base: Column) -> Column:
    # the function has one parameter: a second would be given the place in the array
    return F.transform(flips, lambda f: base.bitwiseXOR(f))


def _lists(p: Column, plan: Plan) -> Column:
    """All values at which a hash can meet a partner, with its side in the two lowest bits."""
    m, keys = len(plan.thresholds), []
    for i, (value, width, t) in enumerate(zip(part_values(p, m), widths(m), plan.thresholds)):
        if t < 0:
            continue
        base = F.shiftleft(value, 8).bitwiseOR(F.lit(i * 4).cast("bigint"))
        for side, radius in ((2, t // 2),) if t % 2 == 0 else ((0, (t + 1) // 2), (1, t // 2)):
            flips = F.array(*[F.lit((f << 8) + side).cast("bigint") for f in _flips(width, radius)])
            keys.append(_flipped(flips, base))
    return F.concat(*keys)


def hot_values(nodes: DataFrame, plan: Plan, hot: int = HOT) -> DataFrame:
    """``key``, ``blocks``: the values near which so many hashes are that they are cut into blocks."""
    m = len(plan.thresholds)
    p = nodes.select(permuted(F.col("s"), plan.order).alias("p"))
    own = F.array(*[F.shiftleft(v, 8).bitwiseOR(F.lit(i * 4).cast("bigint")) for i, v in enumerate(part_values(F.col("p"), m))])
    crowded = p.select(F.explode(own).alias("k")).groupBy("k").count().where(F.col("count") >= hot)
    near = []
    for i, (width, t) in enumerate(zip(widths(m), plan.thresholds)):
        if t >= 0:
            flips = F.array(*[F.lit(f << 8).cast("bigint") for f in _flips(width, (t + 1) // 2)])
            near.append(F.when(F.col("k").bitwiseAND(255) == i * 4, _flipped(flips, F.col("k"))))
    keys = crowded.select(F.explode(F.coalesce(*near)).alias("k"), "count")
    return keys.groupBy(F.shiftright("k", 2).alias("key")).agg(F.ceil(F.sum("count") / hot).cast("int").alias("blocks")).where("blocks > 1")


def listed_values(nodes: DataFrame, plan: Plan, hot: int = HOT) -> DataFrame:
    """Each node under every value at which it can meet a partner: key, side, node, s."""
    both = nodes.select("node", "s", permuted(F.col("s"), plan.order).alias("p"))
    # the two lowest bits are the side; rows meet at the rest
    listed = both.select(F.explode(_lists(F.col("p"), plan)).alias("k"), "node", "s")
    listed = listed.select(F.shiftright("k", 2).alias("key"), F.col("k").bitwiseAND(3).cast("tinyint").alias("side"), "node", "s")
    alone = F.lit(2 << 2).cast("tinyint")
    if plan.most < hot:
        return listed.select("key", F.col("side").bitwiseOR(alone).alias("side"), "node", "s")
    crowded = materialise(hot_values(nodes, plan, hot), "hot-values")
    dealt = listed.join(_small(crowded, BROADCAST_ROWS), "key", "left")
    b = F.coalesce("blocks", F.lit(1))
    dealt = dealt.withColumns({"b": b, "own": F.pmod(F.xxhash64("node"), b).cast("int")}).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("b") - 1)))
    own, other = F.col("own"), F.col("other")
    block = F.when(own == other, 2).when(own < other, 0).otherwise(1)
    # a pair of blocks of a value is a value of its own
    pair = F.when(F.col("b") == 1, F.col("key")).otherwise(F.xxhash64("key", F.least(own, other), F.greatest(own, other)))
    return dealt.select(pair.alias("key"), F.col("side").bitwiseOR(F.shiftleft(block, 2)).cast("tinyint").alias("side"), "node", "s")


def near_pairs(nodes: DataFrame, tau: int = TAU, tau_pairs: int = TAU_PAIRS, plan: Plan | None = None, hot: int = HOT) -> DataFrame:
    """All pairs a < b of ``nodes`` (node, s, v1, v2) that are near copies, each once."""
    plan = plan or make_plan(nodes, tau)

    def verify(batches):
        held: list[pa.Table] = []

        def found(t: pa.Table):
            key, side, node, s = (c.to_numpy() for c in t.columns)
            i, j = meeting_pairs(key, side, s.view(np.uint64), tau)
            if len(i):
                pair = np.unique(np.sort(np.stack([node[i], node[j]], axis=1), axis=1), axis=0)
                pair = pair[pair[:, 0] != pair[:, 1]]
                yield pa.RecordBatch.from_arrays([pa.array(pair[:, 0]), pa.array(pair[:, 1])], ["node_a", "node_b"])

        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([b])
            key = b.column(0).to_numpy()
            # the last value may go on in the next batch
            cut = int(np.searchsorted(key, key[-1], "left"))
            if cut:
                yield from found(pa.concat_tables([*held, t.slice(0, cut)]).combine_chunks())
                held = [t.slice(cut)]
            elif held and held[-1].column(0)[-1].as_py() != key[0]:
                yield from found(pa.concat_tables(held).combine_chunks())
                held = [t]
            else:
                held.append(t)
        if held:
            yield from found(pa.concat_tables(held).combine_chunks())

    # rows are few bytes and much work, so the number of tasks goes by the estimated work
    tasks = int(min(max(12, plan.cost / TASK_COST), 100_000))
    sorted_ = listed_values(nodes, plan, hot).repartition(tasks, "key").sortWithinPartitions("key")
    found = materialise(sorted_.mapInArrow(verify, "node_a bigint, node_b bigint").distinct(), "simhash-pairs")
    v = nodes.select("node", "v1", "v2")
    a, b = (v.select(*[F.col(c).alias(f"{c}_{x}") for c in v.columns]) for x in "ab")
    both = found.join(a, "node_a").join(b, "node_b")
    return both.where(differing(F.col("v1_a"), F.col("v1_b")) + differing(F.col("v2_a"), F.col("v2_b")) <= tau_pairs).select("node_a", "node_b")


def components(edges: DataFrame) -> DataFrame:
    """``node``, ``root`` (the smallest node of its component) for every node of the edges
    (node_a, node_b)."""
    e = edges.select(F.greatest("node_a", "node_b").alias("u"), F.least("node_a", "node_b").alias("v")).where("u <> v").distinct()
    spark, path = edges.sparkSession, scratch_path(edges.sparkSession, "component-edges")
    e, before = materialise(e, "", path), None
    while True:
        # large star: every larger neighbour of u is tied to the smallest node around u
        both = e.union(e.select("v", "u")).toDF("u", "v")
        least = both.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("low"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("low").alias("v")).distinct()
        # small star: u and its smaller neighbours are tied to the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("low"))
        small = large.join(low, "u").where("v <> low").select(F.col("v").alias("u"), F.col("low").alias("v"))
        last, path = path, scratch_path(spark, "component-edges")
        e = materialise(small.union(low.select("u", F.col("low").alias("v"))).distinct(), "", path)
        remove(spark, last)
        state = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _small(df: DataFrame, broadcast_rows: int) -> DataFrame:
    return F.broadcast(df) if df.count() <= broadcast_rows else df


def near_groups(df: DataFrame, text: str = "text", doc_id: str = "doc_id", tau: int = TAU, tau_pairs: int = TAU_PAIRS, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``doc_id``, ``keeper`` for every document with an id and a word."""
    require(df, text, doc_id)
    prints = df.where(q(doc_id).isNotNull()).select(q(doc_id).alias("doc_id"), fingerprint_column(q(text)).alias("f"))
    prints = materialise(prints.select("doc_id", "f.s", "f.v1", "f.v2"), "fingerprints")
    worded = prints.where("s IS NOT NULL")
    # the smallest id does not name a node, as one id can have two texts and so two hashes
    nodes = worded.groupBy("s", "v1", "v2").agg(F.min("doc_id").alias("id")).withColumn("node", F.monotonically_increasing_id())
    nodes = materialise(nodes, "simhash-nodes")
    tied = components(materialise(near_pairs(nodes, tau, tau_pairs), "near-pairs"))
    tied = materialise(tied.join(nodes, "node"), "near-nodes")
    keepers = tied.groupBy("root").agg(F.min("id").alias("keeper"))
    grouped = materialise(tied.join(keepers, "root").select("s", "v1", "v2", "keeper"), "near-groups")
    each = worded.join(nodes.select("s", "v1", "v2", "id"), ["s", "v1", "v2"])
    each = each.join(_small(grouped, broadcast_rows), ["s", "v1", "v2"], "left").select("doc_id", F.coalesce("keeper", "id").alias("keeper"))
    return each.union(prints.where("s IS NULL").select("doc_id", "doc_id")).groupBy("doc_id").agg(F.min("keeper").alias("keeper"))


def near_dedup(df: DataFrame, text: str = "text", doc_id: str = "doc_id", tau: int = TAU, tau_pairs: int = TAU_PAIRS, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """The rows of ``df`` that stay: one document of each group, and all that are in none."""
    (gone,) = fresh(df, "gone")
    groups = near_groups(df, text, doc_id, tau, tau_pairs, broadcast_rows)
    go = materialise(groups.where("doc_id <> keeper").select(F.col("doc_id").alias(gone)), "near-copies")
    return df.join(_small(go, broadcast_rows), q(doc_id) == q(gone), "left_anti")


def near_duplicate_pairs(df: DataFrame, text: str = "text", doc_id: str = "doc_id", tau: int = TAU, tau_pairs: int = TAU_PAIRS) -> DataFrame:
    """A row for each document that has an id: ``doc_id`` is the one that stays, ``duplicate_id``
    the near copy that goes in favour of it (NULL in the row of the document that stays itself)."""
    groups = near_groups(df, text, doc_id, tau, tau_pairs)
    return groups.select(F.col("keeper").alias("doc_id"), F.when(F.col("doc_id") != F.col("keeper"), F.col("doc_id")).alias("duplicate_id"))
