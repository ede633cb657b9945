"""Exact top-k by inner product with norm-bucketed retrieval: a set of queries against all rows.

Vectors are sorted by length and cut into buckets, queries likewise into blocks. Buckets are visited in
waves, the longest vectors first; a wave holds as many buckets as all before it together. What
a wave has found gives each query a score that its k-th partner must reach; divided by the
lengths of the query and of a bucket's longest vector it is the query's local cosine threshold there:

* above 1, the bucket is pruned for the query (and where this holds for all queries of a block,
  block and bucket never meet);
* otherwise either *length* pruning (only vectors long enough, a prefix of the bucket) or
  *coordinate* pruning (only vectors whose value in the query's largest coordinate lies where
  a cosine of at least the threshold allows), whichever leaves fewer vectors.

What is left is verified by its product in double precision, added up in the order of the coordinates,
so that results do not depend on how work is cut. Ranks go by that product, and of equal ones the
smaller id comes first; ``score`` is the product rounded to ``DECIMALS`` places for show. The number of pairs
of a block and a bucket is the work that an exact search has; each is one row, searched by itself.
Blocks and buckets are broadcast if all together they have at most ``broadcast_bytes``, and shuffled
otherwise; at scale both should hold more rows than by default, as a pair carries one of each.

Edge cases: rows with a NULL id, and vectors that are NULL, empty or hold a NULL, NaN or
infinite value, are neither queries nor partners. Vectors of different dimension do not
compare. Of rows that share an id the smallest vector, in array order, counts, and it is a query if one of
them is; no id is its own partner. A query with fewer than k others gets them all. Ids may be of any
type that has an order, vectors of floats or doubles. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewright.llm.common import materialise, q, require

DECIMALS = 6
BUCKET_ROWS, BLOCK_ROWS = 4096, 1024
BROADCAST_BYTES = 32 << 20
#: Products with vectors picked one by one cost so many times those of a dense block.
PICK_COST = 12
#: Relative to the lengths of both vectors, a bound for the error of a product.
_SLACK = 1e-9
_STEP = 256


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows, added up from the first coordinate to the last."""
    return np.cumsum(a * b, axis=1)[:, -1]


def search(q_ids: np.ndarray, q_vec: np.ndarray, p_ids: np.ndarray, p_vec: np.ndarray, reach: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query ids, partner ids, products: for each query its best ``k`` partners that reach ``reach``.
    Partners are sorted by length, longest first."""
    q_len, p_len = np.linalg.norm(q_vec, axis=1), np.linalg.norm(p_vec, axis=1)
    top = p_len[0] if len(p_len) else 0.0
    bound = q_len * top
    slack = _SLACK * bound
    limit = reach - slack
    alive = np.flatnonzero(limit <= bound + slack)
    if not len(alive) or not len(p_ids):
        e = np.zeros(0, np.int64)
        return e, e, np.zeros(0)
    with np.errstate(divide="ignore", invalid="ignore"):
        need = np.where(q_len > 0, limit / q_len, -np.inf)
        cosine = np.where(bound > 0, limit / bound, -1.0)
    # length pruning keeps a prefix; for a negative limit it keeps everything
    prefix = np.where(need > 0, np.searchsorted(-p_len, -need * (1 - _SLACK), side="right"), len(p_ids))
    picked: dict[int, np.ndarray] = {}
    sharp = alive[cosine[alive] > 0.5]
    if len(sharp):
        unit = p_vec / np.where(p_len > 0, p_len, 1)[:, None]
        order = np.argsort(unit, axis=0, kind="stable")
        ranked = np.take_along_axis(unit, order, axis=0)
        for i in sharp:
            direction = q_vec[i] / q_len[i]
            f = int(np.abs(direction).argmax())
            c, t = direction[f], min(cosine[i], 1.0)
            spread = np.sqrt(max(0.0, (1 - t * t) * (1 - c * c))) + 1e-7
            low = -np.inf if c < -t else t * c - spread
            high = np.inf if c > t else t * c + spread
            a, b = np.searchsorted(ranked[:, f], low, "left"), np.searchsorted(ranked[:, f], high, "right")
            if (b - a) * PICK_COST < prefix[i]:
                at = order[a:b, f]
                picked[int(i)] = np.sort(at[at < prefix[i]])
    out_q, out_p, out_s = [], [], []

    def keep(row: int, at: np.ndarray) -> None:
        at = at[p_ids[at] != q_ids[row]]
        s = products(p_vec[at], q_vec[row][None]) if len(at) else np.zeros(0)
        at, s = at[s >= reach[row]], s[s >= reach[row]]
        best = np.lexsort((p_ids[at], -s))[:k]
        out_q.append(np.full(len(best), q_ids[row]))
        out_p.append(p_ids[at[best]])
        out_s.append(s[best])

    for i, at in picked.items():
        keep(i, at)
    dense = np.array([i for i in alive if int(i) not in picked], np.int64)
    dense = dense[np.argsort(-prefix[dense], kind="stable")] if len(dense) else dense
    for x in range(0, len(dense), _STEP):
        rows = dense[x : x + _STEP]
        width = int(prefix[rows[0]])
        s = q_vec[rows] @ p_vec[:width].T
        cut = limit[rows]
        if width > 4 * k:  # k others, the query itself apart
            cut = np.maximum(cut, np.partition(s, width - k - 1, axis=1)[:, width - k - 1] - slack[rows])
        for r, row in enumerate(rows):
            keep(int(row), np.flatnonzero(s[r] >= cut[r]))
    return np.concatenate(out_q), np.concatenate(out_p), np.concatenate(out_s)


_PACKED = "part int, dim int, longest double, ids binary, lengths binary, vectors binary"


def _pack(batches):
    """One row for each dimension of the vectors of a partition, longest first."""
    t = pa.Table.from_batches(list(batches))
    if not t.num_rows:
        return
    part, ids = t.column(0).to_numpy()[0], t.column(1).to_numpy()
    lists = t.column(2).combine_chunks()
    sizes = lists.value_lengths().to_numpy()
    flat, starts = lists.flatten().to_numpy(), np.concatenate([[0], np.cumsum(sizes)])
    for dim in np.unique(sizes):
        at = np.flatnonzero(sizes == dim)
        v = np.stack([flat[starts[i] : starts[i] + dim] for i in at])
        length = np.linalg.norm(v.astype(np.float64), axis=1)
        order = np.lexsort((ids[at], -length))
        row = [part, int(dim), float(length[order[0]]), ids[at][order].astype("<i8").tobytes(), length[order].tobytes(), v[order].astype(v.dtype.newbyteorder("<")).tobytes()]
        kinds = [pa.int32(), pa.int32(), pa.float64(), pa.binary(), pa.binary(), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array([x], kind) for x, kind in zip(row, kinds)], ["part", "dim", "longest", "ids", "lengths", "vectors"])


def _packed(v: DataFrame, rows: int, of: int, label: str) -> DataFrame:
    """``v`` (id, v, length) in rows of about ``of`` vectors; ``part`` falls with the length."""
    spread = v.repartitionByRange(max(1, -(-rows // of)), F.col("length").desc(), "id")
    return materialise(spread.select(F.spark_partition_id().alias("part"), "id", "v").mapInArrow(_pack, _PACKED), label)


def _numbered(df: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """``df`` with ids that are 64-bit integers in the order of its own, and the table of both."""
    if dict(df.dtypes)["id"] in ("tinyint", "smallint", "int", "bigint"):
        return df.withColumn("id", F.col("id").cast("bigint")), None
    parts = df.select(F.col("id").alias("name")).repartitionByRange("name").sortWithinPartitions("name")
    names = materialise(parts.withColumn("id", F.monotonically_increasing_id()), "vector-names")
    return df.withColumnRenamed("id", "name").join(names, "name").drop("name"), names


def _needed(reach: np.ndarray, lengths: np.ndarray) -> float:
    """The length below which no vector can help any of the queries."""
    if (reach == -np.inf).any() or not len(reach):
        return -np.inf
    with np.errstate(divide="ignore", invalid="ignore"):
        need = np.where(lengths > 0, reach / lengths, np.where(reach > 0, np.inf, -np.inf))
    return float(np.where(reach > 0, need * (1 - 2 * _SLACK), -np.inf).min())


def _with_reach(blocks: DataFrame, found: DataFrame | None, k: int) -> DataFrame:
    """block, dim, need, reach of each block, from the best partners found so far."""
    heads = blocks.select(F.col("part").alias("block"), "dim", "ids", "lengths")
    if found is None:
        heads = heads.withColumn("got", F.expr("cast(array() as array<struct<vec_id: bigint, low: double>>)"))
    else:
        full = found.groupBy("block", "dim", "vec_id").agg(F.count("*").alias("n"), F.min("product").alias("low")).where(F.col("n") == k)
        heads = heads.join(full.groupBy("block", "dim").agg(F.collect_list(F.struct("vec_id", "low")).alias("got")), ["block", "dim"], "left")

    def reach(batches):
        for b in batches:
            rows = []
            for block, dim, ids, lengths, got in zip(*(c.to_pylist() for c in b.columns)):
                low = {g["vec_id"]: g["low"] for g in got or ()}
                r = np.array([low.get(i, -np.inf) for i in np.frombuffer(ids, "<i8").tolist()])
                rows.append((block, dim, _needed(r, np.frombuffer(lengths, np.float64)), r.tobytes()))
            kinds = (pa.int32(), pa.int32(), pa.float64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows) if rows else [[]] * 4, kinds)], ["block", "dim", "need", "reach"])

    return heads.mapInArrow(reach, "block int, dim int, need double, reach binary")


def top_k(df: DataFrame, k: int = 10, vec_id: str = "vec_id", embedding: str = "embedding", queries: Column | None = None, bucket_rows: int = BUCKET_ROWS, block_rows: int = BLOCK_ROWS, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``vec_id``, ``rank`` (from 1), ``neighbor_id``, ``score`` of the rows that ``queries`` holds for (all
    by default), with partners among all rows."""
    require(df, vec_id, embedding)
    if k < 1 or bucket_rows < 1 or block_rows < 1:
        raise ValueError("k, bucket_rows and block_rows are at least 1")
    kind = "double" if dict(df.dtypes)[embedding] == "array<double>" else "float"
    sound = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    asks = F.coalesce(queries, F.lit(False)) if queries is not None else F.lit(True)
    v = df.select(q(vec_id).alias("id"), q(embedding).cast(f"array<{kind}>").alias("v"), asks.alias("asks")).where("id IS NOT NULL AND size(v) > 0").where(sound)
    v, names = _numbered(v.groupBy("id").agg(F.min("v").alias("v"), F.bool_or("asks").alias("asks")))
    length = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    v = materialise(v.withColumn("length", length), "vectors")
    n = v.agg(F.count("*").alias("all"), F.count_if("asks").alias("asking")).first()
    buckets = _packed(v, n["all"], bucket_rows, "vector-buckets")
    blocks = _packed(v.where("asks"), n["asking"], block_rows, "query-blocks")
    size = buckets.union(blocks).agg(F.sum(F.length("vectors") + 2 * F.length("ids"))).first()[0] or 0
    small = F.broadcast if size <= broadcast_bytes else lambda x: x
    payload_q = small(blocks.select(F.col("part").alias("block"), "dim", F.col("ids").alias("q_ids"), F.col("vectors").alias("q_vectors")))
    payload_p = small(buckets.select("part", "dim", F.col("ids").alias("p_ids"), F.col("vectors").alias("p_vectors")))
    heads = buckets.select("part", "dim", "longest")
    word = "<f8" if kind == "double" else "<f4"

    def one(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                row = {name: batch.column(name)[r].as_py() for name in ("block", "dim", "q_ids", "q_vectors", "reach", "p_ids", "p_vectors")}
                vec = {x: np.frombuffer(row[f"{x}_vectors"], word).reshape(-1, row["dim"]).astype(np.float64) for x in "qp"}
                ids = {x: np.frombuffer(row[f"{x}_ids"], "<i8") for x in "qp"}
                a, b, s = search(ids["q"], vec["q"], ids["p"], vec["p"], np.frombuffer(row["reach"], np.float64), k)
                yield pa.RecordBatch.from_arrays([pa.array([row[c]] * len(a), pa.int32()) for c in ("block", "dim")] + [pa.array(x) for x in (a, b, s)], ["block", "dim", "vec_id", "neighbor_id", "product"])

    rank = F.row_number().over(Window.partitionBy("vec_id").orderBy(F.col("product").desc(), "neighbor_id"))
    found, at, step, last = None, 0, 1, max(1, -(-n["all"] // bucket_rows))
    while at < last:
        reach = materialise(_with_reach(blocks, found, k), "query-reach")
        due = reach.select("block", "dim", "need", F.explode(F.sequence(F.lit(at), F.lit(min(at + step, last) - 1))).alias("part"))
        pairs = materialise(due.join(heads, ["part", "dim"]).where("longest >= need").select("block", "part", "dim"), "bucket-pairs")
        todo = pairs.count()
        if not todo and found is not None:
            break  # what follows is shorter still
        work = pairs.repartition(max(1, min(todo, 20_000)), "block", "part").join(reach.drop("need"), ["block", "dim"]).join(payload_q, ["block", "dim"]).join(payload_p, ["part", "dim"])
        new = work.mapInArrow(one, "block int, dim int, vec_id bigint, neighbor_id bigint, product double")
        new = new if found is None else found.drop("rank").union(new)
        found = materialise(new.withColumn("rank", rank).where(F.col("rank") <= k), "top-k")
        at, step = at + step, at + step + 1
    out = found.select("vec_id", "rank", "neighbor_id", (F.round("product", DECIMALS) + 0.0).alias("score"))
    if names is None:
        return out
    for c in ("vec_id", "neighbor_id"):
        out = out.join(names.select(F.col("id").alias(c), F.col("name").alias(f"{c}_name")), c).drop(c).withColumnRenamed(f"{c}_name", c)
    return out.select("vec_id", "rank", "neighbor_id", "score")


def oracle_sql(k: int = 10, queries: str = "true") -> str:
    return f"""
WITH v AS (SELECT vec_id, min(embedding) AS e FROM embeddings WHERE vec_id IS NOT NULL AND len(embedding) > 0 GROUP BY vec_id),
s AS (SELECT a.vec_id, b.vec_id AS neighbor_id, list_inner_product(a.e::DOUBLE[], b.e::DOUBLE[]) AS product
      FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE {queries.replace("vec_id", "a.vec_id")}),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY product DESC, neighbor_id)::INT AS rank FROM s)
SELECT vec_id, rank, neighbor_id, round(product, {DECIMALS}) AS score FROM r WHERE rank <= {k}
"""
