"""Sharding by jump consistent hashing: no ring table, and appended shards take over only
the fraction 1/n of the keys that they must.

Keys are 64-bit integers; other key types are hashed to one first. The walk of a key through
its jumps has an expected length of ln(shards), so it is done on whole Arrow batches of keys
with vector arithmetic; only the key column leaves the JVM, and nothing is shuffled.

Edge cases: a NULL key gives a NULL shard. Equal keys give equal shards, whatever else the rows
hold. ``shards`` must be from 1 to 2^31 - 1. An input column named like an output column is
replaced; all others pass through.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.llm.common import q, require, without

_STEP = np.uint64(2862933555777941757)


def jump_hash(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each 64-bit key."""
    if not 1 <= shards < 2**31:
        raise ValueError("shards must be from 1 to 2^31 - 1")
    state = keys.astype(np.int64).view(np.uint64).copy()
    at = np.zeros(len(state), np.int64)
    going = np.arange(len(state))
    land = np.zeros(len(state), np.int64)
    while len(going):
        at[going] = land
        s = state[going] * _STEP + np.uint64(1)
        state[going] = s
        draw = (s >> np.uint64(33)).astype(np.float64) + 1.0
        land = ((at[going] + 1).astype(np.float64) * (2147483648.0 / draw)).astype(np.int64)
        inside = land < shards
        going, land = going[inside], land[inside]
    return at.astype(np.int32)


def shard_column(key: Column, shards: int) -> Column:
    """The shard of a BIGINT key column."""
    jump_hash(np.zeros(0, np.int64), shards)  # an impossible number of shards is an error here, not in a task

    @F.arrow_udf("int")
    def jump(k: pa.Array) -> pa.Array:
        missing = k.is_null().to_numpy(zero_copy_only=False)
        found = jump_hash(k.fill_null(0).to_numpy(zero_copy_only=False), shards)
        return pa.array(found, pa.int32(), mask=missing)

    return jump(key)


def with_shard(df: DataFrame, shards: int, key: str = "doc_id", out: str = "shard") -> DataFrame:
    """``df`` with the shard of each row's key."""
    require(df, key)
    integral = dict(df.dtypes)[key] in ("tinyint", "smallint", "int", "bigint")
    k = q(key).cast("bigint") if integral else F.when(q(key).isNotNull(), F.xxhash64(q(key)))
    return df.select(*[q(c) for c in without(df, out).columns], shard_column(k, shards).alias(out))


def resharding(df: DataFrame, before: int, after: int, key: str = "doc_id") -> DataFrame:
    """Each key's shard among ``before`` and among ``after`` shards, and whether it moves."""
    if after < before:
        raise ValueError("jump hashing appends shards; removing any but the last moves more")
    old = with_shard(df.select(q(key)), before, key, "shard")
    both = with_shard(old, after, key, "shard_after")
    return both.select(q(key), "shard", "shard_after", (F.col("shard") != F.col("shard_after")).alias("moved"))


def write_shards(df: DataFrame, path: str, shards: int, key: str = "doc_id") -> None:
    """Write ``df`` as one folder for each shard. Rows are spread by shard and a salt, so that
    a shard's folder gets a few files and no task all of a large shard."""
    tagged = with_shard(df, shards, key, "shard")
    tagged.repartition(F.col("shard"), F.pmod(F.xxhash64(q(key)), F.lit(4))).write.partitionBy("shard").parquet(path)


def oracle_sql(before: int, after: int) -> str:
    """The same by a recursive query: a row for each jump."""

    def jumps(n: int, name: str) -> str:
        return f"""
{name} AS (
  SELECT doc_id, doc_id::HUGEINT & 18446744073709551615::HUGEINT AS state, -1::BIGINT AS pos, 0::BIGINT AS land FROM keys
  UNION ALL
  SELECT doc_id, state, pos, floor((pos + 1)::DOUBLE * (2147483648.0::DOUBLE / ((state // 8589934592)::DOUBLE + 1.0::DOUBLE)))::BIGINT
  FROM (SELECT doc_id, ((state::UHUGEINT * 2862933555777941757::UHUGEINT + 1::UHUGEINT) % 18446744073709551616::UHUGEINT)::HUGEINT AS state, land AS pos
        FROM {name} WHERE land < {n}) s
), {name}_end AS (SELECT doc_id, max(pos)::INT AS shard FROM {name} GROUP BY doc_id)"""

    return f"""
WITH RECURSIVE keys AS (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL), {jumps(before, "a")}, {jumps(after, "b")}
SELECT d.doc_id, a_end.shard, b_end.shard AS shard_after, a_end.shard <> b_end.shard AS moved
FROM documents d LEFT JOIN a_end USING (doc_id) LEFT JOIN b_end USING (doc_id)
"""
