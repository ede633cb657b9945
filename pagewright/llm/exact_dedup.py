"""Exact deduplication by 128-bit content hash, with the bytes compared inside groups.

One narrow pass counts hashes, combined before the shuffle: no text moves. Only documents whose hash
occurs more than once are looked at again. They are written to the shared folder with a
row number; the smallest (id, row) of each hash is found by another combined aggregate, and the text of
each document is compared with that keeper's. A document with the same bytes goes. What
has the hash but not the bytes of its keeper, a collision, is ranked by (hash, text) apart. No
task gets a whole group: where more than ``HOT`` documents share a hash they are spread by a salt, and
the keeper's text is there once for each salt.

The hashes that repeat are broadcast if their number is within ``broadcast_rows``. Beyond it they are put into a
Bloom filter of at most ``filter_bits`` bits (64 MB by default, whatever the data), and only documents that pass
it are shuffled to meet the hashes: at 8 bits a hash some 3 % of the unique ones, and more of them, but
never a wrong result, where the hashes outgrow the filter.

Edge cases: a NULL text equals nothing and always stays; empty texts equal each other. A NULL
id is larger than any id; of rows equal in text and id the one with the smallest hash of all its columns
stays, and of rows equal in everything just one. Extra columns pass through, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewright.llm.common import fresh, materialise, q, require

#: Repeated hashes (16 bytes each, some 100 MB as a hash table) up to which they are broadcast.
BROADCAST_ROWS = 500_000
#: Documents of one hash that one task compares.
HOT = 5_000
#: The most bits that the filter has, and how many a hash sets.
FILTER_BITS, FILTER_HASHES = 1 << 29, 3


def _written(df: DataFrame, label: str) -> DataFrame:
    """``df`` by way of the shared folder, whatever its columns are called; untyped NULLs are not written."""
    kept = [c for c, kind in df.dtypes if kind != "void"]
    plain = materialise(df.select(*[q(c).alias(f"c{i}") for i, c in enumerate(kept)]), label)
    at = {c: f"c{i}" for i, c in enumerate(kept)}
    return plain.select(*[(F.col(at[c]) if c in at else F.lit(None)).alias(c) for c in df.columns])


def bloom_filter(hashes: DataFrame, n: int, filter_bits: int = FILTER_BITS) -> Callable[[Column], Column]:
    """Whether a hash may be among the ``n`` of ``hashes`` (column ``h``). The bits are set by an aggregate and
    broadcast as one array, at most ``filter_bits`` of them (a power of two)."""
    bits = min(filter_bits, max(64, 1 << (8 * n).bit_length()))
    places = lambda h: [F.xxhash64(h, F.lit(k)).bitwiseAND(F.lit(bits - 1).cast("bigint")) for k in range(FILTER_HASHES)]
    at = hashes.select(F.explode(F.array(*places(F.col("h")))).alias("p"))
    bit = F.expr("shiftleft(1L, cast(p & 63 as int))")
    words = at.groupBy(F.shiftright("p", 6).alias("w")).agg(F.bit_or(bit).alias("b")).toArrow()  # a row for 64 bits
    table = np.zeros(bits >> 6, np.int64)
    table[words.column("w").to_numpy()] = words.column("b").to_numpy()
    shared = hashes.sparkSession.sparkContext.broadcast(table)

    @F.arrow_udf("boolean")
    def there(*columns: pa.Array) -> pa.Array:
        ok = np.ones(len(columns[0]), bool)
        for c in columns:
            p = c.to_numpy(zero_copy_only=False).astype(np.int64)
            ok &= (shared.value[p >> 6] >> (p & 63)) & 1 == 1
        return pa.array(ok)

    return lambda h: there(*places(h))


def mark_duplicates(df: DataFrame, text: str = "text", doc_id: str = "doc_id", stays: str = "stays", keeper: str = "keeper", broadcast_rows: int = BROADCAST_ROWS, hot: int = HOT, filter_bits: int = FILTER_BITS) -> DataFrame:
    """``df`` with ``stays`` and ``keeper`` (the id of the document that stays for it)."""
    require(df, text, doc_id)
    h, n, row, salt, o, k, same, hit = fresh(df, "hash", "n", "row", "salt", "order", "keeper", "same", "hit")
    hashed = df.withColumn(h, F.unhex(F.md5(F.encode(q(text), "UTF-8"))))
    counted = hashed.where(q(h).isNotNull()).groupBy(q(h)).agg(F.count("*").alias(n)).where(q(n) > 1)
    repeated = materialise(counted.select(q(h).alias("h"), q(n).alias("n")), "repeated-hashes").toDF(h, n)
    number = repeated.count()
    alone = [*[q(c) for c in df.columns], F.lit(True).alias(stays), q(doc_id).alias(keeper)]
    # NULLs stay as they are in either case: they meet no hash
    if number <= broadcast_rows:
        few = F.broadcast
        once = hashed.join(few(repeated), h, "left_anti").select(*alone)
        again = hashed.join(few(repeated), h)
    else:
        few = lambda x: x
        tried = hashed.withColumn(hit, q(h).isNotNull() & bloom_filter(repeated.toDF("h", "n"), number, filter_bits)(q(h)))
        met = _written(tried.where(q(hit)).drop(hit).join(repeated, h, "left"), "repeated-or-not")
        once = tried.where(~q(hit)).select(*alone).union(met.where(q(n).isNull()).select(*alone))
        again = met.where(q(n).isNotNull())
    again = _written(again.withColumn(row, F.monotonically_increasing_id()), "repeated-texts")
    again = again.withColumn(salt, F.pmod(q(row), F.ceil(q(n) / hot)).cast("int"))
    rest = [q(c) for c, kind in df.dtypes if c != text and "map<" not in kind and kind not in ("void", "variant")]
    order = F.struct(q(doc_id).isNull().alias("none"), q(doc_id).alias("id"), F.xxhash64(*rest).alias("rest"), q(row).alias("row"))
    first = again.groupBy(q(h)).agg(F.min(order).alias(o)).select(q(o)["row"].alias(k))
    firsts = again.join(few(first), q(row) == q(k)).select(q(h).alias("h"), q(text).alias("t"), q(doc_id).alias("i"), q(row).alias("r"), F.explode(F.sequence(F.lit(0), F.ceil(q(n) / hot).cast("int") - 1)).alias("s"))
    met = again.join(firsts.withColumnsRenamed({"h": h, "s": salt, "t": o, "i": k, "r": same}), [h, salt])
    equal = met.where(q(text) == q(o)).select(*[q(c) for c in df.columns], (q(row) == q(same)).alias(stays), q(k).alias(keeper))
    by = Window.partitionBy(q(h), q(text)).orderBy(order)
    collided = met.where(q(text) != q(o)).withColumns({n: F.row_number().over(by), salt: F.first(q(doc_id)).over(by)})
    collided = collided.select(*[q(c) for c in df.columns], (q(n) == 1).alias(stays), q(salt).alias(keeper))
    return once.union(equal).union(collided)


def exact_dedup(df: DataFrame, text: str = "text", doc_id: str = "doc_id", broadcast_rows: int = BROADCAST_ROWS, hot: int = HOT) -> DataFrame:
    """The rows of ``df`` that stay, with its columns."""
    stays, keeper = fresh(df, "stays", "keeper")
    return mark_duplicates(df, text, doc_id, stays, keeper, broadcast_rows, hot).where(q(stays)).select(*[q(c) for c in df.columns])


def duplicate_pairs(df: DataFrame, text: str = "text", doc_id: str = "doc_id", broadcast_rows: int = BROADCAST_ROWS, hot: int = HOT) -> DataFrame:
    """A row for each input row: ``doc_id`` is the document that stays, ``duplicate_id`` the one
    that goes in favour of it (NULL in the row of the document that stays itself)."""
    stays, keeper = fresh(df, "stays", "keeper")
    marked = mark_duplicates(df, text, doc_id, stays, keeper, broadcast_rows, hot)
    return marked.select(q(keeper).alias("doc_id"), F.when(~q(stays), q(doc_id)).alias("duplicate_id"))


ORACLE_SQL = """
SELECT keeper AS doc_id, CASE WHEN rank > 1 THEN doc_id END AS duplicate_id
FROM (SELECT doc_id, row_number() OVER w AS rank, first_value(doc_id) OVER w AS keeper
      FROM documents WHERE text IS NOT NULL WINDOW w AS (PARTITION BY text ORDER BY doc_id)) t
UNION ALL SELECT doc_id, NULL FROM documents WHERE text IS NULL
"""
