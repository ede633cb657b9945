"""Mixing sources to target weights.

Tokens are totalled by source over all documents; a source's repetition rate is
(target share x total target tokens) / (its tokens). A document is then emitted floor(rate)
times, and once more with a probability equal to the fraction, decided by a hash of its id
and a seed, so that a second run or a retried task decides the same.

Texts are not shuffled: the totals are one map-side-combined aggregate, and the table of rates
(a row for each source) is joined by broadcast while it has at most ``broadcast_rows`` rows;
beyond that it is joined by source and a salt, so that a hot source is spread over
``SALTS`` tasks.

Tokens are runs without white space, or the values of a given count column. Edge cases: a NULL
source is a source of its own; a NULL or empty text has no tokens; a source without tokens keeps
each of its documents once; a source missing from the weights gets ``default_weight``; weight 0
drops a source. Rows equal in id are decided alike; a NULL id is hashed as the word ``null``. An
empty table gives an empty one. Extra columns pass through; an input column named like an
output column is replaced.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.llm.common import fresh, materialise, q, require, without

SALTS = 64


@dataclass(frozen=True)
class Mix:
    """Target weights by source; ``total_tokens`` None keeps the size of the corpus."""

    weights: dict[str, float] = field(default_factory=dict)
    default_weight: float = 1.0
    total_tokens: int | None = None
    seed: int = 20240601
    broadcast_rows: int = 200_000

    def weight(self, source: Column) -> Column:
        out = F.lit(float(self.default_weight))
        for name, w in self.weights.items():
            out = F.when(source == name, F.lit(float(w))).otherwise(out)
        return out


#: The production mix: equal weights, but for the source that dwarfs the others, which gets four shares.
PRODUCTION = Mix(weights={"src0": 4.0})


def token_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^ \t\n\r\f]+")), F.lit(0)).cast("bigint")


def draw(doc_id: Column, seed: int) -> Column:
    """A number in [0, 1) that depends on the id and the seed only."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("bigint").cast("double") / F.lit(float(1 << 52))


def rates(df: DataFrame, mix: Mix, source: str = "source", text: str = "text", tokens: str | None = None) -> DataFrame:
    """A row for each source: ``source``, ``tokens``, ``weight``, ``rate``."""
    count = F.coalesce(q(tokens), F.lit(0)) if tokens else token_count(q(text))
    totals = df.groupBy(q(source).alias("source")).agg(F.sum(count).cast("bigint").alias("tokens"))
    totals = materialise(totals, "source-tokens").withColumn("weight", mix.weight(F.col("source")))
    whole = totals.where("tokens > 0").agg(F.sum("tokens").alias("all_tokens"), F.sum("weight").alias("all_weight"))
    target = F.lit(float(mix.total_tokens)) if mix.total_tokens is not None else F.col("all_tokens").cast("double")
    rate = F.col("weight") * target / (F.col("all_weight") * F.col("tokens").cast("double"))
    by = totals.crossJoin(F.broadcast(whole))  # one row
    return by.select("source", "tokens", "weight", F.when((F.col("tokens") > 0) & (F.col("all_weight") > 0), rate).otherwise(F.when(F.col("tokens") > 0, 0.0).otherwise(1.0)).alias("rate"))


def mix_sources(df: DataFrame, mix: Mix = PRODUCTION, source: str = "source", text: str = "text", doc_id: str = "doc_id", tokens: str | None = None, copy: str = "copy") -> DataFrame:
    """``df`` with each row as often as the mix asks; ``copy`` counts from 0."""
    require(df, source, text, doc_id, *([tokens] if tokens else []))
    df = without(df, copy)
    src, rate, copies, salt = fresh(df, "src", "rate", "copies", "salt")
    table = materialise(rates(df, mix, source, text, tokens).select(F.col("source").alias(src), F.col("rate").alias(rate)), "source-rates")
    if table.count() <= mix.broadcast_rows:
        joined = df.join(F.broadcast(table), q(source).eqNullSafe(q(src)))
    else:
        spread = table.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        salted = df.withColumn(salt, F.pmod(F.xxhash64(q(doc_id)), F.lit(SALTS)).cast("int"))
        joined = salted.join(spread, q(source).eqNullSafe(q(src)) & (salted[salt] == spread[salt])).drop(spread[salt])
    whole = F.floor(q(rate))
    n = (whole + F.when(draw(q(doc_id), mix.seed) < q(rate) - whole, 1).otherwise(0)).cast("int")
    out = joined.withColumn(copies, n).where(q(copies) > 0)
    return out.select(*[q(c) for c in df.columns], F.explode(F.sequence(F.lit(0), q(copies) - 1)).alias(copy))


def oracle_sql(mix: Mix = PRODUCTION, columns: str = "doc_id, source, copy", table: str = "documents") -> str:
    weight = " ".join(f"WHEN source = '{s}' THEN {float(w)!r}::DOUBLE" for s, w in mix.weights.items())
    weight = f"CASE {weight} ELSE {mix.default_weight!r}::DOUBLE END" if weight else f"{mix.default_weight!r}::DOUBLE"
    target = f"{float(mix.total_tokens)!r}::DOUBLE" if mix.total_tokens is not None else "all_tokens::DOUBLE"
    return f"""
WITH totals AS (
  SELECT source, coalesce(sum(len(regexp_extract_all(text, '[^ \\t\\n\\r\\f]+'))), 0)::BIGINT AS tokens FROM {table} GROUP BY source
), weighted AS (SELECT *, {weight} AS weight FROM totals),
whole AS (SELECT sum(tokens) AS all_tokens, sum(weight) AS all_weight FROM weighted WHERE tokens > 0),
rates AS (SELECT source AS src, CASE WHEN tokens = 0 THEN 1.0::DOUBLE WHEN all_weight > 0 THEN weight * {target} / (all_weight * tokens::DOUBLE) ELSE 0.0::DOUBLE END AS rate
  FROM weighted, whole),
counted AS (
  SELECT d.*, (floor(rate) + CASE WHEN ('0x' || substr(md5('{mix.seed}:' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT::DOUBLE / {float(1 << 52)!r}::DOUBLE < rate - floor(rate) THEN 1 ELSE 0 END)::INT AS copies
  FROM {table} d JOIN rates ON d.source IS NOT DISTINCT FROM rates.src
)
SELECT {columns} FROM (SELECT *, unnest(range(copies))::INT AS copy FROM counted WHERE copies > 0) t
"""
