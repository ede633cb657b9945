"""The queries of the training-data operators and their SQL, for the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.llm import bpe, exact_dedup, html_extract, mixing, repair, sharding, simhash, token_rollup, topk, toxicity
from pagewright.llm.common import materialise, scratch_path, table


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded, and decoded again."""
    docs = bpe.encode_and_decode(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select("doc_id", "token_ids", F.size("token_ids").alias("n_tokens"), "round_trip")


def op2_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's token ids, compressed; the rules of the shards are rows too."""
    return repair.compress_documents(table(spark, sf_dir, "documents"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicate_pairs(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.duplicate_pairs(table(spark, sf_dir, "documents").select("doc_id", "text"))


SHARDS_BEFORE, SHARDS_AFTER = 1024, 1280


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.resharding(table(spark, sf_dir, "documents"), SHARDS_BEFORE, SHARDS_AFTER)


def op6_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_text(table(spark, sf_dir, "pages")).drop("html")


TOP_K_QUERIES = "vec_id % 20 = 0"


def op7_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best partners, among all vectors, of those whose id is divisible by twenty."""
    return topk.top_k(table(spark, sf_dir, "embeddings"), k=10, queries=F.expr(TOP_K_QUERIES))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "source", "copy")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.with_toxicity(docs.select("doc_id", "text"), model).select("doc_id", "toxicity", "toxic")


def op10_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents inserted under two tokenizers, one of the inserts sent twice; the BPE counts
    revised to include an end-of-text token; exact copies deleted, row by row."""
    docs = table(spark, sf_dir, "documents")
    docs = exact_dedup.mark_duplicates(docs.select("doc_id", "text", "source", "lang"))
    counts = docs.select("source", "lang", "stays", mixing.token_count(F.col("text")).alias("words"), token_rollup.bpe_count(F.col("text")).alias("bpe"))
    counts = materialise(counts, "token-counts")
    rollup = token_rollup.TokenRollup(spark, scratch_path(spark, "token-rollup"))
    words, bpe_, more = F.col("words"), F.col("bpe"), F.col("bpe") + 1
    inserts = token_rollup.changes(counts, "words-1", words).union(token_rollup.changes(counts, "byte-bpe-50k-1", bpe_))
    rollup.commit("load-1", inserts)
    rollup.commit("load-1", inserts)  # sent again: nothing changes
    rollup.commit("end-of-text-1", token_rollup.revisions(counts, "byte-bpe-50k-1", bpe_, more))
    gone = counts.where("NOT stays")
    rollup.commit("dedup-1", token_rollup.changes(gone, "words-1", words, -1).union(token_rollup.changes(gone, "byte-bpe-50k-1", more, -1)))
    return rollup.totals()


QUERIES = {
    "op1_bpe": op1_bpe,
    "op2_repair": op2_repair,
    "op3_simhash": op3_simhash,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_sharding": op5_sharding,
    "op6_html": op6_html,
    "op7_topk": op7_topk,
    "op8_mixing": op8_mixing,
    "op9_toxicity": op9_toxicity,
    "op10_token_rollup": op10_token_rollup,
}
ORACLES = {
    "op4_exact_dedup": exact_dedup.ORACLE_SQL,
    "op5_sharding": sharding.oracle_sql(SHARDS_BEFORE, SHARDS_AFTER),
    "op7_topk": topk.oracle_sql(10, TOP_K_QUERIES),
    "op8_mixing": mixing.oracle_sql(),
}
