"""The training-data pipeline over ``documents``: toxic texts go, of equal texts one stays, of
near copies one stays, sources are mixed to their target weights, texts become token ids.

Each stage takes a table with at least ``doc_id``, ``text`` and ``source``; all but the last return its columns, in
their order, whatever else there is and whatever it is called. Edge cases:

* a NULL text is not toxic, equals nothing and is near to nothing, so its row stays; it counts no tokens
  in the mix and has NULL ids. Empty texts equal each other: one stays;
* a NULL id is larger than any id where copies are compared, is near to nothing, and is drawn as
  one key in the mix. A NULL source is a source of its own; other columns may hold NULLs;
* of rows repeated in all columns one stays. Ties go to the smallest id;
* an empty table gives an empty one, also without labels; texts are taken whole, however long.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pagewright.llm import bpe, exact_dedup, mixing, simhash, toxicity
from pagewright.llm.common import fresh, scratch_path, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labels, rejects go."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.drop_toxic(docs, model)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the smallest id stays."""
    return exact_dedup.exact_dedup(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the one with the smallest id stays."""
    return simhash.near_dedup(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the target weights ask."""
    (copy,) = fresh(docs, "copy")
    return mixing.mix_sources(docs, copy=copy).drop(copy)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their token ids, and whether these decode to the text."""
    return bpe.encode_and_decode(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("SimHash near-dedup", drop_near_copies),
    ("mixing sources to target weights", mix),
    ("byte-level BPE encoding and decoding", tokenize),
]

#: Boosted trees, SimHash and BPE are beyond SQL; tests/llm/test_pipeline.py holds run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; each but the last is written and read again as the next one's input."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, f"stage-{name.replace(' ', '-').lower()}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
