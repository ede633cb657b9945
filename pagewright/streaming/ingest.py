"""Continuous ingest: new page files are triaged and appended, failed ones are kept to be driven again.

The checkpoint remembers which files were seen; a batch that is run again after a failure replaces
its own folder, so no page is there twice. A file source does not offer a failed file a second
time, which is what the table of errors is for.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pagewright.config import PipelineOptions
from pagewright.operators.bench import is_document
from pagewright.operators.triage import decide, plan_tiers, profile_objects, profile_text
from pagewright.schema import PAGES
from pagewright.sources.files import Decoder, decode_documents, objects_of, pages_of


def triage_pages(pages: DataFrame, options: PipelineOptions | None = None) -> DataFrame:
    """Profile, route and tier of pages; the same plan for a batch and for a stream."""
    o = options or PipelineOptions()
    return plan_tiers(decide(profile_text(pages), o.thresholds), o)


def read_stream(spark: SparkSession, source: str, max_files: int = 1000) -> DataFrame:
    return spark.readStream.schema(PAGES).option("maxFilesPerTrigger", max_files).parquet(source)


def read_files(spark: SparkSession, source: str, max_files: int = 1000) -> DataFrame:
    """New documents below ``source``, with their bytes."""
    kinds = "path string, modificationTime timestamp, length bigint, content binary"
    found = spark.readStream.format("binaryFile").schema(kinds).option("recursiveFileLookup", True).option("maxFilesPerTrigger", max_files).load(source)
    return found.where(is_document(F.col("path"))).select("path", "content")


def start_ingest(spark: SparkSession, source: str, target: str, checkpoint: str, options: PipelineOptions | None = None, available_now: bool = False, decoder: Decoder | None = None) -> StreamingQuery:
    """Triage what is new under ``source`` into ``target/pages``: Parquet files of pages, or, with a ``decoder``, documents.
    Pages with an error also go to ``target/errors``."""

    def save(batch: DataFrame, number: int) -> None:
        if decoder is None:
            out = triage_pages(batch, options)
        else:  # decoded once: the profile of texts and that of objects both read what was written
            folder = f"{target}/decoded/batch={number}"
            decode_documents(batch, decoder).write.mode("overwrite").parquet(folder)
            decoded = spark.read.parquet(folder)
            out = triage_pages(profile_objects(objects_of(decoded), pages_of(decoded)), options)
        out.write.mode("overwrite").parquet(f"{target}/pages/batch={number}")
        out.where("error IS NOT NULL").select("doc_id", "page_index", "error").write.mode("overwrite").parquet(f"{target}/errors/batch={number}")

    stream = (read_stream(spark, source) if decoder is None else read_files(spark, source)).writeStream.foreachBatch(save).option("checkpointLocation", checkpoint)
    return (stream.trigger(availableNow=True) if available_now else stream.trigger(processingTime="30 seconds")).start()


def to_redrive(spark: SparkSession, target: str) -> DataFrame:
    """Documents with a failed page and no later batch in which all their pages were read."""
    pages = spark.read.option("basePath", f"{target}/pages").parquet(f"{target}/pages/*")
    last = pages.groupBy("doc_id").agg(F.max_by(F.struct("batch"), "batch").alias("b"))
    final = pages.join(last, "doc_id").where(F.col("batch") == F.col("b.batch"))
    return final.where("error IS NOT NULL").select("doc_id").distinct()
