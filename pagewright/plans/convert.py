"""Documents to Markdown: triage, two tiers, merge, typography, regions, layout. Each part is an operator of its
own; here they are put together over tables, for one document as for all."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.adapters.model import Factory, ModelError, run_ladder
from pagewright.config import PipelineOptions
from pagewright.operators import bench, formatting, ladder, layout, merge, regions, spans, triage
from pagewright.schema import PAGE_KEY, PAGE_OBJECTS
from pagewright.sources import files


@dataclass(frozen=True)
class Converted:
    """``documents``: Markdown and summary of each; ``pages``: text, tier and counters of each; ``decisions``: profile,
    reasons and route of each page; ``layout``: blocks, if asked for."""

    documents: DataFrame
    pages: DataFrame
    decisions: DataFrame
    layout: DataFrame | None = None


def _written(df: DataFrame, path: str) -> DataFrame:
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def convert(pages: DataFrame, work: str, options: PipelineOptions | None = None, client: Factory | None = None, objects: DataFrame | None = None, chars: DataFrame | None = None, structured: DataFrame | None = None, specialists: DataFrame | None = None, answers: DataFrame | None = None) -> Converted:
    """Convert the documents of ``pages`` (``schema.PAGES``).

    ``objects`` and ``chars`` are what was drawn on them; without them no image or path escalates a page and no
    typography comes back. ``structured`` are pages of a structured extractor, ``client`` makes the
    page model's clients, ``specialists`` and ``answers`` are what ``adapters.specialists`` has for the regions.
    ``work`` is a folder that the executors share: routes and attempts are kept there, and a run that is started again
    with the same folder asks the model for nothing twice.
    """
    o = options or PipelineOptions()
    profile = triage.profile_text(pages)
    if objects is not None:
        profile = triage.profile_objects(objects, profile)
    decisions = _written(triage.plan_tiers(triage.decide(profile, o.thresholds), o), f"{work}/decisions")
    key = list(PAGE_KEY)
    one, two = decisions.where("tier = 1"), decisions.where("tier = 2")
    tier1 = files.structured_or_text(one, structured)
    if client is None:
        if o.tier2_enabled and not two.isEmpty():
            raise ModelError("pages escalate: give a client, or switch tier 2 off")
        empty = "doc_id string, page_index int, markdown string, degraded boolean, fallback boolean, input_tokens int, output_tokens int"
        tier2 = pages.sparkSession.createDataFrame([], empty)
    else:
        attempts = run_ladder(two.drop("reasons"), client, f"{work}/attempts", o.endpoint, o.max_tier2_workers)
        tier2 = _written(ladder.decide_ladder(attempts, o.endpoint, two), f"{work}/tier2")
        if not o.endpoint.fallback_to_text_layer and (failed := tier2.where("error IS NOT NULL").select(*key, "error").first()):
            raise ModelError(f"page {failed.page_index} of {failed.doc_id}: {failed.error}")
    merged = merge.merge_tiers(decisions, tier1, tier2)
    drawn = objects if objects is not None else pages.sparkSession.createDataFrame([], PAGE_OBJECTS)
    typed = spans.extract_spans(chars, drawn, o.detect_headings) if chars is not None else None
    if typed is not None and o.recover_formatting:
        merged = formatting.apply_formatting(merged, typed).withColumnRenamed("spans_applied", "formatting_marks")
    blocks = None
    if typed is not None and o.emit_layout:
        blocks = _written(layout.document_layout(pages, typed), f"{work}/layout")
        merged = merged.join(blocks.groupBy(*key).agg(F.count("*").alias("layout_blocks")), key, "left")
    if specialists is not None and answers is not None and objects is not None and chars is not None:
        found = regions.detect_regions(pages, objects, chars)
        merged = regions.fuse_pages(merged, regions.dispatch(found, specialists, answers))
    merged = _written(merged, f"{work}/pages")
    documents = merge.concat_pages(merged).join(merge.document_summary(merged), "doc_id")
    return Converted(documents, merged, decisions, blocks)


def batch(spark: SparkSession, root: str, target: str, work: str, decoder: files.Decoder, options: PipelineOptions | None = None, client: Factory | None = None, skip_existing: bool = True) -> DataFrame:
    """Convert all documents below ``root`` to one Markdown file each below ``target``; a document with a file there
    is skipped. A row for each document that was tried: its summary, or why it could not be read. One
    that cannot be read stops nothing and writes nothing."""
    found = files.with_output_path(files.discover(spark, root))
    if skip_existing:
        found = files.without_output(found, target)
    decoded = _written(files.decode_documents(found, decoder), f"{work}/decoded")
    failed = decoded.where("error IS NOT NULL").groupBy("doc_id").agg(F.min_by("error", "page_index").alias("error"))
    good = decoded.join(failed, "doc_id", "left_anti")
    made = convert(files.pages_of(good), work, options, client, files.objects_of(good), files.chars_of(good))
    names = found.select(F.col("path").alias("doc_id"), "output")
    documents = _written(made.documents, f"{work}/documents")
    files.write_markdown(documents.join(names, "doc_id"), target, "output")
    return documents.drop("markdown").join(failed, "doc_id", "full")


def prepare_candidate(pdfs: DataFrame, work: str, target: str, convert_all: Callable[[DataFrame], DataFrame], repeats: int = 1) -> DataFrame:
    """One Markdown file for each benchmark PDF and repeat below ``target``, and the summary of how that went.

    ``pdfs`` has ``pdf``; ``convert_all`` is any conversion: it is given the PDFs that lack a file, and returns pdf,
    markdown, error, pages and escalated. A PDF that failed gets an empty file, which scores nothing, and counts as failed.
    """
    spark = pdfs.sparkSession
    names = pdfs.select("pdf").distinct()
    rows = bench.candidate_rows(names, spark.createDataFrame([], "pdf string, markdown string, error string, pages bigint, escalated bigint"), files.existing_outputs(spark, target), repeats)
    due = _written(rows.where(~F.col("skipped")).select("pdf").distinct(), f"{work}/due")
    outcomes = _written(convert_all(pdfs.join(due, "pdf", "left_semi")), f"{work}/outcomes")
    rows = _written(bench.candidate_rows(names, outcomes, files.existing_outputs(spark, target), repeats), f"{work}/candidate")
    files.write_markdown(rows.where(~F.col("skipped")), target, "target", "content")
    return bench.candidate_summary(rows)
