"""Benchmark preparation and reports over tables of files, tests and outcomes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

IMAGE_SUFFIXES = (".png", ".jpg", ".jpeg", ".tif", ".tiff", ".bmp", ".webp", ".gif", ".jp2")


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))


def is_image(path: Column) -> Column:
    return suffix(path).isin(*IMAGE_SUFFIXES)


def is_document(path: Column) -> Column:
    return suffix(path).isin(".pdf", *IMAGE_SUFFIXES)


def category(path: Column) -> Column:
    """The name of the folder that holds the file; empty at the top."""
    return F.regexp_extract(path, r"(?:^|/)([^/]+)/[^/]+$", 1)


def bench_files(files: DataFrame, categories: list[str] | None = None, limit: int | None = None, path: str = "path") -> DataFrame:
    """PDFs with their category, in order of path; a limit is applied to the sorted list."""
    out = files.where(suffix(F.col(path)) == ".pdf").withColumn("category", category(F.col(path)))
    if categories is not None:
        out = out.where(F.col("category").isin(*categories))
    out = out.orderBy(path)
    return out.limit(limit) if limit is not None else out


def parse_tests(lines: DataFrame, line: str = "line") -> DataFrame:
    """Test rows with the ``pdf`` that they refer to; blank and malformed lines are dropped, the raw
    line is kept."""
    ok = F.try_parse_json(F.col(line)).isNotNull() & (F.trim(F.col(line)) != "")
    return lines.where(ok).withColumn("pdf", F.get_json_object(F.col(line), "$.pdf"))


def subset_tests(tests: DataFrame, kept: DataFrame) -> DataFrame:
    """Tests whose PDF is kept; a test file without any does not appear."""
    return tests.join(kept.select("pdf"), "pdf", "left_semi")


def candidate_path(pdf: Column, page: Column | int = 1, repeat: Column | int = 1) -> Column:
    """``tables/a.pdf`` -> ``tables/a_pg1_repeat1.md``."""
    as_text = lambda x: x.cast("string") if isinstance(x, Column) else F.lit(str(x))
    return F.concat(F.regexp_replace(pdf, r"\.[^./]+$", ""), F.lit("_pg"), as_text(page), F.lit("_repeat"), as_text(repeat), F.lit(".md"))


def markdown_path(path: Column) -> Column:
    return F.concat(F.regexp_replace(path, r"\.[^./]+$", ""), F.lit(".md"))


def pending(files: DataFrame, done: DataFrame, on: str = "path") -> DataFrame:
    """Files without an output."""
    return files.join(done.select(on), on, "left_anti")


def candidate_rows(files: DataFrame, outcomes: DataFrame, existing: DataFrame, repeats: int = 1) -> DataFrame:
    """A row for each target file: whether it is skipped (all targets of its PDF exist) and what is
    written. A conversion that failed or is missing writes an empty file."""
    t = files.withColumn("repeat", F.explode(F.sequence(F.lit(1), F.lit(repeats)))).withColumn("target", candidate_path(F.col("pdf"), 1, F.col("repeat")))
    there = t.join(existing.select(F.col("path").alias("target"), F.lit(True).alias("__there")), "target", "left")
    every = there.groupBy("pdf").agg(F.bool_and(F.coalesce("__there", F.lit(False))).alias("skipped"))
    j = t.join(every, "pdf").join(outcomes, "pdf", "left")
    return j.select("pdf", "repeat", "target", "skipped", F.when(~F.col("skipped"), F.when(F.col("error").isNull(), F.coalesce("markdown", F.lit(""))).otherwise("")).alias("content"), "error", "pages", "escalated")


def candidate_summary(rows: DataFrame) -> DataFrame:
    """A skipped PDF counts as converted once and adds no pages; each repeat that ran counts again."""
    ran = ~F.col("skipped")
    good, bad = ran & F.col("error").isNull(), ran & F.col("error").isNotNull()
    first = F.col("skipped") & (F.col("repeat") == 1)
    total, esc = F.coalesce(F.sum(F.when(good, F.col("pages"))), F.lit(0)), F.coalesce(F.sum(F.when(good, F.col("escalated"))), F.lit(0))
    return rows.agg(F.count_if(good | first).alias("pdfs_converted"), F.count_if(bad).alias("pdfs_failed"), total.alias("pages_total"), esc.alias("pages_escalated"), F.when(total > 0, esc / total).otherwise(0.0).alias("escalation_rate"))


def report_json(summary: DataFrame, scores: DataFrame, failures: DataFrame, name: str) -> DataFrame:
    """The report as one JSON document; at most 50 failures are listed, in order of name."""
    s = scores.select("overall", "ci_low", "ci_high", "categories")
    f = failures.orderBy("pdf").limit(50).agg(F.sort_array(F.collect_list(F.struct("pdf", "error"))).alias("failures"))
    row = summary.crossJoin(s).crossJoin(f)  # one row each
    conv = F.struct("pdfs_converted", "pdfs_failed", "pages_total", "pages_escalated", F.round("escalation_rate", 4).alias("escalation_rate"), "failures")
    cats = F.transform("categories", lambda c: F.struct(c["name"].alias("name"), c["score"].alias("score")))
    return row.select(F.to_json(F.struct(F.lit(name).alias("candidate"), "overall", "ci_low", "ci_high", cats.alias("categories"), conv.alias("conversion")), {"ignoreNullFields": "false"}).alias("report"))
