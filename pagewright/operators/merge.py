"""Two-source merge, ordered reassembly, document roll-up."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEY = ("doc_id", "page_index")


def merge_tiers(decisions: DataFrame, tier1: DataFrame, tier2: DataFrame, key: tuple[str, ...] = KEY) -> DataFrame:
    """A page's markdown: that of tier 2 wherever it has a row, even a NULL one, else that of tier 1,
    else empty. Adds degraded and fallback of the tier-2 row. All three tables are shuffled by the same key."""
    t1 = tier1.select(*key, F.col("markdown").alias("__m1"))
    t2 = tier2.select(*key, F.col("markdown").alias("__m2"), F.lit(True).alias("__has"), *[F.col(c).alias(f"__{c}") for c in ("degraded", "fallback", "input_tokens", "output_tokens") if c in tier2.columns])
    j = decisions.join(t1, list(key), "left").join(t2, list(key), "left")
    text = F.when(F.col("__has"), F.coalesce("__m2", F.lit(""))).otherwise(F.coalesce("__m1", F.lit("")))
    flag = lambda c, zero: (F.coalesce(F.col(f"__{c}"), F.lit(zero)) if f"__{c}" in j.columns else F.lit(zero)).alias(c)
    return j.select(*decisions.columns, text.alias("markdown"), F.coalesce("__has", F.lit(False)).alias("from_tier2"), flag("degraded", False), flag("fallback", False), flag("input_tokens", 0), flag("output_tokens", 0))


def concat_pages(pages: DataFrame, doc: str = "doc_id", order: str = "page_index", text: str = "markdown") -> DataFrame:
    """Pages in order, joined by a blank line; empty ones are dropped, those of white space kept."""
    kept = F.when(F.col(text) != "", F.struct(F.col(order).alias("o"), F.col(text).alias("t")))
    parts = F.transform(F.array_sort(F.collect_list(kept)), lambda x: x["t"])
    return pages.groupBy(doc).agg(F.array_join(parts, "\n\n").alias("markdown"))


def document_summary(pages: DataFrame, doc: str = "doc_id") -> DataFrame:
    """The roll-up of a merged page table: pages, would-be escalations and their share, degraded and
    fallback pages, tokens, characters of the document, marks and layout blocks where counted."""
    total = lambda c: F.sum(F.col(c)) if c in pages.columns else F.lit(0)
    n, esc = F.count("*"), F.count_if("escalated")
    shown = F.count_if(F.col("markdown") != "")
    return pages.groupBy(doc).agg(
        n.alias("pages"),
        esc.alias("tier2_pages"),
        F.round(esc / n, 4).alias("tier2_fraction"),
        F.count_if("degraded").alias("degraded_pages"),
        F.count_if("fallback").alias("fallback_pages"),
        F.coalesce(total("input_tokens"), F.lit(0)).alias("input_tokens"),
        F.coalesce(total("output_tokens"), F.lit(0)).alias("output_tokens"),
        (F.coalesce(F.sum(F.length("markdown")), F.lit(0)) + 2 * F.greatest(shown - 1, F.lit(0))).alias("chars"),
        F.coalesce(total("formatting_marks"), F.lit(0)).alias("formatting_marks"),
        F.coalesce(total("layout_blocks"), F.lit(0)).alias("layout_blocks"),
    )
