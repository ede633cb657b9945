"""Anchor text for page prompts: positioned lines within a budget of characters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewright.functions.text import strip
from pagewright.schema import PAGE_KEY

MAX_CHARS = 6000
TRUNCATED = "[...anchor text truncated...]"


def anchor_line(x: Column, y: Column, text: Column) -> Column:
    whole = lambda c: F.bround(c).cast("bigint").cast("string")
    return F.concat(F.lit("["), whole(x), F.lit(","), whole(y), F.lit("] "), strip(text))


def anchors(rects: DataFrame, max_chars: int = MAX_CHARS, key: tuple[str, ...] = PAGE_KEY) -> DataFrame:
    """One text for each page: its rectangles' lines in order (``rect_index``) while they and their line
    ends fit; the first that does not is replaced by a marker and ends the text. Blank ones do not count."""
    lines = rects.where(strip(F.coalesce("text", F.lit(""))) != "").withColumn("__line", anchor_line(F.col("x0"), F.col("y0"), F.col("text")))
    used = F.sum(F.length("__line") + 1).over(Window.partitionBy(*key).orderBy("rect_index"))
    lines = lines.withColumn("__used", used)
    kept = F.when(F.col("__used") <= max_chars, F.struct("rect_index", "__line"))
    body = F.transform(F.array_sort(F.collect_list(kept)), lambda x: x["__line"])
    over = F.when(F.max("__used") > max_chars, F.array(F.lit(TRUNCATED))).otherwise(F.array())
    return lines.groupBy(*key).agg(F.array_join(F.concat(body, over), "\n").alias("anchors"))


def anchored_prompt(prompt: Column, header: str, anchor_text: Column) -> Column:
    """The prompt alone where a page has no anchors."""
    none = F.coalesce(anchor_text, F.lit("")) == ""
    return F.when(none, prompt).otherwise(F.concat(prompt, F.lit("\n\n" + header + "\n"), anchor_text))
