"""Typography: characters become styled spans, drawn rules become decorations, sizes become
heading levels. Each step keeps the page as its only partitioning, so one shuffle serves all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewright.functions.text import strip
from pagewright.schema import PAGE_KEY

FORCE_BOLD, ITALIC = 1 << 18, 1 << 6
BOLD_NAMES, ITALIC_NAMES = r"(?i)bold|black|heavy|semibold|demibold|ultra", r"(?i)italic|oblique"
RULE_THICKNESS, RULE_WIDTH, RULE_COVERAGE = 3.0, 4.0, 0.55
HEADING_RATIO, BOLD_HEADING_RATIO, HEADING_CHARS, BOLD_HEADING_CHARS = 1.15, 1.08, 200, 120


def is_bold(font: Column, flags: Column, weight: Column) -> Column:
    marked = flags.bitwiseAND(FORCE_BOLD) != 0
    return F.coalesce(marked, F.lit(False)) | F.coalesce(weight >= 600, F.lit(False)) | F.coalesce(font.rlike(BOLD_NAMES), F.lit(False))


def is_italic(font: Column, flags: Column) -> Column:
    return F.coalesce(flags.bitwiseAND(ITALIC) != 0, F.lit(False)) | F.coalesce(font.rlike(ITALIC_NAMES), F.lit(False))


def character(codepoint: Column) -> Column:
    """The one-character string of a code point."""
    return F.decode(F.unhex(F.lpad(F.hex(codepoint.cast("bigint")), 8, "0")), "UTF-32")


def whole_box(*names: str) -> Column:
    ok = F.lit(True)
    for n in names or ("x0", "y0", "x1", "y1"):
        ok = ok & F.col(n).isNotNull()
    return ok


def spans_from_chars(chars: DataFrame, key: tuple[str, ...] = PAGE_KEY) -> DataFrame:
    """Runs of equal font, size to a tenth, weight and slant. Lone surrogates and characters without
    a box are left out before line ends are looked at, so a line end without a box ends no span.
    Blank spans go. Sizes halfway between tenths go to the even one."""
    c = chars.where(~F.col("codepoint").between(0xD800, 0xDFFF) & whole_box())
    font = F.coalesce(F.col("font"), F.lit(""))
    c = c.withColumns({"font": font, "bold": is_bold(font, F.col("flags"), F.col("weight")), "italic": is_italic(font, F.col("flags")), "__nl": F.col("codepoint").isin(10, 13)})
    order = Window.partitionBy(*key).orderBy("char_index")
    c = c.withColumn("__style", F.struct("font", F.bround("size", 1).alias("s"), "bold", "italic"))
    starts = F.lag("__nl").over(order).isNull() | F.lag("__nl").over(order) | ~F.col("__style").eqNullSafe(F.lag("__style").over(order))
    c = c.withColumn("__starts", F.when(~F.col("__nl") & starts, 1).otherwise(0)).withColumn("__run", F.sum("__starts").over(order)).where(~F.col("__nl"))
    letters = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("char_index", character(F.col("codepoint")).alias("ch")))), lambda x: x["ch"]), "")
    first = lambda n: F.min_by(n, "char_index").alias(n)
    spans = c.groupBy(*key, "__run").agg(letters.alias("text"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), first("font"), first("size"), first("bold"), first("italic"))
    spans = spans.where(strip(F.col("text")) != "")
    index = F.row_number().over(Window.partitionBy(*key).orderBy("__run")) - 1
    plain = {"underline": F.lit(False), "strikeout": F.lit(False), "heading_level": F.lit(0)}
    return spans.withColumn("span_index", index).withColumns(plain).select(*key, "span_index", "text", "x0", "y0", "x1", "y1", "font", "size", "bold", "italic", *plain)


def rules(objects: DataFrame, key: tuple[str, ...] = PAGE_KEY) -> DataFrame:
    """Thin wide paths: what underlines are drawn with."""
    thin = ((F.col("y1") - F.col("y0")) <= RULE_THICKNESS) & ((F.col("x1") - F.col("x0")) >= RULE_WIDTH)
    return objects.where((F.col("kind") == "path") & whole_box() & thin).select(*key, "x0", "y0", "x1", "y1")


def decorate(spans: DataFrame, rule_rows: DataFrame, key: tuple[str, ...] = PAGE_KEY) -> DataFrame:
    """Sets ``underline`` and ``strikeout`` of spans that a rule covers for the most part: at or below
    the foot of the letters, or through their middle. Several rules may set both."""
    r = rule_rows.select(*[F.col(k).alias(f"__{k}") for k in key], F.col("x0").alias("__rx0"), F.col("x1").alias("__rx1"), ((F.col("y0") + F.col("y1")) / 2).alias("__mid"))
    s = spans.drop("underline", "strikeout")
    h, w = F.col("y1") - F.col("y0"), F.col("x1") - F.col("x0")
    covered = F.greatest(F.least("x1", "__rx1") - F.greatest("x0", "__rx0"), F.lit(0.0)) >= RULE_COVERAGE * w
    under = F.col("__mid").between(F.col("y0") - 0.35 * h, F.col("y0") + 0.12 * h)
    through = F.col("__mid").between(F.col("y0") + 0.30 * h, F.col("y0") + 0.72 * h)
    on = (h > 0) & (w > 0) & covered & (under | through)
    for k in key:
        on = on & (F.col(k) == F.col(f"__{k}"))
    hit = s.join(r, on, "inner").groupBy(*key, "span_index").agg(F.bool_or(under).alias("underline"), F.bool_or(through).alias("strikeout"))
    out = s.join(hit, [*key, "span_index"], "left")
    no = lambda c: F.coalesce(F.col(c), F.lit(False)).alias(c)
    return out.select(*[no(c) if c in ("underline", "strikeout") else F.col(c) for c in spans.columns])


def body_size(spans: DataFrame, key: tuple[str, ...] = PAGE_KEY) -> DataFrame:
    """The median type size of a page, over its characters."""
    sized = F.when(F.col("size") > 0, F.col("size"))
    return spans.groupBy(*key).agg(F.percentile(sized, F.lit(0.5), F.length(strip(F.col("text"))).cast("bigint")).alias("body"))


def heading_levels(spans: DataFrame, key: tuple[str, ...] = PAGE_KEY) -> DataFrame:
    """Sets ``heading_level``: the three largest sizes well above the body size are levels 1 to 3;
    short bold text slightly above it takes the next one. Long texts are never headings."""
    page = Window.partitionBy(*key)
    n = F.length(strip(F.col("text")))
    sized = F.when(F.col("size") > 0, F.col("size"))
    s = spans.withColumn("__n", n.cast("bigint")).withColumn("__body", F.percentile(sized, F.lit(0.5), F.col("__n")).over(page))
    size = F.bround("size", 1)
    large = F.col("size") >= F.col("__body") * HEADING_RATIO
    s = s.withColumn("__tops", F.slice(F.sort_array(F.collect_set(F.when(large & (F.col("__n") > 1), size)).over(page), asc=False), 1, 3))
    place = F.array_position("__tops", size)
    short_bold = F.col("bold") & (F.col("size") >= F.col("__body") * BOLD_HEADING_RATIO) & (F.col("__n") <= BOLD_HEADING_CHARS)
    level = F.when((F.col("__n") == 0) | (F.col("__n") > HEADING_CHARS) | F.col("__body").isNull(), F.col("heading_level")).when((place > 0) & large, place).when(short_bold, F.least(F.size("__tops") + 1, F.lit(3))).otherwise(F.col("heading_level"))
    return s.withColumn("heading_level", level.cast("int")).drop("__n", "__body", "__tops")


def extract_spans(chars: DataFrame, objects: DataFrame, detect_headings: bool = True, key: tuple[str, ...] = PAGE_KEY) -> DataFrame:
    spans = decorate(spans_from_chars(chars, key), rules(objects, key), key)
    return heading_levels(spans, key) if detect_headings else spans
