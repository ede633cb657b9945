"""Layout blocks with reading order: spans become rows, rows are cut at gutters into lines, lines
fall into columns and blocks. Spans and the pages' sizes are shuffled and sorted once by page, which is all the memory
that a task needs; what follows is done on batches of whole pages.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from pagewright.functions.text import SPACES, lstrip
from pagewright.operators.lots import whole_pages
from pagewright.schema import PAGE_KEY

LINE_GAP, ROW_TOLERANCE, GUTTER_HEIGHTS, GUTTER_WIDTH = 1.8, 0.55, 6.0, 0.035
MIN_LINES, MIN_SIDE, SIDE_SLACK, MAX_CROSSING = 6, 3, 0.02, 0.15


_BLOCK = "reading_order int, text string, x double, y double, w double, h double, level bigint"
_NONE = np.iinfo(np.int64).min


def rows_down(heights: np.ndarray, page: np.ndarray, tolerance: np.ndarray) -> np.ndarray:
    """The row of each height on its page, given in order: one more whenever it is too far from the first of its row."""
    out, at, anchor, row, reach = [], -1, 0.0, 0, tolerance.tolist()
    for h, p in zip(heights.tolist(), page.tolist()):
        if p != at:
            at, anchor, row = p, h, 0
        elif not abs(h - anchor) <= reach[p]:
            anchor, row = h, row + 1
        out.append(row)
    return np.array(out, np.int64)


def median_heights(height: np.ndarray, page: np.ndarray, pages: int) -> np.ndarray:
    """Of each page, of the positive ones; 10 without one."""
    positive = height > 0
    height, page = height[positive], page[positive]
    height = height[np.lexsort((height, page))]
    n = np.bincount(page, minlength=pages)
    some, start = n > 0, np.cumsum(n) - n
    out = np.full(pages, 10.0)
    first, n = start[some], n[some]
    out[some] = 0.5 * height[first + (n - 1) // 2] + 0.5 * height[first + n // 2]
    return out


def _starts(*columns: np.ndarray) -> np.ndarray:
    """Which rows differ from the one before in any column."""
    new = np.ones(len(columns[0]), bool)
    if len(new):
        new[1:] = np.any([c[1:] != c[:-1] for c in columns], axis=0)
    return new


def _joined(texts: pa.Array, begins: np.ndarray) -> pa.Array:
    """The texts of each group with blanks between, trimmed; NULL ones are left out."""
    places = np.r_[begins, len(texts)]
    if texts.null_count:
        places = np.r_[0, np.cumsum(texts.is_valid().to_numpy(zero_copy_only=False))][places]
        texts = texts.drop_null()
    return pc.utf8_trim(pc.binary_join(pa.ListArray.from_arrays(pa.array(places, pa.int32()), texts), " "), characters=SPACES)


def _hulls(box: np.ndarray, begins: np.ndarray) -> np.ndarray:
    return np.stack([f.reduceat(c, begins) for f, c in zip((np.fmin, np.fmin, np.fmax, np.fmax), box)])


def page_lines(page: np.ndarray, box: np.ndarray, number: np.ndarray, level: np.ndarray, texts: pa.Array, width: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """Page, box, heading level and text of the lines, down the pages. A row is cut where the gap to the span before is
    wider than the gutter."""
    known = np.where(np.isnan(box), -np.inf, box)  # NULL comes first
    middle = -(box[1] + box[3]) / 2.0
    down = np.where(np.isnan(middle), -np.inf, middle)
    height = median_heights(box[3] - box[1], page, len(width))
    order = np.lexsort((number, known[0], down, page))
    row = np.empty(len(page), np.int64)
    row[order] = rows_down(middle[order], page[order], height * ROW_TOLERANCE)
    order = np.lexsort((number, down, known[0], row, page))
    page, box, row, level = page[order], box[:, order], row[order], level[order]
    gutter = np.maximum(height * GUTTER_HEIGHTS, width * GUTTER_WIDTH)
    new = _starts(page, row)
    new[1:] |= box[0, 1:] - box[2, :-1] > gutter[page[1:]]
    begins = np.flatnonzero(new)
    level = np.maximum.reduceat(level, begins)
    return page[begins], _hulls(box, begins), np.where(level == _NONE, 0, level), _joined(texts.take(pa.array(order)), begins)


def line_columns(page: np.ndarray, box: np.ndarray, width: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lines in reading order, and their columns: 0 for lines across the middle and on pages without two columns, 1
    and 2 for the halves. A line that touches the middle from both sides is in both halves."""
    mid, slack = width[page] / 2.0, width[page] * SIDE_SLACK
    left, right = box[2] <= mid + slack, box[0] >= mid - slack
    n, l, r = (np.bincount(page[m], minlength=len(width)) for m in (np.ones(len(page), bool), left, right))
    two = ((n >= MIN_LINES) & (l >= MIN_SIDE) & (r >= MIN_SIDE) & (n - l - r <= np.maximum(2.0, n * MAX_CROSSING)))[page]
    sides = [np.flatnonzero(m) for m in (~two | ~(left | right), two & left, two & right)]
    line, column = np.concatenate(sides), np.repeat([0, 1, 2], [len(x) for x in sides])
    order = np.lexsort((line, column, page[line]))
    return line[order], column[order]


def page_blocks(page: np.ndarray, box: np.ndarray, number: np.ndarray, level: np.ndarray, texts: pa.Array, width: np.ndarray, height: np.ndarray) -> tuple[np.ndarray, list[pa.Array]]:
    """Pages of the blocks and their columns, normalised, of the spans of pages. A line goes on with the block of the line
    before it iff levels are equal, they overlap across and the gap is small for the line's height."""
    page, box, level, texts = page_lines(page, box, number, level, texts, width)
    line, column = line_columns(page, box, width)
    page, box, level, texts = page[line], box[:, line], level[line], texts.take(pa.array(line))
    x0, y0, x1, y1 = box
    near = y0[:-1] - y1[1:] <= np.fmax(y1[1:] - y0[1:], 1.0) * LINE_GAP
    over = np.fmin(x1[:-1], x1[1:]) - np.fmax(x0[:-1], x0[1:]) > 0
    new = _starts(page, column, level)
    new[1:] |= ~(near & over)
    begins = np.flatnonzero(new)
    text, box = _joined(texts, begins), _hulls(box, begins)
    some = np.flatnonzero(pc.not_equal(text, "").to_numpy(zero_copy_only=False))
    page, level, box, text = page[begins][some], level[begins][some], box[:, some], text.take(pa.array(some))
    w, h = width[page], height[page]
    at = [np.fmax(box[0] / w, 0.0), np.fmax((h - box[3]) / h, 0.0), np.fmin((box[2] - box[0]) / w, 1.0), np.fmin((box[3] - box[1]) / h, 1.0)]
    order = np.arange(len(page)) - np.searchsorted(page, page)
    return page, [pa.array(order, pa.int32()), text, *(pa.array(c + 0.0) for c in at), pa.array(level)]  # + 0.0: no zero is negative


def block_label(level: Column, text: Column) -> Column:
    t = lstrip(text)
    bullet = t.rlike("^[-*•] ")
    number = t.rlike(r"(?U)^(\d\d|\d\.)") & F.contains(F.substring(t, 1, 4), F.lit(". "))
    return F.when(level == 1, "Title").when(level > 1, "Section").when(bullet | number, "List").otherwise("Text")


def document_layout(pages: DataFrame, spans: DataFrame, key: tuple[str, ...] = PAGE_KEY) -> DataFrame:
    """Blocks of all pages, normalised, origin top left. x and y are held at 0 or more, w and h at 1 or
    less, each by itself. Pages without an area have none."""
    n_keys = len(key)
    number = lambda c, kind="double": F.col(c).cast(kind)
    columns = ("is_page", "a", "b", "c", "d", "number", "level", "text")
    item = lambda df, *c: df.select(*key, *[x.alias(n) for x, n in zip(c, columns)]).dropna(subset=list(key))
    none = F.lit(None)
    sizes = item(pages.where((F.col("width") > 0) & (F.col("height") > 0)), F.lit(True), number("width"), number("height"), none.cast("double"), none.cast("double"), none.cast("bigint"), none.cast("bigint"), none.cast("string"))
    rows = item(spans, F.lit(False), *map(number, ("x0", "y0", "x1", "y1")), number("span_index", "bigint"), number("heading_level", "bigint"), number("text", "string")).unionByName(sizes)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole, begins in whole_pages(batches, n_keys):
            page = np.zeros(whole.num_rows, np.int64)
            page[begins[1:]] = 1
            page = np.cumsum(page)
            is_page = whole.column(n_keys).to_numpy(zero_copy_only=False)
            box = np.stack([c.to_numpy(zero_copy_only=False) for c in whole.columns[n_keys + 1 : n_keys + 5]])
            width, height = np.zeros((2, len(begins)))
            width[page[is_page]], height[page[is_page]] = box[:2, is_page]
            of = np.flatnonzero(~is_page & (width[page] > 0))
            if len(of):
                index, level = (c.fill_null(int(_NONE)).to_numpy()[of] for c in whole.columns[n_keys + 5 : n_keys + 7])
                p, made = page_blocks(page[of], box[:, of], index, level, whole.column(n_keys + 7).take(pa.array(of)), width, height)
                yield pa.RecordBatch.from_arrays([k.take(pa.array(begins[p])) for k in whole.columns[:n_keys]] + made, names=names)

    schema = StructType(rows.select(*key).schema.fields + StructType.fromDDL(_BLOCK).fields)
    names = schema.names
    b = rows.repartition(*key).sortWithinPartitions(*key).mapInArrow(blocks, schema)
    kind = spans.select(F.coalesce("heading_level", F.lit(0)).alias("level")).schema["level"].dataType
    return b.select(*key, "reading_order", "text", "x", "y", "w", "h", block_label(F.col("level"), F.col("text")).alias("label"), F.col("level").cast(kind).alias("heading_level"))


def layout_json(pages: DataFrame, blocks: DataFrame, key: tuple[str, ...] = PAGE_KEY) -> DataFrame:
    """One JSON document for each page, pages without blocks included."""
    box = F.struct("x", "y", "w", "h", "label")
    item = F.struct("reading_order", F.col("label").alias("type"), F.col("text").alias("md"), F.col("text").alias("value"), box.alias("bbox"))
    by_page = blocks.groupBy(*key).agg(F.array_sort(F.collect_list(item)).alias("i"))
    j = pages.join(by_page, list(key), "left")
    items = F.transform(F.coalesce("i", F.array()), lambda x: F.struct(x["type"].alias("type"), x["md"].alias("md"), x["value"].alias("value"), x["bbox"].alias("bbox")))
    text = F.array_join(F.transform(items, lambda x: x["md"]), "\n")
    return j.select(*key, F.to_json(F.struct((F.col(key[-1]) + 1).alias("page_number"), "width", "height", text.alias("text"), items.alias("items"))).alias("layout"))
