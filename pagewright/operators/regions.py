"""Figure and chart regions from drawn objects, and what specialists make of them.

Pages, objects and characters are packed, neighbours on a page into one row, and shuffled once by page; regions are
then found on lots of whole pages. Members, lattices and characters inside given boxes are joins by page.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from pagewright.functions.text import rstrip, strip
from pagewright.operators.lots import changes, whole_pages
from pagewright.operators.spans import whole_box
from pagewright.schema import PAGE_KEY

MIN_PATHS, MAX_DENSITY, MIN_AREA, GAP = 12, 5000.0, 0.015, 0.02
LATTICE_RULES, LATTICE_SPAN, LATTICE_THICKNESS = 3, 0.6, 3.0
PADDING, MIN_PIXELS, CROP_SIDE = 0.012, 8, 900
_BOX = ("x0", "y0", "x1", "y1")
#: Pages with more boxes are merged one by one; so many pairs are compared, so many items looked at and so many packed
#: into a row at once.
FEW_BOXES, PAIRS, LOT, PACK = 32, 1 << 18, 1 << 15, 64
_SIZE, _PATH, _IMAGE, _CENTRE = range(4)
_FIELDS = 6  # what an item is, its box, its number
_FOUND = "region_order int, kind string, x double, y double, w double, h double, path_count int, text_chars bigint"


def merge_boxes(boxes: np.ndarray, gap: float) -> np.ndarray:
    """Boxes grown over all that they touch within ``gap`` until none touches another. As a grown box
    touches whatever its parts did, the outcome does not depend on the order."""
    todo = np.asarray(boxes, float).reshape(-1, 4)
    done: list[np.ndarray] = []
    while len(todo):
        box, todo = todo[-1], todo[:-1]
        while True:
            near = (todo[:, 2] >= box[0] - gap) & (todo[:, 0] <= box[2] + gap) & (todo[:, 3] >= box[1] - gap) & (todo[:, 1] <= box[3] + gap)
            old = [k for k, d in enumerate(done) if d[2] >= box[0] - gap and d[0] <= box[2] + gap and d[3] >= box[1] - gap and d[1] <= box[3] + gap]
            if not near.any() and not old:
                break
            part = np.vstack([box, todo[near], *(done[k] for k in old)])
            box = np.r_[part[:, :2].min(axis=0), part[:, 2:].max(axis=0)]
            todo, done = todo[~near], [d for k, d in enumerate(done) if k not in old]
        done.append(box)
    return np.array(sorted(map(tuple, done)), float).reshape(-1, 4)


def _touch(a: np.ndarray, b: np.ndarray, gap: np.ndarray) -> np.ndarray:
    """Whether boxes, given by columns, touch within the gap, seen from either."""
    one = (b[2] >= a[0] - gap) & (b[0] <= a[2] + gap) & (b[3] >= a[1] - gap) & (b[1] <= a[3] + gap)
    return one | (a[2] >= b[0] - gap) & (a[0] <= b[2] + gap) & (a[3] >= b[1] - gap) & (a[1] <= b[3] + gap)


def _hulls(boxes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return np.stack([f.reduceat(c, starts) for f, c in zip((np.minimum, np.minimum, np.maximum, np.maximum), boxes)])


def _pairs(first: np.ndarray, count: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Each k with each of first[k], ..., first[k] + count[k] - 1, not many more than ``PAIRS`` at once."""
    ends = np.cumsum(count)
    k = 0
    while k < len(count):
        stop = max(k + 1, int(np.searchsorted(ends, (ends[k - 1] if k else 0) + PAIRS, "right")))
        n = count[k:stop]
        i = np.repeat(np.arange(k, stop), n)
        yield i, np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n) + first[i]
        k = stop


def _merge_pages(boxes: np.ndarray, page: np.ndarray, gap: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``merge_boxes`` of several pages, for boxes by columns in the order of their pages; the merged boxes,
    their pages, and which of them each box is in."""
    label = np.arange(len(page))
    while len(page):
        start = np.searchsorted(page, page)
        parent = np.arange(len(page))
        for i, j in _pairs(start, np.arange(len(page)) - start):
            hit = _touch(boxes[:, j], boxes[:, i], gap[page[i]])
            np.minimum.at(parent, i[hit], j[hit])
        if (parent == np.arange(len(page))).all():
            break
        while (parent[parent] != parent).any():
            parent = parent[parent]
        root, group = np.unique(parent, return_inverse=True)
        order = np.argsort(group, kind="stable")
        boxes = _hulls(boxes[:, order], np.searchsorted(group[order], np.arange(len(root))))
        label, page = group[label], page[root]
    return boxes, page, label


def _tallied(boxes: np.ndarray, paths: np.ndarray, i: np.ndarray, j: np.ndarray, gap: np.ndarray | None = None) -> np.ndarray:
    """Of each box: paths within up to the gap, flat and upright rules that meet it. ``i`` are the boxes of the paths
    ``j``; they are its members unless there is a gap, which then is tested."""
    wide, tall = paths[2, j] - paths[0, j], paths[3, j] - paths[1, j]
    of = np.maximum(boxes[2:] - boxes[:2], 1e-6) * LATTICE_SPAN
    flat = (wide >= of[0, i]) & (tall <= LATTICE_THICKNESS)
    upright = ~flat & (tall >= of[1, i]) & (wide <= LATTICE_THICKNESS)
    inside = np.ones(len(i), bool)
    if gap is not None:
        a, b = boxes[:, i], paths[:, j]
        inside = (b[0] >= a[0] - gap[i]) & (b[2] <= a[2] + gap[i]) & (b[1] >= a[1] - gap[i]) & (b[3] <= a[3] + gap[i])
        meets = (b[2] >= a[0]) & (b[0] <= a[2]) & (b[3] >= a[1]) & (b[1] <= a[3])
        flat, upright = flat & meets, upright & meets
    return np.stack([np.bincount(i[m], minlength=boxes.shape[1]) for m in (inside, flat, upright)])


def _charts(paths: np.ndarray, page: np.ndarray, gap: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Boxes of the charts, their pages and numbers of paths, of paths in the order of their pages."""
    if not len(page):
        return paths, page, page
    # neighbours in the order of drawing mostly belong together
    starts = np.r_[True, (page[1:] != page[:-1]) | ~_touch(paths[:, :-1], paths[:, 1:], gap[page[1:]])]
    at, run = np.flatnonzero(starts), np.cumsum(starts) - 1
    hulls, owner = _hulls(paths, at), page[at]
    # what lies within a merged box is a member of it, unless boxes are inside out
    slow = np.bincount(owner, minlength=len(gap)) > FEW_BOXES
    slow[page[(paths[2] < paths[0]) | (paths[3] < paths[1])]] = True
    quick = ~slow[owner]
    boxes, own, label = _merge_pages(hulls[:, quick], owner[quick], gap)
    place = np.zeros(len(at), np.int64)
    place[quick] = label
    j = np.flatnonzero(quick[run])
    tally = _tallied(boxes, paths, place[run[j]], j)
    out = [(boxes, own, tally)]
    for n in np.flatnonzero(slow):
        begin, end = np.searchsorted(owner, (n, n + 1))
        if begin < end:
            big = merge_boxes(hulls[:, begin:end].T, gap[n]).T
            begin, end = np.searchsorted(page, (n, n + 1))
            size = np.full(big.shape[1], end - begin)
            sums = np.zeros((3, len(size)), np.int64)
            for i, k in _pairs(np.zeros_like(size), size):
                sums += _tallied(big, paths[:, begin:end], i, k, np.full(len(size), gap[n]))
            out.append((big, np.full(len(size), n), sums))
    boxes, own, tally = (np.concatenate(c, axis=-1) for c in zip(*out))
    kept = (tally[0] >= MIN_PATHS) & ~((tally[1] >= LATTICE_RULES) & (tally[2] >= LATTICE_RULES))
    return boxes[:, kept], own[kept], tally[0, kept]


def _found(page: np.ndarray, what: np.ndarray, box: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, ...]:
    """Page, order, kind (1 for figures), place and size, paths and characters of the regions of whole pages, whose
    rows follow each other."""
    width, height = np.zeros((2, page[-1] + 1))
    sizes = np.flatnonzero(what == _SIZE)
    width[page[sizes]], height[page[sizes]] = box[0, sizes], box[1, sizes]
    kept = width[page] > 0
    paths = np.bincount(page[what == _PATH], minlength=len(width)) >= MIN_PATHS
    of = np.flatnonzero((what == _PATH) & kept & paths[page])
    charts, on, members = _charts(box[:, of], page[of], np.minimum(width, height) * GAP)
    images = np.flatnonzero((what == _IMAGE) & kept)
    r = np.concatenate([charts, box[:, images]], axis=1)
    p = np.r_[on, page[images]]
    kind = np.repeat([0, 1], (len(on), len(images)))
    rank, members = np.r_[np.zeros_like(on), ids[images]], np.r_[members, np.zeros_like(images)]
    w, h = width[p], height[p]
    # + 0.0: no zero is negative
    at = np.stack([np.maximum(r[0] / w, 0.0), np.maximum((h - r[3]) / h, 0.0), np.fmin((r[2] - r[0]) / w, 1.0), np.fmin((r[3] - r[1]) / h, 1.0)]) + 0.0
    area = np.maximum(at[2], 0.0) * np.maximum(at[3], 0.0)
    large = np.flatnonzero(area >= MIN_AREA)
    r, p, kind, rank, members, at, area = r[:, large], p[large], kind[large], rank[large], members[large], at[:, large], area[large]
    centres = np.flatnonzero(what == _CENTRE)
    first, last = (np.searchsorted(page[centres], p, side) for side in ("left", "right"))
    chars = np.zeros(len(p), np.int64)
    for i, j in _pairs(first, last - first):
        cx, cy = box[:2, centres[j]]
        chars += np.bincount(i[(cx >= r[0, i]) & (cx <= r[2, i]) & (cy >= r[1, i]) & (cy <= r[3, i])], minlength=len(p))
    sparse = (kind == 1) | (chars <= MAX_DENSITY * area)
    order = np.lexsort((*r[::-1], rank, at[3], at[2], kind, at[0], at[1], p))
    order = order[sparse[order]]
    p, place = p[order], np.arange(len(order))
    return p, place - np.searchsorted(p, p), kind[order], at[:, order], members[order], chars[order]


def _packed(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[pa.RecordBatch]:
    """Neighbouring items of a page as the bytes of one value."""
    for batch in batches:
        n = batch.num_rows
        if n:
            begins = np.unique(np.r_[0, changes(batch.columns[:n_keys]), np.arange(0, n, PACK)])
            what, *box, number = (c.to_numpy() for c in batch.columns[n_keys:])
            items = np.stack([what.astype(float), *box, number.view(float)], axis=1)
            offsets = np.r_[begins, n].astype(np.int32) * (8 * _FIELDS)
            blobs = pa.BinaryArray.from_buffers(pa.binary(), len(begins), [None, pa.py_buffer(offsets), pa.py_buffer(items)])
            yield pa.RecordBatch.from_arrays([*[k.take(pa.array(begins)) for k in batch.columns[:n_keys]], blobs], names=[*batch.schema.names[:n_keys], "items"])


def _unpacked(blobs: pa.BinaryArray) -> np.ndarray:
    """The items by columns."""
    ends = np.frombuffer(blobs.buffers()[1], np.int32)[blobs.offset : blobs.offset + len(blobs) + 1]
    items = np.frombuffer(blobs.buffers()[2], np.uint8)[ends[0] : ends[-1]].view(float).reshape(-1, _FIELDS)
    return np.ascontiguousarray(items.T)


def _lots(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[tuple[list[pa.Array], np.ndarray, np.ndarray]]:
    """Keys of whole pages, the page of each item and the items, some ``LOT`` at once or one page."""
    for whole, begins in whole_pages(batches, n_keys):
        sizes = pc.binary_length(whole.column(n_keys)).to_numpy() // (8 * _FIELDS)
        sums = np.r_[0, np.cumsum(sizes)][np.r_[begins, whole.num_rows]]
        k = 0
        while k < len(begins):
            stop = max(k + 1, int(np.searchsorted(sums, sums[k] + LOT, "right")) - 1)
            begin, end = begins[k], begins[stop] if stop < len(begins) else whole.num_rows
            items = _unpacked(whole.column(n_keys).slice(begin, end - begin))
            page = np.repeat(np.arange(stop - k), np.diff(sums[k : stop + 1]))
            yield [c.take(pa.array(begins[k:stop])) for c in whole.columns[:n_keys]], page, items
            k = stop


def _on(key: tuple[str, ...]) -> Column:
    on = F.lit(True)
    for k in key:
        on = on & (F.col(f"a.{k}") == F.col(f"b.{k}"))
    return on


def _boxed(df: DataFrame, other: DataFrame, on: Column, key: tuple[str, ...], *sums: Column) -> DataFrame:
    """Each box of ``df`` with sums over the rows of ``other`` that meet it, boxes without any kept."""
    group = [F.col(f"a.{c}").alias(c) for c in df.columns]
    return df.alias("a").join(other.alias("b"), _on(key) & on, "left").groupBy(*group).agg(*sums)


def with_members(boxes: DataFrame, paths: DataFrame, key: tuple[str, ...] = PAGE_KEY) -> DataFrame:
    """``boxes`` with the number of paths that lie within, up to the gap."""
    g = F.col("a.gap")
    inside = (F.col("b.x0") >= F.col("a.x0") - g) & (F.col("b.x1") <= F.col("a.x1") + g) & (F.col("b.y0") >= F.col("a.y0") - g) & (F.col("b.y1") <= F.col("a.y1") + g)
    return _boxed(boxes, paths, inside, key, F.count("b.x0").alias("path_count"))


def with_lattice(boxes: DataFrame, paths: DataFrame, key: tuple[str, ...] = PAGE_KEY) -> DataFrame:
    """``boxes`` with ``lattice``: long thin rules in both directions, as tables have and charts have
    not. A rule that would do for both counts as horizontal."""
    meets = (F.col("b.x1") >= F.col("a.x0")) & (F.col("b.x0") <= F.col("a.x1")) & (F.col("b.y1") >= F.col("a.y0")) & (F.col("b.y0") <= F.col("a.y1"))
    wide, tall = F.col("b.x1") - F.col("b.x0"), F.col("b.y1") - F.col("b.y0")
    of = lambda c: F.greatest(F.col(f"a.{c}1") - F.col(f"a.{c}0"), F.lit(1e-6)) * LATTICE_SPAN
    flat = (wide >= of("x")) & (tall <= LATTICE_THICKNESS)
    upright = ~flat & (tall >= of("y")) & (wide <= LATTICE_THICKNESS)
    both = (F.count_if(flat) >= LATTICE_RULES) & (F.count_if(upright) >= LATTICE_RULES)
    return _boxed(boxes, paths, meets, key, both.alias("lattice"))


def with_chars(boxes: DataFrame, chars: DataFrame, key: tuple[str, ...] = PAGE_KEY) -> DataFrame:
    """``boxes`` with the number of characters whose centre is inside, borders included."""
    centres = chars.where(whole_box()).select(*key, ((F.col("x0") + F.col("x1")) / 2).alias("cx"), ((F.col("y0") + F.col("y1")) / 2).alias("cy"))
    inside = F.col("b.cx").between(F.col("a.x0"), F.col("a.x1")) & F.col("b.cy").between(F.col("a.y0"), F.col("a.y1"))
    return _boxed(boxes, centres, inside, key, F.count("b.cx").alias("text_chars"))


def detect_regions(pages: DataFrame, objects: DataFrame, chars: DataFrame, key: tuple[str, ...] = PAGE_KEY) -> DataFrame:
    """Figures (one for each image) and charts (clusters of paths that are no ruled table), normalised,
    origin top left. Small ones go, and charts as dense with text as tables are."""
    sized = pages.where((F.col("width") > 0) & (F.col("height") > 0))
    sound = objects.where(whole_box())
    n_keys = len(key)

    def item(df: DataFrame, what: int, x0: Column, y0: Column, x1: Column, y1: Column, number: Column) -> DataFrame:
        boxes = [c.cast("double").alias(n) for n, c in zip(_BOX, (x0, y0, x1, y1))]
        return df.select(*key, F.lit(what).cast("tinyint").alias("what"), *boxes, number.cast("bigint").alias("number")).dropna(subset=list(key))

    zero, box = F.lit(0.0), [F.col(c) for c in _BOX]
    rows = item(sized, _SIZE, F.col("width"), F.col("height"), zero, zero, F.lit(0))
    rows = rows.unionByName(item(sound.where("kind = 'path'"), _PATH, *box, F.lit(0)))
    rows = rows.unionByName(item(sound.where("kind = 'image'"), _IMAGE, *box, F.coalesce("obj_id", F.lit(-1))))
    rows = rows.unionByName(item(chars.where(whole_box()), _CENTRE, (box[0] + box[2]) / 2, (box[1] + box[3]) / 2, zero, zero, F.lit(0)))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _packed(batches, n_keys)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, page, items in _lots(batches, n_keys):
            p, order, kind, at, members, inside = _found(page, items[0], items[1:5], items[5].view(np.int64))
            kinds = pa.array(["chart", "figure"]).take(pa.array(kind))
            made = [pa.array(order, pa.int32()), kinds, *map(pa.array, at), pa.array(members, pa.int32()), pa.array(inside, pa.int64())]
            yield pa.RecordBatch.from_arrays([k.take(pa.array(p)) for k in keys] + made, names=names)

    fields = rows.select(*key).schema.fields
    schema = StructType(fields + StructType.fromDDL(_FOUND).fields)
    names = schema.names
    packed = rows.mapInArrow(pack, StructType(fields).add("items", "binary"))
    return packed.repartition(*key).sortWithinPartitions(*key).mapInArrow(find, schema)


def crop_pixels(regions: DataFrame, width: Column, height: Column) -> DataFrame:
    """Pixel box of each region with its padding, on a rendering of so many pixels; NULL if it is tiny."""
    x, y, w, h = (F.col(c) for c in ("x", "y", "w", "h"))
    left, top = (F.greatest(c - PADDING, F.lit(0.0)) for c in (x, y))
    right, bottom = F.least(x + w + PADDING, F.lit(1.0)), F.least(y + h + PADDING, F.lit(1.0))
    box = F.struct(*[F.floor(c * side).cast("int").alias(n) for n, c, side in (("left", left, width), ("top", top, height), ("right", right, width), ("bottom", bottom, height))])
    out = regions.withColumn("crop", box)
    return out.withColumn("crop", F.when((F.col("crop.right") - F.col("crop.left") >= MIN_PIXELS) & (F.col("crop.bottom") - F.col("crop.top") >= MIN_PIXELS), F.col("crop")))


def dispatch(regions: DataFrame, specialists: DataFrame, outputs: DataFrame, key: tuple[str, ...] = PAGE_KEY) -> DataFrame:
    """Each region with the first usable answer: of the specialists (name, rank, kinds) that take its
    kind, by rank, the first whose output (key, region_order, name, markdown) is not blank. Regions
    without one have a NULL specialist: the page's own text stands for them."""
    at = [*key, "region_order"]
    able = regions.join(specialists.select("name", "rank", F.explode(F.array_distinct("kinds")).alias("kind")), "kind")
    usable = able.join(outputs, [*at, "name"]).where(strip(F.coalesce("markdown", F.lit(""))) != "")
    first = usable.groupBy(*at).agg(F.min_by(F.struct("name", "markdown"), "rank").alias("b"))
    return regions.join(first, at, "left").select(*[regions[c] for c in regions.columns], F.col("b.name").alias("specialist"), F.col("b.markdown").alias("markdown"))


def fuse_pages(pages: DataFrame, dispatched: DataFrame, key: tuple[str, ...] = PAGE_KEY, text: str = "markdown") -> DataFrame:
    """Pages with the specialists' answers below their own text, and counters: regions, fell_back,
    by_kind, by_specialist."""
    answers = F.when(F.col("specialist").isNotNull(), F.struct(F.col("region_order").alias("o"), F.col("markdown").alias("m")))
    tally = lambda c: F.map_from_entries(F.transform(F.array_sort(F.array_distinct(F.collect_list(c))), lambda k: F.struct(k.alias("key"), F.size(F.filter(F.collect_list(c), lambda x: x == k)).alias("value"))))
    d = dispatched.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(answers)), lambda x: x["m"]).alias("__a"), F.count("*").alias("regions"), F.count_if(F.col("specialist").isNull()).alias("fell_back"), tally("kind").alias("by_kind"), tally("specialist").alias("by_specialist"))
    j = pages.join(d, list(key), "left")
    body, more = rstrip(F.coalesce(F.col(text), F.lit(""))), F.array_join("__a", "\n\n")
    fused = F.when(F.coalesce(F.size("__a"), F.lit(0)) <= 0, F.col(text)).when(body == "", more).otherwise(F.concat(body, F.lit("\n\n"), more))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return j.select(*[F.col(c) for c in pages.columns if c != text], fused.alias(text), zero("regions"), zero("fell_back"), "by_kind", "by_specialist")
