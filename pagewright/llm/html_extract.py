"""HTML text extraction by shallow block features.

A page is cut into flat text blocks at every tag that is not inline; scripts, styles, titles and
comments go. Each block has its number of words and its link density (share of words
inside ``<a>``), and those of the blocks before and after it. A decision tree over these six
numbers, trained here on a small labelled table of blocks (``html_labels``), tells content
from the rest; the text of a page is its content blocks, one a line.

One pass over the pages; the tree (31 numbers) travels with the task, and nothing is shuffled.

Edge cases: NULL html gives NULL text and NULL counts; an empty page, or one without
text, gives an empty text and 0 blocks. Broken markup is read as far as it goes: an unclosed
tag or comment ends with the page, a ``<`` that opens no tag is text. Pages of any length are
taken whole. Extra columns pass through; an input column named like an output column is replaced.
"""

from __future__ import annotations

import html
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.llm.common import q, require, without
from pagewright.llm.html_labels import LABELLED
from pagewright.llm.trees import Tree, classification_tree

INLINE = frozenset("a abbr b bdi bdo big br cite code data dfn em font i img ins kbd mark q s samp small span strike strong sub sup time tt u var wbr".split())
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|title|noscript|template)\b[^>]*>.*?(?:</\1\s*>|\Z)|<!\[?[A-Za-z][^>]*(?:>|\Z)|<\?[^>]*(?:>|\Z)|<(/?)([A-Za-z][A-Za-z0-9:-]*)[^>]*(?:>|\Z)", re.DOTALL | re.IGNORECASE)
FEATURES = ("words_before", "links_before", "words", "links", "words_after", "links_after")


def blocks(page: str) -> list[tuple[str, int, int]]:
    """Text, number of words and of linked words of each block that has words."""
    out: list[tuple[str, int, int]] = []
    parts: list[str] = []
    links: list[str] = []
    inside = 0

    def flush() -> None:
        if parts:
            words = html.unescape("".join(parts)).split()
            if words:
                out.append((" ".join(words), len(words), min(len(words), len(html.unescape("".join(links)).split()))))
            parts.clear()
            links.clear()

    at = 0
    for m in _TAG.finditer(page):
        if m.start() > at:
            text = page[at : m.start()]
            parts.append(text)
            if inside:
                links.append(text)
        at = m.end()
        name = (m.group(3) or "").lower()
        if not name:
            continue
        if name == "a":
            inside = 0 if m.group(2) else 1
            links.append(" ")
        elif name == "br":
            parts.append(" ")
        elif name not in INLINE:
            flush()
            if not m.group(2) and inside and name in ("article", "body", "div", "footer", "main", "nav", "section", "table"):
                inside = 0  # a link that was never closed ends with its surroundings
    if at < len(page):
        parts.append(page[at:])
        if inside:
            links.append(page[at:])
    flush()
    return out


def block_features(found: list[tuple[str, int, int]]) -> np.ndarray:
    n = len(found)
    own = np.zeros((n + 2, 2))
    if n:
        own[1:-1, 0] = [b[1] for b in found]
        own[1:-1, 1] = [b[2] / b[1] for b in found]
    return np.concatenate([own[:-2], own[1:-1], own[2:]], axis=1)


@lru_cache(maxsize=1)
def trained_tree() -> Tree:
    table = np.array(LABELLED, float)
    return classification_tree(table[:, :6], table[:, 6], depth=4, min_rows=4)


def extract(page: str, tree: Tree | None = None) -> tuple[str, int, int]:
    """Text, number of blocks, number of content blocks."""
    found = blocks(page)
    if not found:
        return "", 0, 0
    good = (tree or trained_tree()).predict(block_features(found)) >= 0.5
    return "\n".join(b[0] for b, g in zip(found, good) if g), len(found), int(good.sum())


def extract_text(df: DataFrame, page: str = "html", text: str = "text", n_blocks: str = "n_blocks", n_content: str = "n_content") -> DataFrame:
    """``df`` with the extracted text and the numbers of all and of content blocks."""
    require(df, page)
    tree = trained_tree()

    @F.arrow_udf("struct<text: string, n_blocks: int, n_content: int>")
    def extracted(batch: pa.Array) -> pa.Array:
        found = []
        for k in range(0, len(batch), 256):
            found += [None if p is None else extract(p, tree) for p in batch.slice(k, 256).to_pylist()]
        columns = [pa.array([None if f is None else f[i] for f in found], kind) for i, kind in enumerate((pa.string(), pa.int32(), pa.int32()))]
        return pa.StructArray.from_arrays(columns, ["text", "n_blocks", "n_content"])

    new = extracted(q(page))
    kept = [q(c) for c in without(df, text, n_blocks, n_content).columns]
    return df.select(*kept, new["text"].alias(text), new["n_blocks"].alias(n_blocks), new["n_content"].alias(n_content))
