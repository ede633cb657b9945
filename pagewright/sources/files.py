"""Readers for files and tables, and the writers of results. A decoder is any function from (path, bytes) to
``Page``s; ``images`` has one for scans, those of PDF are brought along."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass
from urllib.parse import unquote, urlparse

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.functions.text import sanitize, strip
from pagewright.operators.bench import is_document, markdown_path
from pagewright.schema import PAGES


def discover(spark: SparkSession, root: str) -> DataFrame:
    """``path``, ``relative``, ``content`` of all PDFs and images below ``root``. Contents are read only
    where a plan uses them; files without a byte are left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = "file:" + os.path.abspath(root) if "://" not in root else root.rstrip("/")
    relative = F.regexp_replace(F.col("path"), "^" + _quoted(base) + "/+", "")
    return files.where(is_document(F.col("path"))).select("path", relative.alias("relative"), "content")


def _quoted(text: str) -> str:
    return r"\Q" + text.replace(r"\E", r"\E\\E\Q") + r"\E"


@dataclass(frozen=True)
class Page:
    """What a decoder finds on a page. ``objects``: kind and box; ``chars``: code point, font, flags, weight, size
    and box. A box that cannot be read is four times None."""

    width: float | None
    height: float | None
    text: str = ""
    error: str | None = None
    objects: Sequence[tuple] = ()
    chars: Sequence[tuple] = ()


Decoder = Callable[[str, bytes], Iterable[Page]]

_OBJECT = "obj_id int, kind string, x0 double, y0 double, x1 double, y1 double"
_CHAR = "char_index int, codepoint int, font string, flags int, weight int, size double, x0 double, y0 double, x1 double, y1 double"
DECODED = PAGES + "".join(f", {n} array<struct<{', '.join(c.replace(' ', ': ') for c in fields.split(', '))}>>" for n, fields in (("objects", _OBJECT), ("chars", _CHAR)))


def decode_documents(files: DataFrame, decoder: Decoder) -> DataFrame:
    """A row for each page, with its objects and characters in arrays: a file is decoded once, and whoever
    reads the written table reads only the arrays that are asked for. A file that the decoder refuses becomes one
    row with its error, so that one bad file stops nothing. Text is freed of lone surrogates before it is a column."""
    fields = {n: [c.split()[0] for c in f.split(", ")] for n, f in (("objects", _OBJECT), ("chars", _CHAR))}

    def structs(kind: str, rows: Sequence[tuple]) -> list[dict]:
        return [dict(zip(fields[kind], (i, *r))) for i, r in enumerate(rows)]

    def decode(frames):
        names = [c.split()[0] for c in PAGES.split(", ")] + ["objects", "chars"]
        for frame in frames:
            for path, content in zip(frame["path"], frame["content"]):
                rows = []
                try:
                    for i, p in enumerate(decoder(path, content)):
                        rows.append((path, i, p.width, p.height, sanitize(p.text or ""), p.error, structs("objects", p.objects), structs("chars", p.chars)))
                except Exception as e:  # noqa: BLE001 - whatever a foreign decoder raises is that file's error
                    rows = [(path, 0, None, None, "", f"{type(e).__name__}: {e}", [], [])]
                yield pd.DataFrame(rows, columns=names)

    return files.select("path", "content").mapInPandas(decode, DECODED)


def pages_of(decoded: DataFrame) -> DataFrame:
    return decoded.drop("objects", "chars")


def objects_of(decoded: DataFrame) -> DataFrame:
    return decoded.select("doc_id", "page_index", F.inline("objects"))


def chars_of(decoded: DataFrame) -> DataFrame:
    return decoded.select("doc_id", "page_index", F.inline("chars"))


def text_layer(pages: DataFrame, indices: list[int] | None = None) -> DataFrame:
    """The trimmed text of the selected pages, as a tier-1 extraction."""
    chosen = pages if indices is None else pages.where(F.col("page_index").isin(*indices))
    return chosen.select("doc_id", "page_index", strip(F.coalesce("text", F.lit(""))).alias("markdown"))


def structured_pages(found: DataFrame, extractor: Callable[[str, bytes], Sequence[str]]) -> DataFrame:
    """Pages of a structured extractor: (path, bytes) to the Markdown of each page. A file that it refuses has none,
    so its text layer stands in."""

    def extract(frames):
        for frame in frames:
            rows = []
            for path, content in zip(frame["path"], frame["content"]):
                try:
                    rows += [(path, i, sanitize(text or "")) for i, text in enumerate(extractor(path, content))]
                except Exception:  # noqa: BLE001 - whatever a foreign extractor raises, the text layer stands in
                    continue
            yield pd.DataFrame(rows, columns=["doc_id", "page_index", "markdown"])

    return found.select("path", "content").mapInPandas(extract, "doc_id string, page_index int, markdown string")


def structured_or_text(pages: DataFrame, structured: DataFrame | None) -> DataFrame:
    """Tier 1: a structured extractor's pages where it made any of the document, else the text layer."""
    layer = text_layer(pages)
    if structured is None:
        return layer
    docs = structured.select("doc_id").distinct()
    own = structured.select("doc_id", "page_index", F.coalesce("markdown", F.lit("")).alias("markdown"))
    return own.unionByName(layer.join(docs, "doc_id", "left_anti"))


def read_test_lines(spark: SparkSession, root: str) -> DataFrame:
    """``jsonl_name``, ``line`` of all JSONL files below ``root``."""
    lines = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.jsonl").text(root)
    return lines.select(F.regexp_extract(F.input_file_name(), r"([^/]+)$", 1).alias("jsonl_name"), F.col("value").alias("line"))


def _mounted(root: str) -> str:
    base = unquote(urlparse(root).path) if root.startswith("file:") else root
    if "://" in base:
        raise ValueError("files are written to a mounted folder; use a table for other stores")
    return os.path.normpath(base)


def existing_outputs(spark: SparkSession, root: str) -> DataFrame:
    """``path`` of the Markdown files below ``root``, relative to it, empty ones included (which Spark's own
    readers leave out)."""
    base = _mounted(root)
    found = [os.path.relpath(os.path.join(folder, name), base) for folder, _, names in os.walk(base) for name in names if name.endswith(".md")]
    return spark.createDataFrame([(p,) for p in found], "path string")


def without_output(rows: DataFrame, root: str, output: str = "output") -> DataFrame:
    """The rows whose file below ``root`` is not there; executors look, each for its own rows."""
    base = _mounted(root)

    @F.arrow_udf("boolean")
    def there(paths: pa.Array) -> pa.Array:
        return pa.array([p is not None and os.path.exists(os.path.join(base, p)) for p in paths.to_pylist()], pa.bool_())

    return rows.where(~there(F.col(output)))


def write_markdown(rows: DataFrame, root: str, path: str = "path", text: str = "markdown") -> None:
    """One UTF-8 file for each row, written by the executors under ``root``, a folder they all share. A
    file appears whole or not at all, so a task that runs twice does no harm."""
    base = _mounted(root)

    def write(part):
        for row in part:
            target = os.path.normpath(os.path.join(base, row[0]))
            if not target.startswith(base + os.sep):
                raise ValueError(f"{row[0]!r} lies outside the output folder")
            os.makedirs(os.path.dirname(target), exist_ok=True)
            partial = f"{target}.{os.getpid()}.part"
            with open(partial, "w", encoding="utf-8", newline="") as f:
                f.write(row[1] or "")
            os.replace(partial, target)

    rows.select(path, text).foreachPartition(write)


def with_output_path(files: DataFrame, relative: str = "relative") -> DataFrame:
    return files.withColumn("output", markdown_path(F.col(relative)))
