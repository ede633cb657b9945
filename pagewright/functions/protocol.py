"""Replies of page models: front matter, degenerate text, JSON, linearised tables, score reports.

All are column expressions, but for degenerate text, which is an Arrow function: a repeated tail takes
comparing a text with itself, for which expressions have no loop.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, DecimalType, MapType, StructType

from pagewright.functions.text import rstrip, strip

ROTATIONS = (0, 90, 180, 270)
SPIRAL = r"[ \t]{200,}|(?:\r?\n){40,}"
_BOM = "﻿"


# -- front matter ----------------------------------------------------------------------------


def front_matter_parts(content: Column) -> Column:
    """struct<header, body>: the block between ``---`` lines and the trimmed rest; a text without
    a closed block is all body and has a NULL header."""
    text = F.regexp_replace(F.coalesce(content, F.lit("")), f"^{_BOM}+", "")
    end = F.when(F.startswith(text, F.lit("---\n")), F.locate("\n---", text, 5)).otherwise(F.lit(0))
    header = F.when(end > 0, F.substr(text, F.lit(5), end - 5))
    body = strip(F.when(end > 0, F.substr(text, end + 4)).otherwise(text))
    return F.struct(header.alias("header"), body.alias("body"))


def header_raw(header: Column, key: str) -> Column:
    """What stands after ``key:`` in the last such line, trimmed, a comment cut off; NULL without a line."""
    lines = F.regexp_extract_all(header, F.lit(rf"(?m)^[ \t]*{key}[ \t]*:[ \t]*(.*?)[ \t]*$"), F.lit(1))
    value = F.element_at(lines, -1)
    bare = F.regexp_replace(value, r"(^|[ \t]+)#.*$", "")
    quoted = F.regexp_extract(value, r"""^(("[^"]*")|('[^']*'))""", 1)
    return F.when(F.size(lines) > 0, F.when(quoted != "", quoted).otherwise(bare))


def unquoted(raw: Column) -> Column:
    return F.regexp_replace(raw, r"""^(["'])(.*)\1$""", "$2")


def as_flag(raw: Column, default: bool) -> Column:
    """Of bare words true, yes and on are true and a number or nothing is the default, as a YAML reader
    has it; of quoted ones true, yes and 1 are true. Other text is false."""
    v = F.lower(raw)
    quoted = F.regexp_extract(v, r"""^["'](.*)["']$""", 1)
    return (
        F.when(raw.isNull() | (v == "") | v.isin("null", "~"), F.lit(default))
        .when(v.rlike(r"""^(".*"|'.*')$"""), F.trim(quoted).isin("true", "yes", "1"))
        .when(v.rlike(r"^[-+]?[0-9][0-9_]*(\.[0-9]*)?$"), F.lit(default))
        .otherwise(v.isin("true", "yes", "on"))
    )


def as_rotation(value: Column) -> Column:
    n = value.try_cast("int")
    return F.when(n.isin(*ROTATIONS), n).otherwise(F.lit(0))


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, with ``value`` planned and made once however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def page_response(content: Column) -> Column:
    """struct<primary_language, is_rotation_valid, rotation_correction, is_table, is_diagram, natural_text>."""
    keys = ("primary_language", "is_rotation_valid", "rotation_correction", "is_table", "is_diagram")

    def response(r: Column) -> Column:
        language = unquoted(r["primary_language"])
        # words that a YAML 1.1 reader takes for booleans, nulls or numbers are no language
        no_language = F.lower(language).isin("null", "none", "", "~", "no", "yes", "on", "off", "true", "false") | language.rlike(r"^[-+]?[0-9]+(\.[0-9]*)?$")
        return F.struct(
            F.when(~no_language, language).alias("primary_language"),
            as_flag(r["is_rotation_valid"], True).alias("is_rotation_valid"),
            as_rotation(unquoted(r["rotation_correction"])).alias("rotation_correction"),
            as_flag(r["is_table"], False).alias("is_table"),
            as_flag(r["is_diagram"], False).alias("is_diagram"),
            F.nullif(r["body"], F.lit("")).alias("natural_text"),
        )

    raw = lambda p: F.struct(*[header_raw(p["header"], k).alias(k) for k in keys], p["body"].alias("body"))
    return bound(bound(front_matter_parts(content), raw), response)


# -- degenerate text -------------------------------------------------------------------------

_REPORT = "detected: boolean, kind: string, ngram_size: int, repeats: int, span: int"
_SOUND = (False, "", 0, 0, 0)
_SPIRAL, _BLANKS, _BLANK = re.compile(SPIRAL), re.compile(r"\s+"), re.compile(r"\s")


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _tail(text: str, reach: int) -> str:
    """The last ``reach`` characters of the collapsed text; only the end of the text is looked at."""
    window = 2 * reach
    while True:
        part = text[-window:]
        tail = _BLANKS.sub(" ", part)
        # the first blank of a part may be one with what is before it
        if len(part) == len(text) or len(tail) > reach:
            return tail[-reach:]
        window *= 4


def _looping(tail: str, units: tuple[tuple[int, int], ...]) -> list[int]:
    return [n for n, k in units if len(tail) >= n * k and tail.endswith(tail[len(tail) - n :] * k)]


def longest_loop(text: str, units: tuple[tuple[int, int], ...], reach: int) -> tuple[int, int] | None:
    """Size and repeats of the repeated end that is longest, the smaller size at a tie. ``units`` are the
    sizes and how often each has to repeat; it takes one comparison of the text with itself for a size that does."""
    sizes = _looping(_tail(text, reach), units)
    if not sizes:
        return None
    codes = _codes(_BLANKS.sub(" ", text))
    found = []
    for n in sizes:
        off = np.flatnonzero(codes[n:] != codes[:-n])
        same = len(codes) - n - (int(off[-1]) + 1 if len(off) else 0)
        found.append((n * (1 + same // n), -n))
    span, minus = max(found)
    return -minus, span // -minus


def _units(ngram_size: int, min_repeats: int, min_span: int) -> tuple[tuple[tuple[int, int], ...], int]:
    units = tuple((n, max(min_repeats, 3, -(-min_span // n))) for n in range(1, ngram_size + 1))
    return units, max((n * k for n, k in units), default=0)


def degenerate(text: Column, ngram_size: int = 64, min_repeats: int = 3, min_span: int = 200) -> Column:
    """struct<detected, kind, ngram_size, repeats, span>: white-space spirals first, else the
    longest repeated tail. NULL is sound."""
    units, reach = _units(ngram_size, min_repeats, min_span)

    @F.arrow_udf(f"struct<{_REPORT}>")
    def detect(batch: pa.Array) -> pa.Array:
        return _columns([r for _, r in _reports(batch, units, reach)], _REPORT)

    return detect(text)


def _columns(rows: list[tuple], fields: str) -> pa.Array:
    names, kinds = zip(*(f.split(": ") for f in fields.split(", ")))
    types = {"boolean": pa.bool_(), "int": pa.int32(), "string": pa.string()}
    return pa.StructArray.from_arrays([pa.array(c, types[kind]) for c, kind in zip(zip(*rows) if rows else [()] * len(names), kinds)], names)


def _reports(batch: pa.Array, units: tuple[tuple[int, int], ...], reach: int) -> Iterator[tuple[str | None, tuple]]:
    """Each text and its report; only one text is held besides the batch."""
    for k in range(0, len(batch), 64):
        part = batch.slice(k, 64)
        for value, spiral in zip(part, pc.match_substring_regex(part, SPIRAL).to_pylist()):
            t = value.as_py()
            m = _SPIRAL.search(t) if spiral else None
            loop = longest_loop(t, units, reach) if t is not None and not m else None
            yield t, (True, "whitespace_spiral", 0, 0, len(m.group())) if m else (True, "repetition_loop", *loop, loop[0] * loop[1]) if loop else _SOUND


def kept_length(text: str, size: int) -> int:
    """How much of ``text`` is left with one unit kept of its repeated end. The unit is of the collapsed text, but units
    are counted in the raw one, so a loop that has runs of white space may stay."""
    unit, codes = _codes(_BLANKS.sub(" ", text)[-size:]), _codes(_BLANK.sub(" ", text))
    whole = len(codes) // size
    units = codes[len(codes) - whole * size :].reshape(whole, size)
    other = np.flatnonzero((units != unit).any(axis=1)) if len(unit) == size else np.arange(whole)
    surplus = whole - (int(other[-1]) + 1 if len(other) else 0) - 1
    return len(text) - max(0, surplus) * size


def without_loop(text: str, size: int) -> str:
    return text[: kept_length(text, size)].rstrip()


_CUT = "length: int, respaced: string"


def _cut(text: str | None, kind: str | None, size: int | None) -> tuple[int | None, str | None]:
    """What length of a looping text is kept, or a text whose spirals are gone; long texts need not come back from Python."""
    if text is None or not kind:
        return None, None
    return (None, _SPIRAL.sub("\n\n", text)) if kind == "whitespace_spiral" else (kept_length(text, size), None)


def _trimmed(text: Column, cut: Column) -> Column:
    return F.when(cut["length"].isNotNull(), rstrip(F.left(text, cut["length"]))).when(cut["respaced"].isNotNull(), rstrip(cut["respaced"])).otherwise(text)


def truncate_degenerate(text: Column, report: Column) -> Column:
    """``text`` without what ``report`` (of ``degenerate``) finds degenerate: spirals become a blank line, a
    repeated end keeps one unit."""

    @F.arrow_udf(f"struct<{_CUT}>")
    def cut(texts: pa.Array, kinds: pa.Array, sizes: pa.Array) -> pa.Array:
        return _columns([_cut(t.as_py(), kind, size) for t, kind, size in zip(texts, kinds.to_pylist(), sizes.to_pylist())], _CUT)

    return _trimmed(text, cut(text, report["kind"], report["ngram_size"]))


def degenerate_and_rest(text: Column, ngram_size: int = 64, min_repeats: int = 3, min_span: int = 200) -> tuple[Column, Column]:
    """The report of ``degenerate`` and the text that ``truncate_degenerate`` makes by it, of one pass over the texts:
    in two, each core has two Python workers, both with a batch of texts."""
    units, reach = _units(ngram_size, min_repeats, min_span)

    @F.arrow_udf(f"struct<{_REPORT}, {_CUT}>")
    def detect(batch: pa.Array) -> pa.Array:
        return _columns([(*r, *_cut(t, r[1], r[2])) for t, r in _reports(batch, units, reach)], f"{_REPORT}, {_CUT}")

    both = detect(text)
    return F.struct(*[both[f.split(":")[0]].alias(f.split(":")[0]) for f in _REPORT.split(", ")]), _trimmed(text, both)


# -- names that older callers know ------------------------------------------------------------


def repetition_loop(text: Column, window: int = 64, max_repeats: int = 8) -> Column:
    """Whether a text ends in a loop or holds a spiral."""
    return degenerate(text, window, max_repeats)["detected"]


def truncated_repetition(text: Column, window: int = 64, max_repeats: int = 8) -> Column:
    return degenerate_and_rest(text, window, max_repeats)[1]


# -- JSON ------------------------------------------------------------------------------------


def extract_json(text: Column) -> Column:
    """The JSON text in a reply: fences go; else the widest braces; NULL without valid JSON."""
    cleaned = strip(F.regexp_replace(strip(text), r"(?m)^```(?:json)?\s*|\s*```$", ""))
    valid = lambda c: F.when(F.try_parse_json(c).isNotNull(), c)
    braces = F.regexp_extract(cleaned, r"(?s)\{.*\}", 0)
    return F.coalesce(valid(cleaned), valid(F.nullif(braces, F.lit(""))))


def validated(json: Column, schema: str, required: tuple[str, ...]) -> Column:
    """The JSON as a struct of ``schema``; NULL where a required field is missing or of another type."""
    parsed = F.from_json(json, schema, {"mode": "PERMISSIVE"})
    return F.when(reduce(lambda a, b: a & b, [parsed[f].isNotNull() for f in required]), parsed)


_JSON_TYPES = {"string": "string", "boolean": "boolean", "tinyint": "integer", "smallint": "integer", "int": "integer", "bigint": "integer", "float": "number", "double": "number"}


def json_schema(kind: DataType) -> dict:
    """The JSON schema of a type; fields that may not be NULL are required."""
    if isinstance(kind, StructType):
        required = [f.name for f in kind.fields if not f.nullable]
        return {"type": "object", "properties": {f.name: json_schema(f.dataType) for f in kind.fields}} | ({"required": required} if required else {})
    if isinstance(kind, ArrayType):
        return {"type": "array", "items": json_schema(kind.elementType)}
    if isinstance(kind, MapType):
        return {"type": "object", "additionalProperties": json_schema(kind.valueType)}
    return {"type": "number"} if isinstance(kind, DecimalType) else {"type": _JSON_TYPES.get(kind.simpleString(), "string")}


def with_schema(prompt: Column, schema_json: str, instruction: str = "Answer with JSON of this schema only:") -> Column:
    return F.concat(prompt, F.lit("\n\n" + instruction + "\n"), F.lit(schema_json))


def chat_messages(prompt: Column, image_base64: Column) -> Column:
    """The chat payload as JSON: text part, then image part."""
    text = F.to_json(F.struct(F.lit("text").alias("type"), prompt.alias("text")))
    url = F.to_json(F.struct(F.concat(F.lit("data:image/png;base64,"), image_base64).alias("url")))
    return F.concat(F.lit('[{"role":"user","content":['), text, F.lit(',{"type":"image_url","image_url":'), url, F.lit("}]}]"))


# -- tables, formulas, scores ----------------------------------------------------------------


def linearised_to_markdown(raw: Column) -> Column:
    """A chart model's flat rows as a Markdown table under an optional bold title."""
    lines = F.filter(F.transform(F.split(F.coalesce(raw, F.lit("")), r"<0x0A>|\n"), strip), lambda x: x != "")
    title_of = lambda x: F.regexp_extract(x, r"(?i)^title\s*\|\s*(.+)$", 1)
    titles = F.filter(F.transform(lines, title_of), lambda x: x != "")
    title = F.element_at(F.concat(F.array(F.lit("")), titles), -1)
    cells = F.transform(F.filter(lines, lambda x: title_of(x) == ""), lambda x: F.transform(F.split(x, r"\|"), strip))
    rows = F.filter(cells, lambda r: F.exists(r, lambda x: x != ""))
    width = F.array_max(F.transform(rows, F.size))
    padded = F.transform(rows, lambda r: F.concat(r, F.array_repeat(F.lit(""), width - F.size(r))))
    drawn = F.transform(padded, lambda r: F.concat(F.lit("| "), F.array_join(r, " | "), F.lit(" |")))
    rule = F.concat(F.lit("|"), F.array_join(F.array_repeat(F.lit("---"), width), "|"), F.lit("|"))
    table = F.array_join(F.concat(F.slice(drawn, 1, 1), F.array(rule), F.slice(drawn, 2, F.greatest(F.size(drawn), F.lit(1)))), "\n")
    head = F.when(title != "", F.concat(F.lit("**"), title, F.lit("**"))).otherwise("")
    return F.when(F.size(rows) == 0, head).when(title != "", F.concat(head, F.lit("\n\n"), table)).otherwise(table)


def wrap_latex(latex: Column, display: Column) -> Column:
    s = strip(F.coalesce(latex, F.lit("")))
    done = F.startswith(s, F.lit("\\(")) | F.startswith(s, F.lit("\\[")) | F.startswith(s, F.lit("$"))
    return F.when((s == "") | done, s).when(display, F.concat(F.lit("\\["), s, F.lit("\\]"))).otherwise(F.concat(F.lit("\\("), s, F.lit("\\)")))


_NUMBER = r"([0-9.]+)"


def overall_score(report: Column) -> Column:
    """struct<overall, ci_low, ci_high> from a score report; the line with an interval is preferred,
    and what is not there is NULL."""
    ci = rf"(?i)Average\s+Score:\s*{_NUMBER}\s*%\s*(?:±|\+/-)\s*{_NUMBER}\s*%"
    plain = rf"(?i)Average\s+Score:\s*{_NUMBER}\s*%"
    number = lambda p, g: F.regexp_extract(report, p, g).try_cast("double")
    margin = number(ci, 2)
    has = margin.isNotNull()
    value = F.when(has, number(ci, 1)).otherwise(number(plain, 1))
    return F.struct(value.alias("overall"), F.when(has, value - margin).alias("ci_low"), F.when(has, value + margin).alias("ci_high"))


def category_scores(report: Column) -> Column:
    """array<struct<name, score, tests>>, the first line of each category."""
    pattern = r"(?m)^\s*([A-Za-z_][\w.-]*)\.jsonl\s*:\s*([0-9.]+)\s*%(?:\s*\((\d+)/(\d+)\s*tests\))?"
    part = lambda g: F.regexp_extract_all(report, F.lit(pattern), F.lit(g))
    names = part(1)
    zipped = F.arrays_zip(names.alias("n"), part(2).alias("s"), part(4).alias("t"))
    firsts = F.filter(zipped, lambda x, i: F.array_position(names, x["n"]) == i + 1)
    return F.transform(firsts, lambda x: F.struct(x["n"].alias("name"), x["s"].try_cast("double").alias("score"), F.coalesce(x["t"].try_cast("int"), F.lit(0)).alias("tests")))
