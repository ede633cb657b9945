"""Schemas of the decoded-structure tables that all operators work on. A page's key is
(doc_id, page_index), page_index from 0. Boxes are in page space, origin bottom left."""

from __future__ import annotations

PAGES = "doc_id string, page_index int, width double, height double, text string, error string"
PAGE_OBJECTS = "doc_id string, page_index int, obj_id int, kind string, x0 double, y0 double, x1 double, y1 double"
CHARS = "doc_id string, page_index int, char_index int, codepoint int, font string, flags int, weight int, size double, x0 double, y0 double, x1 double, y1 double"
SPANS = "doc_id string, page_index int, span_index int, text string, x0 double, y0 double, x1 double, y1 double, font string, size double, bold boolean, italic boolean, underline boolean, strikeout boolean, heading_level int"
ATTEMPTS = "doc_id string, page_index int, attempt int, raw_content string, finish_reason string, prompt_tokens int, completion_tokens int, total_tokens int, error string"
COMPONENTS = "name string, kind string, license string, license_class string, developer string, notes string"
GPUS = "index int, name string, memory_total_mb int, compute_capability double"
BENCH_TESTS = "jsonl_name string, line string, pdf string"

PAGE_KEY = ("doc_id", "page_index")
