"""Explicit schemas of the layout tables; every table leads with document_id and page_id."""

from __future__ import annotations

_KEY = "document_id STRING, page_id INT"
_BOX = "x0 DOUBLE, y0 DOUBLE, x1 DOUBLE, y1 DOUBLE"
_WORD = "STRUCT<text: STRING, confidence: DOUBLE, bbox: STRUCT<x0: DOUBLE, y0: DOUBLE, x1: DOUBLE, y1: DOUBLE>>"
_LINE = f"STRUCT<text: STRING, confidence: DOUBLE, bbox: STRUCT<x0: DOUBLE, y0: DOUBLE, x1: DOUBLE, y1: DOUBLE>, words: ARRAY<{_WORD}>>"

SCHEMAS = {
    "layout_pages": f"{_KEY}, type STRING, width_pt DOUBLE, height_pt DOUBLE, rotation INT, text_span_count INT, image_count INT, font_count INT, direction STRING",
    "chars": f"{_KEY}, block_idx INT, line_idx INT, ord INT, c STRING, {_BOX}",
    "words": f"{_KEY}, block_no INT, line_no INT, word_no INT, text STRING, {_BOX}",
    "spans": f"{_KEY}, line_no INT, span_no INT, text STRING, font STRING, size DOUBLE, flags INT, color INT, {_BOX}",
    "elements": f"{_KEY}, element_id STRING, text STRING, {_BOX}, tightness STRING, render_kind STRING, split_reason STRING, source_line_id STRING, source_blocks ARRAY<INT>, merged_element_ids ARRAY<STRING>",
    "styles": f"{_KEY}, style_id STRING, font_family STRING, font_size DOUBLE, weight STRING, italic BOOLEAN, color STRING, alignment STRING, line_spacing DOUBLE, render_mode INT, stroke_width DOUBLE",
    "blocks": f"{_KEY}, block_id STRING, type STRING, text STRING, style_id STRING, reading_order INT, source STRING, confidence DOUBLE, flattened_line_breaks BOOLEAN, text_tightness STRING, source_text_orientation STRING, {_BOX}",
    "regions": f"{_KEY}, region_id STRING, kind STRING, drawing_count INT, score DOUBLE, {_BOX}",
    "barriers": f"{_KEY}, barrier_id STRING, axis STRING, pos DOUBLE, lo DOUBLE, hi DOUBLE, score DOUBLE, kind STRING",
    "translations": f"{_KEY}, block_id STRING, source_text STRING, translated_text STRING, translation_hash STRING, status STRING, attempts INT, issues ARRAY<STRING>",
    "fitted": f"{_KEY}, block_id STRING, source_block_id STRING, style_id STRING, translated_text STRING, lines ARRAY<STRING>, font_size DOUBLE, line_height DOUBLE, overflow BOOLEAN, fit_strategy STRING, bucket_ratio DOUBLE, nominal_font_size DOUBLE, collision BOOLEAN, collides_with ARRAY<STRING>, {_BOX}",
    "ocr": f"{_KEY}, blocks ARRAY<STRUCT<paragraphs: ARRAY<STRUCT<lines: ARRAY<{_LINE}>>>>>",
}
