"""Fonts, colours, alignment, text orientation and line metrics as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quoin.functions.geometry import clamp
from quoin.functions.text import direction, text_width, word_count

# Style rules.
DEFAULT_LINE_SPACING, LEAST_SPACING, MOST_SPACING = 1.2, 0.8, 2.5
FAUX_STROKE, FAUX_FROM_SIZE, FAUX_MODE = 0.02, 10.0, 2
PALETTE_DISTANCE, PALETTE_SIZE = 0.15, 6


def hex_color(value: Column) -> Column:
    return F.concat(F.lit("#"), F.lower(F.lpad(F.hex(value.bitwiseAND(F.lit(0xFFFFFF))), 6, "0")))


def rgb01(color: Column) -> list[Column]:
    """Red, green and blue of ``#rrggbb`` in 0 to 1; black if it is none."""
    good = color.rlike("^#[0-9A-Fa-f]{6}$")
    return [F.when(good, F.conv(F.substring(color, at, 2), 16, 10).cast("double") / 255).otherwise(F.lit(0.0)) for at in (2, 4, 6)]


def luminance(rgb: list[Column]) -> Column:
    return rgb[0] * 0.2126 + rgb[1] * 0.7152 + rgb[2] * 0.0722


def color_distance(a: list[Column], b: list[Column]) -> Column:
    return F.sqrt(sum(((x - y) * (x - y) for x, y in zip(a, b, strict=True)), F.lit(0.0)))


def font_name(name: Column) -> Column:
    """Without the six letters of a subset."""
    return F.regexp_replace(F.coalesce(name, F.lit("")), r"^[A-Z]{6}\+", "")


def font_family(name: Column) -> Column:
    family = F.lower(F.trim(F.regexp_replace(font_name(name), r"\s+", " ")))
    return F.when(family == "", "unknown").otherwise(family)


def alignment(x0: Column, x1: Column, page_width: Column, text_direction: Column) -> Column:
    """center for balanced margins of 8 % and more around at most 80 % of the width, else the side where text starts."""
    left, right = x0, page_width - x1
    centered = (F.abs(left - right) <= 0.03 * page_width) & (left >= 0.08 * page_width) & (right >= 0.08 * page_width) & (x1 - x0 <= 0.8 * page_width)
    return F.when(centered, "center").when(text_direction == "RTL", "right").otherwise("left")


def start_alignment(text: Column) -> Column:
    return F.when(direction(text, tie="ltr") == "rtl", "right").otherwise("left")


def normal_alignment(value: Column) -> Column:
    low = F.lower(F.trim(F.coalesce(value, F.lit(""))))
    return F.when(low.isin("left", "right", "center", "justify", "start"), low).otherwise("left")


def effective_alignment(value: Column, text: Column, tightness: Column, edited: Column) -> Column:
    """Tight text that nobody aligned starts where its direction starts."""
    by_text = ((tightness == "tight") & ~edited) | (normal_alignment(value) == "start")
    return F.when(by_text, start_alignment(text)).otherwise(normal_alignment(value))


def mirrored_alignment(value: Column, text: Column, tightness: Column, mirrored: Column, edited: Column) -> Column:
    plain = normal_alignment(value)
    swapped = F.when(plain == "left", "right").when(plain == "right", "left").otherwise(plain)
    by_text = ((tightness == "tight") & ~edited) | (plain == "start")
    return F.when(by_text, start_alignment(text)).when(mirrored & ~edited, swapped).otherwise(plain)


def faux_policy(policy: Column) -> Column:
    low = F.lower(F.trim(F.coalesce(policy, F.lit(""))))
    return F.when(low == "stroke", "stroke").otherwise("semantic")


def effective_weight(explicit: Column, render_mode: Column, policy: Column) -> Column:
    return F.when((explicit == "bold") | ((faux_policy(policy) == "semantic") & (render_mode == FAUX_MODE)), "bold").otherwise("normal")


def faux_bold(render_mode: Column, size: Column, policy: Column) -> Column:
    return (faux_policy(policy) == "stroke") & (render_mode == FAUX_MODE) & (size >= FAUX_FROM_SIZE)


def faux_stroke(source: Column) -> Column:
    return F.when(source > 0, F.least(source, F.lit(FAUX_STROKE))).otherwise(F.lit(FAUX_STROKE))


def orientation(value: Column) -> Column:
    return F.when(value == "vertical_ttb", "vertical_ttb").otherwise("horizontal")


def rotation(value: Column, mirrored: Column) -> Column:
    return F.when(orientation(value) == "horizontal", F.lit(0)).when(mirrored, F.lit(-90)).otherwise(F.lit(90))


def line_spacing(line_height: Column, size: Column) -> Column:
    ratio = line_height / F.when(size > 0, size)
    return F.when(ratio.between(LEAST_SPACING, MOST_SPACING), ratio).otherwise(F.lit(DEFAULT_LINE_SPACING))


def rescaled_line_height(line_height: Column, size: Column, next_size: Column) -> Column:
    return F.round(next_size * line_spacing(line_height, size), 3)


def line_x(line_width: Column, value: Column, content_width: Column, padding: Column) -> Column:
    """Left edge of a line by its alignment, never before the padding."""
    free = content_width - line_width
    return F.greatest(padding, padding + F.when(value == "right", free).when(value == "center", free / 2).otherwise(F.lit(0.0)))


def justified_gap(text: Column, target_width: Column, size: Column) -> Column:
    """Extra space for each gap of a justified line; 0 for one word or a line that is full."""
    gaps = word_count(text) - 1
    return F.when((gaps > 0) & (target_width > text_width(text, size)), (target_width - text_width(text, size)) / gaps).otherwise(F.lit(0.0))


def wrap_mode(block_type: Column, flattened: Column, vertical: Column) -> Column:
    return F.when(vertical, "none").when(block_type.isin("table_cell", "text_line") | flattened, "word").otherwise("none")


def ocr_font_size(height: Column) -> Column:
    return F.round(clamp(height * 0.82, 6.0, 48.0), 3)


def ocr_confidence(value: Column) -> Column:
    return clamp(F.when(value > 1, value / 100).otherwise(value), 0.0, 1.0)


def clip_for_fit(mode: Column, by_source: Column, edited: Column) -> Column:
    return (mode == "on") | ((mode == "auto") & by_source & ~edited)
