"""Wrapping text and fitting font sizes to boxes.

Without wrapping the fit is a closed form in Column expressions. Greedy wrapping depends on
each line before, and its bisection on each wrap: an Arrow-batched pandas UDF does both.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quoin.functions.geometry import clamp
from quoin.functions.style import DEFAULT_LINE_SPACING
from quoin.functions.text import DIGIT, FULL, NARROW, OTHER, PUNCTUATION, SPACE, WIDE

STEPS = 16


@lru_cache(4096)
def char_width(c: str) -> float:
    if c.isspace():
        return SPACE
    if c in "ilI|":
        return NARROW
    if c in "mwMW":
        return WIDE
    if "0" <= c <= "9":
        return DIGIT
    if c in ".,;:!?\"'()[]{}-_/\\":
        return PUNCTUATION
    return FULL if ord(c) >= 0x2E80 else OTHER


def line_width(text: str, size: float = 1.0) -> float:
    return sum(map(char_width, text)) * size


def broken_token(token: str, width: float, size: float) -> list[str]:
    """A token too wide for a line, cut where the next character would pass the width."""
    out, now, used = [], "", 0.0
    for c in token:
        w = char_width(c) * size
        if now and used + w > width:
            out.append(now)
            now, used = "", 0.0
        now, used = now + c, used + w
    return [*out, now] if now else out


def measured(text: str) -> list[list[tuple[str, float]]]:
    """Paragraphs of a text as words with their widths at size 1, so that each probe of a size only adds numbers."""
    return [[(w, line_width(w)) for w in p.split()] for p in re.split(r"\r\n?|\n", text or "")]


def wrapped(text: str | list, width: float, size: float, most: float = float("inf")) -> list[str]:
    """Greedy word wrap of a text, or of what ``measured`` gave for it; line feeds stay, long tokens are cut by characters.

    Wrapping ends early once there are over ``most`` lines: a probe that only asks whether the text fits.
    """
    out: list[str] = []
    for paragraph in measured(text) if isinstance(text, str) else text:
        now: list[str] = []
        used = 0.0
        for word, unit in paragraph:
            if len(out) > most:
                return out
            more = (SPACE * size if now else 0.0) + unit * size
            if used + more <= width:
                now.append(word)
                used += more
                continue
            if now:
                out.append(" ".join(now))
            if unit * size <= width:
                now, used = [word], unit * size
            else:
                *full, last = broken_token(word, width, size)
                out += full
                now, used = [last], line_width(last, size)
        out.append(" ".join(now))
    return out


def truncated(text: str, width: float, size: float) -> str:
    """The longest prefix with three dots that fits; empty if the dots alone do not."""
    if line_width(text, size) <= width:
        return text
    used, best = line_width("...", size), ""
    if used > width:
        return ""
    for c in text:
        used += char_width(c) * size
        if used > width:
            break
        best += c
    return f"{best.rstrip()}..."


def wrapped_fit(text: str, width: float, height: float, base: float, least: float, spacing: float = DEFAULT_LINE_SPACING) -> tuple[float, list[str], bool]:
    """Largest size up to ``base`` whose wrapped lines fit, by bisection: size, lines, overflow."""

    words = measured(text)

    def fits(size: float) -> tuple[bool, list[str]]:
        lines = wrapped(words, width, size, (height - size) / (size * spacing) + 1)
        return size + (len(lines) - 1) * size * spacing <= height and len(lines) > 0, lines

    ok, lines = fits(base)
    if ok:
        return base, lines, False
    ok, lines = fits(least)
    if not ok:
        return least, wrapped(words, width, least), True
    low, high = least, base
    for _ in range(STEPS):
        mid = (low + high) / 2
        ok, got = fits(mid)
        if ok:
            low, lines = mid, got
        else:
            high = mid
    return round(low, 4), lines, False


def fit_without_wrap(unit_width: Column, width: Column, height: Column, lines: Column, base: Column, least: float = 4.0, spacing: float = DEFAULT_LINE_SPACING) -> tuple[Column, Column]:
    """Size and overflow in closed form: as wide as the widest line allows, as high as the lines allow."""
    size = F.least(base, width / F.when(unit_width > 0, unit_width).otherwise(F.lit(1e-9)), height / (1 + (lines - 1) * spacing))
    return F.greatest(F.lit(least), size), size < least


def fit_blocks(blocks: DataFrame, least: float = 4.0) -> DataFrame:
    """``blocks`` (text, x0..y1, base_size) with font_size, lines and overflow under word wrap."""

    @F.pandas_udf("font_size double, lines array<string>, overflow boolean")
    def fit(text: pd.Series, width: pd.Series, height: pd.Series, base: pd.Series) -> pd.DataFrame:
        got = [wrapped_fit(t or "", w, h, b, least) for t, w, h, b in zip(text, width, height, base, strict=True)]
        return pd.DataFrame(got, columns=["font_size", "lines", "overflow"])

    w, h = F.greatest(F.lit(1.0), F.col("x1") - F.col("x0") - 2), F.greatest(F.lit(1.0), F.col("y1") - F.col("y0") - 2)
    return blocks.withColumn("_f", fit("text", w, h, "base_size")).select(*blocks.columns, "_f.*")


def draw_lines(fitted: DataFrame, keys: list[str]) -> DataFrame:
    """Draw operations: a row per non-empty line with its baseline."""
    rows = fitted.select(*keys, "x0", "y0", "font_size", F.posexplode("lines").alias("line_no", "text")).filter("text <> ''")
    return rows.select(*keys, "line_no", "text", (F.col("x0") + 1).alias("x_pt"), F.round(F.col("y0") + 1 + F.col("font_size") * (1 + F.col("line_no") * DEFAULT_LINE_SPACING), 3).alias("baseline_pt"))


def bucket_ratio(fitted_size: Column, nominal: Column) -> Column:
    return F.round(fitted_size / F.when(nominal > 0, nominal), 4)


def capped_by_ratio(nominal: Column, ratio: Column, fitted: Column) -> Column:
    """A bucket's ratio caps the sizes of its blocks."""
    return F.least(fitted, nominal * F.coalesce(ratio, F.lit(1.0)))


def nudged(ratio: Column, tries: int = 5) -> Column:
    """Growth steps that an overflowing block may try, as an array."""
    return F.transform(F.sequence(F.lit(1), F.lit(tries)), lambda i: clamp(ratio * i, 0.0, 1.0))
