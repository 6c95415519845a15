"""Checks and clean-up of translated texts as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quoin.functions.text import count, direction, squeezed, target_direction

# What counts as a date, a number, and a bulleted line.
DATE = r"(?<![A-Za-z0-9_])(?:\d{1,2}[./-]\d{1,2}[./-]\d{2,4}|\d{4}[./-]\d{1,2}[./-]\d{1,2})(?![A-Za-z0-9_])"
NUMBER = r"\d[\d,./:-]*"
BULLET = r"(?m)^\s*[-*•·]\s+"
# The issues in their order of report.
ISSUES = ("length_ratio_extreme", "missing_numbers", "altered_dates", "missing_parentheses", "dropped_bullet_markers", "unchanged_source_text")
LEAST_RATIO, MOST_RATIO, RATIO_FROM = 0.55, 3.5, 20


def _text(x: Column) -> Column:
    return F.coalesce(x, F.lit(""))


def number_token(token: Column) -> Column:
    """A number without brackets before it, closing punctuation after it and one final stop."""
    bare = F.regexp_replace(F.trim(token), r"""^[(\[{"'\x{05F3}\x{05F4}]+""", "")
    return F.regexp_replace(F.regexp_replace(bare, r"""[)\]},;:!?"'\x{05C3}]+$""", ""), r"\.$", "")


def numbers(text: Column) -> Column:
    found = F.transform(F.regexp_extract_all(_text(text), F.lit(NUMBER), F.lit(0)), number_token)
    return F.array_distinct(F.filter(found, lambda t: t != ""))


def dates(text: Column) -> Column:
    return F.regexp_extract_all(_text(text), F.lit(DATE), F.lit(0))


def missing_numbers(source: Column, target: Column) -> Column:
    return F.size(F.array_except(numbers(source), numbers(target))) > 0


def altered_dates(source: Column, target: Column) -> Column:
    return F.size(F.array_except(dates(source), dates(target))) > 0


def missing_brackets(source: Column, target: Column) -> Column:
    fewer = F.lit(False)
    for bracket in r"\( \) \[ \] \{ \}".split():
        fewer = fewer | (count(_text(source), bracket) > count(_text(target), bracket))
    return fewer


def dropped_bullets(source: Column, target: Column) -> Column:
    return count(_text(source), BULLET) > count(_text(target), BULLET)


def issues(source: Column, target: Column, target_code: Column | None = None) -> Column:
    """Ordered list of what is wrong with a translation."""
    a, b = squeezed(source), squeezed(target)
    ratio = F.length(b) / F.greatest(F.lit(1), F.length(a))
    checks = [(F.length(a) >= RATIO_FROM) & ((ratio < LEAST_RATIO) | (ratio > MOST_RATIO)), missing_numbers(source, target), altered_dates(source, target), missing_brackets(source, target), dropped_bullets(source, target)]
    if target_code is not None:
        wanted, held = target_direction(target_code), direction(_text(source), ("RTL", "LTR", "UNKNOWN"))
        checks.append((a == b) & wanted.isNotNull() & (held != "UNKNOWN") & (held != wanted))
    return F.filter(F.array(*[F.when(c, n) for c, n in zip(checks, ISSUES, strict=False)]), lambda x: x.isNotNull())


def merged_issues(*lists: Column) -> Column:
    return F.array_distinct(F.concat(*lists))


def source_dates_kept(source: Column, target: Column) -> Column:
    """The k-th date of the translation replaced by the k-th date of the source, as far as there are any."""
    wanted, found, gaps = dates(source), dates(target), F.split(_text(target), DATE, -1)
    pieces = F.transform(gaps, lambda g, i: F.concat(g, F.when(i < F.size(found), F.coalesce(F.get(wanted, i), F.get(found, i))).otherwise(F.lit(""))))
    return F.when((F.size(wanted) == 0) | (F.size(found) == 0), target).otherwise(F.array_join(pieces, ""))


def line_breaks_kept(source: Column, target: Column, block_type: Column) -> Column:
    """Line feeds become spaces unless the source has some or the block is a list or a table cell."""
    keep = _text(source).contains("\n") | block_type.isin("list", "table_cell")
    trimmed = F.trim(_text(target))
    return F.when(keep, trimmed).otherwise(F.trim(F.regexp_replace(trimmed, r"\s*\n\s*", " ")))


def shekel_amount(text: Column) -> Column:
    """``NIS <amount>`` for a text that is a shekel amount alone, else null."""
    sign, amount = r"""(?:ש["״”]?ח|₪)""", r"([+-]?\d[\d,]*(?:\.\d+)?)"
    before, after = rf"^\s*{sign}\s*{amount}\s*$", rf"^\s*{amount}\s*{sign}\s*$"
    return F.when(text.rlike(before), F.concat(F.lit("NIS "), F.regexp_extract(text, before, 1))).when(text.rlike(after), F.concat(F.lit("NIS "), F.regexp_extract(text, after, 1)))


def cache_key(source: Column, model: str, glossary: str, prompt: str) -> Column:
    """SHA-256 of a text with the versions that a translation depends on."""
    return F.sha2(F.concat_ws("\n", _text(source), F.lit(model), F.lit(glossary), F.lit(prompt)), 256)
