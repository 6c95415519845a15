"""Right-to-left labels, visual order and token joining.

Label rules are Column expressions; visual reordering walks characters, so it is an Arrow-batched pandas UDF.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quoin.functions.text import RTL, bidi_class, direction

# A right-to-left label, what may begin its value, and runs that keep their order.
LABEL = r"[\x{0590}-\x{08FF}][\x{0590}-\x{08FF}\s\"'()./\-]*?"
VALUE_START = r"[A-Za-z0-9@(+]"
LTR_RUN = re.compile(r"[A-Za-z0-9][A-Za-z0-9.,:/@_+\-]*")
CLOSING, OPENING = set(".,;:!?)]}%"), set("([{")
# A prefix of one Hebrew letter, tokens that join what stands before them, and ends that join what follows.
PREFIX_LETTER, JOINS_BEFORE, JOINS_AFTER = r"(?:^|\s)[\x{0590}-\x{05FF}]$", r"^[.,;:!?%)\]}]", r"[(\[{/\-]$"


def label_colon(text: Column, trailing: bool = True) -> Column:
    """``:label value`` as ``label: value`` on each line; with ``trailing`` also ``a b c:`` as ``a b: c``."""

    def line(x: Column) -> Column:
        lead = F.regexp_replace(x, rf"^\s*:\s*({LABEL})\s+({VALUE_START}.*)$", "$1: $2")
        bare = F.regexp_replace(lead, rf"^\s*:\s*({LABEL})\s*$", "$1:")
        return F.regexp_replace(bare, rf"^\s*({LABEL})\s+({VALUE_START}\S*)\s*:\s*$", "$1: $2") if trailing else bare

    return F.array_join(F.transform(F.split(text, r"\r?\n"), line), "\n")


def labels_kept(source: Column, target: Column) -> Column:
    """``label:`` given back to lines of a translation whose source line is a label, if both have as many lines."""
    a, b = F.split(source, r"\r?\n"), F.split(target, r"\r?\n")
    joined = F.zip_with(a, b, lambda s, t: F.when(s.rlike(rf"^\s*:?\s*{LABEL}\s*:?\s*$") & s.contains(":") & ~t.rlike(r":\s*$"), F.concat(F.regexp_replace(t, r"^\s*:\s*|\s+$", ""), F.lit(":"))).otherwise(t))
    return F.when(F.size(a) == F.size(b), F.array_join(joined, "\n")).otherwise(target)


def visual_rtl(text: str) -> str:
    """Characters reversed, left-to-right runs put back in their own order."""
    return LTR_RUN.sub(lambda m: m[0][::-1], text[::-1])


@F.pandas_udf(T.StringType())
def prepared_line(text: pd.Series, rtl: pd.Series) -> pd.Series:
    """Visual order for right-to-left lines, others as they are."""
    return pd.Series([visual_rtl(t) if r and t else t for t, r in zip(text, rtl, strict=True)])


def join_tokens(tokens: list[str]) -> str:
    """Tokens joined by spaces, none before closing punctuation nor after an opening bracket."""
    out = ""
    for token in tokens:
        glued = not out or token[:1] in CLOSING or out[-1] in OPENING
        out += token if glued else f" {token}"
    return re.sub(r"\s+:", ":", re.sub(r"(?<=[A-Za-z0-9])\s+\.(?=[A-Za-z0-9])", ".", out))


def ocr_languages(source: Column, target: Column) -> Column:
    """OCR language names joined by +: the source's, English for right-to-left ones, the target's."""
    # Names of the OCR models by language code.
    names = F.create_map(*[F.lit(x) for c, n in (("en", "eng"), ("he", "heb"), ("ar", "ara"), ("fr", "fra"), ("de", "deu"), ("it", "ita")) for x in (c, n)])
    english = F.when(source.isin("he", "ar"), F.lit("eng"))
    return F.array_join(F.array_distinct(F.array_compact(F.array(names[source], english, names[target]))), "+")


def _in_order(chars: Column) -> Column:
    return F.array_sort(F.transform(chars, lambda x: F.struct(x["ord"].alias("ord"), x["c"].alias("c"), F.coalesce(x["x0"].cast("double"), F.lit(0.0)).alias("x0"))))


def trimmed_chars(chars: Column) -> Column:
    """Characters (ord, c, x0) in order without white space at either end."""
    ordered = _in_order(chars)
    seen = F.transform(ordered, lambda x: ~x["c"].rlike(r"^\s*$"))
    first, last = F.array_position(seen, True) - 1, F.size(seen) - F.array_position(F.reverse(seen), True)
    return F.when(F.array_contains(seen, True), F.slice(ordered, (first + 1).cast("int"), (last - first + 1).cast("int"))).otherwise(F.slice(ordered, 1, 0))


def bidi_tokens(chars: Column) -> Column:
    """Tokens (x0, direction, text) of characters (ord, c, x0) in their order.

    White space and changes of strong direction part tokens; neutral characters stay with the
    token they stand in, and a token of such alone is neutral.
    """
    token = "struct<x0:double,direction:string,text:string>"
    none = F.lit(None).cast(token)

    def strong(kind: Column) -> Column:
        return kind.isin("rtl", "ltr")

    def step(acc: Column, x: Column) -> Column:
        kind, now = bidi_class(x["c"]), acc["now"]
        parted = (kind == "space") | (strong(kind) & strong(now["direction"]) & (kind != now["direction"]))
        fresh = F.struct(x["x0"].alias("x0"), kind.alias("direction"), x["c"].alias("text"))
        grown = F.struct(F.least(now["x0"], x["x0"]).alias("x0"), F.when(strong(now["direction"]), now["direction"]).otherwise(kind).alias("direction"), F.concat(now["text"], x["c"]).alias("text"))
        held = F.when(parted & now.isNotNull(), F.concat(acc["out"], F.array(now))).otherwise(acc["out"])
        return F.struct(held.alias("out"), F.when(kind == "space", none).when(now.isNull() | parted, fresh).otherwise(grown).alias("now"))

    start = F.struct(F.array().cast(f"array<{token}>").alias("out"), none.alias("now"))
    ended = F.aggregate(_in_order(chars), start, step, lambda acc: F.when(acc["now"].isNull(), acc["out"]).otherwise(F.concat(acc["out"], F.array(acc["now"]))))
    return F.filter(ended, lambda t: t["text"] != "")


def joined_tokens(tokens: Column) -> Column:
    """Token texts of a mixed line in reading order as one text: values go to their label's colon, prefixes and punctuation to their words."""

    def step(acc: Column, token: Column) -> Column:
        last = acc["last"]
        value = last.rlike(RTL) & token.rlike("^:" + VALUE_START)
        prefix = last.rlike(PREFIX_LETTER) & token.rlike("[A-Za-z0-9]") & token.endswith("-")
        glued = (last == "") | token.rlike(JOINS_BEFORE) | last.rlike(JOINS_AFTER) | (last.endswith(".") & (F.length(token) <= 2))
        text = F.when(value, F.concat(last, F.lit(": "), F.substring(token, 2, F.length(token)))).when(prefix, F.concat(last, F.lit("-"), F.substring(token, 1, F.length(token) - 1))).when(glued, F.concat(last, token))
        done = F.when(text.isNull(), F.concat(acc["done"], last, F.lit(" "))).otherwise(acc["done"])
        return F.struct(done.alias("done"), F.coalesce(text, token).alias("last"))

    start = F.struct(F.lit("").alias("done"), F.lit("").alias("last"))
    return F.aggregate(tokens, start, step, lambda acc: F.trim(F.regexp_replace(F.concat(acc["done"], acc["last"]), r"\s+", " ")))


def mixed_line(chars: Column, orientation: Column | None = None) -> Column:
    """Text of a line's characters (ord, c, x0).

    A horizontal right-to-left line that has tokens of both directions is read from the right,
    token by token; any other line keeps the order of its characters.
    """
    plain = F.array_join(F.transform(_in_order(chars), lambda x: x["c"]), "")
    tokens = bidi_tokens(chars)
    both = F.exists(tokens, lambda t: t["direction"] == "rtl") & F.exists(tokens, lambda t: t["direction"] == "ltr")
    placed = F.array_sort(F.transform(tokens, lambda t, i: F.struct((-t["x0"]).alias("x"), i.alias("i"), t["text"].alias("text"))))
    rebuilt = joined_tokens(F.transform(placed, lambda t: t["text"]))
    level = F.lit(True) if orientation is None else F.coalesce(orientation, F.lit("horizontal")) == "horizontal"
    return F.when(level & (direction(plain) == "rtl") & both & (rebuilt != ""), rebuilt).otherwise(plain)


def ordered_words(words: Column) -> Column:
    """Words (text, x0, word_no) of a line by place: from the right, from the left, or as numbered, by the direction of the whole line."""
    way = direction(F.array_join(F.transform(words, lambda w: w["text"]), " "))

    def placed(d: Column) -> Column:
        side = lambda w: F.when(d == "rtl", -w["x0"]).when(d == "ltr", w["x0"]).otherwise(F.lit(0.0))
        return F.transform(F.array_sort(F.transform(words, lambda w: F.struct(side(w).alias("side"), w["word_no"].alias("word_no"), w.alias("w")))), lambda k: k["w"])

    return F.transform(F.array(way), placed)[0]  # the direction is found once a line, not once a word
