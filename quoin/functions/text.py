"""Text, language and direction as Column expressions.

Lengths count code points. Word borders are ASCII ones, written as look-arounds.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Advance of a character by class, in shares of the font size.
SPACE, NARROW, WIDE, DIGIT, PUNCTUATION, FULL, OTHER = 0.33, 0.3, 0.78, 0.55, 0.3, 1.0, 0.56
WIDTH_CLASSES = (
    (r"\s", SPACE),
    (r"[ilI|]", NARROW),
    (r"[mwMW]", WIDE),
    (r"[0-9]", DIGIT),
    (r"""[.,;:!?"'()\[\]{}\-_/\\]""", PUNCTUATION),
    (r"[\x{2E80}-\x{10FFFF}]", FULL),
)
# Scripts, hint words and accents of the rule classifier, in its order of preference.
RTL, LTR = r"[\x{0590}-\x{08FF}]", r"[A-Za-z]"
HEBREW, ARABIC = r"[\x{0590}-\x{05FF}]", r"[\x{0600}-\x{06FF}\x{0750}-\x{077F}\x{08A0}-\x{08FF}]"
LATIN = r"[A-Za-zÀ-ÖØ-öø-ÿĀ-žßŒœÆæ]"
HINTS = {
    "fr": ("le|la|les|des|une|un|avec|pour|dans|sur|est|et", "[àâæçéèêëîïôœùûüÿ]", 3),
    "de": ("der|die|das|und|mit|nicht|für|ein|eine|von|auf", "[äöüß]", 3),
    "it": ("il|lo|la|gli|le|una|uno|con|per|che|del|della|dei", "[àèéìíîòóùú]", 2),
}
ENGLISH_HINTS = "the|and|for|with|this|that|from|your|you|page|document"
# The six document languages with their writing direction.
LANGUAGES = {"en": ("English", "ltr"), "he": ("Hebrew", "rtl"), "ar": ("Arabic", "rtl"), "fr": ("French", "ltr"), "de": ("German", "ltr"), "it": ("Italian", "ltr")}
RTL_TARGETS = ("ar", "fa", "he", "iw", "ur")


def count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def whole_words(words: str) -> str:
    return f"(?<![A-Za-z0-9_])(?:{words})(?![A-Za-z0-9_])"


def squeezed(text: Column) -> Column:
    """White space collapsed to one space, trimmed."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))


def words(text: Column) -> Column:
    return F.filter(F.split(squeezed(text), " "), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.size(words(text))


def text_width(text: Column, font_size: Column | float = 1.0) -> Column:
    """Sum of the class advances: the portable measure of a line."""
    size = font_size if isinstance(font_size, Column) else F.lit(float(font_size))
    text = F.coalesce(text, F.lit(""))
    extra = sum((count(text, p) * F.lit(round(w - OTHER, 4)) for p, w in WIDTH_CLASSES), F.lit(0.0))
    return (F.length(text) * OTHER + extra) * size


def digit_like_share(text: Column) -> Column:
    visible = count(text, r"\S")
    return F.when(visible > 0, count(text, r"[0-9.,/%\-:()]") / visible).otherwise(F.lit(1.0))


def letter_count(text: Column) -> Column:
    return count(text, r"\p{L}")


def number_count(text: Column) -> Column:
    return count(text, r"\p{N}")


def direction(text: Column, labels: tuple[str, str, str] = ("rtl", "ltr", "neutral"), tie: str | None = None) -> Column:
    """Direction by letter counts. labels: (rtl, ltr, none); ``tie`` names the winner of equal counts, rtl if not given."""
    rtl, ltr = count(text, RTL), count(text, LTR)
    won = F.when(rtl > ltr, labels[0]).when(rtl < ltr, labels[1]).otherwise(F.lit(labels[0] if tie is None else tie))
    return F.when((rtl == 0) & (ltr == 0), F.lit(labels[2])).otherwise(won)


def bidi_class(char: Column) -> Column:
    return F.when(char.rlike(RTL), "rtl").when(char.rlike(r"[A-Za-z0-9]"), "ltr").when(char.rlike(r"\s"), "space").otherwise("neutral")


def is_word_separator(char: Column) -> Column:
    return char.rlike(r"[\s\x{FFFD}\x{0000}-\x{001F}\x{007F}-\x{009F}]")


def visible_char(char: Column) -> Column:
    """Control characters become U+FFFD."""
    return F.regexp_replace(char, r"[\x{0000}-\x{001F}\x{007F}-\x{009F}]", "�")


def has_script(text: Column, code: Column) -> Column:
    return F.when(code == "he", text.rlike(HEBREW)).when(code == "ar", text.rlike(ARABIC)).otherwise(text.rlike(LATIN))


def language_scores(text: Column) -> dict[str, Column]:
    low = F.lower(text)
    out = {code: (count(low, whole_words(w)) * 2 + count(low, accents) * times).cast("double") for code, (w, accents, times) in HINTS.items()}
    return out | {"en": count(low, whole_words(ENGLISH_HINTS)) * 2 + F.lit(0.5)}


def language(text: Column) -> Column:
    """Struct of code, confidence and reason by the rule classifier.

    Scripts first; among Latin languages the highest score wins, English on ties, then
    French before German before Italian.
    """
    sample = F.trim(F.coalesce(text, F.lit("")))
    counts = {"hebrew": count(sample, HEBREW), "arabic": count(sample, ARABIC), "latin": count(sample, LATIN), "long": F.length(sample)} | language_scores(sample)
    return _once(F.struct(*[v.alias(k) for k, v in counts.items()]), _language)


def _once(value: Column, use) -> Column:
    """``use(value)`` with the value computed once a row; written out at each use it would be computed at each."""
    return F.get(F.transform(F.array(value), use), 0)


def _language(n: Column) -> Column:
    hebrew, arabic, latin = n["hebrew"], n["arabic"], n["latin"]
    best = F.greatest(n["en"], *[n[c] for c in HINTS])
    code = F.when((latin == 0) | (n["en"] == best), "en")
    for c in HINTS:
        code = code.when(n[c] == best, c)
    by_script = lambda k: F.least(F.lit(1.0), k / F.greatest(F.lit(10.0), n["long"] * 0.08))
    lexical = F.greatest(F.lit(0.35), F.least(F.lit(1.0), (best + 1) / F.greatest(F.lit(3.0), latin * 0.12)))
    of = lambda c, conf, why: F.struct(c.alias("code"), conf.cast("double").alias("confidence"), why.alias("reason"))
    latin_reason = F.when(code == "en", "latin_fallback").otherwise(F.concat(code, F.lit("_lexical")))
    return (
        F.when(n["long"] == 0, of(F.lit("en"), F.lit(0.0), F.lit("empty_text")))
        .when(hebrew >= F.greatest(F.lit(3), arabic + 1), of(F.lit("he"), by_script(hebrew), F.lit("hebrew_script")))
        .when(arabic >= F.greatest(F.lit(3), hebrew + 1), of(F.lit("ar"), by_script(arabic), F.lit("arabic_script")))
        .otherwise(of(code, F.when(latin > 0, lexical).otherwise(F.lit(0.35)), latin_reason))
    )


def language_code(code: Column, fallback: str = "en") -> Column:
    known = F.lower(F.trim(F.coalesce(code, F.lit(""))))
    return F.when(known.isin(*LANGUAGES), known).otherwise(F.lit(fallback))


def language_direction(code: Column) -> Column:
    return F.when(language_code(code).isin(*[c for c, v in LANGUAGES.items() if v[1] == "rtl"]), "rtl").otherwise("ltr")


def language_name(code: Column) -> Column:
    known = F.create_map(*[F.lit(x) for c, v in LANGUAGES.items() for x in (c, v[0])])
    return known[language_code(code)]


def mirrors_by_default(source: Column, target: Column) -> Column:
    return language_direction(source) != language_direction(target)


def target_direction(code: Column) -> Column:
    low = F.lower(F.trim(F.coalesce(code, F.lit(""))))
    return F.when(low == "", F.lit(None)).when(low.isin(*RTL_TARGETS), "RTL").otherwise("LTR")


def looks_structural(text: Column) -> Column:
    """Lines that are labels, bullets or figures and so never join a paragraph."""
    sample = F.trim(F.coalesce(text, F.lit("")))
    tokens = word_count(sample)
    return (F.length(sample) <= 1) | (sample.endswith(":") & (tokens <= 3)) | ((tokens <= 1) & (F.length(sample) < 8)) | ((digit_like_share(sample) >= 0.7) & (tokens <= 4))


def ends_sentence(text: Column) -> Column:
    return text.rlike(r"[.!?:;]\s*$")


def starts_with_bullet(text: Column) -> Column:
    return text.rlike(r"^\s*(\d+[.)]\s|[-•●■]\s|[א-ת][.)]\s|סעיף\s)")


def has_unmatched_open(text: Column) -> Column:
    return (count(text, r"\(") > count(text, r"\)")) | (count(text, r"\[") > count(text, r"\]"))


def explicit_lines(text: Column) -> Column:
    return F.split(F.regexp_replace(F.coalesce(text, F.lit("")), r"\r\n?", "\n"), "\n")


# Characters that a wrong decoding leaves behind.
SUSPICIOUS = r"[\x{FFFD}€‚ƒ„…†‡‰‹‘’“”•–—™]"
PLAIN_LETTER = r"[A-Za-z\x{0590}-\x{05FF}]"


def extraction_warning(text: Column) -> Column:
    """Struct of suspicious, reasons, score for a badly decoded text; null for a sound one."""
    sample = F.trim(F.coalesce(text, F.lit("")))
    replaced, odd = count(sample, r"\x{FFFD}"), count(sample, SUSPICIOUS)
    tokens = words(sample)
    bad = F.size(F.filter(tokens, lambda t: (count(t, SUSPICIOUS) >= 2) & (count(t, PLAIN_LETTER) == 0)))
    share = bad / F.greatest(F.lit(1), F.size(tokens))
    score = F.least(F.lit(1.0), replaced * 0.4 + share * 0.6 + F.least(F.lit(0.2), odd * 0.01))
    of = lambda why: F.struct(F.lit(True).alias("suspicious"), F.array(F.lit(why)).alias("reasons"), F.round(score, 3).alias("score"))
    return F.when(sample == "", F.lit(None)).when(replaced > 0, of("replacement_chars")).when((bad >= 3) & (share >= 0.18), of("mojibake_tokens"))
