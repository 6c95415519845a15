"""Registered queries over the driver's tables, each with its oracle in DuckDB SQL where SQL can say it.

Documents become layout rows by the rules of ``quoin.sources.synth``; the oracles rebuild them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quoin.functions import geometry as g
from quoin.functions import style as st
from quoin.functions import text as tx
from quoin.functions import translation as tr
from quoin.operators import aggregates, continuation, fitting, folds, islands, session, spatial, translate
from quoin.sources import readers
from quoin.sources.synth import synth_lines, synth_words, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
PAGE = ["doc_id", "page_id"]
PAGE_WIDTH, PAGE_HEIGHT = 612.0, 792.0


def query(sql: str | None = None):
    """Register a query under its function's name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql.strip()
        return f

    return add


def r6(x: Column) -> Column:
    return F.round(x.cast("double"), 6)


# --- SQL that the oracles share


def n_of(text: str, pattern: str) -> str:
    return f"len(regexp_extract_all({text}, '{pattern}'))"


def width_sql(t: str) -> str:
    parts = [f"{round(w - tx.OTHER, 4)}::DOUBLE * " + n_of(t, p.replace("'", "''")) for p, w in tx.WIDTH_CLASSES]
    return f"({tx.OTHER}::DOUBLE * length({t}) + " + " + ".join(parts) + ")"


LINES = f"""raw AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents),
numbered AS (SELECT doc_id, text, (row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1)::INT AS line_no FROM raw WHERE trim(text) <> ''),
placed AS (SELECT *, 40::DOUBLE + 20 * (doc_id % 3) + CASE WHEN doc_id % 5 = 0 AND line_no % 2 = 1 THEN 300 ELSE 0 END AS x0 FROM numbered),
lines AS (SELECT doc_id, (line_no // 50 + 1)::INT AS page_id, line_no, text, CASE WHEN line_no = 0 THEN 14 ELSE 10 END::DOUBLE AS font_size, x0, (40 + 14 * (line_no % 50))::DOUBLE AS y0, round(x0 + 10 * {width_sql("text")}, 4) AS x1, (50 + 14 * (line_no % 50))::DOUBLE AS y1 FROM placed)"""

WORDS = LINES + f""",
parts AS (SELECT doc_id, page_id, line_no, x0 AS lx, y0, y1, list_filter(string_split(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' '), lambda w: w <> '') AS ws FROM lines),
spread AS (SELECT *, unnest(ws) AS text, generate_subscripts(ws, 1) - 1 AS k FROM parts),
led AS (SELECT *, coalesce(sum(10 * {width_sql("text")} + 3.3) OVER (PARTITION BY doc_id, line_no ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lead FROM spread),
words AS (SELECT doc_id, page_id, line_no, k::INT AS word_no, text, round(lx + lead, 4) AS x0, y0, round(lx + lead + 10 * {width_sql("text")}, 4) AS x1, y1 FROM led)"""


def box_sql(op: str, a: str = "a", b: str = "b") -> str:
    """Measures of two boxes in SQL."""
    ow = f"greatest(0, least({a}.x1, {b}.x1) - greatest({a}.x0, {b}.x0))"
    oh = f"greatest(0, least({a}.y1, {b}.y1) - greatest({a}.y0, {b}.y0))"
    area = lambda q: f"(greatest(0, {q}.x1 - {q}.x0) * greatest(0, {q}.y1 - {q}.y0))"
    return {"ow": ow, "oh": oh, "inter": f"({ow} * {oh})", "aa": area(a), "ab": area(b), "ha": f"({a}.y1 - {a}.y0)", "hb": f"({b}.y1 - {b}.y0)", "wa": f"({a}.x1 - {a}.x0)", "wb": f"({b}.x1 - {b}.x0)"}[op]


def line_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbouring lines of a page as a_ and b_."""
    lines = synth_lines(table(spark, sf_dir, "documents")).select(*PAGE, "line_no", "text", "font_size", "x0", "y0", "x1", "y1")
    b = spatial.prefixed(lines, "b_", PAGE).withColumn("a_line_no", F.col("b_line_no") - 1)
    return spatial.prefixed(lines, "a_", PAGE).join(b, [*PAGE, "a_line_no"])


PAIRS = LINES + ", pairs AS (SELECT a, b FROM lines a JOIN lines b ON a.doc_id = b.doc_id AND a.page_id = b.page_id AND b.line_no = a.line_no + 1)"

# --- text


_lang_counts = ", ".join([f"{n_of('t', tx.HEBREW)} AS he", f"{n_of('t', tx.ARABIC)} AS ar", f"{n_of('t', tx.LATIN)} AS la", *[f"({n_of('l', f'{chr(92)}b(?:{w}){chr(92)}b')} * 2 + {n_of('l', acc)} * {k})::DOUBLE AS {c}" for c, (w, acc, k) in tx.HINTS.items()], f"({n_of('l', f'{chr(92)}b(?:{tx.ENGLISH_HINTS}){chr(92)}b')} * 2 + 0.5)::DOUBLE AS en"])


@query(f"""WITH s AS (SELECT doc_id, trim(coalesce(text, '')) AS t, lower(trim(coalesce(text, ''))) AS l FROM documents), c AS (SELECT doc_id, t, {_lang_counts} FROM s),
d AS (SELECT *, greatest(fr, de, it, en) AS best FROM c),
e AS (SELECT *, CASE WHEN la = 0 OR en = best THEN 'en' WHEN fr = best THEN 'fr' WHEN de = best THEN 'de' ELSE 'it' END AS w FROM d)
SELECT doc_id, CASE WHEN t = '' THEN 'en' WHEN he >= greatest(3, ar + 1) THEN 'he' WHEN ar >= greatest(3, he + 1) THEN 'ar' ELSE w END AS code,
round(CASE WHEN t = '' THEN 0 WHEN he >= greatest(3, ar + 1) THEN least(1, he / greatest(10, length(t) * 0.08::DOUBLE)) WHEN ar >= greatest(3, he + 1) THEN least(1, ar / greatest(10, length(t) * 0.08::DOUBLE)) WHEN la > 0 THEN greatest(0.35::DOUBLE, least(1, (best + 1) / greatest(3, la * 0.12::DOUBLE))) ELSE 0.35 END::DOUBLE, 6) AS confidence,
CASE WHEN t = '' THEN 'empty_text' WHEN he >= greatest(3, ar + 1) THEN 'hebrew_script' WHEN ar >= greatest(3, he + 1) THEN 'arabic_script' WHEN w = 'en' THEN 'latin_fallback' ELSE w || '_lexical' END AS reason FROM e""")
def doc_language(spark, sf_dir):
    lang = table(spark, sf_dir, "documents").select("doc_id", tx.language(F.col("text")).alias("l"))
    return lang.select("doc_id", "l.code", r6(F.col("l.confidence")).alias("confidence"), "l.reason")


@query(f"""WITH c AS (SELECT doc_id, lang, coalesce(text, '') AS t, {n_of("coalesce(text, '')", tx.RTL)} AS r, {n_of("coalesce(text, '')", tx.LTR)} AS l FROM documents)
SELECT doc_id, CASE WHEN r = 0 AND l = 0 THEN 'UNKNOWN' WHEN r >= l THEN 'RTL' ELSE 'LTR' END AS tie_rtl, CASE WHEN r = 0 AND l = 0 THEN 'neutral' WHEN r > l THEN 'rtl' ELSE 'ltr' END AS tie_ltr,
CASE WHEN lang IN ('he', 'ar') THEN 'rtl' ELSE 'ltr' END AS lang_direction, CASE WHEN lower(lang) IN ('en', 'he', 'ar', 'fr', 'de', 'it') THEN lower(lang) ELSE 'en' END AS lang_code, lang IN ('he', 'ar') AS mirrors, regexp_matches(t, '{tx.LATIN}') AS has_latin FROM c""")
def doc_direction(spark, sf_dir):
    t, lang = F.coalesce("text", F.lit("")), F.col("lang")
    return table(spark, sf_dir, "documents").select("doc_id", tx.direction(t, ("RTL", "LTR", "UNKNOWN")).alias("tie_rtl"), tx.direction(t, tie="ltr").alias("tie_ltr"), tx.language_direction(lang).alias("lang_direction"), tx.language_code(lang).alias("lang_code"), tx.mirrors_by_default(lang, F.lit("en")).alias("mirrors"), tx.has_script(t, F.lit("en")).alias("has_latin"))


@query(f"""WITH {LINES}, m AS (SELECT doc_id, line_no, text, trim(text) AS s, len(list_filter(string_split(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' '), lambda w: w <> '')) AS n, {n_of("text", r"\S")} AS v, {n_of("text", r"[0-9.,/%\-:()]")} AS d FROM lines)
SELECT doc_id, line_no, n::INT AS n_words, {n_of("text", r"\p{L}")}::INT AS letters, {n_of("text", r"\p{N}")}::INT AS numbers, round(10 * {width_sql("text")}, 4) AS width, round(CASE WHEN v > 0 THEN d / v ELSE 1 END::DOUBLE, 6) AS digit_share,
length(s) <= 1 OR (s LIKE '%:' AND n <= 3) OR (n <= 1 AND length(s) < 8) OR (CASE WHEN v > 0 THEN d / v ELSE 1 END >= 0.7 AND n <= 4) AS structural, regexp_matches(text, '[.!?:;]\\s*$') AS ends, regexp_matches(text, '^\\s*(\\d+[.)]\\s|[-•●■]\\s)') AS bullet, {n_of("text", r"\(")} > {n_of("text", r"\)")} OR {n_of("text", r"\[")} > {n_of("text", r"\]")} AS open_bracket FROM m""")
def text_measure(spark, sf_dir):
    t = F.col("text")
    return synth_lines(table(spark, sf_dir, "documents")).select("doc_id", "line_no", tx.word_count(t).alias("n_words"), tx.letter_count(t).alias("letters"), tx.number_count(t).alias("numbers"), F.round(tx.text_width(t, 10.0), 4).alias("width"), r6(tx.digit_like_share(t)).alias("digit_share"), tx.looks_structural(t).alias("structural"), tx.ends_sentence(t).alias("ends"), tx.starts_with_bullet(t).alias("bullet"), tx.has_unmatched_open(t).alias("open_bracket"))


@query(f"""WITH c AS (SELECT doc_id, trim(coalesce(text, '')) AS t FROM documents), d AS (SELECT doc_id, t, {n_of("t", chr(0xFFFD))} AS r, {n_of("t", tx.SUSPICIOUS)} AS o, list_filter(string_split(regexp_replace(t, '\\s+', ' ', 'g'), ' '), lambda w: w <> '') AS ws FROM c),
e AS (SELECT *, len(list_filter(ws, lambda w: len(regexp_extract_all(w, '{tx.SUSPICIOUS}')) >= 2 AND len(regexp_extract_all(w, '{tx.PLAIN_LETTER}')) = 0)) AS bad FROM d)
SELECT doc_id, CASE WHEN t <> '' AND r > 0 THEN 'replacement_chars' WHEN t <> '' AND bad >= 3 AND bad / greatest(1, len(ws)) >= 0.18 THEN 'mojibake_tokens' END AS reason, CASE WHEN t <> '' AND (r > 0 OR bad >= 3 AND bad / greatest(1, len(ws)) >= 0.18) THEN round(least(1, r * 0.4 + bad / greatest(1, len(ws)) * 0.6 + least(0.2, o * 0.01))::DOUBLE, 3) END AS score FROM e""")
def mojibake_warning(spark, sf_dir):
    w = table(spark, sf_dir, "documents").select("doc_id", tx.extraction_warning(F.col("text")).alias("w"))
    return w.select("doc_id", F.get("w.reasons", 0).alias("reason"), F.col("w.score").alias("score"))


@query("SELECT 'doc_' || substr(sha256(coalesce(text, '')), 1, 12) AS document_id, sha256(coalesce(text, '')) AS sha256, count(DISTINCT doc_id) AS page_count FROM documents GROUP BY ALL")
def doc_manifest_sha(spark, sf_dir):
    return readers.manifest(table(spark, sf_dir, "documents").select(F.coalesce("text", F.lit("")).cast("binary").alias("content"), F.col("doc_id").alias("page_id")))


@query("SELECT conv_id, turn, sha256(coalesce(text, '') || chr(10) || 'm1' || chr(10) || 'g1' || chr(10) || 'p1') AS translation_hash FROM conversations")
def translation_hash(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", tr.cache_key(F.col("text"), "m1", "g1", "p1").alias("translation_hash"))


def _turns(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    nxt = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("target"))
    return c.select("conv_id", "turn", F.col("text").alias("source")).join(nxt, ["conv_id", "turn"])


_DATE = r"\b(?:\d{1,2}[./-]\d{1,2}[./-]\d{2,4}|\d{4}[./-]\d{1,2}[./-]\d{1,2})\b"
_numbers = lambda c: f"list_distinct(list_filter(list_transform(regexp_extract_all({c}, '\\d[\\d,./:-]*'), lambda n: regexp_replace(regexp_replace(n, '[,;:]+$', ''), '\\.$', '')), lambda n: n <> ''))"


@query(f"""WITH p AS (SELECT a.conv_id, a.turn, coalesce(a.text, '') AS s, coalesce(b.text, '') AS t FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1),
q AS (SELECT *, trim(regexp_replace(s, '\\s+', ' ', 'g')) AS sn, trim(regexp_replace(t, '\\s+', ' ', 'g')) AS tn FROM p),
r AS (SELECT *, length(sn) >= 20 AND (length(tn) / greatest(1, length(sn)) < 0.55 OR length(tn) / greatest(1, length(sn)) > 3.5) AS i1, len(list_filter({_numbers("s")}, lambda n: NOT list_contains({_numbers("t")}, n))) > 0 AS i2, len(list_filter(regexp_extract_all(s, '{_DATE}'), lambda d: NOT list_contains(regexp_extract_all(t, '{_DATE}'), d))) > 0 AS i3,
{" OR ".join(f"{n_of('s', b)} > {n_of('t', b)}" for b in (r"\(", r"\)", r"\[", r"\]", r"\{", r"\}"))} AS i4, {n_of("s", r"(?m)^\s*[-*•·]\s+")} > {n_of("t", r"(?m)^\s*[-*•·]\s+")} AS i5, {n_of("s", tx.LTR)} AS ltr, {n_of("s", tx.RTL)} AS rtl FROM q)
SELECT conv_id, turn, array_to_string(list_filter([CASE WHEN i1 THEN 'length_ratio_extreme' END, CASE WHEN i2 THEN 'missing_numbers' END, CASE WHEN i3 THEN 'altered_dates' END, CASE WHEN i4 THEN 'missing_parentheses' END, CASE WHEN i5 THEN 'dropped_bullet_markers' END, CASE WHEN sn = tn AND rtl + ltr > 0 AND rtl >= ltr THEN 'unchanged_source_text' END], lambda x: x IS NOT NULL), ',') AS issues, i2 AS numbers_missing, i3 AS dates_altered, i4 AS brackets_missing, i5 AS bullets_dropped FROM r""")
def validate_translation_issues(spark, sf_dir):
    s, t = F.col("source"), F.col("target")
    return _turns(spark, sf_dir).select("conv_id", "turn", F.array_join(tr.issues(s, t, F.lit("en")), ",").alias("issues"), tr.missing_numbers(s, t).alias("numbers_missing"), tr.altered_dates(s, t).alias("dates_altered"), tr.missing_brackets(s, t).alias("brackets_missing"), tr.dropped_bullets(s, t).alias("bullets_dropped"))


# --- layout rows and geometry


@query(f"WITH {LINES} SELECT * FROM lines")
def layout_lines(spark, sf_dir):
    return synth_lines(table(spark, sf_dir, "documents"))


@query(f"WITH {WORDS} SELECT * FROM words")
def line_words(spark, sf_dir):
    return synth_words(synth_lines(table(spark, sf_dir, "documents")))


@query(f"""WITH {PAIRS} SELECT a.doc_id, a.line_no AS a_line_no, round({box_sql("wa")}, 6) AS width, round({box_sql("ha")}, 6) AS height, round({box_sql("aa")}, 6) AS area, round({box_sql("ow")}, 6) AS overlap_w, round({box_sql("inter")}, 6) AS inter, round({box_sql("inter")} / {box_sql("aa")}, 6) AS share,
round(greatest(0, b.x0 - a.x1, a.x0 - b.x1), 6) AS gap_x, round(greatest(0, b.y0 - a.y1, a.y0 - b.y1), 6) AS gap_y, round({box_sql("inter")} / ({box_sql("aa")} + {box_sql("ab")} - {box_sql("inter")}), 6) AS iou, round({box_sql("inter")} / greatest(1, least({box_sql("aa")}, {box_sql("ab")})), 6) AS on_smaller, round({box_sql("oh")} / least({box_sql("ha")}, {box_sql("hb")}), 6) AS v_share, round({box_sql("ow")} / least({box_sql("wa")}, {box_sql("wb")}), 6) AS h_share, abs(a.y0 - b.y0) <= 2 AND abs(a.y1 - b.y1) <= 2 AS baseline, round((a.x0 + a.x1) / 2, 6) AS cx FROM pairs""")
def geometry_measures(spark, sf_dir):
    a, b = g.box("a_"), g.box("b_")
    out = {"width": g.width(a), "height": g.height(a), "area": g.area(a), "overlap_w": g.overlap_width(a, b), "inter": g.intersection_area(a, b), "share": g.overlap_share(a, b), "gap_x": g.horizontal_gap(a, b), "gap_y": g.vertical_gap(a, b), "iou": g.iou(a, b), "on_smaller": g.overlap_on_smaller(a, b), "v_share": g.vertical_overlap_share(a, b), "h_share": g.horizontal_overlap_share(a, b)}
    return line_pairs(spark, sf_dir).select("doc_id", "a_line_no", *[r6(v).alias(k) for k, v in out.items()], g.same_baseline(a, b).alias("baseline"), r6(g.center_x(a)).alias("cx"))


@query(f"""WITH {LINES} SELECT doc_id, line_no, CASE WHEN least(612, greatest(0, 612 - x0)) > least(612, greatest(0, 612 - x1)) THEN round(least(612, greatest(0, 612 - x1)), 6) ELSE x0 END AS mirrored_x0, round(612 - x1, 6) AS reflected_x0, greatest(0, x0 - 2) AS padded_x0, round(least(612, x1 + 2), 6) AS padded_x1, round(CASE WHEN x1 - x0 > 2 THEN x0 + 1 ELSE x0 END, 6) AS inner_x0, round(x0 * 0.5, 3) AS scaled_x0, round(greatest(1, y1 - y0 - 2), 6) AS frame_h, round(least(greatest(0, x0 + 15), greatest(0, 612 - (x1 - x0))), 6) AS moved_x0, round(greatest(x1, least(608, x1 + (x1 - x0) * 0.1)), 6) AS wide_x1, round(greatest(y1, least(788, y1 + (y1 - y0) * 0.1)), 6) AS deep_y1, CASE WHEN abs(x0 - 42) <= 3 THEN 42 WHEN abs(x0 - 61) <= 3 THEN 61 ELSE x0 END::DOUBLE AS snapped_x0 FROM lines""")
def geometry_transforms(spark, sf_dir):
    b, w, h = g.box(), F.lit(PAGE_WIDTH), F.lit(PAGE_HEIGHT)
    padded, frame = g.inflate(b, 2, 2, w, h), g.text_frame(b, F.lit(False))
    out = {"mirrored_x0": g.mirror(b, w).x0, "reflected_x0": g.mirror(b, w, clamped=False).x0, "padded_x0": padded.x0, "padded_x1": padded.x1, "inner_x0": g.inset(b, 1.0).x0, "frame_h": frame[1], "moved_x0": g.moved(b, F.lit(15.0), F.lit(0.0), w, h).x0, "wide_x1": g.widened(b, 0.1, w).x1, "deep_y1": g.deepened(b, 0.1, h).y1, "snapped_x0": g.snapped(b.x0, F.array(F.lit(42.0), F.lit(61.0)), 3.0)}
    return layout_lines(spark, sf_dir).select("doc_id", "line_no", *[r6(v).alias(k) for k, v in out.items()], g.rescale(b, F.lit(0.5), F.lit(0.5)).x0.alias("scaled_x0"))


@query(f"""WITH {PAIRS} SELECT a.doc_id, a.line_no AS a_line_no, {box_sql("oh")} / least({box_sql("ha")}, {box_sql("hb")}) >= 0.5 AS same_row, {box_sql("ow")} / least({box_sql("wa")}, {box_sql("wb")}) >= 0.45 OR abs(a.x0 - b.x0) <= 6 OR abs(a.x1 - b.x1) <= 6 OR abs(a.x0 + a.x1 - b.x0 - b.x1) / 2 <= 6 AS same_lane, least({box_sql("ha")}, {box_sql("hb")}) >= 0.78 * greatest({box_sql("ha")}, {box_sql("hb")}) AS heights, greatest(0, b.y0 - a.y1, a.y0 - b.y1) <= 2 * greatest({box_sql("ha")}, {box_sql("hb")}) AND {box_sql("ow")} / least({box_sql("wa")}, {box_sql("wb")}) >= 0.2 AS proximate, a.x0 < b.x1 AND b.x0 < a.x1 AND a.y0 < b.y1 AND b.y0 < a.y1 AS intersects, abs(a.x0 - b.x0) <= 12 AND abs(a.x1 - b.x1) <= 12 AS same_span, greatest(0, b.x0 - a.x1, a.x0 - b.x1) <= 3 AND greatest(0, b.y0 - a.y1, a.y0 - b.y1) <= 5 AS neighbours FROM pairs""")
def geometry_predicates(spark, sf_dir):
    a, b = g.box("a_"), g.box("b_")
    return line_pairs(spark, sf_dir).select("doc_id", "a_line_no", g.same_row(a, b).alias("same_row"), g.same_lane(a, b).alias("same_lane"), g.heights_fit(a, b).alias("heights"), g.proximate(a, b).alias("proximate"), g.intersects(a, b).alias("intersects"), g.same_horizontal_span(a, b).alias("same_span"), g.neighbours(a, b, 3, 5).alias("neighbours"))


@query("""WITH c AS (SELECT event_id, '#' || lower(lpad(to_hex((event_id * 7919) & 16777215), 6, '0')) AS color, value FROM events), d AS (SELECT *, ('0x' || substr(color, 2, 2))::INT / 255 AS r, ('0x' || substr(color, 4, 2))::INT / 255 AS gr, ('0x' || substr(color, 6, 2))::INT / 255 AS b FROM c)
SELECT event_id, color, round((r * 0.2126 + gr * 0.7152 + b * 0.0722)::DOUBLE, 6) AS luminance, round(sqrt(r * r + gr * gr + b * b)::DOUBLE, 6) AS from_black, round(least(48, greatest(6, value * 0.82)), 3) AS ocr_size, round(least(1, greatest(0, CASE WHEN value > 1 THEN value / 100 ELSE value END)), 6) AS ocr_confidence, CASE WHEN event_id % 3 = 2 OR event_id % 2 = 0 THEN 'bold' ELSE 'normal' END AS weight, CASE WHEN event_id % 2 = 0 THEN 90 ELSE 0 END AS rotation FROM d""")
def style_values(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "value", st.hex_color(F.col("event_id") * 7919).alias("color"))
    rgb, black, odd = st.rgb01(F.col("color")), [F.lit(0.0)] * 3, F.col("event_id") % 2
    weight = st.effective_weight(F.when(odd == 0, "bold"), (F.col("event_id") % 3).cast("int"), F.lit("auto"))
    return e.select("event_id", "color", r6(st.luminance(rgb)).alias("luminance"), r6(st.color_distance(rgb, black)).alias("from_black"), st.ocr_font_size(F.col("value")).alias("ocr_size"), r6(st.ocr_confidence(F.col("value"))).alias("ocr_confidence"), weight.alias("weight"), st.rotation(F.when(odd == 0, "vertical_ttb"), F.lit(False)).alias("rotation"))


# --- islands and order


@query(f"""WITH {WORDS}, w AS (SELECT doc_id, page_id, line_no, text, x0 + 9 * (word_no // 5) AS x0, y0, x1 + 9 * (word_no // 5) AS x1, y1 FROM words), f AS (SELECT *, CASE WHEN x0 - lag(x1) OVER q > 6 THEN 1 ELSE 0 END AS n FROM w WINDOW q AS (PARTITION BY doc_id, line_no ORDER BY x0, x1)), i AS (SELECT *, sum(n) OVER (PARTITION BY doc_id, line_no ORDER BY x0, x1 ROWS UNBOUNDED PRECEDING) AS island FROM f)
SELECT doc_id, page_id, line_no, island::BIGINT AS island, string_agg(text, ' ' ORDER BY x0, text) AS text, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, count(*) AS n_words FROM i GROUP BY ALL""")
def word_gap_groups(spark, sf_dir):
    gap = 9 * F.floor(F.col("word_no") / 5)  # a wide gap after each fifth word
    words = line_words(spark, sf_dir).withColumn("x0", F.col("x0") + gap).withColumn("x1", F.col("x1") + gap)
    return islands.word_cells(words, [*PAGE, "line_no"], 6.0)


_SPLITS = """cx AS (SELECT *, (x0 + x1) / 2 AS cx FROM lines), o AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page_id ORDER BY cx, line_no) AS k, lead(cx) OVER (PARTITION BY doc_id, page_id ORDER BY cx, line_no) AS nx, count(*) OVER (PARTITION BY doc_id, page_id) AS n FROM cx),
splits AS (SELECT doc_id, page_id, (cx + nx) / 2 AS split FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, page_id ORDER BY nx - cx DESC, k) AS q FROM o WHERE k >= 2 AND n - k >= 2 AND nx - cx >= 0.18 * 612) WHERE q = 1)"""
_ORDER = _SPLITS + """, cols AS (SELECT l.*, CASE WHEN split IS NULL OR (l.x0 + l.x1) / 2 < split THEN 0 ELSE 1 END AS col FROM lines l LEFT JOIN splits s ON l.doc_id = s.doc_id AND l.page_id = s.page_id),
ordered AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page_id ORDER BY col, y0, x0, line_no) AS ro FROM cols)"""


@query(f"WITH {LINES}, {_SPLITS} SELECT doc_id, page_id, round(split, 6) AS split FROM splits")
def two_column_split(spark, sf_dir):
    return islands.two_columns(layout_lines(spark, sf_dir), PAGE, PAGE_WIDTH).select(*PAGE, r6(F.col("split")).alias("split"))


def _ordered(spark, sf_dir):
    lines = layout_lines(spark, sf_dir)
    return islands.reading_order(islands.assign_columns(lines, islands.two_columns(lines, PAGE, PAGE_WIDTH), PAGE), PAGE)


@query(f"WITH {LINES}, {_ORDER} SELECT doc_id, page_id, line_no, col AS \"column\", ro::INT AS reading_order FROM ordered")
def reading_order(spark, sf_dir):
    return _ordered(spark, sf_dir).select(*PAGE, "line_no", "column", "reading_order")


_ROWS = _ORDER + """, rf AS (SELECT *, lag(y0) OVER w AS py0, lag(y1) OVER w AS py1, lag(x0) OVER w AS px0, lag(x1) OVER w AS px1, lag(col) OVER w AS pc FROM ordered WINDOW w AS (PARTITION BY doc_id, page_id ORDER BY ro)),
rn AS (SELECT *, sum(CASE WHEN py0 IS NOT NULL AND NOT (abs(y0 - py0) <= 2 AND abs(y1 - py1) <= 2 AND col = pc AND greatest(0, x0 - px1, px0 - x1) <= 12) THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, page_id ORDER BY ro ROWS UNBOUNDED PRECEDING) AS rw FROM rf),
rowsz AS (SELECT doc_id, page_id, rw, font_size, count(*) AS n, min(ro) AS o FROM rn GROUP BY ALL), rowstyle AS (SELECT doc_id, page_id, rw, font_size FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, page_id, rw ORDER BY n DESC, o) AS q FROM rowsz) WHERE q = 1),
rowboxes AS (SELECT r.doc_id, r.page_id, r.rw, string_agg(text, ' ' ORDER BY ro) AS text, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, min(col) AS col, count(*) AS n_lines, any_value(s.font_size) AS font_size FROM rn r JOIN rowstyle s ON r.doc_id = s.doc_id AND r.page_id = s.page_id AND r.rw = s.rw GROUP BY r.doc_id, r.page_id, r.rw)"""


@query(f"WITH {LINES}, {_ROWS} SELECT doc_id, page_id, rw::BIGINT AS \"row\", text, x0, y0, x1, y1, col AS \"column\", n_lines, font_size FROM rowboxes")
def geometry_rows(spark, sf_dir):
    rows = islands.row_boxes(islands.geometry_rows(_ordered(spark, sf_dir), PAGE), PAGE)
    return rows.select(*PAGE, "row", "text", "x0", "y0", "x1", "y1", "column", "n_lines", "font_size")


@query(f"""WITH {LINES}, {_ROWS}, pf AS (SELECT *, median(y1 - y0) OVER (PARTITION BY doc_id, page_id) AS h, lag(x0) OVER w AS px0, lag(y0) OVER w AS py0, lag(y1) OVER w AS py1, lag(col) OVER w AS pc, lag(font_size) OVER w AS pfs FROM rowboxes WINDOW w AS (PARTITION BY doc_id, page_id ORDER BY rw)),
pn AS (SELECT *, sum(CASE WHEN col <> pc OR y0 - py1 > 1.35 * h OR (abs(x0 - px0) > 0.08 * 612 AND y0 - py1 > 0.4 * h) OR font_size <> pfs OR abs(y0 - py0) <= 2 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, page_id ORDER BY rw ROWS UNBOUNDED PRECEDING) AS p FROM pf)
SELECT doc_id, page_id, (p + 1)::BIGINT AS block_no, string_agg(text, chr(10) ORDER BY rw) AS text, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, CASE WHEN median(font_size) >= 12.5 AND count(DISTINCT font_size) <= 2 THEN 'title' ELSE 'paragraph' END AS type, sum(n_lines)::BIGINT AS n_lines FROM pn GROUP BY doc_id, page_id, p""")
def paragraph_blocks(spark, sf_dir):
    rows = islands.row_boxes(islands.geometry_rows(_ordered(spark, sf_dir), PAGE), PAGE)
    return islands.paragraph_blocks(islands.paragraphs(rows, PAGE, PAGE_WIDTH), PAGE)


_EVENTS = "ev AS (SELECT user_id, (floor(epoch(ts))::BIGINT // 60)::DOUBLE AS lo, (floor(epoch(ts))::BIGINT // 60 + event_id % 600)::DOUBLE AS hi, round(value, 1) AS v, event_id % 7 + 1 AS w, event_type FROM events)"


def _events(spark, sf_dir):
    minute = F.floor(F.unix_timestamp("ts") / 60)
    return table(spark, sf_dir, "events").select("user_id", minute.cast("double").alias("lo"), (minute + F.col("event_id") % 600).cast("double").alias("hi"), F.round("value", 1).alias("v"), (F.col("event_id") % 7 + 1).alias("w"), "event_type")


@query(f"""WITH {_EVENTS}, f AS (SELECT *, max(hi) OVER (PARTITION BY user_id ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM ev), i AS (SELECT *, sum(CASE WHEN lo > reach + 3 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS island FROM f) SELECT user_id, island::BIGINT AS island, min(lo) AS lo, max(hi) AS hi, count(*) AS n FROM i GROUP BY ALL""")
def interval_merge(spark, sf_dir):
    return islands.merge_intervals(_events(spark, sf_dir), ["user_id"], "lo", "hi", 3.0)


@query(f"""WITH {_EVENTS}, d AS (SELECT DISTINCT user_id, v FROM ev), i AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY v ROWS UNBOUNDED PRECEDING) AS island FROM (SELECT *, CASE WHEN v - lag(v) OVER (PARTITION BY user_id ORDER BY v) > 3 THEN 1 ELSE 0 END AS n FROM d)) SELECT user_id, island::BIGINT AS island, round(avg(v), 6) AS mean, min(v) AS least, max(v) AS most, count(*) AS n FROM i GROUP BY ALL""")
def value_clusters(spark, sf_dir):
    return islands.cluster_values(_events(spark, sf_dir), ["user_id"], "v", 3.0).withColumn("mean", r6(F.col("mean")))


@query(f"""WITH {_EVENTS}, s AS (SELECT event_type, v, sum(w) AS w FROM ev GROUP BY ALL), r AS (SELECT *, sum(w) OVER (PARTITION BY event_type ORDER BY v ROWS UNBOUNDED PRECEDING) AS run, sum(w) OVER (PARTITION BY event_type) AS tot FROM s) SELECT event_type, min(v) AS median, max(tot)::BIGINT AS weight FROM r WHERE run * 2 >= tot GROUP BY ALL""")
def weighted_median_rollup(spark, sf_dir):
    return aggregates.weighted_median(_events(spark, sf_dir), ["event_type"], "v", "w")


@query()
def palette_top6(spark, sf_dir):
    colors = table(spark, sf_dir, "events").select(st.hex_color((F.col("event_id") % 40) * 404040).alias("color"))
    return aggregates.palette(colors)


# --- spatial joins


@query(f"""WITH {WORDS}, f AS (SELECT l.doc_id, l.page_id, l.line_no, length(w.text) % 3 AS style, greatest(0, least(l.x1, w.x1) - greatest(l.x0, w.x0)) * greatest(0, least(l.y1, w.y1) - greatest(l.y0, w.y0)) AS a, w.line_no * 10000 + w.word_no AS o FROM lines l JOIN words w ON l.doc_id = w.doc_id AND l.page_id = w.page_id), s AS (SELECT doc_id, page_id, line_no, style, sum(a) AS area, min(o) AS o FROM f WHERE a > 0 GROUP BY ALL)
SELECT doc_id, page_id, line_no, style::INT AS style, round(area, 3) AS area FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, page_id, line_no ORDER BY round(area, 6) DESC, o) AS q FROM s) WHERE q = 1""")
def style_argmax_overlap(spark, sf_dir):
    lines = layout_lines(spark, sf_dir)
    words = synth_words(lines).select(*PAGE, "x0", "y0", "x1", "y1", (F.length("text") % 3).alias("style"), (F.col("line_no") * 10000 + F.col("word_no")).alias("o"))
    best = spatial.best_by_area(lines.select(*PAGE, "line_no", "x0", "y0", "x1", "y1"), words, PAGE, "line_no", "style", "o")
    return best.withColumn("area", F.round("area", 3))


_AREAS = "areas AS (SELECT DISTINCT doc_id, page_id, 30::DOUBLE AS x0, 60::DOUBLE AS y0, 400::DOUBLE AS x1, 160::DOUBLE AS y1 FROM lines)"


def _areas(lines):
    return lines.select(*PAGE).distinct().select(*PAGE, *[F.lit(v).alias(c) for c, v in zip(("x0", "y0", "x1", "y1"), (30.0, 60.0, 400.0, 160.0), strict=True)])


@query(f"""WITH {LINES}, {_AREAS} SELECT a.doc_id, a.page_id, a.line_no FROM lines a WHERE NOT EXISTS (SELECT 1 FROM areas b WHERE a.doc_id = b.doc_id AND a.page_id = b.page_id AND {box_sql("inter")} / {box_sql("aa")} >= 0.5)""")
def line_table_antijoin(spark, sf_dir):
    lines = layout_lines(spark, sf_dir)
    return spatial.outside_of(lines, _areas(lines), PAGE).select(*PAGE, "line_no")


@query(f"""WITH {LINES}, l AS (SELECT doc_id, page_id, line_no, x0, y0, x1, y1 + 6 AS y1 FROM lines) SELECT a.doc_id, a.page_id, a.line_no AS "left", b.line_no AS "right" FROM l a JOIN l b ON a.doc_id = b.doc_id AND a.page_id = b.page_id AND a.line_no < b.line_no WHERE {box_sql("inter")} > 0.5 AND NOT (least({box_sql("ow")}, {box_sql("oh")}) < 0.75 AND {box_sql("inter")} / least({box_sql("aa")}, {box_sql("ab")}) < 0.01)""")
def bbox_collisions(spark, sf_dir):
    boxes = layout_lines(spark, sf_dir).select(*PAGE, "line_no", "x0", "y0", "x1", (F.col("y1") + 6).alias("y1"))
    return spatial.collisions(boxes, PAGE, "line_no")


@query(f"""WITH {LINES}, {_AREAS} SELECT a.doc_id, a.page_id, a.line_no, round(max({box_sql("inter")} / greatest(1, least({box_sql("aa")}, {box_sql("ab")}))), 6) AS coverage FROM lines a JOIN areas b ON a.doc_id = b.doc_id AND a.page_id = b.page_id GROUP BY ALL""")
def region_coverage(spark, sf_dir):
    lines = layout_lines(spark, sf_dir)
    return spatial.coverage(lines.select(*PAGE, "line_no", "x0", "y0", "x1", "y1"), _areas(lines), PAGE, "line_no").withColumn("coverage", r6(F.col("coverage")))


@query(f"""WITH {LINES}, e AS (SELECT doc_id, page_id, line_no AS ord, x0 + 5 AS x, y1 + 3 AS y, line_no % 3 AS mode FROM lines WHERE line_no % 2 = 0), c AS (SELECT l.doc_id, l.page_id, l.line_no, e.mode, e.ord, abs(e.y - l.y1) + 0.05 * abs(e.x - l.x0) AS d FROM lines l JOIN e ON l.doc_id = e.doc_id AND l.page_id = e.page_id WHERE abs(e.y - l.y1) <= 6)
SELECT doc_id, page_id, line_no, ord AS b_ord, mode AS b_mode FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, page_id, line_no ORDER BY round(d, 6), ord) AS q FROM c) WHERE q = 1""")
def nearest_mode_join(spark, sf_dir):
    lines = layout_lines(spark, sf_dir)
    entries = lines.filter("line_no % 2 = 0").select(*PAGE, F.col("line_no").alias("ord"), (F.col("x0") + 5).alias("x"), (F.col("y1") + 3).alias("y"), (F.col("line_no") % 3).alias("mode"))
    return spatial.nearest_entry(lines.select(*PAGE, "line_no", "x0", "y0", "x1", "y1"), entries, PAGE, "line_no", "ord").select(*PAGE, "line_no", "b_ord", "b_mode")


@query(f"""WITH {LINES}, b AS (SELECT doc_id, page_id, x1 + 10 AS pos, y0 AS lo, y1 + 4 AS hi FROM lines WHERE line_no % 3 = 0) SELECT l.doc_id, l.page_id, l.line_no, round(min(CASE WHEN b.pos >= l.x1 AND greatest(0, least(l.y1, b.hi) - greatest(l.y0, b.lo)) / (l.y1 - l.y0) >= 0.5 THEN b.pos END) - 1.5, 6) AS "limit" FROM lines l LEFT JOIN b ON l.doc_id = b.doc_id AND l.page_id = b.page_id GROUP BY ALL""")
def right_barrier_limit(spark, sf_dir):
    lines = layout_lines(spark, sf_dir).select(*PAGE, "line_no", "x0", "y0", "x1", "y1")
    rules = lines.filter("line_no % 3 = 0").select(*PAGE, (F.col("x1") + 10).alias("pos"), F.col("y0").alias("lo"), (F.col("y1") + 4).alias("hi"))
    return spatial.right_limit(lines, rules, PAGE, "line_no").withColumn("limit", r6(F.col("limit")))


@query(f"""WITH {WORDS}, p AS (SELECT doc_id, page_id, line_no * 10000 + word_no AS item, (x0 + x1) / 2 AS x, (y0 + y1) / 2 AS y FROM words), c AS (SELECT p.doc_id, p.page_id, p.item, l.line_no, (l.x1 - l.x0) * (l.y1 - l.y0) AS a FROM p JOIN lines l ON p.doc_id = l.doc_id AND p.page_id = l.page_id AND p.x BETWEEN l.x0 - 1.5 AND l.x1 + 1.5 AND p.y BETWEEN l.y0 - 1.5 AND l.y1 + 1.5) SELECT doc_id, page_id, item, line_no FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, page_id, item ORDER BY a, line_no) AS q FROM c) WHERE q = 1""")
def glyph_to_element(spark, sf_dir):
    lines = layout_lines(spark, sf_dir)
    points = synth_words(lines).select(*PAGE, (F.col("line_no") * 10000 + F.col("word_no")).alias("item"), g.center_x(g.box()).alias("x"), g.center_y(g.box()).alias("y"))
    return spatial.smallest_container(points, lines.select(*PAGE, "line_no", "x0", "y0", "x1", "y1"), PAGE, "item", "line_no")


@query(f"""WITH {LINES}, l AS (SELECT doc_id, page_id, x0, y0, x1, y1 + 6 AS y1 FROM lines), xs AS (SELECT DISTINCT doc_id, page_id, unnest([x0, x1]) AS x FROM l), s AS (SELECT *, lead(x) OVER (PARTITION BY doc_id, page_id ORDER BY x) AS nx FROM xs), c AS (SELECT s.*, l.y0, l.y1, max(l.y1) OVER (PARTITION BY s.doc_id, s.page_id, s.x ORDER BY l.y0, l.y1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM s JOIN l ON s.doc_id = l.doc_id AND s.page_id = l.page_id AND l.x0 <= s.x AND l.x1 >= s.nx WHERE nx IS NOT NULL)
SELECT doc_id, page_id, round(sum(greatest(0, y1 - greatest(y0, coalesce(reach, y0))) * (nx - x)), 3) AS area FROM c GROUP BY ALL""")
def union_area(spark, sf_dir):
    boxes = layout_lines(spark, sf_dir).select(*PAGE, "x0", "y0", "x1", (F.col("y1") + 6).alias("y1"))
    return aggregates.union_area(boxes, PAGE).withColumn("area", F.round("area", 3))


_WALLS = "walls AS (SELECT doc_id, 1 AS page_id, u.axis, u.pos, u.lo, u.hi + doc_id % 3 * 40 AS hi FROM documents, (VALUES ('h', 100.0::DOUBLE, 50.0::DOUBLE, 150.0::DOUBLE), ('h', 200.0, 50.0, 150.0), ('h', 260.0, 45.0, 95.0), ('v', 50.0, 100.0, 200.0), ('v', 100.0, 100.0, 255.0), ('v', 150.0, 100.0, 200.0)) u(axis, pos, lo, hi))"


def _walls(spark, sf_dir):
    rules = F.array(*[F.struct(F.lit(a).alias("axis"), F.lit(p).alias("pos"), F.lit(lo).alias("lo"), F.lit(hi).alias("hi")) for a, p, lo, hi in (("h", 100.0, 50.0, 150.0), ("h", 200.0, 50.0, 150.0), ("h", 260.0, 45.0, 95.0), ("v", 50.0, 100.0, 200.0), ("v", 100.0, 100.0, 255.0), ("v", 150.0, 100.0, 200.0))])
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.lit(1).alias("page_id"), F.explode(rules).alias("r")).select(*PAGE, "r.axis", "r.pos", "r.lo", (F.col("r.hi") + F.col("doc_id") % 3 * 40).alias("hi"))


@query(f"""WITH {_WALLS}, e AS (SELECT doc_id, page_id, axis, pos, lo, hi, 1 AS rl FROM walls UNION ALL SELECT doc_id, 1, u.axis, u.pos, 0, u.hi, 0 FROM documents, (VALUES ('h', 0.0::DOUBLE, 500.0::DOUBLE), ('h', 500.0, 500.0), ('v', 0.0, 500.0), ('v', 500.0, 500.0)) u(axis, pos, hi)),
c AS (SELECT a.doc_id, a.pos AS x0, t.pos AS y0, b.pos AS x1, o.pos AS y1, a.rl + b.rl + t.rl + o.rl AS walls FROM e a JOIN e b ON a.doc_id = b.doc_id AND b.axis = 'h' AND b.pos - a.pos >= 10 JOIN e t ON a.doc_id = t.doc_id AND t.axis = 'v' JOIN e o ON a.doc_id = o.doc_id AND o.axis = 'v' AND o.pos - t.pos >= 10 WHERE a.axis = 'h'
AND t.pos BETWEEN a.lo - 12 AND a.hi + 12 AND a.pos BETWEEN t.lo - 12 AND t.hi + 12 AND o.pos BETWEEN a.lo - 12 AND a.hi + 12 AND a.pos BETWEEN o.lo - 12 AND o.hi + 12 AND t.pos BETWEEN b.lo - 12 AND b.hi + 12 AND b.pos BETWEEN t.lo - 12 AND t.hi + 12 AND o.pos BETWEEN b.lo - 12 AND b.hi + 12 AND b.pos BETWEEN o.lo - 12 AND o.hi + 12)
SELECT doc_id, 1 AS page_id, x0, y0, x1, y1, max(walls)::INT AS walls FROM c WHERE walls >= 3 AND (x1 - x0) * (y1 - y0) <= 0.15 * 250000 GROUP BY ALL""")
def table_cells_from_walls(spark, sf_dir):
    pages = table(spark, sf_dir, "documents").select("doc_id", F.lit(1).alias("page_id"), F.lit(500.0).alias("width"), F.lit(500.0).alias("height"))
    return spatial.cells_from_walls(_walls(spark, sf_dir), pages, PAGE)


@query(f"""WITH {_WALLS} SELECT u.doc_id, 1 AS page_id, u.pos AS x, l.pos AS y, count(*) AS n FROM walls u JOIN walls l ON u.doc_id = l.doc_id WHERE u.axis = 'h' AND l.axis = 'v' AND l.pos BETWEEN u.lo - 3 AND u.hi + 3 AND u.pos BETWEEN l.lo - 3 AND l.hi + 3 GROUP BY ALL""")
def edge_crossings(spark, sf_dir):
    return spatial.edge_crossings(_walls(spark, sf_dir), PAGE)


# --- features, quality, sessions, fits


@query(f"""WITH {PAIRS}, q AS (SELECT a, b, len(list_filter(string_split(trim(regexp_replace(a.text, '\\s+', ' ', 'g')), ' '), lambda w: w <> '')) AS na, len(list_filter(string_split(trim(regexp_replace(b.text, '\\s+', ' ', 'g')), ' '), lambda w: w <> '')) AS nb FROM pairs)
SELECT a.doc_id, a.line_no AS a_line_no, regexp_matches(a.text, '[.!?:;]\\s*$')::INT::DOUBLE AS ends_terminal, (nb < 5)::INT::DOUBLE AS short_b, round(greatest(a.font_size, b.font_size) / least(a.font_size, b.font_size) - 1, 6) AS size_ratio, round(greatest(0, b.y0 - a.y1, a.y0 - b.y1) / greatest({box_sql("ha")}, {box_sql("hb")}), 6) AS gap, CASE WHEN {box_sql("oh")} >= 0.5 * least({box_sql("ha")}, {box_sql("hb")}) THEN round(greatest(0, b.x0 - a.x1, a.x0 - b.x1) / greatest({box_sql("wa")}, {box_sql("wb")}), 6) ELSE 0 END::DOUBLE AS side_gap, round(greatest({box_sql("wa")}, {box_sql("wb")}) / least({box_sql("wa")}, {box_sql("wb")}) - 1, 6) AS width_ratio, na::DOUBLE AS na, nb::DOUBLE AS nb, round(0.5 * (greatest({box_sql("wa")}, {box_sql("wb")}) / least({box_sql("wa")}, {box_sql("wb")}) - 1) - regexp_matches(a.text, '[.!?:;]\\s*$')::INT - 0.25, 6) AS score FROM q""")
def continuation_features_score(spark, sf_dir):
    f = line_pairs(spark, sf_dir).select("doc_id", "a_line_no", continuation.pair_features().alias("f"))
    at = lambda name: F.get("f", continuation.FEATURES.index(name))
    weights = [0.0] * len(continuation.FEATURES)
    weights[0], weights[12] = -1.0, 0.5
    return f.select("doc_id", "a_line_no", at("ends_terminal_punct").alias("ends_terminal"), at("short_b").alias("short_b"), r6(at("font_size_ratio")).alias("size_ratio"), r6(at("vertical_gap_norm")).alias("gap"), r6(at("horizontal_gap_norm")).alias("side_gap"), r6(at("bbox_width_ratio")).alias("width_ratio"), at("a_word_count").alias("na"), at("b_word_count").alias("nb"), r6(continuation.score(F.col("f"), weights, -0.25)).alias("score"))


@query("""WITH p AS (SELECT source AS document_id, doc_id % 7 = 0 AS bad, doc_id % 5 <> 0 AS ok FROM documents), r AS (SELECT document_id, count(*) AS n, sum(bad::INT) AS b, sum((NOT ok)::INT) AS s, sum(ok::INT) AS k FROM p GROUP BY ALL)
SELECT document_id, round(1 - least(1, b / n * 0.7 + s / n * 0.8)::DOUBLE, 3) AS confidence, array_to_string(list_filter([CASE WHEN b > 0 THEN 'suspicious_extraction' END, CASE WHEN s > 0 THEN 'unsupported_detected_text_pages' END], lambda x: x IS NOT NULL), ',') AS reasons, CASE WHEN b > 0 OR s > 0 OR k = 0 THEN 'ocr-grouped-mirrored' ELSE 'main' END AS recommended, CASE WHEN b > 0 OR s > 0 OR k = 0 THEN 2 + (k > 0)::INT ELSE 1 END AS planned FROM r""")
def document_quality(spark, sf_dir):
    pages = table(spark, sf_dir, "documents").select(F.col("source").alias("document_id"), F.lit(True).alias("requested"), (F.col("doc_id") % 7 == 0).alias("suspicious"), (F.col("doc_id") % 5 != 0).alias("supported"))
    return aggregates.document_quality(pages).withColumn("reasons", F.array_join("reasons", ","))


@query("SELECT o_orderkey AS id, coalesce(CASE WHEN o_orderkey % 2 = 0 THEN 'new' END, o_orderstatus) AS status, o_totalprice AS price FROM orders WHERE o_orderkey % 3 = 0")
def snapshot_upsert(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("price"))
    snapshot = o.filter("id % 3 = 0").select("id", F.when(F.col("id") % 2 == 0, "new").alias("status"), F.lit(None).cast("double").alias("price"))
    return session.merge_snapshot(o, snapshot, [], "id")


@query("SELECT coalesce(a.id, b.id) AS id, coalesce(a.price, b.price) AS price FROM (SELECT o_orderkey AS id, o_totalprice + 1 AS price FROM orders WHERE o_orderkey % 3 = 0) a FULL JOIN (SELECT o_orderkey AS id, o_totalprice AS price FROM orders WHERE o_orderkey % 2 = 0) b ON a.id = b.id")
def regions_full_outer(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("price"))
    return session.upsert_regions(o.filter("id % 2 = 0"), o.filter("id % 3 = 0").withColumn("price", F.col("price") + 1), ["id"])


@query(f"""WITH {LINES} SELECT doc_id, line_no, round(greatest(4, least(12, (x1 - x0 - 12) / {width_sql("text")}, 8 / 1)), 4) AS size, least(12, (x1 - x0 - 12) / {width_sql("text")}, 8) < 4 AS overflow FROM lines WHERE {width_sql("text")} > 0""")
def closed_form_fit(spark, sf_dir):
    unit = tx.text_width(F.col("text"))
    size, over = fitting.fit_without_wrap(unit, F.col("x1") - F.col("x0") - 12, F.col("y1") - F.col("y0") - 2, F.lit(1), F.lit(12.0))
    return layout_lines(spark, sf_dir).filter(unit > 0).select("doc_id", "line_no", F.round(size, 4).alias("size"), over.alias("overflow"))


def _elements(spark, sf_dir):
    # Lines are dealt by page before they are words: the folds that follow need no shuffle of words. A fixed number of
    # partitions, since adaptive execution would join them by the size of the lines, not of the words to be sorted.
    lines = layout_lines(spark, sf_dir).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), *PAGE)
    return synth_words(lines).select(*PAGE, F.concat_ws("_", "line_no", "word_no").alias("element_id"), "text", F.lit("").alias("split_reason"), "x0", "y0", "x1", "y1")


@query()
def horizontal_merge(spark, sf_dir):
    return folds.by_page(_elements(spark, sf_dir), PAGE, folds.horizontal_merge, "doc_id long, page_id int, element_id string, text string, x0 double, y0 double, x1 double, y1 double, merged_ids array<string>")


@query()
def table_components(spark, sf_dir):
    cells = table_cells_from_walls(spark, sf_dir)
    return folds.by_page(cells, PAGE, folds.box_components, "doc_id long, page_id int, x0 double, y0 double, x1 double, y1 double, walls int, component int")


@query()
def wrapped_font_fit(spark, sf_dir):
    blocks = layout_lines(spark, sf_dir).select(*PAGE, "line_no", "text", "x0", "y0", (F.col("x0") + 200).alias("x1"), (F.col("y0") + 60).alias("y1"), F.lit(12.0).alias("base_size"))
    return fitting.fit_blocks(blocks).select(*PAGE, "line_no", "font_size", F.size("lines").alias("n_lines"), "overflow")


@query()
def translation_ladder(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("document_id"), F.col("turn").cast("int").alias("page_id"), F.col("role").alias("block_id"), F.lit("paragraph").alias("type"), "text")
    return translate.translate_blocks(c, "en", "fr")
