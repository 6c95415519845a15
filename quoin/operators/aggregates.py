"""Roll-ups: weighted medians on several levels, palettes, union areas, page and document quality."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quoin.functions import geometry as g
from quoin.functions.style import PALETTE_DISTANCE, PALETTE_SIZE, color_distance, rgb01
from quoin.functions.text import _once
from quoin.operators.extraction import lines_from_chars

# What makes a page image a suspicious background.
BACKGROUND_SHARE, BACKGROUND_BLOCKS, BACKGROUND_TEXT = 0.8, 15, 120


def weighted_median(df: DataFrame, keys: list[str], value: str, weight: str) -> DataFrame:
    """Lower weighted median of each group: the first value at which half of the weight is reached.

    Weights are summed by value before the ordered scan, so equal values meet once.
    """
    by_value = df.filter(F.col(value).isNotNull() & (F.col(weight) > 0)).groupBy(*keys, value).agg(F.sum(weight).alias("w"))
    w = Window.partitionBy(*keys)
    run = by_value.withColumn("run", F.sum("w").over(w.orderBy(value).rowsBetween(Window.unboundedPreceding, 0))).withColumn("of", F.sum("w").over(w))
    return run.filter(F.col("run") * 2 >= F.col("of")).groupBy(*keys).agg(F.min(value).alias("median"), F.max("of").alias("weight"))


def leveled_medians(df: DataFrame, levels: list[list[str]], value: str, weight: str) -> list[DataFrame]:
    """Weighted medians of nested groups, finest first; the last level may be empty for the whole table."""
    out = []
    for keys in levels:
        rows = df if keys else df.withColumn("_all", F.lit(1))
        out.append(weighted_median(rows, keys or ["_all"], value, weight))
    return out


def with_fallback(df: DataFrame, levels: list[list[str]], medians: list[DataFrame], least: float) -> DataFrame:
    """``df`` with ``ratio``: the median of the finest level that has enough weight."""
    ratio = F.lit(None).cast("double")
    for i, (keys, m) in enumerate(zip(levels, medians, strict=True)):
        held = m.select(*(keys or ["_all"]), F.when(F.col("weight") >= least, F.col("median")).alias(f"_m{i}"))
        df = df.join(held, keys, "left") if keys else df.crossJoin(F.broadcast(held.drop("_all")))  # one row
        ratio = F.coalesce(ratio, F.col(f"_m{i}"))
    return df.withColumn("ratio", ratio).drop(*[f"_m{i}" for i in range(len(levels))])


def palette(colors: DataFrame, column: str = "color", keep: int = PALETTE_SIZE, distance: float = PALETTE_DISTANCE) -> DataFrame:
    """The commonest colours that differ: by count, then name, a colour stays if it is far from those kept before.

    Each of ``keep`` rounds takes the first that is left (one row) and drops what is near it. Colours are
    counted once, and at most 2 ** 24 of them are held for the rounds.
    """
    counts = colors.filter(F.col(column).rlike("^#[0-9A-Fa-f]{6}$")).groupBy(F.lower(column).alias("color")).count()
    rgb = rgb01(F.col("color"))
    ranked = counts.select("color", "count", *[c.alias(n) for c, n in zip(rgb, "rgb", strict=True)]).persist()
    kept, rest = [], ranked
    for _ in range(keep):
        top = rest.orderBy(F.col("count").desc(), "color").first()
        if top is None:
            break
        kept.append((top["color"], top["count"]))
        rest = rest.filter(color_distance([F.col(c) for c in "rgb"], [F.lit(top[c]) for c in "rgb"]) >= distance)
    ranked.unpersist()
    return colors.sparkSession.createDataFrame(kept, "color string, count long")


def union_area(boxes: DataFrame, keys: list[str]) -> DataFrame:
    """Area of the union of each group's boxes, by a sweep: slabs between distinct x, merged intervals of y in each."""
    xs = boxes.select(*keys, F.explode(F.array("x0", "x1")).alias("x")).distinct()
    slabs = xs.withColumn("next", F.lead("x").over(Window.partitionBy(*keys).orderBy("x"))).filter("next IS NOT NULL")
    cover = slabs.join(boxes, keys).filter((F.col("x0") <= F.col("x")) & (F.col("x1") >= F.col("next")) & (F.col("y1") > F.col("y0")))
    w = Window.partitionBy(*keys, "x").orderBy("y0", "y1")
    reach = F.max("y1").over(w.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.greatest(F.lit(0.0), F.col("y1") - F.greatest(F.col("y0"), F.coalesce(reach, F.col("y0"))))
    return cover.withColumn("a", fresh * (F.col("next") - F.col("x"))).groupBy(*keys).agg(F.sum("a").alias("area"))


def background_warning(width: Column, height: Column, image_area: Column, blocks: Column, text: Column) -> Column:
    """Struct for a page whose image covers it while it has much text; null otherwise."""
    share = image_area / F.when(width * height > 0, width * height)
    score = F.least(F.lit(1.0), share * 0.7 + F.least(F.lit(1.0), blocks / 80) * 0.2 + F.least(F.lit(1.0), text / 400) * 0.1)
    bad = (share >= BACKGROUND_SHARE) & (blocks >= BACKGROUND_BLOCKS) & (text >= BACKGROUND_TEXT)
    return F.when(bad, F.struct(F.lit(True).alias("suspicious"), F.array(F.lit("background_text_image")).alias("reasons"), F.round(score, 3).alias("score")))


def combined_warning(*warnings: Column) -> Column:
    """Distinct reasons in order and the highest score of the warnings that are there."""
    reasons = F.array_distinct(F.flatten(F.array(*[F.coalesce(w["reasons"], F.array().cast("array<string>")) for w in warnings])))
    score = F.greatest(F.lit(0.0), *[F.coalesce(w["score"], F.lit(0.0)) for w in warnings])
    return F.when(F.size(reasons) > 0, F.struct(F.lit(True).alias("suspicious"), reasons.alias("reasons"), score.alias("score")))


def document_quality(pages: DataFrame, alternatives: bool = True, mirrored: bool = True) -> DataFrame:
    """Roll-up of pages (document_id, requested, suspicious, supported) to confidence, reasons and the candidate to open."""
    n = F.sum(F.col("requested").cast("int"))
    bad, skipped = F.sum((F.col("requested") & F.col("suspicious")).cast("int")), F.sum((F.col("requested") & ~F.col("supported")).cast("int"))
    rows = pages.groupBy("document_id").agg(n.alias("n"), bad.alias("bad"), skipped.alias("skipped"), F.sum(F.col("supported").cast("int")).alias("ok"))
    of = F.when(F.col("n") > 0, F.col("n")).cast("double")
    loss = F.coalesce(F.col("bad") / of, F.lit(0.0)) * 0.7 + F.coalesce(F.col("skipped") / of, F.lit(0.0)) * 0.8
    reasons = F.filter(F.array(F.when(F.col("bad") > 0, "suspicious_extraction"), F.when(F.col("skipped") > 0, "unsupported_detected_text_pages")), lambda x: x.isNotNull())
    more = F.lit(alternatives) & ((F.size(reasons) > 0) | (F.col("ok") == 0))
    other = "ocr-grouped-mirrored" if mirrored else "ocr-grouped"
    return rows.select("document_id", F.round(1 - F.least(F.lit(1.0), loss), 3).alias("confidence"), reasons.alias("reasons"), F.when(more, other).otherwise("main").alias("recommended"), F.when(more, F.lit(1 + int(mirrored)) + F.when(F.col("ok") > 0, 1).otherwise(0)).otherwise(1).alias("planned"))


def line_glyph_widths(lines: DataFrame, keys: list[str]) -> DataFrame:
    """Of each line's ``chars``: their text, median width of visible characters, widest space, largest gap in x order. No shuffle."""
    wide = F.transform("chars", lambda x: F.struct((F.trim(x["c"]) == "").alias("s"), (x["x1"] - x["x0"]).alias("w")))
    visible = F.sort_array(F.filter(wide, lambda x: ~x["s"] & (x["w"] > 0)).getField("w"))
    half = lambda v: (F.get(v, F.floor((F.size(v) - 1) / 2).cast("int")) + F.get(v, F.floor(F.size(v) / 2).cast("int"))) / 2
    placed = F.sort_array(F.transform("chars", lambda x: F.struct(x["x0"].alias("x0"), x["ord"].alias("ord"), x["x1"].alias("x1"))))
    gap = _once(placed, lambda p: F.array_max(F.transform(p, lambda x, i: F.when(i > 0, x["x0"] - F.get(p, i - 1)["x1"]))))
    zero = F.lit(0.0)
    return lines.select(*keys, F.array_join(F.col("chars").getField("c"), "").alias("text"), F.coalesce(_once(visible, half), zero).alias("median_width"), F.coalesce(F.array_max(F.filter(wide, lambda x: x["s"]).getField("w")), zero).alias("space_width"), F.coalesce(gap, zero).alias("max_gap"))


def glyph_widths(chars: DataFrame, keys: list[str]) -> DataFrame:
    """``line_glyph_widths`` of flat characters."""
    return line_glyph_widths(lines_from_chars(chars, keys), keys)


def tightness(metrics: DataFrame) -> DataFrame:
    """empty, tight or non-tight from text and glyph widths."""
    wide = F.col("text").rlike(r"\s{3,}") | (F.col("max_gap") >= F.greatest(F.lit(12.0), 2.5 * F.col("median_width"))) | (F.col("space_width") >= F.greatest(F.lit(10.0), 2.25 * F.col("median_width")))
    return metrics.withColumn("tightness", F.when(F.trim("text") == "", "empty").when(wide, "non-tight").otherwise("tight"))


def mean_color(pixels: pd.DataFrame) -> str:
    """Mean of r, g, b rows as #rrggbb."""
    r, gr, b = (int(round(v)) for v in pixels[["r", "g", "b"]].mean())
    return f"#{r:02x}{gr:02x}{b:02x}"


def covered_share(boxes: DataFrame, keys: list[str]) -> DataFrame:
    """Share of a target box (columns t_) that the union of a group's boxes covers."""
    clipped = boxes.select(*keys, F.greatest("x0", "t_x0").alias("x0"), F.greatest("y0", "t_y0").alias("y0"), F.least("x1", "t_x1").alias("x1"), F.least("y1", "t_y1").alias("y1"), ((F.col("t_x1") - F.col("t_x0")) * (F.col("t_y1") - F.col("t_y0"))).alias("of")).filter("x1 > x0 AND y1 > y0")
    sizes = clipped.groupBy(*keys).agg(F.max("of").alias("of"))
    return union_area(clipped, keys).join(sizes, keys).select(*keys, (F.col("area") / F.col("of")).alias("share"))
