"""Table reconstruction: rows from cells, outlier rows, spanning cells, key/value blocks, OCR groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quoin.functions import geometry as g
from quoin.operators.extraction import ordered_text
from quoin.operators.islands import gap_islands, islands

# Outlier rows, spanning cells, OCR gaps.
OUTLIER_HEIGHT, OUTLIER_FACTOR, OUTLIER_SHARE = 24.0, 2.5, 0.6
SPAN_FACTOR, SPAN_LINES, SPAN_SHARE, SPAN_SMALLER = 1.8, 2, 0.85, 0.95
OCR_CHAR, OCR_HEIGHT, OCR_LEAST, OCR_MOST = 2.5, 0.35, 4.0, 14.0


def table_rows(cells: DataFrame, keys: list[str], digits: int = 2) -> DataFrame:
    """Cells with row and column ordinals from distinct starts, as a table's grid."""
    y, x = F.round("y0", digits), F.round("x0", digits)
    return cells.withColumn("row", F.dense_rank().over(Window.partitionBy(*keys).orderBy(y)) - 1).withColumn("col", F.dense_rank().over(Window.partitionBy(*keys).orderBy(x)) - 1)


def pivot_rows(cells: DataFrame, keys: list[str], columns: int) -> DataFrame:
    """One row per table row with a text column per table column, null where a cell is missing."""
    grid = table_rows(cells, keys)
    return grid.groupBy(*keys, "row").agg(*[F.max(F.when(F.col("col") == i, F.col("text"))).alias(f"c{i}") for i in range(columns)])


def outlier_row(height: Column, median: Column, filled: Column, cells: Column) -> Column:
    return (height >= F.greatest(F.lit(OUTLIER_HEIGHT), OUTLIER_FACTOR * median)) & (filled > 0) & (filled <= F.greatest(F.lit(3.0), F.round(OUTLIER_SHARE * cells)))


def trim_outlier_rows(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows (row, height, filled, cells) without outliers at the top and bottom; inner ones stay, and never all go."""
    w = Window.partitionBy(*keys)
    marked = rows.withColumn("_o", outlier_row(F.col("height"), F.median("height").over(w), F.col("filled"), F.col("cells")))
    first, last = F.min(F.when(~F.col("_o"), F.col("row"))).over(w), F.max(F.when(~F.col("_o"), F.col("row"))).over(w)
    return marked.withColumn("_a", first).withColumn("_b", last).filter(F.col("_a").isNull() | F.col("row").between(F.col("_a"), F.col("_b"))).drop("_o", "_a", "_b")


def prune_spanning(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Cells without those that span others: tall, of several lines, and covering two smaller ones."""
    height = F.col("y1") - F.col("y0")
    tall = cells.withColumn("_m", F.median(height).over(Window.partitionBy(*keys)))
    big = tall.filter((height >= SPAN_FACTOR * F.col("_m")) & (F.size(F.split("text", "\n")) > SPAN_LINES))
    a = big.select(*keys, *[F.col(c).alias(f"a_{c}") for c in ("cell_id", "x0", "y0", "x1", "y1")])
    b = cells.select(*keys, *[F.col(c).alias(f"b_{c}") for c in ("cell_id", "x0", "y0", "x1", "y1")])
    inner = (g.overlap_share(g.box("b_"), g.box("a_")) >= SPAN_SHARE) & (g.area(g.box("b_")) < SPAN_SMALLER * g.area(g.box("a_"))) & (F.col("a_cell_id") != F.col("b_cell_id"))
    gone = a.join(b, keys).filter(inner).groupBy(*keys, F.col("a_cell_id").alias("cell_id")).count().filter("count >= 2")
    return cells.join(gone.select(*keys, "cell_id"), [*keys, "cell_id"], "left_anti")


def smallest_cells(points: DataFrame, keys: list[str]) -> DataFrame:
    """Cells between crossings: for each point the next below and the next to the right, where the fourth corner exists."""
    right = F.lead("x").over(Window.partitionBy(*keys, "y").orderBy("x"))
    below = F.lead("y").over(Window.partitionBy(*keys, "x").orderBy("y"))
    open_ = points.select(*keys, "x", "y", right.alias("x1"), below.alias("y1")).filter("x1 IS NOT NULL AND y1 IS NOT NULL")
    corner = points.select(*keys, F.col("x").alias("x1"), F.col("y").alias("y1"))
    return open_.join(corner, [*keys, "x1", "y1"], "left_semi").select(*keys, F.col("x").alias("x0"), F.col("y").alias("y0"), "x1", "y1")


def box_edges(boxes: DataFrame, keys: list[str]) -> DataFrame:
    """The four sides of each box as rules: an unpivot by one explode."""
    sides = F.array(*[F.struct(F.lit(a).alias("axis"), F.col(p).alias("pos"), F.col(lo).alias("lo"), F.col(hi).alias("hi")) for a, p, lo, hi in (("h", "x0", "y0", "y1"), ("h", "x1", "y0", "y1"), ("v", "y0", "x0", "x1"), ("v", "y1", "x0", "x1"))])
    return boxes.select(*keys, F.explode(sides).alias("e")).select(*keys, "e.*")


def word_rules(words: DataFrame, keys: list[str], least: int = 3) -> DataFrame:
    """Level rules above and below the rows of words that have ``least`` words, over the page's whole extent of such rows."""
    rows = words.groupBy(*keys, F.round("y0", 1).alias("top")).agg(F.count(F.lit(1)).alias("n"), F.min("x0").alias("lo"), F.max("x1").alias("hi"), F.max("y1").alias("bottom")).filter(F.col("n") >= least)
    w = Window.partitionBy(*keys)
    wide = rows.select(*keys, F.min("lo").over(w).alias("lo"), F.max("hi").over(w).alias("hi"), F.explode(F.array("top", "bottom")).alias("pos"))
    return wide.select(*keys, F.lit("v").alias("axis"), "pos", "lo", "hi").distinct()


def key_values(words: DataFrame, keys: list[str], page_width: float) -> DataFrame:
    """Lines of at least four words with one colon and a wide gap, as key and value."""
    marked = gap_islands(words, keys, "x0", "x1", F.lit(0.04 * page_width))
    lines = marked.groupBy(*keys).agg(F.max("island").alias("gaps"), F.count(F.lit(1)).alias("n"), ordered_text("x0", "text", " ").alias("text"))
    parts = F.split("text", r"\s*:\s*")
    return lines.filter((F.col("n") >= 4) & (F.col("gaps") >= 1) & (F.size(parts) == 2)).select(*keys, F.get(parts, 0).alias("key"), F.get(parts, 1).alias("value"))


def ocr_groups(words: DataFrame, keys: list[str]) -> DataFrame:
    """OCR words of a line in groups by gap, clamped between 4 and 14 pixels: text, box and mean confidence."""
    p = Window.partitionBy(*keys)
    char = F.median((F.col("x1") - F.col("x0")) / F.greatest(F.lit(1), F.length("text"))).over(p)
    limit = g.clamp(F.greatest(OCR_CHAR * char, OCR_HEIGHT * F.median(F.col("y1") - F.col("y0")).over(p)), OCR_LEAST, OCR_MOST)
    rows = words.withColumn("_limit", limit)
    rows = islands(rows.withColumn("_gap", F.col("x0") - F.lag("x1").over(p.orderBy("x0"))), keys, [F.col("x0")], F.col("_gap") > F.col("_limit"), "grp")
    return rows.groupBy(*keys, "grp").agg(ordered_text("x0", "text", " ").alias("text"), *g.union_over(), F.avg("confidence").alias("confidence"))


def fill_bands(drawings: DataFrame, keys: list[str], page_width: float) -> DataFrame:
    """Bands of filled rectangles: wide and low fills whose tops lie within 1.5 points, as one box each."""
    wide = drawings.filter((F.col("x1") - F.col("x0") >= 0.3 * page_width) & (F.col("y1") - F.col("y0")).between(6, 60))
    w = Window.partitionBy(*keys).orderBy("y0", "x0")
    runs = islands(wide.withColumn("_new", F.col("y0") - F.lag("y0").over(w) > 1.5), keys, [F.col("y0"), F.col("x0")], F.col("_new"), "band")
    return runs.groupBy(*keys, "band").agg(*g.union_over(), F.count(F.lit(1)).alias("n"))
