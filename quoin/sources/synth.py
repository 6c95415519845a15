"""Deterministic layout rows from plain documents, for queries over tables without boxes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quoin.functions.text import SPACE, text_width, words

LINES_PER_PAGE, TOP, PITCH, LINE_HEIGHT, LEFT = 50, 40, 14, 10, 40


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def synth_lines(docs: DataFrame) -> DataFrame:
    """Lines of documents as boxes: doc_id, page_id, line_no, text, font_size, box. Blank lines go; no shuffle."""
    lines = F.filter(F.split("text", "\n"), lambda t: F.trim(t) != "")
    rows = docs.select("doc_id", F.posexplode(lines).alias("i", "text"))
    x0 = F.lit(float(LEFT)) + 20.0 * (F.col("doc_id") % 3) + F.when((F.col("doc_id") % 5 == 0) & (F.col("i") % 2 == 1), 300.0).otherwise(0.0)
    y0 = F.lit(float(TOP)) + PITCH * (F.col("i") % LINES_PER_PAGE)
    page = F.floor(F.col("i") / LINES_PER_PAGE).cast("int") + 1
    return rows.select("doc_id", page.alias("page_id"), F.col("i").alias("line_no"), "text", F.when(F.col("i") == 0, 14.0).otherwise(10.0).alias("font_size"), x0.alias("x0"), y0.cast("double").alias("y0"), F.round(x0 + text_width(F.col("text"), 10.0), 4).alias("x1"), (y0 + LINE_HEIGHT).cast("double").alias("y1"))


def synth_words(lines: DataFrame) -> DataFrame:
    """Words of lines with boxes: each begins where the text before it ends, by a running sum over the line."""
    w = lines.select("doc_id", "page_id", "line_no", F.col("x0").alias("lx"), "y0", "y1", F.posexplode(words(F.col("text"))).alias("word_no", "text"))
    w = w.withColumn("_w", text_width(F.col("text"), 10.0))
    before = Window.partitionBy("doc_id", "page_id", "line_no").orderBy("word_no").rowsBetween(Window.unboundedPreceding, -1)
    lead = F.coalesce(F.sum(F.col("_w") + 10.0 * SPACE).over(before), F.lit(0.0))
    w = w.withColumn("_x", F.col("lx") + lead)
    return w.select("doc_id", "page_id", "line_no", "word_no", "text", F.round("_x", 4).alias("x0"), "y0", F.round(F.col("_x") + F.col("_w"), 4).alias("x1"), "y1")
