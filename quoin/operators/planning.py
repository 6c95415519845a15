"""Candidate plans, notices, draw operations and the history of edits."""

from __future__ import annotations

from collections import deque
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Candidates in their order, phases of a run and their stages, and how far edits can be undone.
CANDIDATES = (("main", "detected-text", True), ("ocr-grouped", "ocr", False), ("ocr-grouped-mirrored", "ocr", True))
STAGES = {"receive_upload": "reading", "build_manifest": "reading", "extract_layouts": "reading", "prepare_web_layouts": "reading", "download_language_pack": "preparing", "translate_pages": "translating", "fit_pages": "finishing", "render_outputs": "finishing", "create_working_session": "finishing"}
SKIPPED = ("Skipped page {} because it looks scanned or image-only.", "Skipped pages {} because they look scanned or image-only.")
UNSUPPORTED = ("Page {} looks like a scanned or image-only page, so it cannot open in this text-based editor yet. Try a different method.", "Pages {} look like scanned or image-only pages, so they cannot open in this text-based editor yet. Try a different method.")
UNDO_DEPTH = 50


def candidate_configs(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, *c) for i, c in enumerate(CANDIDATES)], "ord int, candidate_id string, source string, mirrored boolean")


def planned_candidates(quality: DataFrame, configs: DataFrame, mirrored: bool = True) -> DataFrame:
    """Ordered candidates of each document: main unless nothing supports it, the others if alternatives are asked for."""
    wants = (F.col("candidate_id") == "main") & F.col("main_supported") | (F.col("candidate_id") != "main") & F.col("alternatives") & (F.lit(mirrored) | ~F.col("mirrored")) | (F.col("candidate_id") == "main") & ~F.col("alternatives")
    flat = quality.select("document_id", "alternatives", "main_supported", F.explode(F.array(*[F.lit(i) for i in range(len(CANDIDATES))])).alias("ord"))
    return flat.join(F.broadcast(configs), "ord").filter(wants).select("document_id", F.row_number().over(Window.partitionBy("document_id").orderBy("ord")).alias("place"), "candidate_id")


def run_decision(planned: DataFrame) -> DataFrame:
    n = F.count(F.lit(1))
    return planned.groupBy("document_id").agg(F.when(n == 1, "direct-open").otherwise("choose").alias("decision"), F.min_by("candidate_id", "place").alias("first"))


def stage_of(phase: Column) -> Column:
    """The stage that users see; the first one for unknown phases."""
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in STAGES.items() for x in kv]), phase), F.lit("reading"))


def page_list(pages: DataFrame) -> DataFrame:
    """Distinct positive pages of each document in order, their number and as text; a document without any has none."""
    found = F.collect_set(F.when(F.col("page_id") > 0, F.col("page_id")))
    return pages.groupBy("document_id").agg(F.array_join(F.array_sort(found), ", ").alias("pages"), F.size(found).alias("n"))


def _worded(sentences: tuple[str, str]) -> Column:
    one, many = (s.split("{}") for s in sentences)
    return F.when(F.col("n") == 1, F.concat(F.lit(one[0]), "pages", F.lit(one[1]))).otherwise(F.concat(F.lit(many[0]), "pages", F.lit(many[1])))


def skipped_notice(pages: DataFrame) -> DataFrame:
    """Notice of the pages that were left out, empty if there are none."""
    return page_list(pages).select("document_id", F.when(F.col("n") == 0, "").otherwise(_worded(SKIPPED)).alias("notice"))


def unsupported_message(pages: DataFrame) -> DataFrame:
    """Message of the pages that cannot be opened."""
    return page_list(pages).select("document_id", _worded(UNSUPPORTED).alias("message"))


def warning_summary(pages: DataFrame) -> DataFrame:
    """Message per reason and document with the pages concerned."""
    rows = pages.select("document_id", "page_id", F.explode("warning.reasons").alias("reason"))
    return rows.groupBy("document_id", "reason").agg(F.count_distinct("page_id").alias("n"), F.concat(F.col("reason"), F.lit(" on pages "), F.array_join(F.array_sort(F.collect_set("page_id")), ", ")).alias("message"))


def needs_textless_ocr(page_type: Column, corrupted: Column) -> Column:
    return page_type.isin("DIGITAL", "MIXED") & ~corrupted


def needs_background(page_type: Column) -> Column:
    return page_type.isin("SCANNED", "MIXED")


def table_draw_ops(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Fill operations of enabled cells, then stroke operations of their borders, in order of drawing."""
    fills = cells.filter("fill_enabled").select(*keys, F.lit(0).alias("layer"), F.lit("fill").alias("op"), "x0", "y0", "x1", "y1", F.col("fill").alias("color"))
    strokes = cells.select(*keys, F.lit(1).alias("layer"), F.lit("stroke").alias("op"), "x0", "y0", "x1", "y1", F.col("border").alias("color"))
    return fills.unionByName(strokes)


def justified_runs(lines: DataFrame, keys: list[str]) -> DataFrame:
    """A run per word of a justified line at its own x: running widths and gaps."""
    from quoin.functions.text import text_width, words
    from quoin.operators.islands import running_offsets

    rows = lines.select(*keys, "x0", "size", "gap", F.posexplode(words(F.col("text"))).alias("word_no", "word")).withColumn("w", text_width(F.col("word"), F.col("size")))
    return running_offsets(rows, keys, "word_no", "w", F.col("gap")).select(*keys, "word_no", "word", F.round(F.col("x0") + F.col("offset"), 4).alias("x_pt"))


def fills_and_runs(blocks: DataFrame, keys: list[str]) -> DataFrame:
    """Draw operations of translated blocks: a background where one is set, and a run per non-empty line."""
    back = blocks.filter("background IS NOT NULL").select(*keys, F.lit("background").alias("op"), F.lit(-1).alias("line_no"), F.col("background").alias("value"))
    runs = blocks.select(*keys, F.posexplode("lines").alias("line_no", "value")).filter("value <> ''").select(*keys, F.lit("run").alias("op"), "line_no", "value")
    return back.unionByName(runs)


def region_edits(regions: DataFrame, edits: DataFrame, keys: list[str]) -> DataFrame:
    """Regions after their last edit: moved by dx, dy and flipped where asked."""
    last = edits.groupBy(*keys).agg(F.max_by(F.struct("dx", "dy", "flip"), "ord").alias("e"))
    j = regions.join(last, keys, "left")
    dx, dy = F.coalesce("e.dx", F.lit(0.0)), F.coalesce("e.dy", F.lit(0.0))
    return j.select(*keys, (F.col("x0") + dx).alias("x0"), (F.col("y0") + dy).alias("y0"), (F.col("x1") + dx).alias("x1"), (F.col("y1") + dy).alias("y1"), F.coalesce("e.flip", F.lit(False)).alias("flipped"))


def request_log(events: DataFrame) -> DataFrame:
    """Latest state of each request: started rows updated by their success or failure."""
    return events.groupBy("request_id").agg(F.max_by("status", "ts").alias("status"), F.max_by("detail", "ts").alias("detail"), (F.max("ts").cast("timestamp").cast("double") - F.min("ts").cast("timestamp").cast("double")).alias("seconds"))


class UndoStack:
    """States of one page that can be gone back and forth through, the oldest dropped beyond a depth."""

    def __init__(self, depth: int = UNDO_DEPTH):
        self.past: deque[Any] = deque(maxlen=depth)
        self.future: list[Any] = []

    def push(self, state: Any) -> None:
        self.past.append(state)
        self.future.clear()

    def undo(self, now: Any) -> Any:
        if not self.past:
            return now
        self.future.append(now)
        return self.past.pop()

    def redo(self, now: Any) -> Any:
        if not self.future:
            return now
        self.past.append(now)
        return self.future.pop()
