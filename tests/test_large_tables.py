"""Queries that must not shuffle characters or words, and folds whose cost must not grow with the square of a line."""

import time

import pytest
from pyspark.sql import functions as F

from quoin.operators import aggregates, extraction, folds
from quoin.plans import catalog, pages  # noqa: F401

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize(("name", "most"), [("char_spans", 0), ("char_words", 0), ("text_tightness", 0), ("horizontal_merge", 1)])
def test_shuffles(spark, name, most):
    plan = catalog.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == most


def test_horizontal_merge_of_a_long_line():
    rows = [{"element_id": str(i), "text": "word", "x0": 20.0 * i, "x1": 20.0 * i + 17, "y0": 0.0, "y1": 10.0} for i in range(20000)]
    start = time.process_time()
    (one,) = folds.horizontal_merge(rows)
    assert time.process_time() - start < 10
    assert one["text"] == " ".join(["word"] * 20000)
    assert one["merged_ids"] == [str(i) for i in range(20000)]
    assert (one["x0"], one["x1"]) == (0.0, 399997.0)


def test_flat_characters(spark):
    text = " ab אב1c  d"
    rows = [(1, i, c, i < 3, 10.0 * i, 0.0, 10.0 * i + (30.0 if c == "d" else 10.0), 9.0) for i, c in enumerate(text)]
    chars = spark.createDataFrame(rows[::-1], "line_no int, ord int, c string, bold boolean, x0 double, y0 double, x1 double, y1 double")
    words = extraction.words_from_chars(chars, ["line_no"]).orderBy("word_no").collect()
    assert [(r["word_no"], r["text"], r["x0"], r["x1"]) for r in words] == [(0, "ab", 10.0, 30.0), (1, "אב1", 40.0, 70.0), (2, "c", 70.0, 80.0), (3, "d", 100.0, 130.0)]
    spans = extraction.spans_from_chars(chars, ["line_no"], ["bold"]).orderBy("span_no").collect()
    assert [(r["span_no"], r["bold"], r["text"], r["x0"], r["x1"]) for r in spans] == [(0, True, text[:3], 0.0, 30.0), (1, False, text[3:], 30.0, 130.0)]
    widths = aggregates.glyph_widths(chars.withColumn("x0", F.col("x0") + F.when(F.col("ord") > 5, 7.0).otherwise(0.0)), ["line_no"]).first()
    assert (widths["text"], widths["median_width"], widths["space_width"], widths["max_gap"]) == (text, 10.0, 10.0, 7.0)
