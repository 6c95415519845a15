"""Literal rows for branches that the tables never reach."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quoin.functions import bidi, style, text, translation
from quoin.functions import geometry as g
from quoin.operators import aggregates, continuation, fitting, folds, islands, raster, session, spatial


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "t string").select(column(F.col("t")).alias("v")).first()["v"]


@pytest.mark.parametrize(("t", "code", "confidence", "reason"), [("", "en", 0, "empty_text"), ("שלום עולם", "he", 0.8, "hebrew_script"), ("le la et un", "fr", 1, "fr_lexical"), ("der die und", "de", 1, "de_lexical"), ("xfür éle le", "fr", 1, "fr_lexical"), ("12345", "en", 0.35, "latin_fallback")])
def test_language(spark, t, code, confidence, reason):
    got = one(spark, t, text.language)
    assert (got["code"], got["reason"]) == (code, reason)
    assert got["confidence"] == pytest.approx(confidence)


def test_direction_ties(spark):
    assert one(spark, "אa", lambda t: text.direction(t, ("RTL", "LTR", "UNKNOWN"))) == "RTL"
    assert one(spark, "אa", lambda t: text.direction(t, tie="ltr")) == "ltr"
    assert one(spark, "12", lambda t: text.direction(t)) == "neutral"


def test_warning_and_width(spark):
    got = one(spark, "ab � cd", text.extraction_warning)
    assert got["reasons"] == ["replacement_chars"]
    assert got["score"] == pytest.approx(0.41)
    assert one(spark, "plain text", text.extraction_warning) is None
    assert one(spark, "Wil 1.", lambda t: text.text_width(t, 10.0)) == pytest.approx(25.6)
    assert fitting.line_width("Wil 1.", 10) == pytest.approx(25.6)


def test_translation_issues(spark):
    rows = spark.createDataFrame([("Pay 120 (net) by 01/02/2024", "Pay by 2024"), ("שלום", "שלום")], "s string, t string")
    got = [r[0] for r in rows.select(translation.issues(F.col("s"), F.col("t"), F.lit("en"))).collect()]
    assert got[0] == ["length_ratio_extreme", "missing_numbers", "altered_dates", "missing_parentheses"]
    assert got[1] == ["unchanged_source_text"]
    assert one(spark, "₪ 1,200", translation.shekel_amount) == "NIS 1,200"
    kept = rows.limit(1).select(translation.source_dates_kept(F.lit("on 01/02/2024"), F.lit("am 02.01.2024 und 3.3.2025")))
    assert kept.first()[0] == "am 01/02/2024 und 3.3.2025"


def test_geometry(spark):
    df = spark.createDataFrame([(10.0, 0.0, 30.0, 5.0)], "x0 double, y0 double, x1 double, y1 double")
    m = g.mirror(g.box(), F.lit(100.0))
    assert tuple(df.select(*m).first()) == (70, 0, 90, 5)
    assert tuple(df.select(*g.mirror(m, F.lit(100.0))).first()) == (10, 0, 30, 5)
    boxes = spark.createDataFrame([(1, "a", 0.0, 0.0, 10.0, 10.0), (1, "b", 9.0, 9.0, 20.0, 20.0), (1, "c", 10.0, 0.0, 20.0, 10.0)], "p int, id string, x0 double, y0 double, x1 double, y1 double")
    assert {(r["left"], r["right"]) for r in spatial.collisions(boxes, ["p"], "id").collect()} == {("a", "b"), ("b", "c")}
    two = spark.createDataFrame([(1, 0.0, 0.0, 10.0, 10.0), (1, 5.0, 5.0, 15.0, 15.0)], "p int, x0 double, y0 double, x1 double, y1 double")
    assert aggregates.union_area(two, ["p"]).first()["area"] == 175


def test_islands(spark):
    v = spark.createDataFrame([(1, float(x)) for x in (1, 3, 6, 20)], "k int, v double")
    assert sorted((r["least"], r["most"]) for r in islands.cluster_values(v, ["k"], "v", 3.0).collect()) == [(1, 6), (20, 20)]
    s = spark.createDataFrame([(1, 0.0, 10.0), (1, 12.0, 20.0), (1, 30.0, 40.0)], "k int, lo double, hi double")
    assert sorted((r["lo"], r["hi"]) for r in islands.merge_intervals(s, ["k"], tolerance=3.0).collect()) == [(0, 20), (30, 40)]
    lines = spark.createDataFrame([(1, i, c, 0.0, c, 1.0) for i, c in enumerate((10.0, 12.0, 110.0, 112.0))], "k int, line_no int, x0 double, y0 double, x1 double, y1 double")
    assert islands.two_columns(lines, ["k"], 200.0).first()["split"] == 61
    assert islands.two_columns(lines.filter("line_no < 3"), ["k"], 200.0).count() == 0


def test_weighted_median(spark):
    rows = spark.createDataFrame([(1, 0.8, 1), (1, 1.0, 2), (1, 1.2, 1), (2, 0.8, 2), (2, 1.2, 2)], "k int, v double, w int")
    assert {r["k"]: r["median"] for r in aggregates.weighted_median(rows, ["k"], "v", "w").collect()} == {1: 1.0, 2: 0.8}
    levels = [["k"], []]
    got = aggregates.with_fallback(rows, levels, aggregates.leveled_medians(rows, levels, "v", "w"), 4)
    assert {r["k"]: r["ratio"] for r in got.collect()} == {1: 1.0, 2: 0.8}


def test_nearest_mode(spark):
    item = spark.createDataFrame([(1, 1, 0.0, 0.0, 50.0, 20.0)], "p int, id int, x0 double, y0 double, x1 double, y1 double")
    entries = spark.createDataFrame([(1, 0, 0.0, 22.0, 2), (1, 1, 40.0, 20.0, 1), (1, 2, 0.0, 30.0, 3)], "p int, ord int, x double, y double, mode int")
    assert spatial.nearest_entry(item, entries, ["p"], "id", "ord").first()["b_mode"] == 2


def test_palette(spark):
    df = spark.createDataFrame([("#122333",), ("#132434",), ("#ff0000",), ("bad",)], "color string")
    assert {r["color"] for r in aggregates.palette(df).collect()} == {"#122333", "#ff0000"}
    assert style.PALETTE_SIZE == 6


def test_cells_from_walls(spark):
    pages = spark.createDataFrame([(1, 500.0, 500.0)], "p int, width double, height double")

    def cells(*rules):
        edges = spark.createDataFrame([(1, *r) for r in rules], "p int, axis string, pos double, lo double, hi double")
        return [tuple(r)[1:] for r in spatial.cells_from_walls(edges, pages, ["p"]).collect()]

    up = [("h", 100.0, 50.0, 150.0), ("h", 200.0, 50.0, 150.0)]
    assert cells(*up, ("v", 50.0, 100.0, 200.0), ("v", 150.0, 100.0, 200.0)) == [(100, 50, 200, 150, 4)]
    assert cells(up[1], ("v", 50.0, 0.0, 200.0), ("v", 150.0, 0.0, 200.0)) == [(0, 50, 200, 150, 3)]
    assert cells(up[1], ("v", 50.0, 50.0, 200.0), ("v", 150.0, 50.0, 200.0)) == []


def test_horizontal_merge():
    def row(i, t, x0, y0, x1, y1, why=""):
        return {"element_id": i, "text": t, "x0": x0, "y0": y0, "x1": x1, "y1": y1, "split_reason": why}

    got = folds.horizontal_merge([row("a", "Bank", 10, 10, 34, 20), row("b", "Account", 36, 10.2, 72, 20.1)])
    assert [(r["text"], r["x0"], r["y0"], r["x1"], r["y1"], r["merged_ids"]) for r in got] == [("Bank Account", 10, 10, 72, 20.1, ["a", "b"])]
    assert len(folds.horizontal_merge([row("a", "Bank", 10, 10, 34, 20, "large-visual-gap"), row("b", "Account", 36, 10.2, 72, 20.1)])) == 2


def test_suppression_and_components():
    box = lambda x, s: {"x0": x, "y0": 0, "x1": x + 10, "y1": 10, "score": s, "walls": 4}
    assert [r["score"] for r in folds.suppress([box(0, 0.5), box(2, 0.9), box(30, 0.1)])] == [0.9, 0.1]
    assert [r["component"] for r in folds.box_components([box(0, 1), box(12, 1), box(60, 1)])] == [0, 0, 2]
    assert len(folds.distinct_cells([box(0, 1), box(3, 1), box(60, 1)])) == 2
    assert [(r["row"], r["col"]) for r in folds.table_grid([box(0, 1), box(10, 1)])] == [(0, 0), (0, 1)]


def test_quality(spark):
    rows = [("d", i, True, i == 2, i != 4) for i in (1, 2, 3, 4)]
    got = aggregates.document_quality(spark.createDataFrame(rows, "document_id string, page int, requested boolean, suspicious boolean, supported boolean")).first()
    assert (got["confidence"], got["reasons"], got["recommended"], got["planned"]) == (0.625, ["suspicious_extraction", "unsupported_detected_text_pages"], "ocr-grouped-mirrored", 3)


def test_scorer_and_training(spark):
    df = spark.createDataFrame([([1.0, 0.0, 2.0],)], "x array<double>")
    assert df.select(continuation.score(F.col("x"), [0.5, -1.0, 0.25], -0.5)).first()[0] == pytest.approx(0.5)
    rng = np.random.default_rng(1)
    rows = [([float(a), float(b)], int(a > b)) for a, b in rng.normal(0, 1, (80, 2))]
    w, b = continuation.train_logistic(spark.createDataFrame(rows, "x array<double>, y int"), "x", "y", steps=25, rate=2.0)
    assert np.mean([(np.dot(x, w) + b > 0) == bool(y) for x, y in rows]) > 0.9


def test_fit():
    spark_free = fitting.wrapped_fit("word " * 6, 100, 20, 12, 4)
    assert spark_free[0] < 12
    assert not spark_free[2]
    assert fitting.truncated("abcdefgh", 20, 10).endswith("...")
    assert fitting.wrapped("aa bb", 11, 10) == ["a", "a", "b", "b"] or fitting.wrapped("aa bb", 12, 10)


def test_closed_form_fit(spark):
    df = spark.createDataFrame([(10.0,), (30.0,)], "u double")
    size, over = fitting.fit_without_wrap(F.col("u"), F.lit(100.0), F.lit(20.0), F.lit(1), F.lit(12.0))
    assert [tuple(r) for r in df.select(size, over).collect()] == [(10.0, False), (4.0, True)]


def test_raster():
    page = np.full((100, 200), 255, np.uint8)
    page[50:52, 20:180] = 0
    page[10:90, 100] = 0
    assert {(a, p) for a, p, _, _ in raster.find_rules(page)} == {("v", 51.0), ("h", 100.5)}
    blob = np.zeros((20, 20), bool)
    blob[2:5, 2:5] = blob[10:12, 10:15] = True
    assert sorted(c[4] for c in raster.pixel_components(blob)) == [9, 10]
    table = raster.summed_area(page.astype(float))
    assert raster.rectangle_mean(table, 0, 0, 10, 10) == 255


def test_session(spark):
    blocks = spark.createDataFrame([(1, "g1"), (1, "g2")], "page_id int, group_id string")
    taken = spark.createDataFrame([(1, "p1_m3")], "page_id int, block_id string")
    assert sorted(r["block_id"] for r in session.next_ids(blocks, taken).collect()) == ["p1_m4", "p1_m5"]
    with pytest.raises(Exception, match="page ids"):
        session.require(blocks, F.col("page_id") > 1, "page ids must be over 1").count()


def test_stream(spark, tmp_path):
    from quoin.streaming.warnings import watch_documents

    spark.createDataFrame([(1, "der die und", "de", "s", 11)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "in"))
    q = watch_documents(spark, str(tmp_path / "in")).writeStream.format("memory").queryName("seen").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.sql("SELECT code FROM seen").first()["code"] == "de"


def _line(spark, *tokens):
    """Characters of tokens that stand from the left at the given x, in the order of the tokens."""
    chars, n = [], 0
    for token, x in tokens:
        for i, c in enumerate(token):
            chars.append((n, c, float(x + i)))
            n += 1
    return spark.createDataFrame([(chars,)], "chars array<struct<ord:int,c:string,x0:double>>")


def test_mixed_lines(spark):
    line = lambda *tokens: _line(spark, *tokens).select(bidi.mixed_line(F.col("chars"))).first()[0]
    assert line(("ABC", 10), (" ", 14), ("שלום", 50)) == "שלום ABC"
    assert line((":12", 10), (" ", 14), ("סכום", 50)) == "סכום: 12"
    assert line(("USB-", 10), (" ", 15), ("ב", 50), (" ", 52), ("שלום", 60)) == "שלום ב-USB"
    assert line(("שלוםABC", 50)) == "ABC שלום"  # parted where the direction changes; the Latin run stands further right
    assert line(("hello ", 10), ("שם", 20)) == "hello שם"  # more Latin letters: as it is
    assert line(("שלום", 10), (" ", 15), ("עולם", 20)) == "שלום עולם"
    df = _line(spark, ("ABC שלום", 10))
    assert df.select(bidi.mixed_line(F.col("chars"), F.lit("vertical"))).first()[0] == "ABC שלום"
    got = _line(spark, ("-א1", 0)).select(bidi.bidi_tokens(F.col("chars"))).first()[0]
    assert [(t["text"], t["direction"]) for t in got] == [("-א", "rtl"), ("1", "ltr")]
    empty = spark.createDataFrame([([],)], "chars array<struct<ord:int,c:string,x0:double>>")
    assert empty.select(bidi.mixed_line(F.col("chars"))).first()[0] == ""


def test_trimmed_chars_and_word_order(spark):
    trimmed = lambda t: [x["c"] for x in _line(spark, (t, 0)).select(bidi.trimmed_chars(F.col("chars"))).first()[0]]
    assert trimmed("  a b ") == list("a b")
    assert trimmed("   ") == []
    words = lambda *w: [x["text"] for x in spark.createDataFrame([(list(w),)], "w array<struct<text:string,x0:double,word_no:int>>").select(bidi.ordered_words(F.col("w"))).first()[0]]
    assert words(("שם", 1.0, 0), ("אב", 9.0, 1)) == ["אב", "שם"]
    assert words(("b", 9.0, 0), ("a", 1.0, 1)) == ["a", "b"]
    assert words(("2", 1.0, 1), ("1", 9.0, 0)) == ["1", "2"]


BLOCK = "page_id int, block_id string, type string, style_id string, text string, x0 double, y0 double, x1 double, y1 double, reading_order int, confidence double"


def test_continuation_pairs(spark):
    assert continuation.chained([(0, 1), (0, 2), (1, 3), (2, 3), (2, 4)]) == [[0, 1, 3], [2, 4]]
    blocks = spark.createDataFrame([(1, "p1_b1", "text_line", "s1", "one  two", 100.0, 50.0, 200.0, 62.0, 1, 0.99), (1, "p1_b2", "text_line", "s1", "three", 100.0, 64.0, 200.0, 76.0, 2, 0.9), (1, "p1_b3", "text_line", "s2", "end", 220.0, 50.0, 280.0, 62.0, 3, 0.98)], BLOCK)
    pairs = spark.createDataFrame([(1, 0, 1)], "page_id int, a long, b long")
    groups = continuation.continuation_groups(blocks.withColumn("at", F.col("reading_order") - 1), pairs, ["page_id"])
    cells = spark.createDataFrame([(1, 1, 90.0, 40.0, 210.0, 90.0, 4)], "page_id int, cell_id int, x0 double, y0 double, x1 double, y1 double, walls int")
    got = continuation.merged_pairs(blocks, groups, cells, ["page_id"]).orderBy("reading_order").collect()
    assert [(r["block_id"], r["reading_order"], r["merged_ids"]) for r in got] == [("p1_m1", 1, ["p1_b1", "p1_b2"]), ("p1_b3", 2, None)]
    assert (got[0]["text"], got[0]["confidence"], got[0]["x0"], got[0]["y0"], got[0]["x1"], got[0]["y1"]) == ("one two three", 0.9, 100, 50, 200, 76)
    # A smaller cell around one of them, three walls, or another style: nothing is merged.
    inner = spark.createDataFrame([(1, 2, 90.0, 40.0, 210.0, 63.0, 4)], cells.schema)
    for c, b in ((cells.union(inner), blocks), (cells.withColumn("walls", F.lit(3)), blocks), (cells, blocks.withColumn("style_id", F.col("block_id")))):
        assert {r["block_id"] for r in continuation.merged_pairs(b, groups, c, ["page_id"]).collect()} == {"p1_b1", "p1_b2", "p1_b3"}
