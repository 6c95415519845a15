"""Readers and sinks of layout tables, and flat rows from nested records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quoin.functions import geometry as g
from quoin.functions.text import count, direction
from quoin.sources.schemas import SCHEMAS


def read_layout(spark: SparkSession, name: str, path: str, kind: str = "parquet") -> DataFrame:
    """A layout table under its declared schema, so nothing is inferred; kinds: parquet, json, orc."""
    return spark.read.schema(SCHEMAS[name]).format(kind).load(path)


def write_layout(df: DataFrame, path: str, kind: str = "parquet", mode: str = "errorifexists") -> None:
    """Rows parted by document hash upstream stay so; no shuffle is added."""
    df.write.format(kind).mode(mode).save(path)


def read_binaries(spark: SparkSession, path: str, pattern: str = "*.pdf") -> DataFrame:
    """Files as one row each: path, length, content, with document_id from the content's SHA-256."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    return files.select("path", "length", "content", document_id(F.col("content")).alias("document_id"))


def document_id(content: Column) -> Column:
    return F.concat(F.lit("doc_"), F.substring(F.sha2(content, 256), 1, 12))


def page_class(has_text: Column, has_images: Column) -> Column:
    return F.when(has_text & has_images, "MIXED").when(has_text, "DIGITAL").otherwise("SCANNED")


def manifest(pages: DataFrame, content: str = "content") -> DataFrame:
    """One row per document: document_id, sha256, page_count. ``pages`` has content and page_id."""
    return pages.groupBy(document_id(F.col(content)).alias("document_id"), F.sha2(F.col(content), 256).alias("sha256")).agg(F.count_distinct("page_id").alias("page_count"))


def page_summary(words: DataFrame, fonts: Column, has_images: Column) -> DataFrame:
    """Per page: text_span_count, font_count, type and direction from its words; sums of letters, so map-side combined."""
    text = F.col("text")
    rtl, ltr = F.sum(count(text, r"[\x{0590}-\x{08FF}]")), F.sum(count(text, "[A-Za-z]"))
    grouped = words.groupBy("document_id", "page_id").agg(F.count(F.lit(1)).alias("text_span_count"), F.count_distinct(fonts).alias("font_count"), F.max(has_images).alias("i"), rtl.alias("r"), ltr.alias("l"))
    way = F.when((F.col("r") == 0) & (F.col("l") == 0), "UNKNOWN").when(F.col("r") >= F.col("l"), "RTL").otherwise("LTR")
    return grouped.select("document_id", "page_id", "text_span_count", "font_count", page_class(F.col("text_span_count") > 0, F.col("i")).alias("type"), way.alias("direction"))


def requested_pages(pages: DataFrame, wanted: DataFrame, strict: bool = True) -> DataFrame:
    """Pages that are asked for. Unknown ones raise an error, or pass silently if not ``strict``."""
    if strict:
        unknown = wanted.join(pages.select("document_id", "page_id"), ["document_id", "page_id"], "left_anti")
        bad = unknown.limit(1).collect()
        if bad:
            raise ValueError(f"page {bad[0]['page_id']} of {bad[0]['document_id']} is not in the document")
    return pages.join(wanted.select("document_id", "page_id").distinct(), ["document_id", "page_id"], "left_semi")


def chars_from_raw(raw: DataFrame) -> DataFrame:
    """Nested blocks → lines → spans → chars as rows; y turned over to grow downwards by ``page_height``."""
    b = raw.select("document_id", "page_id", "page_height", F.posexplode("blocks").alias("block_idx", "b"))
    ln = b.select("document_id", "page_id", "page_height", "block_idx", F.posexplode("b.lines").alias("line_idx", "l"))
    s = ln.select("document_id", "page_id", "page_height", "block_idx", "line_idx", F.posexplode("l.spans").alias("span_no", "s"))
    c = s.select("document_id", "page_id", "page_height", "block_idx", "line_idx", "span_no", F.posexplode("s.chars").alias("ord", "c"))
    return c.select("document_id", "page_id", "block_idx", "line_idx", "span_no", "ord", F.col("c.c").alias("c"), F.col("c.x0").alias("x0"), (F.col("page_height") - F.col("c.y1")).alias("y0"), F.col("c.x1").alias("x1"), (F.col("page_height") - F.col("c.y0")).alias("y1"))


def words_from_tuples(df: DataFrame, column: str = "words") -> DataFrame:
    """Word structs as rows; blank tokens and null ones go."""
    w = df.select("document_id", "page_id", F.explode(column).alias("w")).select("document_id", "page_id", "w.*")
    return w.filter(F.trim("text") != "")


def line_elements(chars: DataFrame) -> DataFrame:
    """One element per text line: id, trimmed text, union box; lines without a valid box go, repeated ones keep the first."""
    valid = chars.filter(g.is_valid(g.box()))
    key = ["document_id", "page_id", "block_idx", "line_idx"]
    ordered = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "c"))), lambda x: x["c"]), "")
    lines = valid.groupBy(*key).agg(F.trim(ordered).alias("text"), *g.union_over())
    first = F.struct("block_idx", "line_idx")
    same = ["document_id", "page_id", "text", *[F.round(c, 3).alias(f"_{c}") for c in ("x0", "y0", "x1", "y1")]]
    kept = lines.filter("text <> ''").groupBy(*same).agg(F.min_by(F.struct(*lines.columns), first).alias("k")).select("k.*")
    return kept.withColumn("element_id", F.concat_ws("_", F.concat(F.lit("b"), "block_idx"), F.concat(F.lit("l"), "line_idx")))


def ocr_boxes(ocr: DataFrame) -> DataFrame:
    """OCR trees as rows of granularity line and word with confidence and box."""
    p = ocr.select("document_id", "page_id", F.posexplode("blocks").alias("b", "block")).select("document_id", "page_id", "b", F.posexplode("block.paragraphs").alias("p", "par"))
    ln = p.select("document_id", "page_id", "b", "p", F.posexplode("par.lines").alias("l", "line"))
    lines = ln.select("document_id", "page_id", F.lit("line").alias("granularity"), "b", "p", "l", F.lit(None).cast("int").alias("w"), "line.text", "line.confidence", "line.bbox.*")
    words = ln.select("document_id", "page_id", "b", "p", "l", F.posexplode("line.words").alias("w", "word"))
    words = words.select("document_id", "page_id", F.lit("word").alias("granularity"), "b", "p", "l", "w", "word.text", "word.confidence", "word.bbox.*")
    return lines.unionByName(words)


def textbox(words: DataFrame, areas: DataFrame) -> DataFrame:
    """Text of the words that meet each area: words joined by spaces, lines by line feeds. areas: keys, area_id, a_ box."""
    hit = words.join(areas, ["document_id", "page_id"]).filter(g.intersects(g.box(), g.box("a_")))
    key = ["document_id", "page_id", "area_id"]
    lines = hit.groupBy(*key, "block_no", "line_no").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("word_no", "text"))), lambda x: x["text"]), " ").alias("t"))
    return lines.groupBy(*key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block_no", "line_no", "t"))), lambda x: x["t"]), "\n").alias("text"))


def dominant_direction(text: Column) -> Column:
    """rtl only if strictly more letters are."""
    return F.when(direction(text, tie="ltr") == "rtl", "rtl").otherwise("ltr")
