"""The translation dataflow: deterministic answers, cache, provider with checks, fallback."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quoin.functions import translation as t
from quoin.functions.text import has_script, squeezed


def identity_provider(texts: list[str], source: str, target: str) -> list[str]:
    """Stands in where no translator is at hand."""
    return list(texts)


def translate_blocks(blocks: DataFrame, source: str, target: str, provider: Callable = identity_provider, cache: DataFrame | None = None, versions: tuple[str, str, str] = ("1", "1", "1")) -> DataFrame:
    """Blocks (document_id, page_id, block_id, type, text) with translated_text, status, attempts and issues.

    Amounts and texts without the source's script need no translator; cached texts are joined by
    hash; the rest is made distinct, so each text goes to the provider once.
    """
    rows = blocks.withColumn("source_text", F.coalesce("text", F.lit(""))).withColumn("translation_hash", t.cache_key(F.col("source_text"), *versions))
    foreign = ~has_script(F.col("source_text"), F.lit(source))
    ready = F.coalesce(t.shekel_amount(F.col("source_text")), F.when(foreign, F.col("source_text")))
    rows = rows.withColumn("_ready", ready)
    held = (cache if cache is not None else blocks.sparkSession.createDataFrame([], "translation_hash string, cached string")).select("translation_hash", "cached").dropDuplicates(["translation_hash"])
    rows = rows.join(held, "translation_hash", "left")
    todo = rows.filter("_ready IS NULL AND cached IS NULL").select("translation_hash", "source_text").dropDuplicates(["translation_hash"])

    def call(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"translation_hash": b["translation_hash"], "fresh": provider(b["source_text"].tolist(), source, target)})

    fresh = todo.mapInPandas(call, "translation_hash string, fresh string")
    joined = rows.join(fresh, "translation_hash", "left")
    given = t.source_dates_kept(F.col("source_text"), t.line_breaks_kept(F.col("source_text"), F.col("fresh"), F.col("type")))
    issues = t.issues(F.col("source_text"), given, F.lit(target))
    bad = F.size(issues) > 0
    text = F.coalesce("_ready", "cached", F.when(bad, F.col("source_text")).otherwise(given))
    status = F.when(F.col("_ready").isNotNull(), "translated").when(F.col("cached").isNotNull(), "cached").when(bad, "fallback").otherwise("translated")
    none = F.array().cast("array<string>")
    return joined.select("document_id", "page_id", "block_id", "source_text", text.alias("translated_text"), "translation_hash", status.alias("status"), F.when(F.col("fresh").isNotNull(), 1).otherwise(0).alias("attempts"), F.when(F.col("fresh").isNotNull(), issues).otherwise(none).alias("issues"))


def passthrough(blocks: DataFrame, order: str = "reading_order") -> DataFrame:
    """Identity translations whose hash is the block's ordinal, 64 digits wide."""
    return blocks.select("document_id", "page_id", "block_id", F.col("text").alias("translated_text"), F.lpad(F.col(order).cast("string"), 64, "0").alias("translation_hash"))


def replayed_run(stored: DataFrame, pages: DataFrame, file_name: str, source: str, target: str) -> DataFrame:
    """A stored run for the same file and languages, its document ids taken from the pages at hand."""
    same = stored.filter((F.col("file_name") == file_name) & (F.col("source_code") == source) & (F.col("target_code") == target))
    ids = pages.select("page_id", F.col("document_id").alias("_id"))
    return same.join(ids, "page_id", "left").withColumn("document_id", F.coalesce("_id", "document_id")).drop("_id")


def join_candidates(text: DataFrame, source: str, target: str) -> DataFrame:
    """Joined blocks worth translating anew: the merged text has the target's script, its source the source's."""
    return text.filter(has_script(squeezed(F.col("merged_text")), F.lit(target)) & has_script(squeezed(F.col("merged_source")), F.lit(source)))
