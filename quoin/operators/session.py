"""Edited pages: snapshot upserts, selections, validation and export rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def merge_snapshot(current: DataFrame, snapshot: DataFrame, keys: list[str], block: str = "block_id") -> DataFrame:
    """Snapshot rows, with values of the current row where the snapshot has null; blocks absent from the snapshot go."""
    on = [*keys, block]
    c = current.select(*on, *[F.col(x).alias(f"_{x}") for x in current.columns if x not in on])
    values = [F.coalesce(F.col(x), F.col(f"_{x}")).alias(x) if f"_{x}" in c.columns else F.col(x) for x in snapshot.columns if x not in on]
    return snapshot.join(c, on, "left").select(*on, *values)


def upsert_regions(current: DataFrame, changed: DataFrame, keys: list[str]) -> DataFrame:
    """Regions updated and appended: a full outer join, the change first."""
    c = current.select(*keys, *[F.col(x).alias(f"_{x}") for x in current.columns if x not in keys])
    return changed.join(c, keys, "full_outer").select(*keys, *[F.coalesce(F.col(x), F.col(f"_{x}")).alias(x) for x in changed.columns if x not in keys])


def block_pages(blocks: DataFrame) -> DataFrame:
    """First page of each block id."""
    return blocks.groupBy("block_id").agg(F.min("page_id").alias("page_id"))


def selected(blocks: DataFrame, selection: DataFrame) -> DataFrame:
    """Selected blocks (ord, block_id) that exist, each once, by first mention."""
    first = selection.groupBy("block_id").agg(F.min("ord").alias("ord"))
    return blocks.join(first, "block_id")


def split_requested(requested: DataFrame, blocks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Requested pages with at least one block, and those without."""
    pages = blocks.select("document_id", "page_id").distinct()
    asked = requested.select("document_id", "page_id").distinct()
    return asked.join(pages, ["document_id", "page_id"], "left_semi"), asked.join(pages, ["document_id", "page_id"], "left_anti")


def export_blocks(blocks: DataFrame, least: int = 2) -> DataFrame:
    """Blocks that an export draws: those with at least two characters."""
    return blocks.filter(F.length(F.trim("text")) >= least)


def require(df: DataFrame, good, message: str) -> DataFrame:
    """``df``, or an error at run time if a row is not ``good``."""
    return df.filter(F.when(F.coalesce(good, F.lit(False)), F.lit(True)).otherwise(F.raise_error(F.lit(message)).cast("boolean")))


def next_ids(blocks: DataFrame, taken: DataFrame, start: int = 1) -> DataFrame:
    """New ids p{page}_m{n} that are not taken, numbered in order on each page."""
    from pyspark.sql import Window

    used = taken.groupBy("page_id").agg(F.max(F.regexp_extract("block_id", r"_m(\d+)$", 1).try_cast("int")).alias("_last"))
    rows = blocks.join(used, "page_id", "left")
    n = F.row_number().over(Window.partitionBy("page_id").orderBy("group_id")) + F.greatest(F.coalesce("_last", F.lit(0)), F.lit(start - 1))
    return rows.withColumn("block_id", F.concat(F.lit("p"), "page_id", F.lit("_m"), n)).drop("_last")
