"""Extraction warnings over a stream of document files: stateless, so any trigger gives the batch result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quoin.functions.text import extraction_warning, language


def watch_documents(spark: SparkSession, folder: str, schema: str = "doc_id LONG, text STRING, lang STRING, source STRING, n_chars LONG") -> DataFrame:
    """A streaming DataFrame over Parquet files that arrive in a folder: doc_id, language code and warning."""
    rows = spark.readStream.schema(schema).parquet(folder)
    return rows.select("doc_id", language(F.col("text"))["code"].alias("code"), extraction_warning(F.col("text")).alias("warning"))
