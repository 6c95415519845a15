"""Exact token-length histogram with suffix sums.

Documents are aggregated by encoded length (only counts leave the encoder); from the histogram, sums over all
longer lengths answer totals, quantiles and truncated totals for every context
limit without another pass over the texts.

Suffix sums run in two levels, so that no task holds the whole histogram: sums
over blocks of 256 lengths, then sums inside each block. An empty table gives
an empty histogram; null texts have length 0; repeated rows count each time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quoin.llm._base import checkpointed
from quoin.llm.bpe_chunks import token_lengths

BLOCK = 256


def length_histogram(lengths: DataFrame, length_column: str = "n_tokens") -> DataFrame:
    """Documents by length: ``n_tokens, n_docs``."""
    return lengths.groupBy(F.col(length_column).cast("long").alias("n_tokens")).agg(F.count(F.lit(1)).alias("n_docs"))


def suffix_sums(histogram: DataFrame) -> DataFrame:
    """One row per length L that occurs, L being the context limit.

    Columns: n_tokens (L), n_docs, docs_up_to (documents of length <= L), docs_over,
    tokens_over (tokens of the longer documents), truncated_total (tokens left when every
    document is cut at L), total_docs, total_tokens, quantile (share of documents <= L).
    """
    # Used twice below; without the checkpoint every text would be encoded twice.
    blocks = checkpointed(histogram.withColumn("block", (F.col("n_tokens") / BLOCK).cast("long")))
    sums = blocks.groupBy("block").agg(F.sum("n_docs").alias("b_docs"), F.sum(F.col("n_docs") * F.col("n_tokens")).alias("b_tokens"))
    after = Window.orderBy(F.col("block").desc()).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    zero = F.lit(0).cast("long")
    sums = sums.select("block", F.coalesce(F.sum("b_docs").over(after), zero).alias("after_docs"), F.coalesce(F.sum("b_tokens").over(after), zero).alias("after_tokens"), F.sum("b_docs").over(whole).alias("total_docs"), F.sum("b_tokens").over(whole).alias("total_tokens"))
    inside = Window.partitionBy("block").orderBy(F.col("n_tokens").desc()).rowsBetween(Window.unboundedPreceding, -1)
    docs_over = F.col("after_docs") + F.coalesce(F.sum("n_docs").over(inside), zero)
    tokens_over = F.col("after_tokens") + F.coalesce(F.sum(F.col("n_docs") * F.col("n_tokens")).over(inside), zero)
    out = blocks.join(sums, "block").select("n_tokens", "n_docs", docs_over.alias("docs_over"), tokens_over.alias("tokens_over"), "total_docs", "total_tokens")
    return out.select("n_tokens", "n_docs", (F.col("total_docs") - F.col("docs_over")).alias("docs_up_to"), "docs_over", "tokens_over", (F.col("total_tokens") - F.col("tokens_over") + F.col("docs_over") * F.col("n_tokens")).alias("truncated_total"), "total_docs", "total_tokens", ((F.col("total_docs") - F.col("docs_over")) / F.col("total_docs")).alias("quantile"))


def quantile_lengths(sums: DataFrame, shares: list[float]) -> DataFrame:
    """The least length L such that at least ``share`` of the documents have length <= L."""
    wanted = F.explode(F.array(*[F.lit(float(s)) for s in shares]))
    per = sums.select("n_tokens", "docs_up_to", "total_docs", wanted.alias("share"))
    return per.filter(F.col("docs_up_to") >= F.ceil(F.col("share") * F.col("total_docs"))).groupBy("share").agg(F.min("n_tokens").alias("n_tokens"))


def truncated_totals(sums: DataFrame, limits: list[int]) -> DataFrame:
    """For any context limits: tokens left when every document is cut there, and documents that are cut.

    A limit between two lengths is answered from the longest length below it:
    all longer documents are longer than the limit too.
    """
    wanted = F.explode(F.array(*[F.lit(int(x)).cast("long") for x in limits]))
    spread = sums.select("n_tokens", "docs_over", "tokens_over", "total_docs", "total_tokens", wanted.alias("context"))
    below = F.col("n_tokens") <= F.col("context")
    best = spread.groupBy("context").agg(F.max(F.when(below, F.struct("n_tokens", "docs_over", "tokens_over"))).alias("b"), F.max("total_docs").alias("d"), F.max("total_tokens").alias("t"))
    over, tokens = F.coalesce(F.col("b.docs_over"), F.col("d")), F.coalesce(F.col("b.tokens_over"), F.col("t"))
    return best.select("context", over.alias("docs_cut"), (F.col("t") - tokens + over * F.col("context")).alias("truncated_total"))


def token_histogram(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """The histogram of every whole text of ``docs`` with its suffix sums."""
    return suffix_sums(length_histogram(token_lengths(docs, vocabulary)))
