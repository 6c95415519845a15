"""The registered queries of this subpackage and their oracle SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quoin.llm import bpe_chunks, decontaminate, html_template, langid, media_gif, ngram_join, secret_scan, sentence_spans, token_histogram, toxicity
from quoin.llm._base import crc_part, table


def op1_gif_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_gif.text_media(table(spark, sf_dir, "documents"))


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.link_documents(table(spark, sf_dir, "documents"))


def op3_bpe_chunk_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_chunks.encode_documents(table(spark, sf_dir, "documents"))


def op4_html_template_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_template.extract_main_text(table(spark, sf_dir, "pages"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit_toxicity(docs, table(spark, sf_dir, "labels"), held_out=(3, 1))
    return toxicity.score_toxicity(docs, model).select("doc_id", (crc_part("doc_id", 3) == 1).alias("held_out"), "score", "predicted")


def op6_token_length_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_histogram.token_histogram(table(spark, sf_dir, "documents"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit_language_model(docs, held_out=(4, 2))
    return langid.identify(docs, model).select("doc_id", (crc_part("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score", F.col("rejected"))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return secret_scan.secret_spans(docs, secret_scan.train_markov(docs))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentence_spans.dedup_substrings(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_gif_media, op2_ngram_jaccard_join, op3_bpe_chunk_reuse, op4_html_template_extraction, op5_toxicity, op6_token_length_histogram, op7_secret_scan, op8_language_id, op9_decontamination, op10_substring_dedup)}


def _decontamination_sql() -> str:
    d = decontaminate
    units = "|".join(d.UNITS)

    def tokens(name: str, key: str) -> str:
        return rf"""{name}_p AS (SELECT {key}, translate(coalesce(text, ''), '<>', '  ') AS p FROM {name}),
{name}_c AS (SELECT {key}, regexp_extract_all(lower(regexp_replace(regexp_replace(regexp_replace(p, '{d.NAME}', '\1<c>', 'g'), '{d.NUMBER}', '<n>', 'g'), '(<n>\s?)(?:{units})([^\p{{L}}\p{{M}}]|$)', '\1<u>\2', 'g')), '{d.TOKEN}') AS c, regexp_extract_all(regexp_replace(p, '{d.NAME}', '\1<c\2>', 'g'), '{d.RAW_TOKEN}') AS r FROM {name}_p)"""

    def windows(name: str, key: str, source: str) -> str:
        return f"""{name}_w AS (SELECT {key}, i, w, c[i + 1 : i + w] AS k, list_transform(list_filter(list_zip(c[i + 1 : i + w], r[i + 1 : i + w]), lambda x: x[1][1] = '<'), lambda x: lower(x[2])) AS slots, len(c) - w + 1 AS n_of FROM (SELECT *, unnest(range(0, len(c) - w + 1)) AS i FROM {source}))"""

    return f"""WITH {tokens("documents", "doc_id")}, {tokens("benchmark", "item_id")},
sized AS (SELECT *, least({d.WINDOW}, len(c)) AS w FROM benchmark_c WHERE len(c) >= {d.LEAST_TOKENS}),
{windows("benchmark", "item_id", "sized")},
{windows("documents", "doc_id", "documents_c, (SELECT DISTINCT w FROM sized)")},
met AS (SELECT a.doc_id, b.item_id, a.i - b.i AS diagonal, b.i AS ipos, b.n_of, b.w, list_zip(b.slots, a.slots) AS pairs FROM documents_w a JOIN benchmark_w b ON a.k = b.k),
near AS (SELECT *, CASE kind WHEN 0 THEN diagonal WHEN 1 THEN floor(diagonal / {d.DRIFT}.0) ELSE floor((diagonal + {d.DRIFT // 2}) / {d.DRIFT}.0) END AS at_ FROM met, (VALUES (0), (1), (2)) AS v(kind)),
passages AS (SELECT doc_id, item_id, kind, at_, count(DISTINCT ipos) AS n, max(n_of) AS n_of, min(w) AS w, list_distinct(flatten(list(pairs))) AS pairs FROM near GROUP BY ALL),
judged AS (SELECT *, len(list_filter(pairs, lambda x: x[1] <> x[2])) = 0 AS exact FROM passages WHERE len(list_distinct(list_transform(pairs, lambda x: x[1]))) = len(pairs) AND n / n_of >= {d.LEAST_COVERAGE}),
kept AS (SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY n DESC, kind, at_) AS q FROM judged WHERE exact OR w = {d.WINDOW})
SELECT doc_id, item_id, n AS n_windows, round(n / n_of, 6) AS coverage, len(pairs) AS n_slots, exact FROM kept WHERE q = 1"""


#: Trained models, tokenizers, byte formats and components are beyond SQL; tests hold these against brute force.
ORACLES: dict[str, str] = {"op9_decontamination": _decontamination_sql()}
