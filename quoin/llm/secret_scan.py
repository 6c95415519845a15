"""Secret scans in DataFrame expressions: fixed patterns, and character Markov models.

Three patterns give the base spans. The models add spans: runs of 16 and more
token characters with a letter are scored by the log-likelihood ratio of two character bigram
models, one of random strings and one of ordinary words and identifiers, both
trained from labelled samples. All offsets are code points, end exclusive.

Null texts count as empty and have no spans. Every row stands alone, so
repeated rows give repeated results; other columns, whatever their names, are
carried or ignored. Texts are read whole, whatever their length; an empty table
gives an empty result, and models are then trained on identifiers alone.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quoin.llm._base import sample_ids

# The base kinds in their listed order, each with its pattern, the group that is measured and its least length.
KINDS = (
    ("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),
)
RANDOM = "random"
CANDIDATE = r"[A-Za-z0-9+/_=-]{16,}"
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
#: Bounds of the labelled samples: documents whose words are ordinary, and random strings.
ORDINARY_DOCS, RANDOM_STRINGS = 200, 4000
#: A run is random if it is e ** LEAST_RATIO times likelier so, and by LEAST_MEAN for each character.
LEAST_RATIO, LEAST_MEAN = 14.0, 0.7
_SCALE = 1000
# Words that ordinary identifiers are made of.
IDENTIFIER_WORDS = "get set user name list item count index value key type data file path read write open close node tree parse token request response handler manager config service client server session table column row field object string number array buffer stream event listener update delete create insert select default static public private internal factory builder context option result error message source target width height".split()


def _spans(text: Column, kind: str, order: int, pattern: str, group: int = 0, least: int = 0) -> Column:
    """Array of (start, order, end) of the matches whose group has ``least`` characters."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    sized = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
    lengths = F.zip_with(F.slice(F.split(text, pattern, -1), 1, F.size(found)), F.arrays_zip(found.alias("m"), sized.alias("g")), lambda gap, m: F.struct(F.length(gap).alias("gap"), F.length(m["m"]).alias("long"), F.length(m["g"]).alias("g")))
    blank = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<s:int,k:int,e:int>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        span = F.struct(start.alias("s"), F.lit(order).alias("k"), (start + x["long"]).alias("e"))
        return F.struct((start + x["long"]).alias("at"), F.when(x["g"] >= least, F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"))

    none = F.array().cast("array<struct<s:int,k:int,e:int>>")
    return F.when(text.rlike(pattern), F.aggregate(lengths, blank, step, lambda acc: acc["out"])).otherwise(none)


def _bigrams(words: DataFrame, column: str) -> DataFrame:
    pairs = F.explode(F.transform(F.sequence(F.lit(1), F.length(column) - 1), lambda i: F.substring(F.col(column), i, F.lit(2))))
    return words.filter(F.length(column) >= 2).select(pairs.alias("pair")).groupBy("pair").count()


def _random_strings(spark, rows: int) -> DataFrame:
    """Seeded random strings: hexadecimal, base 64, and upper case with digits."""
    seeds = spark.range(rows).select("id", F.sha2(F.concat(F.lit("random-"), F.col("id").cast("string")), 256).alias("h"))
    b64 = F.base64(F.unhex(F.col("h")))
    return seeds.select(F.when(F.col("id") % 3 == 0, F.substring("h", 1, 40)).when(F.col("id") % 3 == 1, F.substring(b64, 1, 40)).otherwise(F.upper(F.regexp_replace(b64, "[+/=]", ""))).alias("w"))


def _ordinary_words(docs: DataFrame, rows: int) -> DataFrame:
    """Words of a bounded sample of documents, and identifiers made of common words in four styles."""
    spark = docs.sparkSession
    ids = [r[0] for r in sample_ids(docs.filter(F.col("text").isNotNull()), "doc_id", rows, 7).collect()]
    plain = docs.filter(F.col("doc_id").isin(ids)) if ids else docs.limit(0)
    words = plain.select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z][A-Za-z_-]+"), F.lit(0))).alias("w"))
    cap, n = [w.capitalize() for w in IDENTIFIER_WORDS], len(IDENTIFIER_WORDS)
    made = []
    for i, a in enumerate(IDENTIFIER_WORDS):
        for j in range(1, 12):
            b, c = IDENTIFIER_WORDS[(i + 7 * j) % n], (i + 5 * j) % n
            made += [f"{a}_{b}_{IDENTIFIER_WORDS[c]}", a + cap[(i + 7 * j) % n] + cap[c], cap[i] + cap[c], f"{a}-{b}", f"{a}/{b}", f"{a}_{j}", f"{a.upper()}_{b.upper()}"]
    return words.union(spark.createDataFrame([(m,) for m in made], "w string"))


def train_markov(docs: DataFrame, ordinary_docs: int = ORDINARY_DOCS, random_strings: int = RANDOM_STRINGS) -> list[int]:
    """Log-likelihood ratios of all character pairs in thousandths, previous character slowest.

    Only counts of character pairs reach the driver: at most the alphabet squared.
    """
    n = len(ALPHABET)
    logs = []
    for words in (_random_strings(docs.sparkSession, random_strings), _ordinary_words(docs, ordinary_docs)):
        counts = [[1.0] * n for _ in range(n)]
        for pair, times in _bigrams(words, "w").collect():
            a, b = ALPHABET.find(pair[0]), ALPHABET.find(pair[1])
            if a >= 0 and b >= 0:
                counts[a][b] += times
        logs.append([[math.log(c / sum(row)) for c in row] for row in counts])
    return [round(_SCALE * (r - o)) for x, y in zip(*logs, strict=True) for r, o in zip(x, y, strict=True)]


def _ratio(word: Column, ratios: list[int]) -> Column:
    table = F.split(F.lit(",".join(map(str, ratios))), ",").cast("array<int>")
    at = F.transform(F.split(word, ""), lambda c: F.instr(F.lit(ALPHABET), c) - 1)
    pairs = F.zip_with(F.slice(at, 1, F.size(at) - 1), F.slice(at, 2, F.size(at) - 1), lambda a, b: F.get(table, a * len(ALPHABET) + b))
    return F.aggregate(pairs, F.lit(0), lambda acc, x: acc + F.coalesce(x, F.lit(0)))


def scan(docs: DataFrame, ratios: list[int]) -> DataFrame:
    """``docs`` with ``base`` and ``added``: sorted arrays of (s start, k kind, e end)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    found = docs.select("*", *[_spans(text, kind, i, pattern, group, least).alias(f"_{kind}") for i, (kind, pattern, group, least) in enumerate(KINDS)], _spans(text, RANDOM, len(KINDS), CANDIDATE).alias("_runs"))
    merged = found.select(*docs.columns, F.array_sort(F.concat(*[F.col(f"_{k[0]}") for k in KINDS])).alias("base"), "_runs")

    def random(x: Column) -> Column:
        ratio = _ratio(F.substring(text, x["s"] + 1, x["e"] - x["s"]), ratios)
        free = ~F.exists("base", lambda b: (b["s"] < x["e"]) & (x["s"] < b["e"]))
        letters = F.substring(text, x["s"] + 1, x["e"] - x["s"]).rlike("[A-Za-z]")  # bare numbers are no keys
        return free & letters & (ratio >= _SCALE * LEAST_RATIO) & (ratio >= _SCALE * LEAST_MEAN * (x["e"] - x["s"]))

    added = F.when(F.size("_runs") > 0, F.filter("_runs", random)).otherwise(F.col("_runs"))
    return merged.select(*docs.columns, "base", added.alias("added"))


def _written(spans: Column) -> Column:
    names = F.array(*[F.lit(k[0]) for k in KINDS], F.lit(RANDOM))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["k"]), x["s"].cast("string"), x["e"].cast("string"))), ",")


def secret_spans(docs: DataFrame, ratios: list[int]) -> DataFrame:
    """doc_id, counts of the base kinds, base_sha256 and all spans as text."""
    count = lambda k: F.size(F.filter("base", lambda x: x["k"] == k)).cast("long")
    return scan(docs.select("doc_id", "text"), ratios).select("doc_id", *[count(i).alias(f"n_{k[0]}") for i, k in enumerate(KINDS)], F.sha2(_written(F.col("base")), 256).alias("base_sha256"), _written(F.array_sort(F.concat("base", "added"))).alias("spans"))


def redact(docs: DataFrame, ratios: list[int], mark: str = "[secret]") -> DataFrame:
    """``docs`` with every span in text replaced by ``mark`` and n_chars of these rows counted anew; other rows are as they were."""
    # The row travels as one column, so that no column of docs meets a name of the scan.
    rows = docs.select(F.struct("*").alias("_row"), "text")
    found = scan(rows, ratios).withColumn("_all", F.array_sort(F.concat("base", "added")))
    none = F.array().cast("array<struct<s:int,k:int,e:int>>")

    def join(acc: Column, x: Column) -> Column:
        last = F.element_at(acc, -1)
        touch = (F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1))["e"] >= x["s"])
        wide = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(last["s"].alias("s"), last["k"].alias("k"), F.greatest(last["e"], x["e"]).alias("e"))))
        return F.when(touch, wide).otherwise(F.concat(acc, F.array(x)))

    found = found.withColumn("_all", F.when(F.size("_all") > 1, F.aggregate("_all", none, join)).otherwise(F.col("_all")))
    before = lambda i: F.when(i == 0, F.lit(0)).otherwise(F.get("_all", i - 1)["e"])
    parts = F.transform("_all", lambda x, i: F.concat(F.substring(F.col("text"), before(i) + 1, x["s"] - before(i)), F.lit(mark)))
    tail = F.substring(F.col("text"), F.element_at("_all", -1)["e"] + 1, F.length("text"))
    text = F.when(F.size("_all") > 0, F.concat(F.array_join(parts, ""), tail)).otherwise(F.col("text"))
    changed = {"text": text, "n_chars": F.when(F.size("_all") > 0, F.length(text).cast("long")).otherwise(F.col("_row")["n_chars"]) if "n_chars" in docs.columns else None}
    return found.select(*[(changed[c] if c in changed else F.col("_row")[c]).alias(c) for c in docs.columns])
