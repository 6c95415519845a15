"""Substring deduplication over sliding sentence spans.

A text is cut into sentences, and these into parts: of any ``WINDOW`` consecutive
words of the text, a part ends at the one with the least hash (the last of equal
ones). So no part has over ``WINDOW`` words, and parts depend on near words only
and agree wherever a passage stands. From every part a run of consecutive ones
begins, the shortest that has two parts and ``LEAST_WORDS`` words. Runs are
hashed and brought together by hash over the whole table; the first run of a hash (least
doc_id, then place) stays, and every part that any other run of that hash covers
is removed.

A passage of ``4 * WINDOW + 17`` words or more holds a whole run wherever it
stands: parts agree from its word ``WINDOW`` on to as many words before its end,
the first of them begins within ``WINDOW`` words, and a run has at most
``LEAST_WORDS + WINDOW - 1``. At the end of a repeated passage fewer than two
windows of words may stay.

Null and empty texts, and rows without a doc_id, have no run and are kept as
they are. Rows of one doc_id count as one document: what its rows repeat of each
other stays, and each row, whatever its text, loses what lesser documents or
earlier places of its own text hold. Texts are read whole, whatever their
length. Only doc_id and text are read, so other columns may have any name. An
empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quoin.llm._base import arrow_map, checkpointed, stored, struct

LEAST_WORDS, LEAST_SENTENCES = 20, 2
#: Of so many consecutive words one ends a part; a power of two, and the largest for passages of 50 words.
WINDOW = 8
#: Words whose hashes a worker holds.
HELD_WORDS = 100_000
#: Runs of one hash that one task sorts; the most hashes that are dealt to several (the commonest, their list is
#: broadcast; any other has under 1 / HOT_HASHES of all runs); and of how many documents one is counted for that.
HOT_ROWS, HOT_HASHES, HOT_SAMPLE = 10_000, 100_000, 64
_BREAK = re.compile(r"(?<=[.!?])\s+|\n\s*")
_TOKEN = re.compile(r"\S+")


class _Hashes(dict):
    """crc32 of words, each computed once while it is held."""

    def __missing__(self, word: str) -> int:
        if len(self) >= HELD_WORDS:
            self.clear()
        self[word] = h = zlib.crc32(word.encode("utf-8", "surrogatepass"))
        return h


_HASHES = _Hashes()


def part_ends(words: list[str]) -> list[int]:
    """Places of the words that end a part: the least hash of any window, the last one of equal ones."""
    n = len(words)
    if n < WINDOW:
        return []
    least = (np.fromiter(map(_HASHES.__getitem__, words), np.int64, n) << 31) | np.arange(n, 0, -1)
    step = 1
    while step < WINDOW:
        least = np.minimum(least[:-step], least[step:])
        step *= 2
    return (n - np.unique(least & ((1 << 31) - 1))[::-1]).tolist()


def sentences(text: str) -> list[tuple[int, int, int]]:
    """(start, end, words) of the parts of sentences in order."""
    out, at, k = [], 0, 0
    spans = [m.span() for m in _TOKEN.finditer(text)]
    ends = iter([*part_ends(text.split()), len(spans)])
    cut = next(ends)
    for end, after in [m.span() for m in _BREAK.finditer(text)] + [(len(text), len(text))]:
        start, first = at, k
        while k < len(spans) and spans[k][1] <= end:
            k += 1
            if cut == k - 1:
                cut = next(ends)
                out.append((start, spans[k - 1][1], k - first))
                start, first = spans[k - 1][1], k
        if k > first:
            out.append((start, end, k - first))
        at = after
    return out


def runs(text: str, found: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(hash, first sentence, sentences) of the run that begins at each part, where there is one."""
    import xxhash

    marks = [xxhash.xxh3_64_digest(" ".join(text[a:b].split()).encode("utf-8", "surrogatepass")) for a, b, _ in found]
    out, end, words = [], 0, 0
    for i in range(len(found)):
        while end < len(found) and (words < LEAST_WORDS or end - i < LEAST_SENTENCES):
            words += found[end][2]
            end += 1
        if words < LEAST_WORDS or end - i < LEAST_SENTENCES:
            break
        h = xxhash.xxh3_64_intdigest(b"".join(marks[i:end]))
        out.append((h - (1 << 64) if h >> 63 else h, i, end - i))
        words -= found[i][2]
    return out


RUNS = struct(("h", T.LongType()), ("doc_id", T.LongType()), ("t", T.LongType()), ("place", T.LongType()))


def sentence_runs(docs: DataFrame) -> DataFrame:
    """Every run of every text: h, doc_id, t (hash of the text) and place.

    A place is one number, so that rows stay small in the shuffle: the first part times 256,
    plus twice the number of parts (a run has at most ``LEAST_WORDS``), plus one if the text
    had the run before.
    """

    def make():
        def step(cols):
            rows = []
            for key, t, text in zip(cols["doc_id"], cols["t"], cols["text"], strict=True):
                seen: set[int] = set()
                for h, i, n in runs(text, sentences(text)) if text else ():
                    rows.append((h, key, t, i << 8 | n << 1 | (h in seen)))
                    seen.add(h)
            return {f.name: [r[k] for r in rows] for k, f in enumerate(RUNS)}

        return step

    return arrow_map(_keyed(docs).filter(F.col("doc_id").isNotNull()), ["doc_id", "t", "text"], make, RUNS)


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.xxhash64("text").alias("t"), "text")


def hot_hashes(docs: DataFrame) -> DataFrame:
    """h and the number of tasks that its runs are dealt to, for the commonest hashes: at most ``HOT_HASHES`` rows.

    Counted on one document in ``HOT_SAMPLE``, chosen by hash: it only says how rows are dealt,
    and no result depends on it.
    """
    some = docs.filter(F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(HOT_SAMPLE)) == 0)
    counts = sentence_runs(some).groupBy("h").agg((HOT_SAMPLE * F.count(F.lit(1))).alias("rows")).filter(F.col("rows") > HOT_ROWS)
    return checkpointed(counts.orderBy(F.desc("rows"), "h").limit(HOT_HASHES).select("h", F.ceil(F.col("rows") / HOT_ROWS).cast("int").alias("salts")))


def covered_sentences(docs: DataFrame) -> DataFrame:
    """doc_id, t and the covered runs of that text as an array of numbers (first part times 128, plus parts), for texts that have any.

    The array has at most one number for each part of its text. Runs are made and shuffled
    once, a common hash to several tasks; sorted by document, the first row is the least.
    """
    hot = hot_hashes(docs)
    salts = F.coalesce("salts", F.lit(1))
    dealt = sentence_runs(docs).join(F.broadcast(hot), "h", "left").select(*RUNS.names, F.when(salts > 1, F.pmod(F.xxhash64("doc_id", "place"), salts).cast("int") + 1).otherwise(0).alias("salt"))
    so_far = Window.partitionBy("h", "salt").orderBy("doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = dealt.withColumn("first", F.first("doc_id").over(so_far))
    later = (F.col("doc_id") > F.col("first")) | (F.col("place") % 2 == 1)
    # Of a dealt hash every task has a first document; the least of these is the first of all.
    kept = stored(placed.select(F.when(~later, F.col("h")).alias("h"), "doc_id", "t", F.shiftright("place", 1).alias("place"), "salt", later.alias("later")).filter("later OR salt > 0"))
    open_ = kept.filter("NOT later")
    least = open_.groupBy("h").agg(F.min("doc_id").alias("first"))  # one row for each hash of ``hot`` at most
    lost = open_.join(F.broadcast(least), "h").filter("doc_id > first")
    covered = kept.filter("later").select("doc_id", "t", "place").union(lost.select("doc_id", "t", "place"))
    return covered.groupBy("doc_id", "t").agg(F.collect_set("place").alias("covered"))


def without_covered(text: str | None, covered: list[tuple[int, int]] | None) -> tuple[str | None, int, list[tuple[int, int]]]:
    """The text without the covered sentences, how many these are, and their joined spans in code points."""
    if not text or not covered:
        return text, 0, []
    found = sentences(text)
    gone = sorted({i for at, n in covered for i in range(at, at + n)})
    spans: list[tuple[int, int]] = []
    for i in gone:
        end = found[i + 1][0] if i + 1 < len(found) else len(text)
        if spans and spans[-1][1] >= found[i][0]:
            spans[-1] = (spans[-1][0], end)
        else:
            spans.append((found[i][0], end))
    parts, at = [], 0
    for a, b in spans:
        parts.append(text[at:a])
        at = b
    return "".join([*parts, text[at:]]).rstrip() if at == len(text) else "".join([*parts, text[at:]]), len(gone), spans


KEPT = struct(("doc_id", T.LongType()), ("text", T.StringType()), ("n_removed", T.LongType()), ("removed", T.StringType()))


def dedup_substrings(docs: DataFrame) -> DataFrame:
    """Every document: doc_id, text that stays, n_removed sentences, removed spans as start:end joined by commas."""
    joined = _keyed(docs).join(covered_sentences(docs), ["doc_id", "t"], "left")

    def make():
        def step(cols):
            got = [without_covered(t, [(c >> 7, c & 127) for c in cov] if cov else None) for t, cov in zip(cols["text"], cols["covered"], strict=True)]
            return {"doc_id": cols["doc_id"], "text": [g[0] for g in got], "n_removed": [g[1] for g in got], "removed": [",".join(f"{a}:{b}" for a, b in g[2]) for g in got]}

        return step

    return arrow_map(joined, ["doc_id", "text", "covered"], make, KEPT)
