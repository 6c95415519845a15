"""Benchmark decontamination by template canonicalisation, in DataFrame expressions.

Texts become token sequences in which numbers, units after numbers, and names
(runs of capitalised words) are typed placeholders. Windows of ``WINDOW`` tokens
are hash-joined between documents and benchmark items. Matches on one diagonal
(document position minus item position) form a passage, and so do those on
diagonals within one band of ``DRIFT`` (bands overlap by half), since added,
dropped or longer values shift what follows. A passage counts if it covers
enough of the item's windows and its slots are consistent: equal values in the
item always stand for equal values in the document, so that a question with
changed parameters is caught and a chance meeting of templates is not.

Document windows are first tested against a bit set of the benchmark's token
triples, which lets no true match go; only those that pass are hashed and
joined. The bit set and the benchmark's windows are broadcast while the
benchmark is under ``BROADCAST_WINDOWS`` windows (counted first); beyond that
every window is shuffled on its hash instead.

An item of fewer tokens than a window is one window of its own length, and must
stand there with its own values; items of fewer than ``LEAST_TOKENS`` match
nothing. Null texts count as empty; texts of any length are read whole. Rows
that share a doc_id count as one document, items that share an item_id as one
item. Other columns may have any name. Empty tables give an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW, LEAST_TOKENS = 8, 3
#: Least share of an item's windows in one passage, and the width of its band of diagonals.
LEAST_COVERAGE, DRIFT = 0.4, 16
#: The benchmark is broadcast up to so many windows (some 30 bytes each).
BROADCAST_WINDOWS = 200_000
# Units that may follow a number.
UNITS = "km m cm mm mi ft in kg g mg lb oz l ml s sec min h hr hours minutes seconds days weeks months years percent dollars euros usd eur miles meters metres kilometers kilograms grams liters litres degrees".split()
NUMBER = r"\p{N}+(?:[.,:/]\p{N}+)*"
RAW_TOKEN = r"<c[^<>]*>|" + NUMBER + r"|[\p{L}\p{M}]+"
TOKEN = r"<[nuc]>|[\p{L}\p{M}]+"
#: Runs of capitalised words, wherever they stand: an item reads the same at the start of a text and inside a sentence.
NAME = r"(^|[^\p{L}\p{M}])(\p{Lu}\p{Ll}[\p{L}\p{M}]*(?:\x20\p{Lu}\p{Ll}[\p{L}\p{M}]*)*)"


def _looped(pattern: str) -> str:
    """A pattern with its repeated groups possessive: Java matches these in a loop, plain ones by a recursion that overflows the stack on long runs.

    Nothing that follows a repeated group here can match a part of it, so matches stay the same. SQL has no such form.
    """
    return pattern.replace(")*", ")*+")


def canonical(text: Column) -> Column:
    """Canonical tokens: lower-case words, <n> for numbers, <u> for units, <c> for runs of capitalised words."""
    plain = F.translate(F.coalesce(text, F.lit("")), "<>", "  ")
    named = F.regexp_replace(plain, _looped(NAME), "$1<c>")
    numbered = F.regexp_replace(named, _looped(NUMBER), "<n>")
    united = F.regexp_replace(numbered, r"(<n>\s?)(?:" + "|".join(UNITS) + r")([^\p{L}\p{M}]|$)", "$1<u>$2")
    return F.regexp_extract_all(F.lower(united), F.lit(TOKEN), F.lit(0))


def raw_tokens(text: Column) -> Column:
    """The values that stand behind the canonical tokens, one for one; names between <c and >."""
    plain = F.translate(F.coalesce(text, F.lit("")), "<>", "  ")
    return F.regexp_extract_all(F.regexp_replace(plain, _looped(NAME), "$1<c$2>"), F.lit(_looped(RAW_TOKEN)), F.lit(0))


def _triple(tokens: Column, i: Column) -> Column:
    return F.xxhash64(F.get(tokens, i), F.get(tokens, i + 1), F.get(tokens, i + 2))


def _positions(tokens: Column, width: Column | int = WINDOW) -> Column:
    n = F.size(tokens) - width
    return F.when(n >= 0, F.sequence(F.lit(0), n)).otherwise(F.array().cast("array<int>"))


def _slots(canon: Column, raw: Column, at: Column, width: Column | int = WINDOW) -> Column:
    """Values of a window's placeholders in order; empty where a window has none."""
    pairs = F.arrays_zip(F.slice(canon, at + 1, width).alias("c"), F.slice(raw, at + 1, width).alias("r"))
    return F.transform(F.filter(pairs, lambda x: x["c"].startswith("<")), lambda x: F.lower(x["r"]))


def item_windows(benchmark: DataFrame) -> DataFrame:
    """item_id, ipos, h, islots, n_windows, width, c: all windows of the benchmark; an item shorter than a window is one."""
    both = F.struct(canonical(F.col("text")).alias("c"), raw_tokens(F.col("text")).alias("r"))

    def windows(t: Column) -> Column:
        width = F.least(F.lit(WINDOW), F.greatest(F.lit(LEAST_TOKENS), F.size(t["c"])))
        places = _positions(t["c"], width)
        return F.transform(places, lambda i: F.struct(i.alias("ipos"), F.xxhash64(F.slice(t["c"], i + 1, width)).alias("h"), _slots(t["c"], t["r"], i, width).alias("islots"), F.size(places).alias("n_windows"), width.alias("width"), F.slice(t["c"], i + 1, width).alias("c")))

    return benchmark.select("item_id", F.explode_outer(_once(both, windows)).alias("w")).filter(F.col("w").isNotNull()).select("item_id", "w.*")


def _bit_set(windows: DataFrame) -> tuple[str, int]:
    """The first and last token triples of the benchmark's windows as a set of bits: 64-bit words as text, and the number of bits."""
    triples = windows.select(F.explode(F.array(_triple(F.col("c"), F.lit(0)), _triple(F.col("c"), F.col("width") - 3))).alias("t")).distinct()
    found = [r[0] for r in triples.collect()]
    bits = 1 << max(12, (32 * len(found)).bit_length() - 1)
    bits = min(bits, 1 << 18)
    words = [0] * (bits // 64)
    for t in found:
        at = t % bits
        words[at // 64] |= 1 << at % 64
    return ",".join(str(w - (1 << 64) if w >= 1 << 63 else w) for w in words), bits


def _in_set(hashed: Column, words: Column, bits: int) -> Column:
    at = hashed.bitwiseAND(F.lit(bits - 1))
    return F.getbit(F.get(words, F.shiftright(at, 6).cast("int")), at.bitwiseAND(F.lit(63)).cast("int")) == 1


def _once(value: Column, use) -> Column:
    """``use(value)`` with the value computed once a row; Catalyst would write it out at each use, inside lambdas too."""
    return F.get(F.transform(F.array(value), use), 0)


def document_windows(docs: DataFrame, bit_set: tuple[str, int] | None, widths: list[int]) -> DataFrame:
    """doc_id, pos, h, slots of the windows that may occur in the benchmark (all without a bit set)."""
    words = F.split(F.lit(bit_set[0]), ",").cast("array<bigint>") if bit_set else None

    def likely(c: Column, width: int) -> Column:
        if not bit_set:
            return _positions(c, width)
        first = F.filter(_positions(c, width), lambda i: _in_set(_triple(c, i), words, bit_set[1]))
        return F.filter(first, lambda i: _in_set(_triple(c, i + width - 3), words, bit_set[1]))

    def window(c: Column, r: Column, i: Column, width: int) -> Column:
        return F.struct(i.alias("pos"), F.xxhash64(F.slice(c, i + 1, width)).alias("h"), _slots(c, r, i, width).alias("slots"))

    def windows(c: Column, p: Column, width: int) -> Column:
        made = _once(raw_tokens(F.col("text")), lambda r: F.transform(p, lambda i: window(c, r, i, width)))
        return F.when(F.size(p) > 0, made).otherwise(F.array().cast("array<struct<pos:int,h:bigint,slots:array<string>>>")) if len(widths) > 1 else F.when(F.size(p) > 0, made)

    def of_width(c: Column, width: int) -> Column:
        return _once(likely(c, width), lambda p: windows(c, p, width))

    def of(c: Column) -> Column:
        return F.concat(*[of_width(c, w) for w in widths]) if len(widths) > 1 else of_width(c, widths[0])

    found = _once(canonical(F.col("text")), of)
    # explode_outer and a later filter: explode would make Catalyst test the array, and so compute it, twice.
    return docs.select("doc_id", F.explode_outer(found).alias("w")).filter(F.col("w").isNotNull()).select("doc_id", "w.pos", "w.h", "w.slots")


def contaminated(docs: DataFrame, benchmark: DataFrame, least: float = LEAST_COVERAGE) -> DataFrame:
    """One row per document and item that it holds: doc_id, item_id, n_windows, coverage, n_slots, exact.

    Of a pair's passages the one with most windows counts, then one on a single diagonal,
    then the earliest. ``exact`` says that all slot values are the item's own.
    """
    items = item_windows(benchmark)
    small = items.limit(BROADCAST_WINDOWS + 1).count() <= BROADCAST_WINDOWS
    widths = sorted(r[0] for r in items.select("width").distinct().collect())  # from LEAST_TOKENS to WINDOW
    windows = document_windows(docs, _bit_set(items) if small else None, widths or [WINDOW])
    items = items.drop("c")
    met = windows.join(F.broadcast(items) if small else items, "h")
    slots = F.zip_with("islots", "slots", lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    diagonal = F.col("pos") - F.col("ipos")
    near = [F.struct(F.lit(0).alias("kind"), diagonal.cast("long").alias("at"))]
    near += [F.struct(F.lit(k).alias("kind"), F.floor((diagonal + shift) / DRIFT).alias("at")) for k, shift in ((1, 0), (2, DRIFT // 2))]
    met = met.select("doc_id", "item_id", F.explode(F.array(*near)).alias("near"), "ipos", "n_windows", "width", slots.alias("pairs"))
    passages = met.groupBy("doc_id", "item_id", "near").agg(F.size(F.collect_set("ipos")).alias("n"), F.max("n_windows").alias("of"), F.min("width").alias("width"), F.array_distinct(F.flatten(F.collect_set("pairs"))).alias("pairs"))
    values = F.size(F.array_distinct(F.transform("pairs", lambda x: x["a"])))
    exact = F.forall("pairs", lambda x: x["a"] == x["b"])
    consistent = (values == F.size("pairs")) & ((F.col("width") == WINDOW) | exact)
    coverage = F.col("n") / F.col("of")
    kept = passages.filter(consistent & (coverage >= least))
    best = kept.groupBy("doc_id", "item_id").agg(F.max_by(F.struct("n", coverage.alias("coverage"), F.size("pairs").alias("n_slots"), exact.alias("exact")), F.struct("n", -F.col("near.kind"), -F.col("near.at"))).alias("b"))
    return best.select("doc_id", "item_id", F.col("b.n").cast("long").alias("n_windows"), F.round("b.coverage", 6).alias("coverage"), F.col("b.n_slots").cast("long").alias("n_slots"), F.col("b.exact").alias("exact"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the documents that hold a benchmark item; rows without a doc_id stay."""
    leaks = contaminated(docs, benchmark).select("doc_id").distinct()
    return docs.join(leaks, "doc_id", "left_anti").select(*docs.columns)
