"""N-gram Jaccard self-join of documents by MinHash banding.

Words are runs of letters, digits and underscores in lower case; a document's
set has the 64-bit hashes of its runs of five words (its whole text if it has
fewer). Two documents are linked if the Jaccard similarity of their sets is 0.8
or more.

1. One pass gives each document its set's fingerprint and MinHash bands.
   Documents of one fingerprint are one class; only its least document goes on.
2. Bands are shuffled on their hashes. Documents of a bucket are tied to its
   least one, and connected components of these ties are the candidate groups:
   all pairs that share a bucket lie inside a group.
3. Groups are cut into blocks of ``BLOCK`` documents. Every pair of blocks
   counts the intersections of whole sets and gives back, for each document,
   its number of links and the least document that it reaches: no pair leaves
   the task, and no task holds more than two blocks.
4. Links give the final classes by components again.

Band and row counts follow from the recall wanted at the threshold. Texts
without a word have no n-gram: each is a class of its own without links.
Equal doc_ids are one document. An empty table gives an empty result.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quoin.llm._base import arrow_map, checkpointed, struct
from quoin.llm.components import connected_components

WORDS, SIMILARITY = 5, 0.8
#: Chance that a pair at the threshold shares a band, and the most hash functions for it.
RECALL, MOST_HASHES = 0.998, 140
BLOCK = 96
_WORD = re.compile(r"\w+")
_CACHE = 100_000
_MIX = np.uint64(0x9E3779B97F4A7C15)


def bands_and_rows(similarity: float = SIMILARITY, recall: float = RECALL, most: int = MOST_HASHES) -> tuple[int, int]:
    """The most rows a band may have so that enough bands for the recall fit into ``most`` hashes; then the bands."""
    best = (most, 1)
    for rows in range(1, most + 1):
        bands = int(np.ceil(np.log(1 - recall) / np.log1p(-(similarity**rows))))
        if bands * rows <= most:
            best = (bands, rows)
    return best


class Shingler:
    """Sets of n-gram hashes, and their MinHash bands."""

    def __init__(self, words: int = WORDS, bands: int = 1, rows: int = 1):
        self.words, self.bands, self.rows = words, bands, rows
        rng = np.random.default_rng(90)
        self.powers = rng.integers(1, 2**63, words, dtype=np.uint64) | np.uint64(1)
        self.factors = rng.integers(1, 2**63, bands * rows, dtype=np.uint64) | np.uint64(1)
        self.known: dict[str, int] = {}

    def __call__(self, text: str | None) -> np.ndarray:
        """Sorted distinct n-gram hashes."""
        import xxhash

        words = _WORD.findall(text.lower()) if text else []
        if not words:
            return np.zeros(0, np.uint64)
        known = self.known
        if len(known) > _CACHE:
            known.clear()
        for w in set(words).difference(known):
            known[w] = xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass"))
        h = np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words))
        n = max(1, len(h) - self.words + 1)
        total = np.zeros(n, np.uint64)
        for j in range(min(self.words, len(h))):
            total += h[j : j + n] * self.powers[j]
        total ^= total >> np.uint64(32)
        total *= _MIX
        return np.unique(total ^ total >> np.uint64(29))

    def band_hashes(self, shingles: np.ndarray) -> list[int]:
        """One signed 64-bit hash for each band."""
        import xxhash

        least = np.full(len(self.factors), np.uint64(2**64 - 1))
        for at in range(0, len(shingles), 2048):
            least = np.minimum(least, (self.factors[:, None] * shingles[at : at + 2048]).min(axis=1))
        least = np.ascontiguousarray((least >> np.uint64(24)).reshape(self.bands, self.rows))
        return [x - (1 << 64) if (x := xxhash.xxh3_64_intdigest(least[b].tobytes(), seed=b)) >> 63 else x for b in range(self.bands)]


SIGNED = struct(("doc_id", T.LongType()), ("fingerprint", T.BinaryType()), ("bands", T.ArrayType(T.LongType())))


def signatures(docs: DataFrame, words: int, bands: int, rows: int) -> DataFrame:
    """doc_id, fingerprint of the whole set (null without a word), bands."""

    def make():
        import xxhash

        shingler = Shingler(words, bands, rows)

        def step(cols):
            sets = [shingler(t) for t in cols["text"]]
            return {"doc_id": cols["doc_id"], "fingerprint": [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], "bands": [shingler.band_hashes(s) if len(s) else None for s in sets]}

        return step

    return arrow_map(docs, ["doc_id", "text"], make, SIGNED)


def _intersections(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, width: int = 1 << 15) -> np.ndarray:
    """Sizes of the intersections of sets[left] with sets[right], ``width`` distinct members at a time."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    names, place = np.unique(np.concatenate(sets), return_inverse=True)
    shared = np.bincount(place)[place] > 1  # what one set holds alone meets nothing
    owner, place = owner[shared], place[shared]
    order = np.argsort(place, kind="stable")
    owner, place = owner[order], place[order]
    out = np.zeros((len(left), len(right)), np.float32)
    for at in range(0, len(names), width):
        lo, hi = np.searchsorted(place, (at, at + width))
        if lo == hi:
            continue
        held = np.zeros((len(sets), min(width, len(names) - at)), np.float32)
        held[owner[lo:hi], place[lo:hi] - at] = 1
        out += held[left] @ held[right].T
    return out


def _verified(similarity: float):
    def verify(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.drop_duplicates("node").sort_values("node", ignore_index=True)
        first, second = key[1], key[2]
        left = np.flatnonzero(rows["block"].to_numpy() == first)
        right = np.flatnonzero(rows["block"].to_numpy() == second)
        empty = pd.DataFrame({"node": [], "links": [], "mate": []}).astype("int64")
        if not len(left) or not len(right):
            return empty
        sets = [np.asarray(s, dtype=np.int64) for s in rows["shingles"]]
        sizes, copies, nodes = np.array([len(s) for s in sets]), rows["copies"].to_numpy(), rows["node"].to_numpy()
        common = _intersections(sets, left, right)
        linked = common >= similarity * (sizes[left][:, None] + sizes[right][None] - common) - 1e-6
        if first == second:
            np.fill_diagonal(linked, False)
        mate, links = np.arange(len(rows)), np.zeros(len(rows), np.int64)
        links[left] += linked @ copies[right]
        if first != second:
            links[right] += copies[left] @ linked

        def root(i: int) -> int:
            while mate[i] != i:
                mate[i] = mate[mate[i]]
                i = mate[i]
            return i

        for a, b in zip(*np.nonzero(linked), strict=True):
            x, y = root(left[a]), root(right[b])
            mate[max(x, y)] = min(x, y)
        out = pd.DataFrame({"node": nodes, "links": links, "mate": [nodes[root(i)] for i in range(len(rows))]})
        return out[links > 0]

    return verify


def link_documents(docs: DataFrame, words: int = WORDS, similarity: float = SIMILARITY, recall: float = RECALL) -> DataFrame:
    """One row per document: doc_id, class_id (least document of its class), copy_of, n_links.

    ``class_id`` joins what links reach; ``copy_of`` is the least document with the same
    set; ``n_links`` counts the other documents that are linked to this one, copies included.
    """
    bands, rows = bands_and_rows(similarity, recall)
    signed = checkpointed(signatures(docs.filter(F.col("doc_id").isNotNull()), words, bands, rows).dropDuplicates(["doc_id"]))
    classes = checkpointed(signed.filter(F.col("fingerprint").isNotNull()).groupBy("fingerprint").agg(F.min("doc_id").alias("node"), F.count(F.lit(1)).alias("copies"), F.first("bands").alias("bands")))

    buckets = classes.select("node", F.posexplode("bands").alias("band", "h"))
    leaders = buckets.groupBy("band", "h").agg(F.min("node").alias("leader"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    ties = buckets.join(leaders, ["band", "h"]).filter("node <> leader").select(F.col("node").alias("u"), F.col("leader").alias("v"))
    groups = connected_components(ties)
    sizes = groups.groupBy("component").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    members = groups.join(sizes, "component").join(classes.select("node", "copies"), "node")
    members = checkpointed(members.select("node", "component", "copies", "blocks", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("block")))

    sets = _member_sets(docs, members, words)
    pairs = sets.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    pairs = pairs.select("component", F.least("block", "other").alias("first"), F.greatest("block", "other").alias("second"), "node", "copies", "block", "shingles")
    links = checkpointed(pairs.groupBy("component", "first", "second").applyInPandas(_verified(similarity), "node long, links long, mate long"))
    counts = links.groupBy("node").agg(F.sum("links").alias("links"))
    joined = connected_components(links.select(F.col("node").alias("u"), F.col("mate").alias("v")))
    found = classes.select("fingerprint", "node", "copies").join(joined, "node", "left").join(counts, "node", "left")
    found = found.select("fingerprint", F.coalesce("component", "node").alias("class_id"), F.col("node").alias("copy_of"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    out = signed.select("doc_id", "fingerprint").join(found, "fingerprint", "left")
    return out.select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("copy_of", "doc_id").alias("copy_of"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def _member_sets(docs: DataFrame, members: DataFrame, words: int) -> DataFrame:
    """``members`` with the whole n-gram sets of their documents."""
    texts = docs.select(F.col("doc_id").alias("node"), "text").join(members, "node")
    schema = struct(("node", T.LongType()), ("component", T.LongType()), ("copies", T.LongType()), ("blocks", T.IntegerType()), ("block", T.IntegerType()), ("shingles", T.ArrayType(T.LongType())))

    def make():
        shingler = Shingler(words)

        def step(cols):
            return {c: cols[c] for c in ("node", "component", "copies", "blocks", "block")} | {"shingles": [shingler(t).view(np.int64) for t in cols["text"]]}

        return step

    return arrow_map(texts, ["node", "component", "copies", "blocks", "block", "text"], make, schema)


def keep_one_each(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with one document of each class, the least; documents without links stay."""
    gone = link_documents(docs, **options).filter("doc_id <> class_id").select("doc_id")
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
