"""Sentence continuation: pair features, a logistic scorer and its training, merged blocks."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quoin.functions import geometry as g
from quoin.functions.text import HEBREW, ends_sentence, has_unmatched_open, starts_with_bullet, word_count
from quoin.operators.spatial import prefixed

# Word lists of the Hebrew rules and the names of the features in order.
PREPOSITIONS = "בגין של על עם אל עבור לפי כגון כמו ללא בין תוך מתוך לפני אחרי בתוך".split()
PREFIXES = "ב ל מ ש ו ה כ".split()
SHORT_WORDS, DEFAULT_SIZE = 5, 10.0
FEATURES = ("ends_terminal_punct", "starts_bullet", "dangling_preposition", "single_letter_prefix", "unmatched_open", "short_b", "short_a", "both_short", "font_size_ratio", "vertical_gap_norm", "horizontal_gap_norm", "same_row", "bbox_width_ratio", "both_hebrew", "a_word_count", "b_word_count")


def dangling_preposition(text: Column) -> Column:
    return F.trim(text).rlike(r"(^|\s)(?:" + "|".join(PREPOSITIONS) + r")$")


def single_letter_prefix(text: Column) -> Column:
    return F.trim(text).rlike(r"(^|\s)[" + "".join(PREFIXES) + r"]$")


def pair_features(a: str = "a_", b: str = "b_") -> Column:
    """The 16 features of a pair of blocks with text, font_size and box columns under two prefixes, as one array.

    Ratios of sizes and widths are how much the larger exceeds the smaller; the gap beside each
    other counts on one row only.
    """
    ta, tb, ba, bb = F.col(f"{a}text"), F.col(f"{b}text"), g.box(a), g.box(b)
    na, nb = word_count(ta), word_count(tb)
    sizes = [F.when(F.col(f"{p}font_size") != 0, F.col(f"{p}font_size")).otherwise(F.lit(DEFAULT_SIZE)) for p in (a, b)]
    high, wide = F.greatest(g.height(ba), g.height(bb)), F.greatest(g.width(ba), g.width(bb))
    share = lambda x, of: F.when(of > 0, x / of).otherwise(F.lit(0.0))
    excess = lambda x, y: F.when(F.least(x, y) > 0, F.greatest(x, y) / F.least(x, y) - 1).otherwise(F.lit(0.0))
    values = [ends_sentence(ta), starts_with_bullet(tb), dangling_preposition(ta), single_letter_prefix(ta), has_unmatched_open(ta), nb < SHORT_WORDS, na < SHORT_WORDS, (na < SHORT_WORDS) & (nb < SHORT_WORDS), excess(*sizes), share(g.vertical_gap(ba, bb), high), F.when(g.same_row(ba, bb), share(g.horizontal_gap(ba, bb), wide)).otherwise(F.lit(0.0)), g.same_row(ba, bb), excess(g.width(ba), g.width(bb)), ta.rlike(HEBREW) & tb.rlike(HEBREW), na, nb]
    return F.array(*[v.cast("double") for v in values])


def score(features: Column, weights: list[float], bias: float) -> Column:
    """Linear score; a pair is merged above 0."""
    return F.aggregate(F.zip_with(features, F.array(*[F.lit(float(w)) for w in weights]), lambda x, w: x * w), F.lit(float(bias)), lambda acc, x: acc + x)


def probability(value: Column) -> Column:
    return 1 / (1 + F.exp(-value))


def train_logistic(rows: DataFrame, features: str, label: str, steps: int = 200, rate: float = 0.5, ridge: float = 1e-3) -> tuple[list[float], float]:
    """Full-batch gradient descent on a DataFrame; each step sums gradients on the executors, and only these reach the driver.

    Features are scaled by their means and deviations, which the weights then take back.
    """
    n = len(rows.select(features).first()[0])
    cols = [F.get(features, i) for i in range(n)]
    stats = rows.agg(F.count(F.lit(1)), *[F.avg(c) for c in cols], *[F.stddev_pop(c) for c in cols]).first()
    mean, spread = np.array(stats[1 : n + 1], float), np.maximum(np.array(stats[n + 1 :], float), 1e-6)
    held = rows.select(F.array(*[(c - float(m)) / float(s) for c, m, s in zip(cols, mean, spread, strict=True)]).alias("x"), F.col(label).cast("double").alias("y")).persist()
    w, b = np.zeros(n), 0.0
    for _ in range(steps):
        wrong = probability(score(F.col("x"), w.tolist(), b)) - F.col("y")
        got = held.select("x", wrong.alias("d")).agg(F.avg("d"), *[F.avg(F.get("x", i) * F.col("d")) for i in range(n)]).first()
        w -= rate * (np.array(got[1:], float) + ridge * w)
        b -= rate * float(got[0])
    held.unpersist()
    w = w / spread
    return w.tolist(), float(b - (w * mean).sum())


def barrier_between(pairs: DataFrame, barriers: DataFrame, keys: list[str], margin: float = 2.0, share: float = 0.3) -> DataFrame:
    """Pairs (a_, b_ boxes) without a rule in the gap between them that spans 30 % of the pair: an anti join on ranges."""
    a, b = g.box("a_"), g.box("b_")
    both = g.union(a, b)
    level = (F.col("axis") == "v") & F.col("pos").between(F.least(a.y1, b.y1) - margin, F.greatest(a.y0, b.y0) + margin) & (g.axis_overlap(F.col("lo"), F.col("hi"), both.x0, both.x1) >= share * (both.x1 - both.x0))
    up = (F.col("axis") == "h") & F.col("pos").between(F.least(a.x1, b.x1) - margin, F.greatest(a.x0, b.x0) + margin) & (g.axis_overlap(F.col("lo"), F.col("hi"), both.y0, both.y1) >= share * (both.y1 - both.y0))
    rules = barriers.select(*[F.col(k).alias(f"_{k}") for k in keys], "axis", "pos", "lo", "hi")
    return pairs.join(rules, [*[pairs[k] == rules[f"_{k}"] for k in keys], level | up], "left_anti")


def merged_block(groups: DataFrame, keys: list[str]) -> DataFrame:
    """Blocks of a group as one: ordered text, union box padded by 2, confidence at most 0.98, list of ids."""
    ordered = F.array_sort(F.collect_list(F.struct("reading_order", "block_id", "text")))
    texts = F.filter(F.transform(ordered, lambda x: F.trim(x["text"])), lambda t: t != "")
    out = groups.groupBy(*keys, "group_id").agg(F.array_join(texts, " ").alias("text"), F.transform(ordered, lambda x: x["block_id"]).alias("block_ids"), (F.min("x0") - 2).alias("x0"), (F.min("y0") - 2).alias("y0"), (F.max("x1") + 2).alias("x1"), (F.max("y1") + 2).alias("y1"), F.least(F.lit(0.98), F.min("confidence")).alias("confidence"))
    return out


def chained(pairs: list[tuple[int, int]]) -> list[list[int]]:
    """Chains of ordinals: from each start in order, the first later member that its tail accepts and no chain holds."""
    after: dict[int, list[int]] = {}
    for a, b in sorted(pairs):
        after.setdefault(a, []).append(b)
    held: set[int] = set()
    out = []
    for start in sorted(after):
        if start in held:
            continue
        chain = [start]
        while (step := next((b for b in after.get(chain[-1], ()) if b > chain[-1] and b not in held), None)) is not None:
            chain.append(step)
            held.add(step)
        if len(chain) > 1:
            out.append(chain)
    return out


def continuation_groups(blocks: DataFrame, pairs: DataFrame, keys: list[str]) -> DataFrame:
    """keys, group_id, position and block_id of the sentences that go on over blocks.

    ``blocks`` has block_id and ``at``, its place on the page; ``pairs`` the accepted ones, as
    places ``a`` < ``b``: scored above 0, near, and without a barrier or block between. Only
    accepted pairs of a page meet in a task.
    """

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        chains = chained(list(zip(rows["a"], rows["b"], strict=True)))
        found = [(*key, g_ + 1, i + 1, at) for g_, chain in enumerate(chains) for i, at in enumerate(chain)]
        return pd.DataFrame(found, columns=[*keys, "group_id", "position", "at"])

    kinds = ", ".join(f"{k} {pairs.schema[k].dataType.simpleString()}" for k in keys)
    chains = pairs.select(*keys, "a", "b").groupBy(*keys).applyInPandas(run, f"{kinds}, group_id int, position int, at long")
    return chains.join(blocks.select(*keys, "block_id", F.col("at").cast("long").alias("at")), [*keys, "at"]).select(*keys, "group_id", "position", "block_id")


def mergeable_pairs(blocks: DataFrame, groups: DataFrame, cells: DataFrame, keys: list[str]) -> DataFrame:
    """Keys and group_id of groups of exactly two text lines of one style in one cell.

    The cell is the smallest one with four walls that holds both blocks, and neither block lies
    in another one that is smaller by over one square point.
    """
    members = groups.join(blocks, [*keys, "block_id"])
    alike = members.groupBy(*keys, "group_id").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("type") == "text_line", F.col("style_id"))).alias("lines"), F.countDistinct("style_id").alias("styles"))
    two = members.join(alike.filter("n = 2 AND lines = 2 AND styles = 1").select(*keys, "group_id"), [*keys, "group_id"])
    held = prefixed(two, "a_", keys).join(prefixed(cells, "b_", keys), keys).filter(g.holds_center(g.box("b_"), g.box("a_")))
    by_cell = held.groupBy(*keys, "a_group_id", "b_cell_id").agg(F.count(F.lit(1)).alias("n"), F.first("b_walls").alias("walls"), F.first(g.area(g.box("b_"))).alias("area"))
    best = by_cell.groupBy(*keys, "a_group_id").agg(F.min(F.when((F.col("n") == 2) & (F.col("walls") == 4), F.col("area"))).alias("area"), F.min("area").alias("least"))
    return best.filter(F.col("least") >= F.col("area") - 1).select(*keys, F.col("a_group_id").alias("group_id"))


def merged_pairs(blocks: DataFrame, groups: DataFrame, cells: DataFrame, keys: list[str]) -> DataFrame:
    """``blocks`` with each mergeable pair as one block in the place of its first, numbered anew by reading order.

    A merged block has a free id ``p<page>_m<n>``, the first one's other columns, the union of the
    boxes, and the ids it was made of in ``merged_ids`` (null for other blocks).
    """
    wanted = groups.join(mergeable_pairs(blocks, groups, cells, keys), [*keys, "group_id"])
    ids = blocks.groupBy(*keys).agg(F.collect_set("block_id").alias("_used"))
    clean = F.trim(F.regexp_replace("text", r"\s+", " "))
    paired = wanted.join(blocks, [*keys, "block_id"])
    part = F.array_sort(F.collect_list(F.struct("position", "block_id", clean.alias("t"))))
    least = [F.min(c).alias(f"_{c}") for c in ("x0", "y0")] + [F.max(c).alias(f"_{c}") for c in ("x1", "y1")]
    one = paired.groupBy(*keys, "group_id").agg(part.alias("_parts"), *least, F.least(F.min("confidence"), F.lit(0.98)).alias("_confidence"), F.min_by("reading_order", "position").alias("_order"))
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy("group_id"))
    named = one.withColumn("_n", nth).join(ids, keys)
    name = lambda i: F.concat(F.lit("p"), F.col("page_id").cast("string"), F.lit("_m"), i.cast("string"))
    free = F.array_except(F.transform(F.sequence(F.lit(1), F.col("_n") + F.size("_used")), name), F.col("_used"))
    named = named.withColumn("_id", F.element_at(free, F.col("_n")))
    lead = named.select(*keys, F.col("_parts")[0]["block_id"].alias("block_id"), "_id", F.transform("_parts", lambda p: p["block_id"]).alias("merged_ids"), F.array_join(F.filter(F.transform("_parts", lambda p: p["t"]), lambda t: t != ""), " ").alias("_text"), "_x0", "_y0", "_x1", "_y1", F.coalesce("_confidence", F.lit(0.98)).alias("_confidence"))
    tails = wanted.filter("position = 2").select(*keys, "block_id")
    kept = blocks.join(tails, [*keys, "block_id"], "left_anti").join(lead, [*keys, "block_id"], "left")
    new = {"block_id": "_id", "text": "_text", "x0": "_x0", "y0": "_y0", "x1": "_x1", "y1": "_y1", "confidence": "_confidence"}
    order = F.row_number().over(Window.partitionBy(*keys).orderBy("reading_order", "block_id"))
    cols = [order.alias(c) if c == "reading_order" else F.when(F.col("merged_ids").isNotNull(), F.col(new[c])).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in blocks.columns]
    return kept.select(*cols, "merged_ids")
