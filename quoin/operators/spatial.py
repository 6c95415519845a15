"""Spatial joins. All carry the page keys as equi-keys, so Spark hashes on them and tests boxes as a residual;
``grid`` adds a band of y for pages with very many boxes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quoin.functions import geometry as g

# Reach of the nearest-entry join and of barriers.
NEAREST_Y, NEAREST_X_WEIGHT, BARRIER_MARGIN, BARRIER_SHARE = 6.0, 0.05, 1.5, 0.5


def prefixed(df: DataFrame, prefix: str, keys: list[str]) -> DataFrame:
    return df.select(*keys, *[F.col(c).alias(f"{prefix}{c}") for c in df.columns if c not in keys])


def banded(df: DataFrame, prefix: str, grid: float) -> DataFrame:
    """A row for each band of ``grid`` points that a box reaches."""
    b = g.box(prefix)
    return df.withColumn("_band", F.explode(F.sequence(F.floor(b.y0 / grid), F.floor(b.y1 / grid))))


def spatial_join(left: DataFrame, right: DataFrame, keys: list[str], condition: Column, grid: float | None = None) -> DataFrame:
    """Join boxes a_ and b_ of one page. With ``grid`` only boxes of a common band meet, each pair in the first one."""
    if grid is None:
        return left.join(right, keys).filter(condition)
    a, b = banded(left, "a_", grid), banded(right, "b_", grid)
    first = F.greatest(F.floor(F.col("a_y0") / grid), F.floor(F.col("b_y0") / grid))
    return a.join(b, [*keys, "_band"]).filter((F.col("_band") == first) & condition).drop("_band")


def best_by_area(items: DataFrame, candidates: DataFrame, keys: list[str], item: str, label: str, order: str) -> DataFrame:
    """For each item the label with the largest summed intersection, the first seen on ties: keys, item, label, area."""
    joined = prefixed(items, "a_", keys).join(prefixed(candidates, "b_", keys), keys)
    area = g.intersection_area(g.box("a_"), g.box("b_"))
    summed = joined.filter(area > 0).groupBy(*keys, f"a_{item}", f"b_{label}").agg(F.sum(area).alias("area"), F.min(f"b_{order}").alias("o"))
    best = summed.groupBy(*keys, f"a_{item}").agg(F.max_by(F.struct(f"b_{label}", "area"), F.struct(F.round("area", 6).alias("a"), (-F.col("o")).alias("o"))).alias("m"))
    return best.select(*keys, F.col(f"a_{item}").alias(item), F.col(f"m.b_{label}").alias(label), F.col("m.area").alias("area"))


def outside_of(lines: DataFrame, areas: DataFrame, keys: list[str], share: float = 0.5) -> DataFrame:
    """Lines of which no area covers ``share``: an anti join on boxes."""
    b = prefixed(areas, "b_", keys)
    same = [lines[k] == b[k] for k in keys]
    return lines.join(b, [*same, g.overlap_share(g.Box(*(lines[c] for c in ("x0", "y0", "x1", "y1"))), g.box("b_")) >= share], "left_anti")


def collisions(blocks: DataFrame, keys: list[str], item: str, exempt_seams: str | None = None) -> DataFrame:
    """Pairs of a page's blocks that collide, each once: keys, left, right. ``exempt_seams`` names a flag of table cells."""
    a, b = prefixed(blocks, "a_", keys), prefixed(blocks, "b_", keys)
    hit = g.collides(g.box("a_"), g.box("b_")) & (F.col(f"a_{item}") < F.col(f"b_{item}"))
    if exempt_seams:
        hit = hit & ~(F.col(f"a_{exempt_seams}") & F.col(f"b_{exempt_seams}") & g.table_seam(g.box("a_"), g.box("b_")))
    return a.join(b, keys).filter(hit).select(*keys, F.col(f"a_{item}").alias("left"), F.col(f"b_{item}").alias("right"))


def collision_lists(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """keys, item, collides_with (sorted) for every block with a collision."""
    both = pairs.select(*keys, F.col("left").alias("item"), F.col("right").alias("other")).union(pairs.select(*keys, "right", "left"))
    return both.groupBy(*keys, "item").agg(F.array_sort(F.collect_set("other")).alias("collides_with"))


def coverage(items: DataFrame, others: DataFrame, keys: list[str], item: str) -> DataFrame:
    """The largest overlap of an item with any other box, over the smaller area: keys, item, coverage."""
    joined = prefixed(items, "a_", keys).join(prefixed(others, "b_", keys), keys)
    share = g.overlap_on_smaller(g.box("a_"), g.box("b_"))
    return joined.groupBy(*keys, F.col(f"a_{item}").alias(item)).agg(F.max(share).alias("coverage"))


def nearest_entry(items: DataFrame, entries: DataFrame, keys: list[str], item: str, order: str) -> DataFrame:
    """For each item the entry (x, y) with the least |dy| + 0.05 |dx| among those within 6 points of y; first on ties."""
    e = prefixed(entries, "b_", keys)
    dy, dx = F.abs(F.col("b_y") - F.col("a_y1")), F.abs(F.col("b_x") - F.col("a_x0"))
    joined = prefixed(items, "a_", keys).join(e, keys).filter(dy <= NEAREST_Y)
    rank = F.struct(F.round(dy + NEAREST_X_WEIGHT * dx, 6).alias("d"), F.col(f"b_{order}"))
    best = joined.groupBy(*keys, F.col(f"a_{item}").alias(item)).agg(F.min_by(F.struct(*[c for c in e.columns if c.startswith("b_")]), rank).alias("m"))
    return best.select(*keys, item, "m.*")


def right_limit(blocks: DataFrame, barriers: DataFrame, keys: list[str], item: str) -> DataFrame:
    """Nearest upright rule to the right that covers half of a block's height, less a margin; null if none."""
    a, b = prefixed(blocks, "a_", keys), prefixed(barriers, "b_", keys)
    share = g.axis_overlap(F.col("a_y0"), F.col("a_y1"), F.col("b_lo"), F.col("b_hi")) / g.height(g.box("a_"))
    ahead = (F.col("b_pos") >= F.col("a_x1")) & (share >= BARRIER_SHARE)
    return a.join(b, keys, "left").groupBy(*keys, F.col(f"a_{item}").alias(item)).agg((F.min(F.when(ahead, F.col("b_pos"))) - BARRIER_MARGIN).alias("limit"))


def smallest_container(points: DataFrame, boxes: DataFrame, keys: list[str], item: str, label: str) -> DataFrame:
    """Each point (x, y) with the smallest box that contains it: keys, item, label."""
    b = prefixed(boxes, "b_", keys)
    hit = points.join(b, keys).filter(g.contains_point(g.box("b_"), F.col("x"), F.col("y"), 1.5))
    rank = F.struct(g.area(g.box("b_")).alias("a"), F.col(f"b_{label}"))
    return hit.groupBy(*keys, item).agg(F.min_by(f"b_{label}", rank).alias(label))


def words_in_regions(words: DataFrame, regions: DataFrame, keys: list[str], share: float = 0.55) -> DataFrame:
    """Words of each region: centre inside, contained, or covered by ``share``."""
    w, r = prefixed(words, "a_", keys), prefixed(regions, "b_", keys)
    a, b = g.box("a_"), g.box("b_")
    return w.join(r, keys).filter(g.holds_center(b, a) | g.inside(a, b) | (g.overlap_share(a, b) >= share))


def edge_crossings(edges: DataFrame, keys: list[str], tolerance: float = 3.0) -> DataFrame:
    """Points where upright rules (axis h: pos is x) and level ones (axis v: pos is y) meet within a tolerance."""
    up = edges.filter("axis = 'h'").select(*keys, F.col("pos").alias("x"), F.col("lo").alias("u_lo"), F.col("hi").alias("u_hi"))
    level = edges.filter("axis = 'v'").select(*keys, F.col("pos").alias("y"), F.col("lo").alias("l_lo"), F.col("hi").alias("l_hi"))
    meets = F.col("y").between(F.col("u_lo") - tolerance, F.col("u_hi") + tolerance) & F.col("x").between(F.col("l_lo") - tolerance, F.col("l_hi") + tolerance)
    return up.join(level, keys).filter(meets).groupBy(*keys, F.round("x", 3).alias("x"), F.round("y", 3).alias("y")).agg(F.count(F.lit(1)).alias("n"))


def cells_from_walls(edges: DataFrame, pages: DataFrame, keys: list[str]) -> DataFrame:
    """Cells between walls: four corners (page edges count as walls), three real walls, 10 points a side, 15 % of the page.

    Walls meet where their ends come within 12 points. Two upright and two level walls are joined through
    their common corners, not as a product of all four.
    """
    tol = g.CORNER_TOLERANCE
    real = edges.select(*keys, "axis", "pos", "lo", "hi", F.lit(1).alias("real"))
    frame = pages.select(*keys, F.explode(F.array(*[F.struct(F.lit(a).alias("axis"), p.alias("pos"), F.lit(0.0).alias("lo"), h.alias("hi")) for a, p, h in (("h", F.lit(0.0), F.col("height")), ("h", F.col("width"), F.col("height")), ("v", F.lit(0.0), F.col("width")), ("v", F.col("height"), F.col("width")))])).alias("e")).select(*keys, "e.*", F.lit(0).alias("real"))
    walls = real.unionByName(frame)
    up = walls.filter("axis = 'h'").select(*keys, F.col("pos").alias("x"), F.col("lo").alias("u_lo"), F.col("hi").alias("u_hi"), F.col("real").alias("u_real"))
    level = walls.filter("axis = 'v'").select(*keys, F.col("pos").alias("y"), F.col("lo").alias("l_lo"), F.col("hi").alias("l_hi"), F.col("real").alias("l_real"))
    meets = F.col("y").between(F.col("u_lo") - tol, F.col("u_hi") + tol) & F.col("x").between(F.col("l_lo") - tol, F.col("l_hi") + tol)
    corners = up.join(level, keys).filter(meets)
    one, two = prefixed(corners, "p_", keys), prefixed(corners, "q_", keys)
    # Both corners of an upright wall give its pair of level walls; two such pairs on the same level walls are a cell.
    same_wall = (F.col("p_x") == F.col("q_x")) & (F.col("p_u_lo") == F.col("q_u_lo")) & (F.col("p_u_hi") == F.col("q_u_hi")) & (F.col("p_u_real") == F.col("q_u_real")) & (F.col("q_y") - F.col("p_y") >= 10)
    sides = one.join(two, keys).filter(same_wall).select(*keys, F.col("p_x").alias("x"), F.col("p_u_real").alias("u_real"), F.col("p_y").alias("top"), F.col("q_y").alias("bottom"), F.struct("p_l_lo", "p_l_hi", "p_l_real").alias("t"), F.struct("q_l_lo", "q_l_hi", "q_l_real").alias("b"))
    right = sides.select(*keys, F.col("x").alias("x1"), F.col("u_real").alias("r_real"), "top", "bottom", "t", "b")
    cells = sides.join(right, [*keys, "top", "bottom", "t", "b"]).filter(F.col("x1") - F.col("x") >= 10)
    walls_n = F.col("u_real") + F.col("r_real") + F.col("t.p_l_real") + F.col("b.q_l_real")
    found = cells.select(*keys, F.col("x").alias("x0"), F.col("top").alias("y0"), "x1", F.col("bottom").alias("y1"), walls_n.alias("walls")).filter("walls >= 3")
    sized = found.join(pages, keys).filter(g.area(g.box()) <= 0.15 * F.col("width") * F.col("height"))
    return sized.groupBy(*keys, "x0", "y0", "x1", "y1").agg(F.max("walls").alias("walls"))


def shared_containers(groups: DataFrame, cells: DataFrame, keys: list[str], group: str) -> DataFrame:
    """Cells that hold the centres of all blocks of a group: relational division by counting."""
    members = groups.groupBy(*keys, group).agg(F.count(F.lit(1)).alias("_of"))
    held = prefixed(groups, "a_", keys).join(prefixed(cells, "b_", keys), keys).filter(g.holds_center(g.box("b_"), g.box("a_")))
    counts = held.groupBy(*keys, F.col(f"a_{group}").alias(group), "b_cell_id").agg(F.count(F.lit(1)).alias("_n"))
    return counts.join(members, [*keys, group]).filter("_n = _of").select(*keys, group, F.col("b_cell_id").alias("cell_id"))


def visible_page(pages: DataFrame, top: float, bottom: float) -> DataFrame:
    """The page of each document with most visible height in a viewport, the nearest to its top on ties."""
    seen = F.greatest(F.lit(0.0), F.least(F.col("y1"), F.lit(bottom)) - F.greatest(F.col("y0"), F.lit(top)))
    w = Window.partitionBy("document_id").orderBy(seen.desc(), F.abs(F.col("y0") - top), "page_id")
    return pages.withColumn("visible", seen).withColumn("_at", F.row_number().over(w)).filter("_at = 1").drop("_at")
