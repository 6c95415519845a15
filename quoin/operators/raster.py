"""Page rasters as NumPy kernels: rules, ink shares, components and logo candidates.

A raster is one row with width, height and gray bytes; rows are independent, so kernels run
in Arrow batches of pages.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# How dark a rule is and how much of a side it spans.
DARK, LEAST_SPAN, MOST_THICKNESS = 110, 0.12, 6


def gray_of(rgb: np.ndarray) -> np.ndarray:
    return (rgb[..., 0] * 0.299 + rgb[..., 1] * 0.587 + rgb[..., 2] * 0.114).astype(np.uint8)


def percentile_range(gray: np.ndarray, low: float = 0.02, high: float = 0.98) -> tuple[int, int]:
    """Gray levels at two shares of the histogram."""
    run = np.cumsum(np.bincount(gray.ravel(), minlength=256))
    return int(np.searchsorted(run, low * run[-1])), int(np.searchsorted(run, high * run[-1]))


def summed_area(values: np.ndarray) -> np.ndarray:
    out = np.zeros((values.shape[0] + 1, values.shape[1] + 1))
    out[1:, 1:] = values.cumsum(0).cumsum(1)
    return out


def rectangle_mean(table: np.ndarray, x0: int, y0: int, x1: int, y1: int) -> float:
    return (table[y1, x1] - table[y0, x1] - table[y1, x0] + table[y0, x0]) / max(1, (x1 - x0) * (y1 - y0))


def runs_of(dark: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """(line, from, to) of dark runs along rows of at least ``least`` pixels."""
    padded = np.pad(dark.astype(np.int8), ((0, 0), (1, 1)))
    step = np.diff(padded, axis=1)
    starts, ends = np.argwhere(step == 1), np.argwhere(step == -1)
    long = ends[:, 1] - starts[:, 1] >= least
    return [(int(r), int(a), int(b)) for (r, a), (_, b) in zip(starts[long], ends[long], strict=True)]


def find_rules(gray: np.ndarray, dark: int = DARK, span: float = LEAST_SPAN) -> list[tuple[str, float, float, float]]:
    """(axis, pos, lo, hi) of thin dark rules: axis v is level, axis h upright. Neighbouring lines of one rule are joined."""
    out = []
    for axis, plane in (("v", gray < dark), ("h", (gray < dark).T)):
        held: list[list[int]] = []
        for line, a, b in runs_of(plane, max(8, int(span * plane.shape[1]))):
            for h in held:
                if h[1] == line - 1 and min(h[3], b) - max(h[2], a) > 0.8 * min(h[3] - h[2], b - a):
                    h[1], h[2], h[3] = line, min(h[2], a), max(h[3], b)
                    break
            else:
                held.append([line, line, a, b])
        out += [(axis, (h[0] + h[1] + 1) / 2, float(h[2]), float(h[3])) for h in held if h[1] - h[0] < MOST_THICKNESS]
    return out


def pixel_components(binary: np.ndarray) -> list[tuple[int, int, int, int, int]]:
    """(x0, y0, x1, y1, area) of 8-connected components, by runs of rows joined through union-find."""
    runs = runs_of(binary, 1)
    parent = list(range(len(runs)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    by_row: dict[int, list[int]] = {}
    for i, (r, _, _) in enumerate(runs):
        by_row.setdefault(r, []).append(i)
    for r, here in by_row.items():
        above, j = by_row.get(r - 1, []), 0
        for i in here:
            while j < len(above) and runs[above[j]][2] < runs[i][1]:
                j += 1
            k = j
            while k < len(above) and runs[above[k]][1] <= runs[i][2]:
                a, b = root(i), root(above[k])
                parent[max(a, b)] = min(a, b)
                k += 1
    found: dict[int, list[int]] = {}
    for i, (r, a, b) in enumerate(runs):
        f = found.setdefault(root(i), [a, r, b, r + 1, 0])
        f[0], f[1], f[2], f[3], f[4] = min(f[0], a), min(f[1], r), max(f[2], b), max(f[3], r + 1), f[4] + b - a
    return [tuple(f) for f in found.values()]


def symmetry(binary: np.ndarray) -> float:
    """The larger share of pixels that agree with the left-right or the top-bottom mirror image."""
    if not binary.size:
        return 0.0
    return float(max((binary == binary[:, ::-1]).mean(), (binary == binary[::-1]).mean()))


def page_rules(rasters: DataFrame, keys: list[str]) -> DataFrame:
    """Rules of page rasters: keys, axis, pos, lo, hi in pixels."""

    def run(batches):
        for pages in batches:
            rows = []
            for page in pages.to_dict("records"):
                gray = np.frombuffer(page["gray"], np.uint8).reshape(page["height"], page["width"])
                rows += [[*(page[k] for k in keys), *r] for r in find_rules(gray)]
            yield pd.DataFrame(rows, columns=[*keys, "axis", "pos", "lo", "hi"])

    kinds = dict(rasters.dtypes)
    schema = ", ".join([f"{k} {kinds[k]}" for k in keys]) + ", axis string, pos double, lo double, hi double"
    return rasters.select(*keys, "width", "height", "gray").mapInPandas(run, schema)


def logo_candidates(regions: DataFrame, page_width: float, page_height: float) -> DataFrame:
    """Graphics near a page's upper corner, small and made of several drawings."""
    w, h = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    share = w * h / (page_width * page_height)
    near_side = (F.col("x0") <= 0.18 * page_width) | (F.col("x1") >= 0.82 * page_width)
    return regions.filter((F.col("y1") <= 0.22 * page_height) & near_side & share.between(0.0005, 0.08) & (w <= 0.18 * page_width) & (h <= 0.18 * page_height) & ((F.col("kind") == "image") | (F.col("drawing_count") >= 4)))


def masked(gray: np.ndarray, boxes: list[tuple[int, int, int, int]]) -> np.ndarray:
    """Regions painted white."""
    out = gray.copy()
    for x0, y0, x1, y1 in boxes:
        out[y0:y1, x0:x1] = 255
    return out


def stretched(gray: np.ndarray) -> np.ndarray:
    """Contrast stretched between the 2 % and 98 % levels."""
    low, high = percentile_range(gray)
    return np.clip((gray.astype(float) - low) * 255 / max(1, high - low), 0, 255).astype(np.uint8)


def _filtered(gray: np.ndarray, kernel: list[list[float]]) -> np.ndarray:
    padded, h, w = np.pad(gray.astype(float), 1, mode="edge"), *gray.shape
    return sum(kernel[i][j] * padded[i : i + h, j : j + w] for i in range(3) for j in range(3))


def blurred(gray: np.ndarray) -> np.ndarray:
    return _filtered(gray, [[1 / 16, 2 / 16, 1 / 16], [2 / 16, 4 / 16, 2 / 16], [1 / 16, 2 / 16, 1 / 16]])


def edges(gray: np.ndarray) -> np.ndarray:
    """Sobel magnitude by absolute sums."""
    return np.abs(_filtered(gray, [[-1, 0, 1], [-2, 0, 2], [-1, 0, 1]])) + np.abs(_filtered(gray, [[-1, -2, -1], [0, 0, 0], [1, 2, 1]]))


def dark_pixels(gray: np.ndarray, radius: int = 15, offset: float = 10.0) -> np.ndarray:
    """Pixels darker than the mean around them by an offset, through the summed-area table."""
    table, (h, w) = summed_area(gray), gray.shape
    y0, y1 = np.clip(np.arange(h) - radius, 0, h), np.clip(np.arange(h) + radius + 1, 0, h)
    x0, x1 = np.clip(np.arange(w) - radius, 0, w), np.clip(np.arange(w) + radius + 1, 0, w)
    total = table[y1][:, x1] - table[y0][:, x1] - table[y1][:, x0] + table[y0][:, x0]
    return gray < total / ((y1 - y0)[:, None] * (x1 - x0)[None]) - offset


def dilated(binary: np.ndarray) -> np.ndarray:
    p, (h, w) = np.pad(binary, 1), binary.shape
    return np.logical_or.reduce([p[i : i + h, j : j + w] for i in range(3) for j in range(3)])


def eroded(binary: np.ndarray) -> np.ndarray:
    return ~dilated(~binary)


def fnv1a(data: bytes) -> int:
    h = 2166136261
    for b in data:
        h = (h ^ b) * 16777619 & 0xFFFFFFFF
    return h
