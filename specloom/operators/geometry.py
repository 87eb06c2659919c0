"""Lines of a page: runs of indexes, the best ten columns, the end of the table; masks of an image in numpy."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from specloom.schema import WIDTH_RATIOS


def runs(indexes: DataFrame, by: list[str], index: str) -> DataFrame:
    """by, line: the middle of each run of consecutive distinct indexes, halves to even."""
    distinct = indexes.select(*by, index).distinct()
    island = F.col(index) - F.row_number().over(Window.partitionBy(*by).orderBy(index))
    return distinct.withColumn("island", island).groupBy(*by, "island").agg(F.bround(F.avg(index), 0).cast("long").alias("line")).drop("island")


def best_columns(candidates: DataFrame, by: list[str], line: str, width: str, ratios: tuple[float, ...] = WIDTH_RATIOS, margin: bool = True) -> DataFrame:
    """by, lines: the ten neighbouring lines whose widths are nearest to the expected shares.

    A window must span 72 % of the width; the earliest of equal ones wins; without any the first ten, and
    with fewer than ten candidates all of them.
    """
    n = len(ratios) + 1
    w = Window.partitionBy(*by).orderBy(line)
    c = candidates.select(*by, line, width).distinct()
    c = c.withColumn("s", F.collect_list(line).over(w.rowsBetween(0, n - 1))).withColumn("at", F.row_number().over(w))
    span = F.element_at("s", -1) - F.get("s", F.lit(0))
    shares = [(F.get("s", F.lit(i + 1)) - F.get("s", F.lit(i))) / span for i in range(n - 1)]
    error = sum((F.abs(x - r) for x, r in zip(shares, ratios)), F.lit(0.0)) / (n - 1)
    if margin:
        error = error + F.abs(F.get("s", F.lit(0)) / F.col(width) - 0.045) * 0.04
    fits = (F.size("s") == n) & (span >= F.col(width) * 0.72)
    c = c.withColumn("error", F.when(fits, F.round(error, 12)))
    best = F.min(F.when(F.col("error").isNotNull(), F.struct("error", "at", "s")))["s"]
    first = F.min(F.when(F.col("at") == 1, F.struct("at", "s")))["s"]
    return c.groupBy(*by).agg(F.coalesce(best, first).alias("lines"))


def trim_footer(pages: DataFrame, by: list[str], lines: str) -> DataFrame:
    """by, lines: sorted lines up to the first gap, from the third on, over 2.15 times the median of the regular gaps.

    Regular gaps are below the upper quartile; without any, all count. Fewer than five lines stay as they
    are. One shuffle by page serves all windows.
    """
    w = Window.partitionBy(*by)
    at = pages.select(*by, F.posexplode(lines).alias("i", "line"))
    gap = (F.lead("line").over(w.orderBy("i")) - F.col("line")).cast("double")
    at = at.withColumn("gap", gap).withColumn("quartile", F.percentile("gap", F.lit(0.75)).over(w)).withColumn("all", F.percentile("gap", F.lit(0.5)).over(w))
    at = at.withColumn("regular", F.percentile(F.when(F.col("gap") < F.col("quartile"), F.col("gap")), F.lit(0.5)).over(w))
    large = (F.col("i") >= 2) & (F.col("gap") > F.coalesce("regular", "all") * 2.15)
    at = at.withColumn("cut", F.min(F.when(large, F.col("i"))).over(w)).withColumn("n", F.count("*").over(w))
    kept = at.where((F.col("n") < 5) | F.col("cut").isNull() | (F.col("i") <= F.col("cut")))
    return kept.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "line"))), lambda x: x["line"]).alias("lines"))


def expand_crop(x: Column, y: Column, w: Column, h: Column, width: Column, height: Column) -> Column:
    """A crop in fractions as pixels: padded by 3 % and 1.5 % (8 pixels at least), kept inside, 20 pixels at least."""
    px, py = F.greatest(F.lit(8), F.floor(width * 0.03)), F.greatest(F.lit(8), F.floor(height * 0.015))
    left = F.greatest(F.lit(0), F.least(F.floor(x * width) - px, width - 1))
    top = F.greatest(F.lit(0), F.least(F.floor(y * height) - py, height - 1))
    wide = F.greatest(F.lit(20), F.least(F.floor(w * width) + px * 2, width - left))
    high = F.greatest(F.lit(20), F.least(F.floor(h * height) + py * 2, height - top))
    return F.struct(left.cast("int").alias("left"), top.cast("int").alias("top"), wide.cast("int").alias("width"), high.cast("int").alias("height"))


def long_runs(dark: np.ndarray, least: int, along: int) -> np.ndarray:
    """Of a boolean image, the pixels in runs of at least ``least`` along an axis: an opening by a line."""
    m = dark if along == 1 else dark.T
    edges = np.diff(np.pad(m.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    out = np.zeros(m.shape, dtype=bool)
    for (r, a), (_, b) in zip(np.argwhere(edges == 1), np.argwhere(edges == -1)):
        if b - a >= least:
            out[r, a:b] = True
    return out if along == 1 else out.T


def line_masks(gray: np.ndarray, threshold: int = 205) -> tuple[np.ndarray, np.ndarray]:
    """(horizontal, vertical) masks of the ruled lines of a gray page."""
    dark = gray < threshold
    h, w = gray.shape
    return long_runs(dark, max(60, w // 28), 1), long_runs(dark, max(60, h // 24), 0)


def line_positions(covered: np.ndarray) -> list[int]:
    """The middles of runs of set positions, halves to even."""
    at = np.flatnonzero(covered)
    return [round(float(np.mean(g))) for g in np.split(at, np.flatnonzero(np.diff(at) > 1) + 1)] if len(at) else []


def vertical_candidates(vertical: np.ndarray, margin: bool = True) -> list[int]:
    h, w = vertical.shape
    found = line_positions(vertical[: int(h * 0.88)].sum(axis=0) > h * 0.45)
    return [x for x in found if not margin or w * 0.025 < x < w * 0.995]


def horizontal_candidates(horizontal: np.ndarray, left: int, right: int) -> list[int]:
    return [y for y in line_positions(horizontal[:, left : right + 1].sum(axis=1) > (right - left) * 0.80) if y > 5]
