"""Page expressions and page sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_ITEM = r"^(\d+)(?:[-–—](\d+))?$"


def page_items(expression: Column) -> Column:
    """The parts of an expression such as "18-20, 22": parted by commas, semicolons or blanks, blanks around dashes ignored."""
    tight = F.regexp_replace(F.coalesce(expression, F.lit("")), r"\s*([-–—])\s*", "$1")
    return F.filter(F.split(tight, r"[,;\s]+"), lambda p: p != "")


def page_problem(expression: Column, page_count: Column) -> Column:
    """Null for a good expression, else the first bad part."""
    bad = F.filter(page_items(expression), lambda p: ~p.rlike(_ITEM) | ~_within(p, page_count))
    return F.get(bad, F.lit(0))


def _ends(part: Column) -> tuple[Column, Column]:
    a = F.regexp_extract(part, _ITEM, 1).try_cast("int")
    b = F.regexp_extract(part, _ITEM, 2)
    return a, F.when(b == "", a).otherwise(b.try_cast("int"))


def _within(part: Column, page_count: Column) -> Column:
    a, b = _ends(part)
    return F.coalesce((F.least(a, b) >= 1) & (F.greatest(a, b) <= page_count), F.lit(False))


def parse_pages(df: DataFrame, key: str, expression: str, page_count: str) -> DataFrame:
    """key, page: the distinct pages of each good expression; a reversed range counts as the range. Bad ones give no row, see page_problem."""
    good = df.where(page_problem(F.col(expression), F.col(page_count)).isNull())
    part = good.select(key, F.explode(page_items(F.col(expression))).alias("part"))
    a, b = _ends(F.col("part"))
    return part.select(key, F.explode(F.sequence(F.least(a, b), F.greatest(a, b))).alias("page")).distinct()


def page_runs(pages: DataFrame, by: str, page: str = "page", block: int = 4096) -> DataFrame:
    """by, a, b: first and last page of each run of consecutive distinct pages.

    Runs are found within blocks of pages first, so that a large document doesn't fall to one task, and
    runs that meet at the edge of a block are joined.
    """
    d = pages.where(F.col(page).isNotNull()).select(by, page).distinct().withColumn("_block", F.floor(F.col(page) / block))
    island = F.col(page) - F.row_number().over(Window.partitionBy(by, "_block").orderBy(page))
    r = d.withColumn("_i", island).groupBy(by, "_block", "_i").agg(F.min(page).alias("a"), F.max(page).alias("b"))
    w = Window.partitionBy(by).orderBy("a")
    r = r.withColumn("_new", F.when(F.col("a") == F.lag("b").over(w) + 1, 0).otherwise(1)).withColumn("_run", F.sum("_new").over(w))
    return r.groupBy(by, "_run").agg(F.min("a").alias("a"), F.max("b").alias("b")).drop("_run")


def compact_pages(pages: DataFrame, by: str, page: str = "page") -> DataFrame:
    """by, ranges: the distinct pages as "1-3, 5"."""
    span = F.when(F.col("a") == F.col("b"), F.col("a").cast("string")).otherwise(F.concat(F.col("a").cast("string"), F.lit("-"), F.col("b").cast("string")))
    parts = page_runs(pages, by, page).groupBy(by).agg(F.array_sort(F.collect_list(F.struct("a", span.alias("s")))).alias("xs"))
    return parts.select(by, F.array_join(F.transform("xs", lambda x: x["s"]), ", ").alias("ranges"))


def table_pages(grid: DataFrame, columns: int = 9, rows: int = 5) -> DataFrame:
    """Pages that hold a table: nine columns and five rows at least."""
    return grid.where((F.size("x_lines") - 1 == columns) & (F.size("y_lines") - 1 >= rows)).select("document_id", "page")


def known_pages(wanted: DataFrame, existing: DataFrame) -> DataFrame:
    """Distinct wanted pages that exist."""
    return wanted.select("document_id", "page").distinct().join(existing.select("document_id", "page"), ["document_id", "page"], "left_semi")
