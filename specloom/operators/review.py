"""Review of result rows: filters, counters, summaries, edits."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from specloom.functions.text import text
from specloom.schema import COLUMNS, SYSTEM_COLUMNS
from specloom.session import checked_broadcast


def review_filter(row_type: str | None = None, status: str | None = None, search: str | None = None) -> Column:
    """A type, a status, and a text found in any of the fifteen columns whatever its letter case."""
    out = F.lit(True)
    if row_type:
        out = out & (F.col("row_type") == row_type)
    if status:
        out = out & (F.col("status") == status)
    if search:
        found = [F.contains(F.lower(text(F.col(c).cast("string"))), F.lit(search.lower())) for c in (*COLUMNS, *SYSTEM_COLUMNS)]
        out = out & reduce(lambda a, b: a | b, found)
    return out


def is_selected() -> Column:
    """The reviewer's choice, by default items and components."""
    return F.coalesce("selected", F.col("row_type").isin("item", "component"))


def counters(rows: DataFrame, *by: str) -> DataFrame:
    """total, ready, review, selected."""
    n = lambda c: F.count_if(c)
    return rows.groupBy(*by).agg(
        F.count("*").alias("total"),
        n(F.col("status").isin("recognized", "verified", "edited")).alias("ready"),
        n(F.col("status").isin("review", "unrecognized")).alias("review"),
        n(is_selected()).alias("selected"),
    )


def review_filters(rows: DataFrame, filters: Sequence[tuple[str | None, str | None, str | None]], key: str) -> DataFrame:
    """filter_id and ``key`` of the rows that each of several filters keeps (row type, status, search; see review_filter), in one pass."""
    kept = F.array(*[F.when(review_filter(*f), F.lit(i)) for i, f in enumerate(filters)])
    return rows.select(F.explode(F.filter(kept, lambda i: i.isNotNull())).alias("filter_id"), key)


def summary(rows: DataFrame, errors: DataFrame | None = None) -> DataFrame:
    """what, value, n: rows in all, by status and by type, in one pass over the rows; and pages with errors, if such are given as (document_id, page)."""
    kinds = F.array(F.struct(F.lit("total").alias("what"), F.lit("").alias("value")), F.struct(F.lit("status").alias("what"), text("status").alias("value")), F.struct(F.lit("row_type").alias("what"), text("row_type").alias("value")))
    few = rows.groupBy("status", "row_type").agg(F.count("*").alias("n"))
    out = few.select("n", F.inline(kinds)).groupBy("what", "value").agg(F.sum("n").alias("n"))
    if errors is None:
        return out
    pages = errors.select("document_id", "page").distinct().agg(F.count("*").alias("n"))
    return out.unionByName(pages.select(F.lit("page_errors").alias("what"), F.lit("").alias("value"), "n"))


def rows_by_id(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """The rows whose ``key`` is in ``ids``; each row once however often it is asked for. Null keys find nothing."""
    return rows.join(ids.select(key).where(F.col(key).isNotNull()).distinct(), key, "left_semi")


def first_errors(errors: DataFrame, by: list[str], order: list[str], message: str, n: int = 3) -> DataFrame:
    """by, messages: the first n distinct messages in order, joined. Each message is reduced to its first place before any is ranked."""
    at = errors.groupBy(*by, message).agg(F.min(F.struct(*order)).alias("at"))
    ranked = at.withColumn("r", F.row_number().over(Window.partitionBy(*by).orderBy("at", message))).where(F.col("r") <= n)
    return ranked.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("r", F.col(message).alias("m")))).alias("x")).select(*by, F.array_join(F.transform("x", lambda x: x["m"]), "; ").alias("messages"))


def latest_edits(edits: DataFrame, key: str, value: str, order: list[str]) -> DataFrame:
    """key, value of the last edit of each row. Nulls say nothing."""
    e = edits.where(F.col(key).isNotNull() & F.col(value).isNotNull())
    return e.groupBy(key).agg(F.max(F.struct(*order, value))[value].alias("new_value"))


def merge_edits(rows: DataFrame, edits: DataFrame, key: str, column: str, value: str, order: list[str]) -> DataFrame:
    """rows with the last edit of ``column`` taken over, and ``edited``: whether there was one that changed it."""
    joined = rows.join(checked_broadcast(latest_edits(edits, key, value, order)), key, "left")
    changed = F.col("new_value").isNotNull() & ~F.col("new_value").eqNullSafe(F.col(column))
    return joined.withColumn("edited", changed).withColumn(column, F.coalesce("new_value", F.col(column))).drop("new_value")


def status_after_edit(status: Column, edited: Column) -> Column:
    return F.when(edited & (status != "verified"), "edited").otherwise(status)
