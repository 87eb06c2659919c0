"""What leaves the engine: chosen columns and rows, numbers, titles, text lines, and what a workbook says of itself."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from specloom.functions.text import export_number, text
from specloom.schema import CATALOG, EXPORTED, NOT_EXPORTED, NUMERIC

TITLES = {k: t for k, t, _ in CATALOG}
WIDTHS = {k: w for k, _, w in CATALOG}


def known_columns(wanted: Sequence[str]) -> list[str]:
    """The wanted columns that exist, in the order asked for, repeated ones repeated; an error if none is left."""
    known = [c for c in wanted if c in TITLES]
    if not known:
        raise ValueError("no known column is left to export")
    return known


def output_names(columns: Sequence[str]) -> list[str]:
    """A name for each column: its own, and ``<column>_2`` and so on where it is repeated."""
    seen: Counter[str] = Counter()
    out = []
    for c in columns:
        seen[c] += 1
        out.append(c if seen[c] == 1 else f"{c}_{seen[c]}")
    return out


def column_of(name: str) -> str:
    """The column that an output name stands for."""
    return name if name in TITLES else re.sub(r"_\d+$", "", name)


def exportable(only_exportable: bool = True) -> Column:
    """Rows that weren't deselected; with the rule only items and components and rows of no type."""
    chosen = ~F.col("selected").eqNullSafe(F.lit(False))
    return chosen & ~text("row_type").isin(*NOT_EXPORTED) if only_exportable else chosen


def holds_something(column: str) -> Column:
    """Whether the exported value of a column is anything: of a numeric one its number, or its text if it is none."""
    if column in NUMERIC:
        number, rest = export_number(F.col(column).cast("string"))
        return number.isNotNull() | (text(rest) != "")
    return text(F.col(column).cast("string")) != ""


def export_rows(rows: DataFrame, columns: Sequence[str] = EXPORTED, only_exportable: bool = True, keep: Sequence[str] = ()) -> DataFrame:
    """The exported columns of exportable rows that hold anything in them, as text; see output_names for repeated ones. keep: further columns to carry along, such as the order."""
    columns = known_columns(columns)
    some = F.exists(F.array(*[holds_something(c) for c in dict.fromkeys(columns)]), lambda v: v)
    return rows.where(exportable(only_exportable)).where(some).select(*keep, *[F.col(c).alias(n) for c, n in zip(columns, output_names(columns))])


def with_numbers(exported: DataFrame) -> DataFrame:
    """Numeric columns as numbers, and ``<column>_text`` where the text is no number."""
    out = exported
    for c in exported.columns:
        if column_of(c) in NUMERIC:
            number, rest = export_number(c)
            out = out.withColumns({c: number, f"{c}_text": rest})
    return out


def with_titles(exported: DataFrame) -> DataFrame:
    """Columns under their titles; others keep their names."""
    return exported.toDF(*[TITLES.get(column_of(c), c) for c in exported.columns])


def column_order(saved: Sequence[str]) -> list[str]:
    """The saved order, then the columns it doesn't name."""
    known = [c for c in dict.fromkeys(saved) if c in TITLES]
    return known + [k for k, _, _ in CATALOG if k not in known]


def column_order_of(saved: DataFrame, key: str, place: str) -> DataFrame:
    """place, column_key, title: the columns of a saved order by ``place``, then those of the catalog that it doesn't name. Unknown columns are left out."""
    catalog = saved.sparkSession.createDataFrame([(k, t, i) for i, (k, t, _) in enumerate(CATALOG)], "column_key string, title string, at int")
    named = saved.groupBy(F.col(key).alias("column_key")).agg(F.min(place).alias("saved"))
    order = Window.orderBy(F.col("saved").asc_nulls_last(), "at")  # a row per column of the catalog
    joined = catalog.join(named, "column_key", "left")
    return joined.select(F.row_number().over(order).alias("place"), "column_key", "title")


def tsv_line(columns: Sequence[str]) -> Column:
    """The columns of a row with tabs between; tabs and line breaks inside become blanks."""
    return F.concat_ws("\t", *[F.regexp_replace(text(F.col(c).cast("string")), r"[\t\r\n]+", " ") for c in columns])


def tsv_header(columns: Sequence[str]) -> str:
    return "\t".join(TITLES[c] for c in columns)


#: Fixed values. Titles of the sheet that says what was exported.
PROGRAM, EXPORTED_AT, EXPORTED_ROWS, EXPORTED_COLUMNS = "Программа", "Дата экспорта", "Экспортировано строк", "Столбцы"


def metadata_pairs(exported_rows: int, columns: Sequence[str], at: str, program: str = "specloom") -> list[tuple[str, str]]:
    """parameter, value of the second sheet of a workbook. at: dd.mm.yyyy HH:MM."""
    return [(PROGRAM, program), (EXPORTED_AT, at), (EXPORTED_ROWS, str(exported_rows)), (EXPORTED_COLUMNS, ", ".join(columns))]


def export_metadata(rows: DataFrame, columns: Sequence[str] = EXPORTED, only_exportable: bool = True, at: Column | None = None) -> DataFrame:
    """parameter, value: what was exported. at: the time of the export, the newest update among the rows if unset."""
    n = export_rows(rows, columns, only_exportable).agg(F.count("*").cast("string").alias("n"))
    when = rows.agg(F.date_format(F.max("updated_at") if at is None else F.max(at), "dd.MM.yyyy HH:mm").alias("at"))
    values = {PROGRAM: F.lit("specloom"), EXPORTED_AT: F.col("at"), EXPORTED_ROWS: F.col("n"), EXPORTED_COLUMNS: F.lit(", ".join(known_columns(columns)))}
    pairs = F.array(*[F.struct(F.lit(k).alias("parameter"), v.alias("value")) for k, v in values.items()])
    return n.crossJoin(F.broadcast(when)).select(F.inline(pairs))  # a row each
