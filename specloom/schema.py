"""Columns, enumerations, thresholds: what the operators share."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

COLUMNS = ("position_no", "name", "type_mark", "code", "manufacturer", "unit", "quantity", "mass", "note")
SYSTEM_COLUMNS = ("section_name", "system_name", "row_type", "page", "confidence", "status")
#: Fixed values. Titles and widths of the columns, in order.
CATALOG = (
    ("position_no", "Позиция", 14),
    ("name", "Наименование и техническая характеристика", 56),
    ("type_mark", "Тип / марка / обозначение", 34),
    ("code", "Код оборудования", 24),
    ("manufacturer", "Производитель", 28),
    ("unit", "Единица измерения", 18),
    ("quantity", "Количество", 14),
    ("mass", "Масса единицы, кг", 17),
    ("note", "Примечание", 38),
    ("section_name", "Раздел", 20),
    ("system_name", "Система", 16),
    ("row_type", "Тип строки", 18),
    ("page", "Страница PDF", 14),
    ("confidence", "Уверенность, %", 17),
    ("status", "Статус", 18),
)
#: Fixed values. The columns exported by default; row types, those that aren't exported, and statuses.
EXPORTED = ("name", "type_mark", "manufacturer", "unit", "quantity", "note")
NUMERIC = ("quantity", "mass")
ROW_TYPES = ("item", "component", "section", "system", "note", "skip")
NOT_EXPORTED = ("section", "system", "note", "skip")
STATUSES = ("recognized", "review", "verified", "edited", "unrecognized")
#: Fixed values. Units that stand in a finished sheet.
UNITS = ("шт.", "м", "м²", "м³", "кг", "компл.", "п.м.", "л", "к-т")
#: Fixed values. Confidence below which a cell is read again.
THRESHOLDS = {"position_no": 55, "name": 62, "type_mark": 58, "code": 55, "manufacturer": 58, "unit": 78, "quantity": 82, "mass": 80, "note": 48}
#: Fixed values. Stems of section headings, and how a system's code is built.
SECTION_STEMS = ("вентиляц", "кондиционир", "отоплен", "теплоснабжен", "холодоснабжен")
#: Fixed values. Expected share of each column in the width of the table.
WIDTH_RATIOS = (0.051, 0.329, 0.152, 0.089, 0.111, 0.051, 0.051, 0.061, 0.105)


#: Fixed values. How a page is read: pass, languages, page layout, enlargement, characters allowed; and the columns read enlarged by less.
PASS_OF_COLUMN = "accurate-column-"
PAGE_PASSES = (("page-mixed", "rus+eng"), ("page-rus", "rus"))
WIDE_COLUMNS = ("name", "type_mark", "manufacturer", "note")
WHITELIST = {"quantity": "0123456789.,-", "mass": "0123456789.,-", "unit": "штмкгкомпл.²³-п"}


def column_scale(key: str) -> float:
    """Fixed values. By how much a column is enlarged before it is read."""
    return 1.55 if key in WIDE_COLUMNS else 2.0


def cell_scale(key: str) -> float:
    """Fixed values. By how much a single cell is enlarged before it is read."""
    return 4.5 if key in ("unit", "quantity", "mass", "position_no") else 3.0


def language_of(key: str) -> str:
    """Fixed values. The languages a column is read in."""
    return "eng" if key in NUMERIC else "rus" if key == "unit" else "rus+eng" if key in ("name", "note") else "eng+rus"


def reading_plan(accurate: bool = True) -> list[tuple[str, int, str | None, str, int, float, str | None]]:
    """pass_name, pass_ordinal, column_key, language, layout, scale, allowed: all passes over a page, then over columns, then over a single cell."""
    plan: list[tuple[str, str | None, str, int, float, str | None]] = [(name, None, language, 6, 1.0, None) for name, language in PAGE_PASSES]
    if accurate:
        plan += [(PASS_OF_COLUMN + k, k, language_of(k), 11, column_scale(k), None) for k in COLUMNS]
    mode = "accurate" if accurate else "standard"
    for k in COLUMNS:
        tries = 2 if accurate and k in WIDE_COLUMNS else 1
        plan += [(f"cell-{mode}-{i}", k, language_of(k), 6 if k in ("name", "note") else 7, cell_scale(k), WHITELIST.get(k)) for i in range(1, tries + 1)]
    return [(name, i, *rest) for i, (name, *rest) in enumerate(plan)]


@dataclass(frozen=True)
class Profile:
    """A kind of sheet: its columns, where its rows begin, what counts as a table."""

    columns: tuple[str, ...] = COLUMNS
    header_rows: int = 2
    least_rows: int = 5
    ratios: tuple[float, ...] = WIDTH_RATIOS
    thresholds: dict[str, int] = field(default_factory=lambda: dict(THRESHOLDS))
    refinements: int = 8


BBOX = T.StructType([T.StructField(k, T.DoubleType()) for k in ("x", "y", "width", "height")])
RESULT_ROW = T.StructType(
    [T.StructField("document_id", T.StringType()), T.StructField("row_id", T.StringType()), T.StructField("row_order", T.LongType())]
    + [T.StructField(c, T.StringType()) for c in COLUMNS]
    + [T.StructField(c, T.StringType()) for c in ("section_name", "system_name", "row_type")]
    + [T.StructField("page", T.IntegerType()), T.StructField("confidence", T.DoubleType()), T.StructField("status", T.StringType()), T.StructField("bbox", BBOX)]
    + [T.StructField("confidences", T.MapType(T.StringType(), T.DoubleType())), T.StructField("ocr_sources", T.MapType(T.StringType(), T.StringType()))]
    + [T.StructField("source_row", T.StringType()), T.StructField("edited", T.BooleanType()), T.StructField("selected", T.BooleanType())]
)
