"""Problem 1: one surviving record for each group of duplicate records, attribute by attribute.

One aggregation decides: every attribute takes the maximum of a composite struct, compared from left to
right: is there a value, can it be trusted, how whole is it, how sure is it, how late, and last the
identifier, so that the result never depends on the order of rows. The structs are combined on the map
side, so a group that holds a third of all rows is reduced before it is shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from specloom.llm.vocabulary import LETTER, Lexicon

#: A token of running text that is no word: a number with signs, a size, a diameter, a code of Latin capitals.
_FIGURE = r"^(?:[+№]?\d+(?:[.,]\d+)?|\d+(?:×\d+)+|Ø\d+(?:[.,]\d+)?|[IVX]+|[A-Z]{2,}\d*|[А-ЯЁA-Z]\d*)$"
#: Words of up to three letters aren't in the word list.
_SHORT = r"^[а-яё]{1,3}$"
_NUMBER = r"^[+-]?\d+(?:[.,]\d+)?$"


def survivors(df: DataFrame, keys: Sequence[str], fields: dict[str, tuple[Sequence[Column], Column]], *further: Column) -> DataFrame:
    """One row per distinct ``keys``. fields: name of the result -> (what decides, from left to right; the value). further: other aggregates.

    Nulls in a deciding expression lose against any value. Rows with a null key form a group of their own.
    An empty input gives an empty result. Columns not named are not looked at, whatever their names.
    """
    aggs = []
    for name, (order, value) in fields.items():
        rank = F.struct(*[c.alias(f"r{i}") for i, c in enumerate(order)])
        aggs.append(F.max(F.struct(rank.alias("rank"), value.alias("value")))["value"].alias(name))
    return df.groupBy(*keys).agg(*aggs, *further)


#: Sources by what their names begin with, from the least trusted: a page read whole, a column, a single cell.
PRIORITY = ("page-", "accurate-column", "cell-")


def source_priority(source: Column) -> Column:
    """How far a source is trusted: 0 for none or an unknown one."""
    out = F.lit(0)
    for i, start in enumerate(PRIORITY, 1):
        out = F.when(source.startswith(start), i).otherwise(out)
    return F.coalesce(out, F.lit(0))


def _words(text: Column) -> Column:
    return F.filter(F.split(F.regexp_replace(text, r"(?U)[,;:«»\s]+", " "), " "), lambda w: w != "")


def unreadable(column_key: Column, text: Column, lexicon: Lexicon) -> Column:
    """How many tokens of a reading can't have been printed in such a column; 0 for a clean reading.

    Running text must consist of listed words, short words and figures; marks of a listed beginning and
    figures; makers and units of listed entries; amounts of one number. A lexicon without entries of a kind
    lets every reading of that kind pass.
    """
    words = {w.lower() for w in lexicon.keys("word")}
    bare = lambda w: F.regexp_replace(w, r"^\(|\)$|\.$", "")
    known = lambda w: F.lower(w).isin(words) if words else F.lit(True)
    known_word = lambda w: F.when(known(w) | w.rlike(_SHORT) | F.lower(w).rlike(_SHORT) & w.rlike(rf"^[{LETTER}][а-яё]*$") | w.rlike(_FIGURE), True).otherwise(F.forall(F.split(w, "-"), lambda p: known(p)))
    running = F.size(F.filter(_words(text), lambda w: ~known_word(bare(w)))) + F.when(text.rlike(r"(?U)[|~^_#*=¬{}<>$@]|\s$"), 1).otherwise(0)
    listed = lambda kind: F.when(text.isin(lexicon.keys(kind)), 0).otherwise(1) if lexicon.keys(kind) else F.lit(0)
    marks = "|".join(rf"\Q{m}\E" for m in sorted(lexicon.keys("mark"), key=len, reverse=True)) or rf"[{LETTER}]+(?:-[{LETTER}]+)?"
    mark = F.when(text.rlike(rf"^(?:{marks})(?:[- ./×]?\d+)*(?:[- ][A-ZА-ЯЁ]| исп\. [IVX]+)?$"), 0).otherwise(1)
    number = F.when(text.rlike(_NUMBER), 0).otherwise(1)
    return (
        F.when(column_key.isin("name", "note"), running)
        .when(column_key == "type_mark", mark)
        .when(column_key == "manufacturer", listed("maker"))
        .when(column_key == "unit", listed("unit"))
        .when(column_key.isin("quantity", "mass"), number)
        .otherwise(F.lit(0))
    )


def reading_order(lexicon: Lexicon) -> list[Column]:
    """What makes a reading of a cell the better one, from left to right.

    There is a text; a pass read it (source ``none`` is the lowest priority); no token is unreadable; for
    text columns the longest (a cut reading is a beginning of the whole one); confidence; time; smallest id.
    """
    text, column = F.coalesce(F.col("text"), F.lit("")), F.col("column_key")
    return [
        F.trim(text) != "",
        F.coalesce(F.col("source"), F.lit("none")) != "none",
        -unreadable(column, text, lexicon),
        F.when(column.isin("quantity", "mass"), 0).otherwise(F.length(F.trim(text))),
        F.when(F.isnan("confidence"), None).otherwise(F.col("confidence")),
        F.col("read_at"),
        -F.col("result_id"),
    ]


def best_readings(cells: DataFrame, lexicon: DataFrame) -> DataFrame:
    """cell_id, result_id, readings: the surviving reading of each cell and how many readings it had.

    A cell of one reading keeps it. Where no reading has a text, confidence, time and id decide. A null
    text, confidence, source or read_at loses against a value; rows with a null cell_id are left out, for
    they belong to no cell. Readings delivered twice are ties that the smaller result_id wins.
    """
    rows = cells.where(F.col("cell_id").isNotNull()).select("cell_id", "result_id", "column_key", "text", "confidence", "source", "read_at")
    return survivors(rows, ["cell_id"], {"result_id": (reading_order(Lexicon.read(lexicon)), F.col("result_id"))}, F.count("*").alias("readings"))


def golden_cells(cells: DataFrame, lexicon: DataFrame) -> DataFrame:
    """cell_id, text, confidence, source, read_at: a record built field by field.

    text is the surviving reading's; confidence the highest given for a readable text; source the most
    trusted one that gave a readable text, then the one of the highest confidence; read_at the latest of any
    reading. Nulls as in best_readings.
    """
    rows = cells.where(F.col("cell_id").isNotNull())
    order = reading_order(Lexicon.read(lexicon))
    sure = [order[0], order[1], order[2] == 0, *order[4:]]
    return survivors(
        rows,
        ["cell_id"],
        {
            "text": (order, F.col("text")),
            "confidence": (sure, F.col("confidence")),
            "source": ([*sure[:3], source_priority(F.col("source")), *order[4:]], F.col("source")),
            "read_at": ([F.col("read_at")], F.col("read_at")),
        },
    )

