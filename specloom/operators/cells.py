"""From recognised words to cells: bucketing, assembly, choice of reading, noise, retries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from specloom.functions.text import NUMBER, ORDINARY, confidence, normalize_by_key, plausibility, round1, strip, text
from specloom.operators.spelling import CORRECTED, correct_texts
from specloom.schema import COLUMNS, NUMERIC, PASS_OF_COLUMN, THRESHOLDS, UNITS, Profile, column_scale
from specloom.session import checked_broadcast, cut

PAGE = ["document_id", "page"]


def axis(grid: DataFrame, lines: str, index: str, low: str, high: str) -> DataFrame:
    """One row per interval between neighbouring lines of a page."""
    pairs = F.transform(F.sequence(F.lit(0), F.size(lines) - 2), lambda i: F.struct(i.alias(index), F.get(F.col(lines), i).alias(low), F.get(F.col(lines), i + 1).alias(high)))
    return grid.where(F.size(lines) > 1).select(*PAGE, F.inline(pairs))


def bucket_tokens(tokens: DataFrame, grid: DataFrame, profile: Profile = Profile()) -> DataFrame:
    """tokens with the ``row_no`` and ``col_no`` of their centre; words outside the rows are left out.

    A centre on a line belongs to the cell left of or above it. One equi-join on the page and axis with a
    range residual each: small grids are broadcast after a count, large ones shuffled by page.
    """
    centred = tokens.where(strip("text") != "").withColumn("cx", F.col("left_px") + F.col("width_px") / 2).withColumn("cy", F.col("top_px") + F.col("height_px") / 2)
    cols = checked_broadcast(axis(grid, "x_lines", "col_no", "x0", "x1").where(F.col("col_no") < len(profile.columns)))
    rows = checked_broadcast(axis(grid, "y_lines", "row_no", "y0", "y1").where(F.col("row_no") >= profile.header_rows))
    placed = centred.join(cols, PAGE).where((F.col("cx") > F.col("x0")) & (F.col("cx") <= F.col("x1")))
    placed = placed.join(rows, PAGE).where((F.col("cy") > F.col("y0")) & (F.col("cy") <= F.col("y1")))
    return placed.drop("cx", "cy", "x0", "x1", "y0", "y1")


def cell_texts(placed: DataFrame) -> DataFrame:
    """document_id, page, row_no, col_no, pass_name, pass_ordinal, text, confidence: the words of a cell and pass in order.

    A word delivered twice counts once. The text isn't normalised yet.
    """
    word = F.struct("block_num", "par_num", "line_num", "word_num", strip("text").alias("t"), confidence("conf").alias("c"))
    words = F.array_sort(F.array_distinct(F.collect_list(word)))
    grouped = placed.groupBy(*PAGE, "row_no", "col_no", "pass_name", "pass_ordinal").agg(words.alias("w"))
    mean = F.aggregate("w", F.lit(0.0), lambda a, x: a + x["c"]) / F.size("w")
    return grouped.select(*PAGE, "row_no", "col_no", "pass_name", "pass_ordinal", F.array_join(F.transform("w", lambda x: x["t"]), " ").alias("text"), mean.alias("confidence"))


def numbered_candidates(texts: DataFrame) -> DataFrame:
    """texts with ``place``: the order of the candidates of a cell, those of page passes, of column passes, then of single cells, each by their pass."""
    stage = F.when(F.col("pass_name").startswith("page-"), 0).when(F.col("pass_name").startswith(PASS_OF_COLUMN), 1).otherwise(2)
    w = Window.partitionBy(*PAGE, "row_no", "col_no").orderBy(stage, "pass_ordinal", "pass_name")
    return texts.withColumn("place", F.row_number().over(w))


def key_of(col_no: Column, profile: Profile = Profile()) -> Column:
    return F.get(F.array(*[F.lit(c) for c in profile.columns]), col_no)


def source_bonus(source: Column) -> Column:
    return F.when(source.startswith("cell-"), 10.0).when(source.startswith("accurate-column"), 2.0).otherwise(0.0)


def score(key: Column, value: Column, conf: Column, source: Column) -> Column:
    return conf + plausibility(key, value) + source_bonus(source)


def choose_reading(candidates: DataFrame, by: list[str], ordinal: str, key: str = "column_key", value: str = "text", conf: str = "confidence", source: str = "source", judged: str | None = None) -> DataFrame:
    """by, text, confidence, source: the candidate of the highest score, the first of equal ones; ('', 0, 'none') without any.

    judged: the column with the normalised text that plausibility is told from, if ``value`` isn't normalised. One
    aggregation with partial maxima over a composite struct, without a window over the candidates.
    """
    v, c, s = text(value), confidence(conf), F.coalesce(F.col(source), F.lit("none"))
    rank = F.when(v != "", F.struct(score(F.col(key), text(judged or value), c, s).alias("score"), (-F.col(ordinal)).alias("o"), v.alias("text"), c.alias("confidence"), s.alias("source")))
    best = candidates.groupBy(*by).agg(F.max(rank).alias("b"))
    return best.select(*by, F.coalesce("b.text", F.lit("")).alias("text"), F.coalesce("b.confidence", F.lit(0.0)).alias("confidence"), F.coalesce("b.source", F.lit("none")).alias("source"))


def with_judged(readings: DataFrame, key: str = "column_key", value: str = "text", name: str = "judged") -> DataFrame:
    """readings with their texts normalised by column, beside the texts as they are."""
    return normalize_by_key(readings.withColumn(name, F.col(value)), key, name)


def remove_noise(key: Column, value: Column, conf: Column) -> Column:
    """'' for what is dirt in its column, else the value."""
    compact = F.lower(strip(value))
    dirt = ~key.isin(*NUMERIC) & compact.isin("о", "o", "0", "_", "|", ".") & (conf < 72)
    unit = (key == "unit") & ~F.lower(value).isin(*UNITS, "комплект") & (F.length(value) <= 5)
    position = (key == "position_no") & ~value.rlike("[0-9IVXLСА-ЯA-Z]")
    return F.when(dirt | unit | position, "").otherwise(value)


def needs_number(key: Column, value: Column) -> Column:
    return key.isin(*NUMERIC) & (value != "") & ~value.rlike(NUMBER)


def doubtful(key: Column, value: Column, conf: Column, thresholds: dict[str, int] | None = None) -> Column:
    """Whether a cell should be read again."""
    limit = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in (thresholds or THRESHOLDS).items() for x in kv]), key), F.lit(55))
    return (
        F.when(value == "", key.isin("unit", *NUMERIC))
        .when(conf < limit, True)
        .when(key.isin(*NUMERIC), ~value.rlike(NUMBER))
        .when(key == "unit", ~value.isin(*UNITS))
        .when(key.isin("name", "note"), F.regexp_count(value, F.lit(ORDINARY)) >= 2)
        .otherwise(False)
    )


def refinement_budget(cells: DataFrame, order: list[str], by: list[str] = PAGE, budget: int = 8) -> DataFrame:
    """The first ``budget`` doubtful cells of each page, in order; wants a boolean ``doubtful``."""
    w = Window.partitionBy(*by).orderBy(*order)
    return cells.where("doubtful").withColumn("turn", F.row_number().over(w)).where(F.col("turn") <= budget)


def back_fill(rows: DataFrame, unit_again: str, quantity_again: str, unit_confidence: str) -> DataFrame:
    """Unit or quantity of a row that has one of them filled from a second reading, the unit without noise."""
    item = F.concat("name", "type_mark", "manufacturer") != ""
    again = remove_noise(F.lit("unit"), text(unit_again), F.col(unit_confidence))
    unit = F.when(item & (F.col("quantity") != "") & (F.col("unit") == "") & (text(unit_again) != ""), again).otherwise(F.col("unit"))
    filled = rows.withColumn("unit", unit)
    quantity = F.when(item & (F.col("unit") != "") & (F.col("quantity") == "") & (text(quantity_again) != ""), text(quantity_again)).otherwise(F.col("quantity"))
    return filled.withColumn("quantity", quantity)


def column_pass_tokens(tokens: DataFrame, grid: DataFrame, profile: Profile = Profile()) -> DataFrame:
    """Words of column passes with the row_no and col_no of their cell.

    A column pass reads one column from the first data row down, enlarged: pass_name ends in the column's key, and
    heights are divided by its scale before they are compared with the lines of the page. A centre on a line belongs to
    the cell above it.
    """
    columns = [(PASS_OF_COLUMN + k, i, column_scale(k)) for i, k in enumerate(profile.columns)]
    passes = tokens.sparkSession.createDataFrame(columns, "pass_name string, col_no int, scale double")
    first = grid.select(*PAGE, F.get("y_lines", F.least(F.lit(profile.header_rows), F.size("y_lines") - 1)).alias("top_line"))
    words = tokens.where(strip("text") != "").join(F.broadcast(passes), "pass_name").join(checked_broadcast(first), PAGE)  # a row per column
    rows = checked_broadcast(axis(grid, "y_lines", "row_no", "y0", "y1").where(F.col("row_no") >= profile.header_rows))
    words = words.withColumn("cy", F.col("top_line") + (F.col("top_px") + F.col("height_px") / 2) / F.col("scale"))
    return words.join(rows, PAGE).where((F.col("cy") > F.col("y0")) & (F.col("cy") <= F.col("y1"))).drop("cy", "y0", "y1", "scale", "top_line")


def is_again(source: Column) -> Column:
    """Whether a reading comes from a single cell that was read again."""
    return source.startswith("cell-")


def doubtful_cells(cells: DataFrame, by: list[str], accurate: bool, profile: Profile = Profile()) -> DataFrame:
    """by, column_key of the cells that are read again for their text: numbers that are none, and in accurate mode the first doubtful cells of each page, in the order of rows and columns, up to the budget."""
    key, value = F.col("column_key"), F.col("text")
    numbers = cells.where(needs_number(key, value)).select(*by, "column_key")
    if not accurate:
        return numbers
    place = F.array_position(F.array(*[F.lit(c) for c in profile.columns]), key)
    flagged = cells.withColumn("doubtful", doubtful(key, value, F.col("confidence"), profile.thresholds)).withColumn("place", place)
    return numbers.unionByName(refinement_budget(flagged, ["row_no", "place"], PAGE, profile.refinements).select(*by, "column_key")).distinct()


def missing_amounts(cells: DataFrame, by: list[str]) -> DataFrame:
    """by, column_key of missing units beside a quantity and missing quantities beside a unit, in rows that name something."""
    of = lambda k: F.max(F.when(F.col("column_key") == k, F.col("text")))
    held = cells.groupBy(*by).agg(*[F.coalesce(of(k), F.lit("")).alias(k) for k in ("name", "type_mark", "manufacturer", "unit", "quantity")])
    has = lambda k: F.col(k) != ""
    lacks = F.when(has("quantity") & ~has("unit"), "unit").when(has("unit") & ~has("quantity"), "quantity")
    return held.where(has("name") | has("type_mark") | has("manufacturer")).select(*by, lacks.alias("column_key")).where(F.col("column_key").isNotNull())


def wanted_again(cells: DataFrame, accurate: bool = True, profile: Profile = Profile()) -> DataFrame:
    """document_id, page, row_no, column_key of all cells for which a reader of words is to be asked again."""
    by = [*PAGE, "row_no"]
    return doubtful_cells(cells, by, accurate, profile).unionByName(missing_amounts(cells, by)).distinct()


def read_again(cells: DataFrame, again: DataFrame, by: list[str], accurate: bool, profile: Profile = Profile()) -> DataFrame:
    """cells (by, column_key, text, confidence, source) with second readings of the doubtful ones: both readings compete. Cells without a second reading stay. again: the same columns, one row a cell."""
    second = again.join(doubtful_cells(cells, by, accurate, profile), [*by, "column_key"], "left_semi").withColumn("ordinal", F.lit(1))
    return choose_reading(cells.withColumn("ordinal", F.lit(0)).unionByName(second), [*by, "column_key"], "ordinal")


def fill_amounts(cells: DataFrame, again: DataFrame, by: list[str]) -> DataFrame:
    """cells with missing_amounts filled from second readings, units without their noise."""
    new = again.where(F.col("text") != "").join(missing_amounts(cells, by), [*by, "column_key"], "left_semi")
    value = F.when(F.col("column_key") == "unit", remove_noise(F.col("column_key"), F.col("text"), F.col("confidence"))).otherwise(F.col("text"))
    new = new.withColumn("text", value).withColumn("confidence", F.when(F.col("text") != "", F.col("confidence")).otherwise(0.0)).select(*by, "column_key", "text", "confidence", "source")
    return cells.join(new.select(*by, "column_key"), [*by, "column_key"], "left_anti").unionByName(new)


def read_cells(tokens: DataFrame, grid: DataFrame, profile: Profile = Profile(), lexicon: DataFrame | None = None, accurate: bool = True, column_tokens: DataFrame | None = None) -> DataFrame:
    """document_id, page, row_no, column_key, text, confidence, source of every cell that has words.

    tokens are in pixels of the page; column_tokens, if there are any, in those of enlarged columns, see
    column_pass_tokens. Their readings compete. Readings of single cells (pass names ``cell-``) only count where a cell is
    read again or an amount is filled. Misspelt words are corrected if a lexicon is given.
    """
    by = [*PAGE, "row_no"]
    placed = bucket_tokens(tokens, grid, profile)
    if column_tokens is not None:
        placed = placed.unionByName(column_pass_tokens(column_tokens, grid, profile))
    cells = cell_texts(placed).withColumn("column_key", key_of(F.col("col_no"), profile))
    correct = None
    if lexicon is not None:
        correct = lambda df, value: correct_texts(df, value, lexicon, F.col("column_key").isin(*CORRECTED))
    normal = cut(normalize_by_key(cells, "column_key", "text", correct).withColumnRenamed("pass_name", "source"))
    best = choose_reading(normal.where(~is_again(F.col("source"))), [*by, "column_key"], "pass_ordinal")
    again = choose_reading(normal.where(is_again(F.col("source"))), [*by, "column_key"], "pass_ordinal")
    some = not again.isEmpty()
    if some:
        best = read_again(best, again, by, accurate, profile)
    value = remove_noise(F.col("column_key"), F.col("text"), F.col("confidence"))
    best = best.withColumn("text", value).withColumn("confidence", F.when(F.col("text") != "", F.col("confidence")).otherwise(0.0))
    if some:
        best = fill_amounts(best, again, by)
    return best.withColumn("confidence", round1(F.col("confidence")))


def wide_rows(cells: DataFrame, grid: DataFrame) -> DataFrame:
    """One row per line of the sheet with its columns, confidences, sources and box; rows without any text are left out."""
    cell = F.struct("text", "confidence", "source")
    held = cells.where(F.col("column_key").isin(*COLUMNS)).groupBy(*PAGE, "row_no").agg(F.map_from_entries(F.collect_list(F.struct("column_key", cell))).alias("cells"))  # a cell per column
    of = lambda k, c, empty: F.coalesce(F.try_element_at("cells", F.lit(k))[c], F.lit(empty))
    both = lambda c, empty: F.create_map(*[x for k in COLUMNS for x in (F.lit(k), of(k, c, empty))]).alias(f"{c}s")
    wide = held.select(*PAGE, "row_no", *[of(k, "text", "").alias(k) for k in COLUMNS], both("confidence", 0.0), both("source", "none").alias("ocr_sources"))
    wide = wide.where(strip(F.concat(*COLUMNS)) != "")
    pages = checked_broadcast(grid.select(*PAGE, "image_width", "image_height", "x_lines", "y_lines"))
    x0, x1 = F.get("x_lines", F.lit(0)), F.element_at("x_lines", -1)
    y0, y1 = F.get(F.col("y_lines"), F.col("row_no")), F.get(F.col("y_lines"), F.col("row_no") + 1)
    box = F.struct((x0 / F.col("image_width")).alias("x"), (y0 / F.col("image_height")).alias("y"), ((x1 - x0) / F.col("image_width")).alias("width"), ((y1 - y0) / F.col("image_height")).alias("height"))
    return wide.join(pages, PAGE).withColumn("bbox", box).withColumn("source_row", F.col("row_no").cast("string")).drop("image_width", "image_height", "x_lines", "y_lines")
