"""The queries over the reference's own operators, each over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from specloom import schema
from specloom.functions import text as fx
from specloom.operators import cells, export, geometry, pages, review, rows, spelling
from specloom.schema import CATALOG, COLUMNS, EXPORTED, PASS_OF_COLUMN, column_scale
from specloom.session import checked_broadcast, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def _raw(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "raw_rows").withColumn("line", rows.row_number_of(F.col("source_row")))


@query
def recognize_rows(spark: SparkSession, d: str) -> DataFrame:
    """Tokens to result rows: buckets, cells, correction, choice, noise, rows, continuation, context, status."""
    tokens, grid = table(spark, d, "tokens"), table(spark, d, "page_grid")
    lexicon = spelling.with_built_in(table(spark, d, "lexicon"))
    found = rows.result_rows(cells.wide_rows(cells.read_cells(tokens, grid, lexicon=lexicon), grid))
    return found.select("document_id", "row_id", "row_order", *COLUMNS, "section_name", "system_name", "row_type", "page", "confidence", "status", "source_row")


@query
def token_cells(spark: SparkSession, d: str) -> DataFrame:
    placed = cells.bucket_tokens(table(spark, d, "tokens"), table(spark, d, "page_grid"))
    return cells.cell_texts(placed).select("document_id", "page", "row_no", "col_no", "pass_name", "pass_ordinal", "text", F.round("confidence", 8).alias("confidence"))


@query
def candidate_top1(spark: SparkSession, d: str) -> DataFrame:
    r = cells.with_judged(table(spark, d, "cell_results"))
    return cells.choose_reading(r, ["cell_id"], "ordinal", judged="judged").withColumn("confidence", F.round("confidence", 4))


@query
def candidate_union(spark: SparkSession, d: str) -> DataFrame:
    """Candidates of page passes, then of column passes, numbered in that order within each cell."""
    t = cells.cell_texts(cells.bucket_tokens(table(spark, d, "tokens"), table(spark, d, "page_grid")))
    return cells.numbered_candidates(t).select("document_id", "page", "row_no", "col_no", "place", "pass_name", "text")


@query
def column_pass_cells(spark: SparkSession, d: str) -> DataFrame:
    """Words of names and marks as passes over these columns give them, in pixels of the enlarged column, placed in their cells again."""
    tokens, grid = table(spark, d, "tokens"), table(spark, d, "page_grid")
    keys = {1: "name", 2: "type_mark", 6: "quantity"}
    placed = cells.bucket_tokens(tokens, grid).where(F.col("col_no").isin(*keys))
    top = grid.select("document_id", "page", F.get("y_lines", F.lit(2)).alias("top_line"))
    passes = spark.createDataFrame([(i, PASS_OF_COLUMN + k, column_scale(k)) for i, k in keys.items()], "col_no int, pass_of string, scale double")
    enlarged = placed.join(F.broadcast(passes), "col_no").join(checked_broadcast(top), ["document_id", "page"])
    enlarged = enlarged.withColumn("top_px", F.round((F.col("top_px") - F.col("top_line")) * F.col("scale")).cast("int")).withColumn("height_px", F.round(F.col("height_px") * F.col("scale")).cast("int"))
    words = enlarged.withColumn("pass_name", F.col("pass_of")).drop("row_no", "col_no", "pass_of", "scale", "top_line")
    return cells.cell_texts(cells.column_pass_tokens(words, grid)).select("document_id", "page", "row_no", "col_no", "pass_ordinal", "text")


@query
def reading_plan(spark: SparkSession, d: str) -> DataFrame:
    """How each column is read: languages, enlargement and characters of all passes, with the readings there are from them."""
    plan = spark.createDataFrame([r for accurate in (True, False) for r in schema.reading_plan(accurate)], "pass_name string, pass_ordinal int, column_key string, language string, layout int, scale double, allowed string")
    plan = plan.dropDuplicates(["pass_name", "column_key"])
    n = table(spark, d, "cell_results").groupBy(F.col("source").alias("pass_name"), "column_key").agg(F.count("*").alias("readings"))
    of = F.broadcast(plan.select(F.col("pass_name").alias("p"), F.col("column_key").alias("k"), "language", "layout", "scale", "allowed"))  # a row per pass and column
    joined = n.join(of, (F.col("p") == F.col("pass_name")) & (F.col("k").isNull() | (F.col("k") == F.col("column_key"))), "left")
    return joined.select("pass_name", "column_key", "language", "layout", "scale", "allowed", "readings")


@query
def noise_filter(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "cell_results")
    return r.select("result_id", cells.remove_noise(F.col("column_key"), fx.text("text"), fx.confidence("confidence")).alias("kept"))


@query
def refine_budget(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "cell_results").withColumn("line", rows.row_number_of(F.col("source_row")))
    r = r.withColumn("doubtful", cells.doubtful(F.col("column_key"), fx.text("text"), fx.confidence("confidence")))
    return cells.refinement_budget(r, ["line", "cell_id", "ordinal", "result_id"]).select("result_id", "turn")


@query
def numeric_fallback(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "cell_results")
    return r.where(cells.needs_number(F.col("column_key"), fx.text("text"))).select("result_id", "text")


@query
def back_fill(spark: SparkSession, d: str) -> DataFrame:
    """Missing units and quantities of raw rows, filled from the chosen readings of their cells."""
    again = table(spark, d, "cell_results").where(F.col("column_key").isin("unit", "quantity"))
    best = cells.choose_reading(cells.with_judged(again), ["document_id", "page", "source_row", "column_key"], "ordinal", judged="judged")
    of = lambda k, c: F.max(F.when(F.col("column_key") == k, F.col(c)))
    wide = best.groupBy("document_id", "page", "source_row").agg(of("unit", "text").alias("unit_again"), of("unit", "confidence").alias("unit_confidence"), of("quantity", "text").alias("quantity_again"))
    raw = table(spark, d, "raw_rows").select("raw_id", "document_id", "page", "source_row", *[fx.text(c).alias(c) for c in ("name", "type_mark", "manufacturer", "unit", "quantity")])
    joined = raw.join(wide, ["document_id", "page", "source_row"], "left").fillna(0.0, ["unit_confidence"])
    return cells.back_fill(joined, "unit_again", "quantity_again", "unit_confidence").select("raw_id", "unit", "quantity")


@query
def column_titles(spark: SparkSession, d: str) -> DataFrame:
    """Readings per column under its title."""
    catalog = spark.createDataFrame(list(CATALOG), "column_key string, title string, width int")
    n = table(spark, d, "cell_results").groupBy("column_key").agg(F.count("*").alias("readings"))
    return n.join(checked_broadcast(catalog, len(CATALOG)), "column_key").select("column_key", "title", "readings")


@query
def clean_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "raw_rows").select("raw_id", *[fx.clean_text(c).alias(c) for c in ("name", "type_mark", "unit", "note")])


@query
def clean_text_compat(spark: SparkSession, d: str) -> DataFrame:
    """The same with шт and компл shortened inside longer words too."""
    return table(spark, d, "raw_rows").select("raw_id", *[fx.clean_text(c, compat=True).alias(c) for c in ("name", "type_mark", "unit", "note")])


@query
def normalize_cells(spark: SparkSession, d: str) -> DataFrame:
    """All nine columns of the raw rows by the rules of each, spelling apart."""
    return table(spark, d, "raw_rows").select("raw_id", *[fx.normalize_cell(c, c).alias(c) for c in COLUMNS])


@query
def letter_case(spark: SparkSession, d: str) -> DataFrame:
    """The maker in the letter case of the name."""
    return table(spark, d, "raw_rows").select("raw_id", fx.match_case(fx.text("name"), F.lower(fx.text("manufacturer"))).alias("manufacturer"))


@query
def normalize_units(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "raw_rows").select("raw_id", fx.unit_text(fx.text("unit")).alias("unit"))


@query
def numeric_cast(spark: SparkSession, d: str) -> DataFrame:
    number, rest = fx.export_number("quantity")
    return table(spark, d, "raw_rows").select("raw_id", number.alias("number"), rest.alias("not_number"))


@query
def plausibility(spark: SparkSession, d: str) -> DataFrame:
    """Judged by the text normalised by its column."""
    r = cells.with_judged(table(spark, d, "cell_results"))
    return r.select("result_id", F.round(fx.plausibility(F.col("column_key"), fx.text("judged")), 4).alias("plausibility"))


@query
def look_alikes(spark: SparkSession, d: str) -> DataFrame:
    """The distinct words of names that spelling correction compares, in the form that is compared."""
    words = table(spark, d, "raw_rows").select(F.explode(spelling.words_of(fx.text("name"))).alias("word")).distinct()
    return words.select("word", spelling.candidate_form(F.col("word")).alias("form")).where(F.col("form").isNotNull())


@query
def indel_ratio(spark: SparkSession, d: str) -> DataFrame:
    """How alike the title and the filename of each document are."""
    return table(spark, d, "doc_meta").select("document_id", F.round(fx.indel_ratio(fx.text("title"), fx.text("filename")), 6).alias("ratio"))


@query
def fuzzy_correct(spark: SparkSession, d: str) -> DataFrame:
    """Distinct words of names, notes and makers that are nearly words of the lexicon."""
    texts = F.array(*[fx.text(c) for c in spelling.CORRECTED])
    words = table(spark, d, "raw_rows").select(F.explode(texts).alias("text")).distinct().select(F.explode(spelling.words_of(F.col("text"))).alias("word"))
    vocabulary = spelling.with_built_in(table(spark, d, "lexicon")).where(F.col("kind") == "word").select(F.col("lex_key").alias("entry"), "ordinal")
    return spelling.correct_words(words, vocabulary)


@query
def correct_texts(spark: SparkSession, d: str) -> DataFrame:
    """The corrected texts of names, notes and makers."""
    texts = table(spark, d, "raw_rows").unpivot("raw_id", list(spelling.CORRECTED), "column_key", "text")
    return spelling.correct_texts(texts, "text", spelling.with_built_in(table(spark, d, "lexicon")))


@query
def safe_filenames(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "doc_meta").select("document_id", fx.safe_filename("title").alias("filename"))


@query
def classify_rows(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "raw_rows").select("raw_id", rows.classify().alias("row_type"))


@query
def row_status(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "raw_rows").withColumn("row_type", rows.classify()).withColumn("confidence", rows.row_confidence())
    return r.select("raw_id", "row_type", "confidence", rows.status(F.col("row_type"), F.col("confidence")).alias("status"))


@query
def continuation_merge(spark: SparkSession, d: str) -> DataFrame:
    m = rows.merge_continuations(_raw(spark, d), ["document_id", "page"], ["line", "raw_id"])
    return m.select("raw_id", "document_id", "page", "source_row", *COLUMNS, F.col("confidences")["name"].alias("name_confidence"), F.col("confidences")["note"].alias("note_confidence"), F.round("bbox.height", 6).alias("height"))


@query
def context_carry(spark: SparkSession, d: str) -> DataFrame:
    return rows.with_context(_raw(spark, d), ["document_id"], ["page", "line", "raw_id"]).select("raw_id", "row_type", "section_name", "system_name")


@query
def result_summary(spark: SparkSession, d: str) -> DataFrame:
    """Result rows by status and type, and the pages with readings on which no table was found."""
    lost = table(spark, d, "cell_results").select("document_id", "page").join(table(spark, d, "page_grid").select("document_id", "page"), ["document_id", "page"], "left_anti")
    return review.summary(table(spark, d, "result_rows"), lost)


@query
def review_counters(spark: SparkSession, d: str) -> DataFrame:
    return review.counters(table(spark, d, "result_rows"), "document_id")


#: Row type, status and search of the filters of review_filter.
FILTERS = [("item", "review", "Клапан"), ("component", None, None), (None, "edited", None), (None, None, "ГОСТ"), ("section", "recognized", ""), (None, "verified", "сталь"), ("item", None, "мм"), (None, None, "98")]


@query
def review_filter(spark: SparkSession, d: str) -> DataFrame:
    return review.review_filters(table(spark, d, "result_rows"), FILTERS, "row_id")


@query
def rows_by_id(spark: SparkSession, d: str) -> DataFrame:
    """The raw rows that reviewers gave a maker for."""
    return review.rows_by_id(table(spark, d, "raw_rows"), table(spark, d, "maker_edits"), "raw_id").select("raw_id", "document_id", "page", "source_row")


@query
def default_selection(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "result_rows").select("row_id", review.is_selected().alias("chosen"))


@query
def save_merge(spark: SparkSession, d: str) -> DataFrame:
    """Raw rows with the manufacturer of their last edit."""
    raw = table(spark, d, "raw_rows").select("raw_id", "manufacturer")
    edits = table(spark, d, "maker_edits").select("raw_id", F.col("manufacturer").alias("typed"), "edited_at", "edit_id")
    return review.merge_edits(raw, edits, "raw_id", "manufacturer", "typed", ["edited_at", "edit_id"])


@query
def status_after_edit(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "result_rows").select("row_id", review.status_after_edit(F.col("status"), F.col("edited")).alias("status"))


@query
def first_messages(spark: SparkSession, d: str) -> DataFrame:
    return review.first_errors(table(spark, d, "events"), ["user_id"], ["ts", "event_id"], "event_type")


@query
def export_rows(spark: SparkSession, d: str) -> DataFrame:
    return export.with_numbers(export.export_rows(table(spark, d, "result_rows"), EXPORTED, keep=("row_order",)))


@query
def export_titles(spark: SparkSession, d: str) -> DataFrame:
    """Exported rows under the titles of their columns."""
    return export.with_titles(export.export_rows(table(spark, d, "result_rows"), EXPORTED, keep=("row_order",)))


@query
def export_repeated(spark: SparkSession, d: str) -> DataFrame:
    """Columns in an order of their own, one unknown, one repeated, and rows that weren't deselected whatever their type."""
    return export.with_numbers(export.export_rows(table(spark, d, "result_rows"), ("quantity", "name", "nosuch", "quantity"), only_exportable=False, keep=("row_order",)))


@query
def column_order(spark: SparkSession, d: str) -> DataFrame:
    """The columns by how many readings they have, then the others."""
    n = table(spark, d, "cell_results").groupBy("column_key").agg((-F.count("*")).alias("place"))
    return export.column_order_of(n, "column_key", "place")


@query
def export_metadata(spark: SparkSession, d: str) -> DataFrame:
    return export.export_metadata(table(spark, d, "result_rows"))


@query
def tsv_export(spark: SparkSession, d: str) -> DataFrame:
    r = export.export_rows(table(spark, d, "result_rows").where(review.is_selected()), EXPORTED, keep=("row_order",))
    return r.select("row_order", export.tsv_line(EXPORTED).alias("line"))


@query
def mask_islands(spark: SparkSession, d: str) -> DataFrame:
    return geometry.runs(table(spark, d, "tokens").select("document_id", "page", "top_px"), ["document_id", "page"], "top_px")


@query
def column_sequence(spark: SparkSession, d: str) -> DataFrame:
    """The best ten columns among the lines of a page and the middles between them."""
    g = table(spark, d, "page_grid")
    middles = F.transform(F.sequence(F.lit(1), F.size("x_lines") - 1), lambda i: F.floor((F.get("x_lines", i) + F.get("x_lines", i - 1)) / 2).cast("int"))
    candidates = g.select("document_id", "page", "image_width", F.explode(F.concat("x_lines", middles)).alias("x"))
    return geometry.best_columns(candidates, ["document_id", "page"], "x", "image_width").select("document_id", "page", F.array_join("lines", ",").alias("lines"))


@query
def footer_trim(spark: SparkSession, d: str) -> DataFrame:
    """The lines of a page, and of one with a gap below, without what follows the gap."""
    g = table(spark, d, "page_grid")
    last = F.element_at("y_lines", -1)
    both = g.select("document_id", "page", F.explode(F.array(F.struct(F.lit(False).alias("with_gap"), F.col("y_lines").alias("l")), F.struct(F.lit(True).alias("with_gap"), F.concat("y_lines", F.array(last + 900, last + 960)).alias("l")))).alias("x"))
    trimmed = geometry.trim_footer(both.select("document_id", "page", "x.*"), ["document_id", "page", "with_gap"], "l")
    return trimmed.select("document_id", "page", "with_gap", F.array_join("lines", ",").alias("lines"))


@query
def page_geometry(spark: SparkSession, d: str) -> DataFrame:
    """Outer lines of the table as shares of the page, and the crop that these shares stand for, widened, in pixels."""
    g = table(spark, d, "page_grid")
    share = lambda a, b: F.round(a / F.col(b), 6)
    first, last = lambda c: F.get(c, F.lit(0)), lambda c: F.element_at(c, -1)
    g = g.select("document_id", "page", "image_width", "image_height", share(first("x_lines"), "image_width").alias("x0"), share(last("x_lines"), "image_width").alias("x1"), share(first("y_lines"), "image_height").alias("y0"), share(last("y_lines"), "image_height").alias("y1"))
    crop = geometry.expand_crop(F.col("x0"), F.col("y0"), F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"), F.col("image_width"), F.col("image_height"))
    return g.select("document_id", "page", "x0", "x1", "y0", "y1", crop.alias("c")).select("document_id", "page", "x0", "x1", "y0", "y1", "c.*")


@query
def suggest_pages(spark: SparkSession, d: str) -> DataFrame:
    return pages.table_pages(table(spark, d, "page_grid"))


@query
def page_ranges(spark: SparkSession, d: str) -> DataFrame:
    """The pages of an expression over each document's last pages, reversed, with the first one again."""
    m = table(spark, d, "doc_meta").where(F.col("page_count") > 0)
    n = F.col("page_count").cast("string")
    return pages.parse_pages(m.withColumn("expression", F.concat(n, F.lit("-"), F.greatest(F.lit(1), F.col("page_count") - 3).cast("string"), F.lit("; 1, "), n)), "document_id", "expression", "page_count")


@query
def page_problems(spark: SparkSession, d: str) -> DataFrame:
    """What is wrong with the pages of its result rows as an expression, first in a document of one page less than its last, then in one of all pages."""
    r = pages.compact_pages(table(spark, d, "result_rows"), "document_id")
    last = table(spark, d, "result_rows").groupBy("document_id").agg(F.max("page").alias("last"))
    both = r.join(last, "document_id").select("document_id", "ranges", F.explode(F.array(F.col("last") - 1, F.col("last"))).alias("page_count"))
    return both.select("document_id", "page_count", pages.page_problem(F.col("ranges"), F.col("page_count")).alias("problem"))


@query
def compact_ranges(spark: SparkSession, d: str) -> DataFrame:
    return pages.compact_pages(table(spark, d, "cell_results"), "document_id")


@query
def known_pages(spark: SparkSession, d: str) -> DataFrame:
    return pages.known_pages(table(spark, d, "cell_results"), table(spark, d, "page_grid"))


@query
def drop_empty_rows(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "raw_rows").where(rows.filled(*COLUMNS)).select("raw_id")


@query
def document_list(spark: SparkSession, d: str) -> DataFrame:
    """Documents with their titles, the file's name where none is given, and whether they have result rows."""
    m = table(spark, d, "doc_meta")
    have = table(spark, d, "result_rows").select("document_id").distinct().withColumn("has_result", F.lit(True))
    title = F.when(F.trim(fx.text("title")) != "", F.col("title")).otherwise(F.regexp_replace(fx.text("filename"), r"\.[^.]*$", ""))
    return m.join(have, "document_id", "left").select("document_id", title.alias("title"), "page_count", F.coalesce("has_result", F.lit(False)).alias("has_result"))
