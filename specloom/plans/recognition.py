"""From page images to result rows: the whole chain with a reader of words."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from specloom.operators.cells import PAGE, read_cells, wanted_again, wide_rows
from specloom.operators.pages import table_pages
from specloom.operators.review import first_errors
from specloom.operators.rows import result_rows
from specloom.schema import PASS_OF_COLUMN, Profile
from specloom.session import cut
from specloom.sources.images import TableError, WordReader, detect_tables, read_cells_again, read_words


@dataclass
class Recognition:
    """rows: result rows. geometry: the lines of each page's table as shares of the page. errors: document_id, page, error."""

    rows: DataFrame
    geometry: DataFrame
    errors: DataFrame

    def require_some(self) -> "Recognition":
        """Itself if there is any row or no error; else an error that tells the first three different messages."""
        if self.rows.isEmpty() and not self.errors.isEmpty():
            said = first_errors(self.errors.withColumn("one", F.lit(1)), ["one"], PAGE, "error").first()
            raise RuntimeError(f"no page could be read: {said['messages']}")
        return self


def geometry_of(grid: DataFrame) -> DataFrame:
    """document_id, page, x_lines, y_lines as shares to six digits, column_count, row_count."""
    share = lambda lines, size: F.transform(lines, lambda v: F.round(v / F.col(size), 6)).alias(lines)
    return grid.select(*PAGE, share("x_lines", "image_width"), share("y_lines", "image_height"), (F.size("x_lines") - 1).alias("column_count"), (F.size("y_lines") - 1).alias("row_count"))


def suggest_pages(images: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pages, errors) of images (document_id, page, content): the pages that hold a table. A page without one is no error."""
    grid, errors = detect_tables(images)
    return table_pages(grid), errors.where(~F.col("error").startswith(TableError.__name__))


def recognize(images: DataFrame, reader: WordReader, lexicon: DataFrame | None = None, accurate: bool = True, crop: tuple[float, float, float, float] | None = None, profile: Profile = Profile()) -> Recognition:
    """Result rows of images (document_id, page, content).

    Tables are found, words read page by page and column by column, doubtful cells and missing amounts read again, and
    rows made of the cells. A page that fails is an error and has no rows; the others go on.
    """
    grid, lost = detect_tables(images, crop)
    of_tables = images.join(grid.select(*PAGE), PAGE, "left_semi")
    words, unread = read_words(of_tables, reader, accurate, crop, profile)
    in_column = F.col("pass_name").startswith(PASS_OF_COLUMN)
    whole, columns = words.where(~in_column), words.where(in_column)
    first = cut(read_cells(whole, grid, profile, lexicon, accurate, columns))
    again, unread_again = read_cells_again(of_tables, wanted_again(first, accurate, profile), reader, accurate, crop)
    cells = read_cells(whole.unionByName(again), grid, profile, lexicon, accurate, columns)
    errors = lost.unionByName(unread).unionByName(unread_again).groupBy(*PAGE).agg(F.min("error").alias("error"))
    return Recognition(result_rows(wide_rows(cells, grid)), geometry_of(grid), errors)
