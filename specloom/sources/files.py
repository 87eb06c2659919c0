"""Where documents come from: files, images of their pages, tables of words."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from specloom.functions.text import strip

#: Largest file taken in.
MOST_BYTES = 250 * 1024 * 1024

TOKENS = (
    "token_id long, document_id string, page int, pass_name string, pass_ordinal int, level_no int, page_num int, block_num int, par_num int, line_num int, word_num int, "
    "left_px int, top_px int, width_px int, height_px int, conf double, text string, loaded_at timestamp_ntz"
)


def pdf_files(spark: SparkSession, folder: str, most: int = MOST_BYTES, contents: bool = False) -> DataFrame:
    """document_id, filename, title, size_bytes, problem, path of every .pdf below a folder; contents are read only if asked for, and not of files that are too large.

    The title is the file's name without its ending. problem names files that are too large.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.[pP][dD][fF]").option("recursiveFileLookup", "true").load(folder)
    name = F.element_at(F.split("path", "/"), -1)
    return files.select(
        F.md5("path").alias("document_id"),
        name.alias("filename"),
        F.regexp_replace(name, r"\.[^.]*$", "").alias("title"),
        F.col("length").alias("size_bytes"),
        F.when(F.col("length") > most, f"larger than {most} bytes").alias("problem"),
        "path",
        *([F.when(F.col("length") <= most, F.col("content")).alias("content")] if contents else []),
    )


def page_images(spark: SparkSession, folder: str) -> DataFrame:
    """document_id, page, dpi, content of images named <document>/page-<n>-<dpi>.png."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "page-*-*.png").option("recursiveFileLookup", "true").load(folder)
    parts = F.split("path", "/")
    of = lambda i: F.regexp_extract(F.element_at(parts, -1), r"^page-(\d+)-(\d+)\.png$", i).try_cast("int")
    return files.select(F.element_at(parts, -2).alias("document_id"), of(1).alias("page"), of(2).alias("dpi"), "content")


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """Words of recognised pages; blank ones are left out at the scan."""
    return spark.read.schema(TOKENS).parquet(path).where(strip("text") != "")
