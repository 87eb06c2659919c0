"""Token files as they arrive (an addition of this engine): each batch recomputes the pages it touches.

Tokens are kept by bucket, a hash of document and page, so a batch reads again only the buckets of its pages, not all
that ever arrived.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from specloom.operators.cells import PAGE, bucket_tokens, cell_texts
from specloom.sources.files import TOKENS

#: Buckets that tokens are kept in; the number of a store can't be changed later.
BUCKETS = 256


def token_stream(spark: SparkSession, folder: str, files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(TOKENS).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def words_per_window(stream: DataFrame, every: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """start, document_id, words: words by arrival time; what comes later than ``late`` is dropped, as the watermark says."""
    timed = stream.withColumn("at", F.col("loaded_at").cast("timestamp")).withWatermark("at", late)
    return timed.groupBy(F.window("at", every), "document_id").agg(F.count("*").alias("words")).select(F.col("window.start").alias("start"), "document_id", "words")


def bucket_of(buckets: int) -> Column:
    return F.pmod(F.xxhash64(*PAGE), F.lit(buckets)).cast("int")


def keep_cells(stream: DataFrame, store: str, grid: DataFrame, checkpoint: str, once: bool = True, buckets: int = BUCKETS) -> StreamingQuery:
    """Keeps the tokens of each batch in ``store`` and writes the cells of every page it touches, whole pages at a time, under the batch's number.

    A page may come in several batches, so the tokens of its bucket are read again, at most ``buckets`` of them by name;
    a batch run twice overwrites its own files.
    """

    def batch(df: DataFrame, n: int) -> None:
        spark = df.sparkSession
        df.withColumn("bucket", bucket_of(buckets)).write.mode("overwrite").partitionBy("bucket").parquet(f"{store}/tokens/batch={n}")
        new = spark.read.schema(f"{TOKENS}, bucket int").parquet(f"{store}/tokens/batch={n}") if not df.isEmpty() else None
        if new is None:
            return
        touched = new.select("bucket", *PAGE).distinct()
        numbers = [r["bucket"] for r in touched.select("bucket").distinct().collect()]  # at most ``buckets``
        tokens = spark.read.schema(f"{TOKENS}, batch long, bucket int").parquet(f"{store}/tokens").where(F.col("bucket").isin(numbers) & (F.col("batch") <= n))
        cells = cell_texts(bucket_tokens(tokens.join(touched.drop("bucket"), PAGE, "left_semi"), grid))
        cells.withColumn("bucket", bucket_of(buckets)).write.mode("overwrite").partitionBy("bucket").parquet(f"{store}/cells/batch={n}")

    writer = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def latest_cells(spark: SparkSession, store: str, pages: DataFrame | None = None, buckets: int = BUCKETS) -> DataFrame:
    """The cells of each page as its last batch left them; of ``pages`` alone only their buckets are read."""
    cells = spark.read.parquet(f"{store}/cells")
    if pages is not None:
        asked = pages.select(*PAGE).distinct()
        numbers = [r["bucket"] for r in asked.select(bucket_of(buckets).alias("bucket")).distinct().collect()]  # at most ``buckets``
        cells = cells.where(F.col("bucket").isin(numbers)).join(asked, PAGE, "left_semi")
    last = cells.groupBy(*PAGE).agg(F.max("batch").alias("batch"))
    return cells.join(last, [*PAGE, "batch"], "left_semi").drop("bucket")
