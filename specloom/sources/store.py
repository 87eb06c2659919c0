"""Documents and their results as tables in a shared folder; small states as JSON files.

Results are never changed in place. A save writes its rows as a version of its own, and only when these stand does a row
for each of its documents in the table of versions make them the current ones: readers see the old rows or the new,
and a save that was lost half way is never seen. One save may hold the rows of any number of documents.
"""

from __future__ import annotations

import json
import uuid
from datetime import datetime, timezone
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from specloom.operators.review import summary
from specloom.schema import RESULT_ROW
from specloom.sources.files import pdf_files
from specloom.sources.images import DocumentReader, inspect_documents

DOCUMENTS = "document_id string, filename string, page_count int, title string, size_bytes long"
ERRORS = "document_id string, page int, error string"
_VERSIONS = "document_id string, version string, saved_at timestamp"


def _file_system(spark: SparkSession, path: str):  # noqa: ANN202
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def write_json(spark: SparkSession, path: str, data: Any) -> None:
    """Writes a state as JSON beside its place, then puts it there: a reader finds the old one or the new one whole."""
    fs, at = _file_system(spark, path)
    part = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}.tmp")
    out = fs.create(part, True)
    out.write(bytearray(json.dumps(data, ensure_ascii=False, indent=2).encode()))
    out.close()
    if not fs.rename(part, at):  # some file systems don't rename onto a file
        fs.delete(at, False)
        if not fs.rename(part, at):
            raise OSError(f"can't put {path} in its place")


def read_json(spark: SparkSession, path: str, default: Any = None) -> Any:
    """A state that was written, or ``default`` if there is none."""
    fs, at = _file_system(spark, path)
    if not fs.exists(at):
        return default
    stream = fs.open(at)
    try:
        return json.loads(bytes(stream.readAllBytes()).decode())
    finally:
        stream.close()


class Store:
    """Tables of documents, results, errors and versions below a folder."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")

    def _read(self, name: str, schema: str) -> DataFrame:
        """A table, empty before its first write."""
        path = f"{self.folder}/{name}"
        fs, at = _file_system(self.spark, path)
        return self.spark.read.schema(schema).parquet(path) if fs.exists(at) else self.spark.createDataFrame([], schema)

    def add(self, documents: DataFrame) -> None:
        """Registers documents; one that is registered again has what was said last."""
        now = F.lit(datetime.now(timezone.utc)).cast("timestamp")
        documents.select(*[c.split(" ")[0] for c in DOCUMENTS.split(", ")], now.alias("uploaded_at")).write.mode("append").parquet(f"{self.folder}/documents")

    def documents(self) -> DataFrame:
        """The registered documents, and whether they have results."""
        d = self._read("documents", f"{DOCUMENTS}, uploaded_at timestamp")
        last = d.groupBy("document_id").agg(F.max_by(F.struct(*[c for c in d.columns if c != "document_id"]), "uploaded_at").alias("d")).select("document_id", "d.*")
        return last.join(self._current().select("document_id", F.lit(True).alias("has_result")), "document_id", "left").withColumn("has_result", F.coalesce("has_result", F.lit(False)))

    def document(self, document_id: str) -> Row:
        """One document; LookupError if it isn't registered."""
        found = self.documents().where(F.col("document_id") == document_id).head(1)
        if not found:
            raise LookupError(f"no document {document_id}")
        return found[0]

    def save(self, rows: DataFrame, errors: DataFrame | None = None) -> str:
        """Makes rows, of whatever documents, the results of these; errors (document_id, page, error) belong to them. Returns the version.

        Columns that a result row doesn't have are left out, missing ones are null.
        """
        version = uuid.uuid4().hex
        typed = rows.select(*[(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in RESULT_ROW.fields])
        typed.write.parquet(f"{self.folder}/results/version={version}")
        saved = self.spark.read.schema(RESULT_ROW).parquet(f"{self.folder}/results/version={version}").select("document_id")
        if errors is not None:
            errors.select("document_id", "page", "error").write.parquet(f"{self.folder}/errors/version={version}")
            saved = saved.unionByName(errors.select("document_id"))
        now = F.lit(datetime.now(timezone.utc)).cast("timestamp")
        saved.where(F.col("document_id").isNotNull()).distinct().select("document_id", F.lit(version).alias("version"), now.alias("saved_at")).write.mode("append").parquet(f"{self.folder}/versions")
        return version

    def _current(self) -> DataFrame:
        v = self._read("versions", _VERSIONS)
        return v.groupBy("document_id").agg(F.max_by("version", F.struct("saved_at", "version")).alias("version"))

    def _of_current(self, name: str, schema: str) -> DataFrame:
        return self._read(name, f"{schema}, version string").join(self._current(), ["document_id", "version"], "left_semi").drop("version")

    def results(self) -> DataFrame:
        """The current rows of all documents."""
        return self._of_current("results", ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in RESULT_ROW.fields))

    def errors(self) -> DataFrame:
        """The errors that came with the current rows."""
        return self._of_current("errors", ERRORS)

    def result(self, document_id: str) -> DataFrame:
        """The current rows of one document; LookupError if it has none."""
        if not self.document(document_id)["has_result"]:
            raise LookupError(f"document {document_id} has no result")
        return self.results().where(F.col("document_id") == document_id)

    def summary(self, document_id: str) -> DataFrame:
        """Counts of one document's rows by status and type, and of its pages with errors."""
        return summary(self.result(document_id), self.errors().where(F.col("document_id") == document_id))

    def clean(self) -> int:
        """Removes versions that no document has any more, and returns how many; not to be run beside a save."""
        live = {r["version"] for r in self._current().select("version").distinct().collect()}  # a row per save that counts
        gone = 0
        for name in ("results", "errors"):
            fs, at = _file_system(self.spark, f"{self.folder}/{name}")
            for f in fs.listStatus(at) if fs.exists(at) else ():
                part = f.getPath().getName()
                if part.startswith("version=") and part.removeprefix("version=") not in live:
                    gone += bool(fs.delete(f.getPath(), True))
        return gone


def ingest(store: Store, folder: str, reader: DocumentReader) -> DataFrame:
    """Registers every PDF below a folder with its pages and title; returns document_id, filename, error of those that are too large or can't be opened."""
    files = pdf_files(store.spark, folder, contents=True)
    found, broken = inspect_documents(files.where(F.col("problem").isNull()), reader)
    store.add(found)
    return files.where(F.col("problem").isNotNull()).select("document_id", "filename", F.col("problem").alias("error")).unionByName(broken)
