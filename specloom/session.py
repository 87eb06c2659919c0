"""Session helpers: table access, size-checked broadcast and lineage cuts."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a lookup side may be broadcast or brought to the driver. Checked, never assumed.
LOOKUP_ROWS = 50_000
LOOKUP_BYTES = 32 << 20


def build_session(cores: int | str = "*", partitions: int = 8, app: str = "specloom") -> SparkSession:
    """A local session for tests and benches; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("SPECLOOM_DRIVER_MEMORY", "8g"))
        .getOrCreate()
    )


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Gives the executors this package, once per application: their Python may not have it on its path."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    folder = Path(tempfile.mkdtemp(prefix="specloom-"))  # of the driver alone; addPyFile serves the file from there
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    archive = folder / "specloom.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    sc.addPyFile(str(archive))
    _SHIPPED.add(sc.applicationId)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder, one Parquet file or folder each."""
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_enough(df: DataFrame, limit: int = LOOKUP_ROWS, most_bytes: int = LOOKUP_BYTES) -> bool:
    """Whether df has at most ``limit`` rows, which hold at most ``most_bytes`` as text; reads no more rows than it must to know."""
    size = F.coalesce(F.sum(F.octet_length(F.to_json(F.struct("*"))).cast("long")), F.lit(0))
    rows, held = df.limit(limit + 1).agg(F.count("*"), size).first()
    return rows <= limit and held <= most_bytes


def checked_broadcast(df: DataFrame, limit: int = LOOKUP_ROWS) -> DataFrame:
    """df with a broadcast hint if it has at most ``limit`` rows of LOOKUP_BYTES in all, else df as it is: the join then shuffles."""
    return F.broadcast(df) if small_enough(df, limit) else df


def collect_bounded(df: DataFrame, limit: int = LOOKUP_ROWS, what: str = "lookup table") -> list:
    """The rows of a lookup table; an error beyond ``limit`` rows instead of a driver that fills up."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"{what} has more than {limit} rows; raise the limit knowingly or join it instead")
    return rows


def is_local(spark: SparkSession) -> bool:
    """Whether driver and executors are one process, and so share its folders."""
    master = spark.sparkContext.master
    return master == "local" or master.startswith("local[")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """The cluster's spark.checkpoint.dir; a folder of this machine only where the session is local and names none."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
        if not named and not is_local(spark):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or (Path(tempfile.gettempdir()) / f"specloom-{uuid.uuid4().hex}").as_uri())


_FILES: set[tuple[str, str]] = set()


def ship_file(spark: SparkSession, path: str) -> None:
    """Gives the executors a file of the driver, once per application; one that the driver lacks is taken to lie where the executors are."""
    sc = spark.sparkContext
    if (sc.applicationId, path) not in _FILES and os.path.exists(path):
        sc.addFile(path)
        _FILES.add((sc.applicationId, path))


def shipped(path: str) -> str:
    """Where a file is for this process: at its path, or where ship_file put it."""
    return path if os.path.exists(path) else SparkFiles.get(os.path.basename(path))


_CUTS: list[str] = []


def cut(df: DataFrame) -> DataFrame:
    """df written once to the shared checkpoint folder and read back.

    A lost executor then costs no recomputation of the past, and what follows reads only the columns it
    needs. Unlike checkpoint(), which runs the plan twice unless it is cached, this runs it once. The files
    go when the application ends, or at the end of a cuts_removed block.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _CUTS.append(path)
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(conf).deleteOnExit(at)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def cuts_removed(spark: SparkSession) -> Iterator[None]:
    """Removes at its end the files of the cuts made within: for long sessions, around work whose results are written or collected there."""
    before = len(_CUTS)
    try:
        yield
    finally:
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        for path in _CUTS[before:]:
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(conf).delete(at, True)
        del _CUTS[before:]
