"""Problem 5: records that differ only in formatting, collapsed and counted.

A record's canonical key leaves out blanks, letter case, punctuation and the order of its fields and parts.
Keys are hashed to 16 bytes before anything is shuffled. Hot keys are found exactly, from partial counts
combined on the map side: a key is hot if it holds more than one row in HOT_SHARE, so there can't be more
than HOT_SHARE of them, however large the input. They go through a salted two-level aggregation and a
broadcast of at most HOT_SHARE representatives; all other keys go through one shuffle. The representative
is the smallest identifier.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from specloom.session import cut

#: A key with more than 1 / HOT_SHARE of all rows is hot; there are fewer hot keys than that.
HOT_SHARE = 1000
SALTS = 64
#: A sign directly between two digits belongs to the number; it neither parts nor is punctuation.
_SEPARATOR = r"(?<![0-9])[,;/|]|[,;/|](?![0-9])"
_NOT_KEPT = r"[\s\p{Z}]+|(?<![0-9])[^\p{L}\p{N}]+(?![0-9])|(?<![0-9])[^\p{L}\p{N}]|[^\p{L}\p{N}](?![0-9])"


def bare(field: Column) -> Column:
    """A field in lower case without blanks and punctuation; '' for null."""
    return F.regexp_replace(F.lower(F.coalesce(field, F.lit(""))), _NOT_KEPT, "")


def sorted_parts(field: Column) -> Column:
    """The parts of a field between separators, each bare, in order and joined; '' for null."""
    parts = F.transform(F.split(F.coalesce(field, F.lit("")), _SEPARATOR), bare)
    return F.array_join(F.array_sort(F.filter(parts, lambda p: p != "")), "|")


def canonical_keys(rows: DataFrame, name: Column, mark: Column) -> DataFrame:
    """rows with ``k``: one string for all formattings of (name, mark).

    The two fields may stand exchanged. If only one holds anything, or only one has two parts of three letters
    or more, it is the name; else the one with the larger share of digits counts as the mark; at a tie the
    shorter, then the one whose characters come first in order. None of this depends on formatting.
    Each bare field is a column of its own, so that it is computed once.
    """
    share = lambda b: F.coalesce(F.length(F.regexp_replace(b, r"\D+", "")) / F.nullif(F.length(b), F.lit(0)), F.lit(0.0))
    letters = lambda b: F.array_join(F.array_sort(F.split(b, "")), "")
    r = rows.withColumns({"_name": name, "_mark": mark}).withColumns({"_bn": bare(F.col("_name")), "_bm": bare(F.col("_mark"))}).withColumns({"_sn": share(F.col("_bn")), "_sm": share(F.col("_bm"))})
    worded = lambda c: F.size(F.filter(F.split(F.col(c), _SEPARATOR), lambda p: F.regexp_count(p, F.lit(r"\p{L}")) >= 3)) > 1
    wordy = lambda c: F.when(F.col(c).rlike("[,;/|]"), worded(c)).otherwise(False)
    r = r.withColumns({"_wn": wordy("_name"), "_wm": wordy("_mark")})
    shorter = F.when(F.length("_bn") == F.length("_bm"), letters(F.col("_bn")) < letters(F.col("_bm"))).otherwise(F.length("_bn") < F.length("_bm"))
    r = r.withColumn("_x", F.when(F.col("_bm") == "", False).when(F.col("_bn") == "", True).when(F.col("_wn") != F.col("_wm"), F.col("_wm")).when(F.col("_sn") == F.col("_sm"), shorter).otherwise(F.col("_sn") > F.col("_sm")))
    r = r.withColumns({"_text": F.when(F.col("_x"), F.col("_mark")).otherwise(F.col("_name")), "_code": F.when(F.col("_x"), F.col("_bn")).otherwise(F.col("_bm"))})
    return r.withColumn("k", F.concat_ws("#", sorted_parts(F.col("_text")), "_code"))


def keyed(rows: DataFrame, identifier: str, name: str, mark: str) -> DataFrame:
    """id, key of the rows that hold anything in either field: the 16-byte hash of their canonical key, written once.

    The filter comes after the cut: put before it, the optimizer would push it below and compute every rule
    again inside.
    """
    k = canonical_keys(rows.where(F.col(identifier).isNotNull()).select(F.col(identifier).cast("long").alias("id"), F.col(name).alias("n"), F.col(mark).alias("m")), F.col("n"), F.col("m"))
    return cut(k.select("id", F.unhex(F.md5("k")).alias("key"))).where(F.col("key") != F.unhex(F.md5(F.lit("#"))))


def _split_hot(k: DataFrame, hot_share: int) -> tuple[DataFrame, DataFrame]:
    """The rows of hot keys and the rest. Fewer than ``hot_share`` keys are brought to the driver, by the rule that makes them hot."""
    total = k.count()
    hot = [(r["key"],) for r in k.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") * hot_share > total).select("key").collect()]
    listed = F.broadcast(k.sparkSession.createDataFrame(hot, "key binary"))
    return k.join(listed, "key", "left_semi"), k.join(listed, "key", "left_anti")


def _two_level(hot_rows: DataFrame, salts: int) -> DataFrame:
    """key, first_id, copies of hot keys: by key and salt, then by key."""
    salted = hot_rows.groupBy("key", (F.pmod(F.xxhash64("id"), F.lit(salts))).alias("salt")).agg(F.min("id").alias("first_id"), F.count("*").alias("copies"))
    return salted.groupBy("key").agg(F.min("first_id").alias("first_id"), F.sum("copies").alias("copies"))


def copy_groups(rows: DataFrame, identifier: str = "row_order", name: str = "name", mark: str = "type_mark", hot_share: int = HOT_SHARE, salts: int = SALTS) -> DataFrame:
    """first_id, copies: one row per distinct record, with its smallest identifier and how many rows it has.

    Rows with a null identifier, and rows with nothing but blanks and signs in both fields, are no records
    and are left out; a null field counts as an empty one. Repeated rows count each time. An empty table
    gives an empty result; other columns aren't looked at.
    """
    hot_rows, rest = _split_hot(keyed(rows, identifier, name, mark), hot_share)
    groups = rest.groupBy("key").agg(F.min("id").alias("first_id"), F.count("*").alias("copies"))
    return _two_level(hot_rows, salts).unionByName(groups).select("first_id", "copies")


def copies(rows: DataFrame, identifier: str = "row_order", name: str = "name", mark: str = "type_mark", hot_share: int = HOT_SHARE, salts: int = SALTS) -> DataFrame:
    """first_id, id: one row for each copy, with the smallest identifier of its group. Cases as in copy_groups.

    The representatives of hot keys are broadcast, fewer than ``hot_share`` of them; those of the rest are
    found by a window, which spills, over the one shuffle by key. A row delivered twice under one identifier
    gives one pair.
    """
    hot_rows, rest = _split_hot(keyed(rows, identifier, name, mark), hot_share)
    of_hot = hot_rows.join(F.broadcast(_two_level(hot_rows, salts)), "key").select("first_id", "id").distinct()
    of_rest = rest.repartition("key").groupBy("key", "id").agg(F.lit(1)).select(F.min("id").over(Window.partitionBy("key")).alias("first_id"), "id")
    return of_hot.unionByName(of_rest).where(F.col("id") > F.col("first_id"))
