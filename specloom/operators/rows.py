"""From raw rows to result rows: continuation rows, classes, context, confidence and status, in windows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from specloom.functions.text import round1, strip, text
from specloom.schema import COLUMNS, SECTION_STEMS
from specloom.session import cut

#: Fixed value. The code of a system.
SYSTEM = r"(?iu)^(?:[ПВКЕBPK]{1,4}\d+(?:[.,]\d+)?|К\d+(?:\.\d+)*)$"
BULLET = r"^[\-–—•]"


def row_number_of(source_row: Column) -> Column:
    """The first line a row stands on: 3 of "3+4"."""
    return F.regexp_extract(source_row, r"^\d+", 0).try_cast("int")


def filled(*columns: str) -> Column:
    return F.concat(*[strip(c) for c in columns]) != ""


def merge_continuations(rows: DataFrame, page: list[str], order: list[str]) -> DataFrame:
    """Rows that continue the one above are joined to it.

    A row continues if it has no amount or mark of its own, begins no list entry, and has either only a note or
    follows a name that ends in a comma, semicolon or hyphen. One window order serves all steps; the merged
    row has the texts joined, confidences folded pairwise, the box lengthened, the first row's other values.
    """
    w = Window.partitionBy(*page).orderBy(*order)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    r = rows.withColumns({c: strip(c) for c in COLUMNS})
    own = F.concat("position_no", "type_mark", "code", "manufacturer", "unit", "quantity", "mass") != ""
    n = F.row_number().over(w)
    tail = F.when(F.col("name") != "", F.col("name").rlike(r"[,;-]$")).when(F.col("own") | (F.col("n") == 1), False)
    r = r.withColumn("own", own).withColumn("n", n).withColumn("tail", tail)
    punctuated = F.coalesce(F.last("tail", ignorenulls=True).over(before), F.lit(False))
    only_note = (F.col("name") == "") & (F.concat("type_mark", "code", "note") != "")
    joins = (F.col("n") > 1) & ~F.col("own") & ~F.col("name").rlike(BULLET) & (only_note | punctuated)
    r = r.withColumn("joins", joins).withColumn("island", F.sum(F.when(F.col("joins"), 0).otherwise(1)).over(w))
    kept = [c for c in rows.columns if c not in (*COLUMNS, *page, "confidences", "bbox", "source_row")]
    first = lambda c: F.min_by(F.col(c), F.col("n")).alias(c)
    parts = F.array_sort(F.collect_list(F.struct("n", *COLUMNS, "confidences", "bbox", "source_row")), lambda a, b: a["n"] - b["n"])
    g = r.groupBy(*page, "island").agg(parts.alias("p"), *[first(c) for c in kept])

    def folded(c: str) -> Column:
        """A column's confidence: the mean of two at a time where both count, rounded each time; blank cells add nothing."""
        conf = lambda x: F.coalesce(F.try_element_at(x["confidences"], F.lit(c)), F.lit(0.0))
        step = lambda a, x: F.when(x[c] == "", a).otherwise(round1((a + conf(x)) / F.when((a != 0) & (conf(x) != 0), 2).otherwise(1)))
        return F.aggregate(F.slice("p", 2, 1 << 20), conf(F.get("p", F.lit(0))), step)

    top = F.get("p", F.lit(0))["bbox"]
    bottom = F.array_max(F.transform("p", lambda x: x["bbox"]["y"] + x["bbox"]["height"]))
    height = F.when(F.size("p") > 1, bottom - top["y"]).otherwise(top["height"])
    joined = lambda c: F.array_join(F.filter(F.transform("p", lambda x: x[c]), lambda t: t != ""), " ").alias(c)
    return g.select(
        *page,
        *kept,
        *[joined(c) for c in COLUMNS],
        F.create_map(*[x for c in COLUMNS for x in (F.lit(c), folded(c))]).alias("confidences"),
        F.struct(top["x"].alias("x"), top["y"].alias("y"), top["width"].alias("width"), height.alias("height")).alias("bbox"),
        F.array_join(F.transform("p", lambda x: x["source_row"]), "+").alias("source_row"),
    )


def classify() -> Column:
    """The type of a row by its own texts."""
    name, position = strip("name"), strip("position_no")
    low = F.lower(name)
    section = low.rlike("|".join(SECTION_STEMS)) & ~filled("quantity")
    code = lambda c: F.replace(c, F.lit(" "), F.lit("")).rlike(SYSTEM)
    return (
        F.when(section, "section")
        .when((code(name) | code(position)) & ~filled("quantity", "unit"), "system")
        .when(name.rlike(BULLET), "component")
        .when(filled("quantity", "unit", "type_mark", "manufacturer"), "item")
        .when(filled("name", "position_no"), "note")
        .otherwise("skip")
    )


#: Pages of a document that one window holds at most.
BLOCK_PAGES = 64


def with_context(rows: DataFrame, document: list[str], order: list[str], block_pages: int = BLOCK_PAGES) -> DataFrame:
    """row_type, section_name and system_name of each row, carried down its document; order begins with the page.

    A short note under a section becomes a system; rows without an amount after a kit become its components; section and
    system are the last ones above. Rows without a document, or without a page, are a document, or a block, of their own.

    One document may hold a large part of all rows, so windows run within blocks of its pages, over rows that are written
    once, and then over one summary row per block. Whether a short note is a system hangs on a section before its block,
    so a block says its last system for either case and the summary picks one.
    """
    name, position = strip("name"), strip("position_no")
    label = F.when(name != "", name).otherwise(position)
    others = [c for c in COLUMNS if c not in ("name", "position_no")]
    alone = ~filled(*others) & ((name != "").cast("int") + (position != "").cast("int") == 1)
    amount = F.concat(text("unit"), text("quantity"), text("manufacturer")) != ""
    heading = F.regexp_replace(name, r"[:*]+$", "")
    r = rows.withColumns({"_t": classify(), "_block": F.floor(F.col(order[0]) / block_pages)})
    r = r.withColumns(
        {
            "_label": label,
            "_amount": amount,
            "_short": (F.col("_t") == "note") & alone & (F.length(label) <= 5),
            "_heading": F.when(F.col("_t") == "section", F.when(heading != "", heading).otherwise(position)),
            "_opens": F.when(amount, (F.col("_t") == "item") & F.lower(name).contains("компл") & (text("quantity") != "")),
        }
    )
    w = Window.partitionBy(*document, "_block").orderBy(*order)
    here, above = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    last = lambda c, frame: F.last(c, ignorenulls=True).over(frame)
    r = r.withColumns({"_section": last("_heading", here), "_seen": last("_heading", above).isNotNull(), "_active": last("_opens", above)})
    code = F.col("_t") == "system"
    system = lambda c: last(F.when(c, F.col("_label")), here)
    r = cut(r.withColumns({"_system_after": system(code | F.col("_short")), "_system": system(code | (F.col("_short") & F.col("_seen")))}))
    at = F.struct(*order)
    kept = lambda c: F.max(F.when(F.col(c).isNotNull(), F.struct(at.alias("at"), F.col(c).alias("v"))))["v"].alias(c)
    ends = r.groupBy(*document, "_block").agg(*map(kept, ("_heading", "_opens", "_system", "_system_after")))
    before = Window.partitionBy(*document).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.withColumns({"_in_section": last("_heading", before), "_in_active": last("_opens", before)})
    ends = ends.withColumn("_in_system", last(F.when(F.col("_in_section").isNotNull(), F.col("_system_after")).otherwise(F.col("_system")), before))
    keys = [*document, "_block"]
    inherited = ends.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], "_in_section", "_in_active", "_in_system")
    r = r.join(inherited, reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]))
    promoted = F.col("_short") & (F.col("_seen") | F.col("_in_section").isNotNull())
    typed = F.when(promoted, "system").otherwise(F.col("_t"))
    part = F.coalesce("_active", "_in_active", F.lit(False)) & ~F.col("_amount") & ~typed.isin("section", "system") & (F.concat(text("name"), text("type_mark")) != "")
    own_system = F.when(F.col("_in_section").isNotNull(), F.col("_system_after")).otherwise(F.col("_system"))
    r = r.withColumns({"row_type": F.when(part, "component").otherwise(typed), "section_name": F.coalesce("_section", "_in_section", F.lit("")), "system_name": F.coalesce(own_system, "_in_system", F.lit(""))})
    return r.select(*[c for c in rows.columns if c not in ("row_type", "section_name", "system_name")], "row_type", "section_name", "system_name")


def row_confidence(confidences: str = "confidences") -> Column:
    """The mean confidence of the cells that hold text, to one decimal; 0 without any."""
    values = F.filter(F.array(*[F.when(strip(c) != "", F.try_element_at(F.col(confidences), F.lit(c))) for c in COLUMNS]), lambda v: v.isNotNull())
    return F.when(F.size(values) > 0, round1(F.aggregate(values, F.lit(0.0), lambda a, v: a + v) / F.size(values))).otherwise(0.0)


def status(row_type: Column, conf: Column) -> Column:
    """recognized, review or unrecognized; a system whose text is no system code is always for review."""
    label = F.when(strip("name") != "", strip("name")).otherwise(strip("position_no"))
    odd = (row_type == "system") & ~F.replace(label, F.lit(" "), F.lit("")).rlike(SYSTEM)
    sure = lambda limit: F.when(conf >= limit, "recognized").otherwise("review")
    named, measured = text("name") != "", F.concat(text("quantity"), text("unit")) != ""
    return F.when(odd, "review").when(row_type.isin("section", "system", "note", "component"), sure(55)).when(named & measured, sure(68)).when(named, "review").otherwise("unrecognized")


def result_rows(raw: DataFrame) -> DataFrame:
    """Raw rows to result rows: merged, typed, in context, with confidence, status, a stable id and an order."""
    raw = raw.withColumn("line", row_number_of(F.col("source_row")))
    merged = merge_continuations(raw, ["document_id", "page"], ["line"])
    placed = with_context(cut(merged), ["document_id"], ["page", "line"])
    out = placed.withColumn("confidence", row_confidence()).withColumn("status", status(F.col("row_type"), F.col("confidence")))
    out = out.withColumn("row_id", F.md5(F.concat_ws("/", "document_id", F.col("page").cast("string"), "source_row"))).withColumn("edited", F.lit(False)).withColumn("selected", F.lit(None).cast("boolean"))
    return out.withColumn("row_order", F.col("page").cast("long") * 100_000 + F.col("line")).drop("line", "row_no")
