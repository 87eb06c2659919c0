import zipfile
from xml.etree import ElementTree

import pytest
from pyspark.sql import functions as F

from specloom.operators import cells, export, geometry, pages, review, spelling
from specloom.sources.files import TOKENS, pdf_files
from specloom.sources.workbook import save_workbooks


def tokens(spark, given):
    """given: (left, top, width, height, conf, text)."""
    data = [(i, "D", 1, "page-mixed", 0, 5, 1, 1, 1, 1, i, *g[:4], g[4], g[5], None) for i, g in enumerate(given)]
    return spark.createDataFrame(data, TOKENS)


def grid(spark, xs, ys):
    return spark.createDataFrame([("D", 1, 100, 100, xs, ys)], "document_id string, page int, image_width int, image_height int, x_lines array<int>, y_lines array<int>")


def test_bucket(spark):
    from specloom.schema import Profile

    g = grid(spark, [10, 20, 30], [0, 20])
    t = tokens(spark, [(x, 2, 0, 8, 92.5, "w") for x in (10, 20)] + [(20, 2, 1, 8, 50.0, "v"), (30, 2, 1, 8, 50.0, "u"), (12, 2, 1, 8, 50.0, " ")])
    got = cells.bucket_tokens(t, g, Profile(header_rows=0)).select("text", "col_no").collect()
    assert sorted(map(tuple, got)) == [("v", 1), ("w", 0)]
    one = cells.cell_texts(cells.bucket_tokens(tokens(spark, [(2, 2, 8, 8, 92.5, "а"), (5, 2, 8, 8, None, "б")]), grid(spark, [0, 20], [0, 20]), Profile(header_rows=0))).collect()[0]
    assert (one["text"], one["confidence"]) == ("а б", 46.25)


def test_choice(spark):
    df = spark.createDataFrame([(1, 0, "unit", "шт.", 50.0, "page-mixed"), (1, 1, "unit", "xx", 85.0, "page-rus"), (2, 0, "name", None, None, None), (3, 0, "name", "один", 50.0, "a"), (3, 1, "name", "одна", 50.0, "b")], "k int, ordinal int, column_key string, text string, confidence double, source string")
    got = {r["k"]: (r["text"], r["source"]) for r in cells.choose_reading(df, ["k"], "ordinal").collect()}
    assert got == {1: ("шт.", "page-mixed"), 2: ("", "none"), 3: ("один", "a")}


def test_column_passes(spark):
    """Heights of an enlarged column are scaled back; a centre on a line is above it."""
    from specloom.schema import Profile

    g = grid(spark, [0, 10, 20], [0, 20, 40, 60])
    base = tokens(spark, [(1, 10, 5, 42, 90.0, "a"), (1, 31, 5, 0, 80.0, "b"), (1, 62, 5, 0, 80.0, "c"), (1, 200, 5, 2, 80.0, "out"), (1, 0, 5, 4, 80.0, " ")])
    t = base.withColumn("pass_name", F.lit("accurate-column-name"))
    got = {r["text"]: (r["row_no"], r["col_no"]) for r in cells.column_pass_tokens(t, g, Profile(header_rows=1, columns=("position_no", "name"))).collect()}
    assert got == {"a": (1, 1), "b": (1, 1), "c": (2, 1)}  # 20 + 31 / 1.55 = 40: the line itself
    assert cells.column_pass_tokens(base, g).count() == 0


def test_cells_read_again(spark):
    """A number that is none is always read again, doubtful cells within the budget, and amounts are filled."""
    from specloom.schema import Profile

    xs, ys = [0, 10, 20, 30], [0, 20, 40, 60]
    g = grid(spark, xs, ys)
    first = tokens(spark, [(1, 2, 5, 8, 40.0, "Клпн"), (11, 2, 5, 8, 90.0, "1-2"), (1, 22, 5, 8, 99.0, "Отвод"), (11, 22, 5, 8, 99.0, "5"), (1, 42, 5, 8, 10.0, "Щтт")])
    again = tokens(spark, [(1, 2, 5, 8, 95.0, "Клапан"), (11, 2, 5, 8, 80.0, "12"), (1, 22, 5, 8, 99.9, "Отвоз"), (21, 22, 5, 8, 80.0, "шт"), (1, 42, 5, 8, 90.0, "Щит")]).withColumn("pass_name", F.lit("cell-accurate-1")).withColumn("pass_ordinal", F.lit(9))
    of = lambda n, accurate: {(r["row_no"], r["column_key"]): r["text"] for r in cells.read_cells(first.unionByName(again), g, Profile(header_rows=0, columns=("name", "quantity", "unit"), refinements=n), accurate=accurate).collect()}
    assert of(8, True) == {(0, "name"): "Клапан", (0, "quantity"): "12", (1, "name"): "Отвод", (1, "quantity"): "5", (1, "unit"): "шт.", (2, "name"): "Щит"}
    assert of(1, True)[2, "name"] == "Щтт"
    assert of(8, False)[0, "name"] == "Клпн"
    assert of(8, False)[0, "quantity"] == "12"


def test_noise_and_doubt(spark):
    df = spark.createDataFrame([("name", "|", 50.0), ("name", "|", 80.0), ("unit", "zz", 99.0), ("quantity", "0", 10.0), ("position_no", "--", 90.0)], "k string, t string, c double")
    assert [r[0] for r in df.select(cells.remove_noise(F.col("k"), F.col("t"), F.col("c"))).collect()] == ["", "|", "", "0", ""]
    assert [r[0] for r in df.select(cells.doubtful(F.col("k"), F.col("t"), F.col("c"))).collect()] == [True, False, True, True, False]


def test_pages(spark):
    df = spark.createDataFrame([("a", "18-20, 22, 25-26", 58), ("b", "5-3", 10), ("c", "1, 11", 10), ("d", None, 5), ("e", "1-2-3", 9)], "k string, e string, n int")
    got = {}
    for r in pages.parse_pages(df, "k", "e", "n").collect():
        got.setdefault(r["k"], []).append(r["page"])
    assert {k: sorted(v) for k, v in got.items()} == {"a": [18, 19, 20, 22, 25, 26], "b": [3, 4, 5]}
    bad = {r["k"]: r["p"] for r in df.select("k", pages.page_problem(F.col("e"), F.col("n")).alias("p")).collect()}
    assert bad == {"a": None, "b": None, "c": "11", "d": None, "e": "1-2-3"}
    df = spark.createDataFrame([("a", p) for p in (1, 2, 3, 5, 7, 8, 8)], "k string, page int")
    assert pages.compact_pages(df, "k").collect()[0]["ranges"] == "1-3, 5, 7-8"
    assert [tuple(r)[1:] for r in pages.page_runs(df, "k", block=2).orderBy("a").collect()] == [(1, 3), (5, 5), (7, 8)]


def test_geometry(spark):
    df = spark.createDataFrame([("a", i) for i in (3, 4, 5, 8, 9, 15, 16)], "k string, i int")
    assert sorted(r["line"] for r in geometry.runs(df, ["k"], "i").collect()) == [4, 8, 16]
    df = spark.createDataFrame([("a", [0, 10, 20, 30, 80]), ("b", [0, 5, 90])], "k string, l array<int>")
    assert {r["k"]: r["lines"] for r in geometry.trim_footer(df, ["k"], "l").collect()} == {"a": [0, 10, 20, 30], "b": [0, 5, 90]}


def test_spelling(spark):
    words = spark.createDataFrame([("клaпан",), ("Отвот",), ("труба",), ("К25",), (None,)], "word string")
    vocabulary = spark.createDataFrame([("клапан", 0), ("отвод", 1), ("отводы", 2)], "entry string, ordinal int")
    got = {r["word"]: r["corrected"] for r in spelling.correct_words(words, vocabulary).collect()}
    assert got == {"клaпан": "клапан"}


def test_corrected_texts(spark):
    from specloom.schema import Profile

    entries = [("word", "клапан", None), ("word", "клапана", None), ("word", "отвод", None), ("exact", "фультр", "фильтр"), ("exact", "отвот", "отвода"), ("phrase", "привод воздушного клапана", None)]
    lexicon = spark.createDataFrame([(*e, i) for i, e in enumerate(entries)], "kind string, lex_key string, lex_value string, ordinal int")
    cases = {
        "Клaпан, ФУЛЬТР (клaпан/Отвот) К25..": "Клапан, ФИЛЬТР (клапан/Отвода) К25.",
        "Привод воздушнаго клапана": "Привод воздушного клапана",
        "Привод воздушного клапана 5": "Привод воздушного клапана 5",
        "труба": "труба",
        "": "",
        None: None,
    }
    df = spark.createDataFrame([(i, t, t) for i, t in enumerate([*cases, "труба"])], "i int, text string, given string")
    got = [(r["given"], r["text"]) for r in spelling.correct_texts(df, "text", lexicon).collect()]
    assert len(got) == len(cases) + 1
    assert dict(got) == cases
    left = spelling.correct_texts(df, "text", lexicon, F.col("i") > 0).where("i = 0").first()
    assert left["text"] == left["given"]
    g, t = grid(spark, [0, 20, 40], [0, 20]), tokens(spark, [(2, 2, 8, 8, 90.0, "Клaпан"), (12, 2, 5, 8, 90.0, "фультр"), (22, 2, 8, 8, 90.0, "фультр")])
    profile = Profile(header_rows=0, columns=("name", "type_mark"))
    assert {r["column_key"]: r["text"] for r in cells.read_cells(t, g, profile, lexicon).collect()} == {"name": "Клапан фильтр", "type_mark": "фультр"}
    assert {r["column_key"]: r["text"] for r in cells.read_cells(t, g, profile).collect()}["name"] == "Клaпан фультр"


def test_export_and_review(spark, tmp_path):
    df = spark.createDataFrame([("Отвод\tА", "шт.", "12,5", "item", True, "review"), ("Раздел", "", "", "section", None, "review"), ("Лист", "м", "x", "item", False, "edited"), ("", "", "", "item", None, "recognized")], "name string, unit string, quantity string, row_type string, selected boolean, status string")
    out = export.with_numbers(export.export_rows(df, ["name", "unit", "quantity", "nosuch"]))
    assert [tuple(r) for r in out.collect()] == [("Отвод\tА", "шт.", 12.5, None)]
    dash = spark.createDataFrame([("", "-", "item"), ("", "1-2", "item"), ("", "7", "section"), (None, None, None)], "name string, quantity string, row_type string").withColumn("selected", F.lit(None).cast("boolean"))
    both = export.with_numbers(export.export_rows(dash, ["quantity", "name", "quantity"]))
    assert both.columns == ["quantity", "name", "quantity_2", "quantity_text", "quantity_2_text"]
    assert [tuple(r) for r in both.collect()] == [(None, "", None, "1-2", "1-2")]
    assert export.with_titles(export.export_rows(dash, ["quantity"], only_exportable=False)).columns == ["Количество"]
    assert df.select(export.tsv_line(["name", "unit"])).first()[0] == "Отвод А\tшт."
    with pytest.raises(ValueError):
        export.known_columns(["nosuch"])
    assert tuple(review.counters(df).collect()[0]) == (4, 2, 2, 2)
    marked = export.with_numbers(export.export_rows(df, ["name", "unit", "quantity"], keep=("status",))).drop("quantity_text")
    save_workbooks(marked.coalesce(1), str(tmp_path / "w"), sheet="Лист", status="status", at="01.02.2031 10:00")
    files = list((tmp_path / "w").glob("*"))
    assert [f.suffix for f in files] == [".xlsx"]
    with zipfile.ZipFile(files[0]) as z:
        parts = {n: z.read(n).decode() for n in z.namelist()}
    for n, text in parts.items():
        if n.endswith(".xml") or n.endswith(".rels"):
            ElementTree.fromstring(text)
    sheet = parts["xl/worksheets/sheet1.xml"]
    assert '<c r="C2" s="3"><v>12.5</v></c>' in sheet
    assert "Отвод\tА" in sheet
    assert 'state="frozen"' in sheet
    assert sheet.count("<row ") == 2
    assert 'ref="A1:C2"' in parts["xl/tables/table1.xml"]
    assert 'name="Наименование и техническая характеристика"' in parts["xl/tables/table1.xml"]
    assert ">01.02.2031 10:00<" in parts["xl/worksheets/sheet2.xml"]
    assert '<c r="B4" s="1" t="inlineStr"><is><t xml:space="preserve">1</t>' in parts["xl/worksheets/sheet2.xml"]
    assert 'name="Лист"' in parts["xl/workbook.xml"]
    save_workbooks(spark.range(5).select(F.col("id").cast("string").alias("name")).coalesce(1), str(tmp_path / "many"), rows_per_file=2)
    assert len(list((tmp_path / "many").glob("*.xlsx"))) == 3
    save_workbooks(marked.limit(0), str(tmp_path / "none"), status="status")
    assert not list((tmp_path / "none").glob("*.xlsx"))


def test_edits(spark):
    rows = spark.createDataFrame([(1, "a"), (2, None), (3, "c")], "k int, m string")
    edits = spark.createDataFrame([(1, "x", 1), (1, "y", 2), (2, None, 3), (3, "c", 1), (None, "z", 9)], "k int, typed string, at int")
    got = {r["k"]: (r["m"], r["edited"]) for r in review.merge_edits(rows, edits, "k", "m", "typed", ["at"]).collect()}
    assert got == {1: ("y", True), 2: (None, False), 3: ("c", False)}


def test_sources(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"x" * 10)
    (tmp_path / "b.PDF").write_bytes(b"x" * 99)
    (tmp_path / "c.txt").write_bytes(b"x")
    got = {r["title"]: r["problem"] is None for r in pdf_files(spark, str(tmp_path), 50).collect()}
    assert got == {"a": True, "b": False}


def test_stream(spark, tmp_path):
    from specloom.streaming.ingest import keep_cells, latest_cells, token_stream

    folder = str(tmp_path / "t")
    g = grid(spark, [0, 20], [0, 20, 40, 60])
    for word in ("а", "б"):
        tokens(spark, [(2, 42, 8, 8, 90.0, word)]).write.mode("append").parquet(folder)
        keep_cells(token_stream(spark, folder), str(tmp_path / "out"), g, str(tmp_path / "cp"), buckets=4).awaitTermination()
    page = spark.createDataFrame([("D", 1)], "document_id string, page int")
    for pages, want in ((None, [["а", "б"]]), (page, [["а", "б"]]), (page.limit(0), [])):
        assert [sorted(r["text"].split()) for r in latest_cells(spark, str(tmp_path / "out"), pages, buckets=4).collect()] == want
