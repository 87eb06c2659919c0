import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from specloom.jobs import Jobs
from specloom.operators import cells
from specloom.schema import COLUMNS, Profile
from specloom.sources import images
from specloom.sources.store import Store, read_json, write_json

XS = [40, 85, 376, 511, 590, 688, 733, 778, 832, 925]  # the expected shares of a width of 885, on a page of 960
YS = [30, 70, 110, 150, 190, 230, 270]


def page(width=960, height=320):
    gray = np.full((height, width), 255, np.uint8)
    for x in XS:
        gray[YS[0] : YS[-1] + 2, x : x + 2] = 0
    for y in YS:
        gray[y : y + 2, XS[0] : XS[-1] + 2] = 0
    gray[120:130, 100:120] = 40  # a word in the third row
    return gray


def test_png_round_trip():
    gray = page()
    assert np.array_equal(images.to_gray(images.decode_png(images.encode_png(gray))), gray)
    with pytest.raises(ValueError, match="no PNG"):
        images.decode_png(b"x")


def test_png_filters():
    """Lines under each of the five filters, made by their definition."""
    import struct
    import zlib

    rng = np.random.default_rng(3)
    rgb = rng.integers(0, 256, (5, 7, 3), dtype=np.uint8)
    lines = b""
    for y, kind in enumerate((0, 1, 2, 3, 4)):
        body = bytearray()
        for i in range(21):
            here, a = int(rgb[y].ravel()[i]), int(rgb[y].ravel()[i - 3]) if i >= 3 else 0
            b, c = (int(rgb[y - 1].ravel()[i]), int(rgb[y - 1].ravel()[i - 3]) if i >= 3 else 0) if y else (0, 0)
            p = a + b - c
            nearest = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
            body.append((here - (0, a, b, (a + b) // 2, nearest)[kind]) % 256)
        lines += bytes([kind]) + bytes(body)
    chunk = lambda name, data: struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))
    png = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 7, 5, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")
    assert np.array_equal(images.decode_png(png), rgb)


def test_table_of_a_page():
    t = images.detect_table(page())
    assert (len(t.x_lines), t.y_lines[0], len(t.y_lines)) == (10, 30, 7)
    assert all(abs(a - b) <= 1 for a, b in zip(t.x_lines, XS))
    inside = images.detect_table(page(), (0.05, 0.1, 0.9, 0.8))
    assert inside == t
    with pytest.raises(images.TableError):
        images.detect_table(np.full((320, 960), 255, np.uint8))
    with pytest.raises(images.TableError):
        images.detect_table(np.zeros((0, 0), np.uint8))
    assert images.trim_lines([0, 10, 20, 30, 80]) == [0, 10, 20, 30]
    assert images.select_columns([1, 2, 3], 100, True) == [1, 2, 3]


def test_lines_are_removed_and_words_stay():
    clean = images.without_lines(page())
    assert (clean[120:130, 100:120] == 40).all()
    assert (clean == 255).sum() == clean.size - 200


def test_preparation():
    gray = np.tile(np.linspace(90, 160, 40).astype(np.uint8), (24, 1))
    big = images.enlarge(gray, 2.0)
    assert big.shape == (48, 80)
    assert abs(int(big[10, 40]) - int(gray[5, 20])) < 4
    even = images.equalize(big, 2.0)
    assert int(even.max()) - int(even.min()) > int(big.max()) - int(big.min())
    assert set(np.unique(images.black_and_white(gray))) == {0, 255}
    flat = np.full((40, 40), 200, np.uint8)
    flat[18:22, 10:30] = 120
    assert (images.black_and_white_local(flat)[19:21, 12:28] == 0).all()
    assert images.black_and_white_local(flat)[0, 0] == 255


def scanner():
    class Scanner:
        """Says where it finds something dark, with the size of the image for a text."""

        def words(self, image, language, layout, allowed):
            ys, xs = np.nonzero(image < 128)
            if not len(ys):
                return pd.DataFrame()
            return pd.DataFrame([{"block_num": 1, "par_num": 1, "line_num": 1, "word_num": 1, "left": int(xs.min()), "top": int(ys.min()), "width": int(np.ptp(xs)) + 1, "height": int(np.ptp(ys)) + 1, "conf": 50.0, "text": f"слово {language}"}])

    return Scanner()


def test_pages_to_cells(spark):
    """Words of page, column and cell passes all fall into the cell they were printed in; a broken page is an error of its own."""
    pages = spark.createDataFrame([("D", 1, bytearray(images.encode_png(page()))), ("D", 2, bytearray(b"x")), ("D", 3, None)], "document_id string, page int, content binary")
    grid, errors = images.detect_tables(pages)
    assert [r["page"] for r in grid.collect()] == [1]
    assert {r["page"] for r in errors.collect()} == {2, 3}
    tokens, _ = images.read_words(pages.where("page = 1"), scanner())
    whole = cells.bucket_tokens(tokens.where(F.col("pass_name").startswith("page-")), grid).select("row_no", "col_no").distinct().collect()
    assert [tuple(r) for r in whole] == [(2, 1)]
    columns = cells.column_pass_tokens(tokens, grid).where("pass_name = 'accurate-column-name'").select("row_no", "col_no").collect()
    assert [tuple(r) for r in columns] == [(2, 1)]
    best = cells.read_cells(tokens.where(F.col("pass_name").startswith("page-")), grid, Profile())
    wanted = cells.wanted_again(best)
    assert [(r["row_no"], r["column_key"]) for r in wanted.collect()] == [(2, "name")]
    again, _ = images.read_cells_again(pages.where("page = 1"), wanted, scanner())
    assert {r["pass_name"] for r in again.collect()} <= {"cell-accurate-1", "cell-accurate-2"}
    assert [tuple(r) for r in cells.bucket_tokens(again, grid).select("row_no", "col_no").distinct().collect()] == [(2, 1)]


def test_recognition_from_images(spark):
    from specloom.plans.recognition import recognize, suggest_pages

    pages = spark.createDataFrame([("D", 1, bytearray(images.encode_png(page()))), ("D", 2, bytearray(b"x")), ("D", 3, bytearray(images.encode_png(np.full((320, 960), 255, np.uint8))))], "document_id string, page int, content binary")
    found, errors = suggest_pages(pages)
    assert [r["page"] for r in found.collect()] == [1]
    assert [r["page"] for r in errors.collect()] == [2]
    done = recognize(pages, scanner()).require_some()
    rows = done.rows.collect()
    assert [(r["name"], r["page"], r["row_type"], r["status"]) for r in rows] == [("слово rus+eng", 1, "note", "review")]
    assert rows[0]["ocr_sources"]["name"].startswith("cell-accurate-")
    assert {r["page"] for r in done.errors.collect()} == {2, 3}
    assert [(r["column_count"], r["row_count"]) for r in done.geometry.collect()] == [(9, 6)]
    with pytest.raises(RuntimeError, match="no PNG"):
        recognize(pages.where("page = 2"), scanner()).require_some()


def test_reader_of_words_is_looked_for(tmp_path):
    (tmp_path / "rus.traineddata").write_bytes(b"")
    assert images.missing_models(str(tmp_path)) == ["eng"]
    assert images.command_of(None, ["surely-no-program", "ls"]).endswith("ls")
    assert images.command_of("surely-no-program", []) is None


def test_ingest(spark, tmp_path):
    from specloom.sources.store import ingest

    for name, content in (("a.pdf", bytes([2])), ("b.PDF", b"bad"), ("c.txt", b"x")):
        (tmp_path / name).write_bytes(content)
    store = Store(spark, str(tmp_path / "s"))
    assert [(r["filename"], r["error"]) for r in ingest(store, str(tmp_path), reader()).collect()] == [("b.PDF", "ValueError: no document")]
    assert [(r["filename"], r["page_count"], r["title"]) for r in store.documents().collect()] == [("a.pdf", 2, "Проект")]


def reader():
    class Reader:
        def inspect(self, content):
            if content == b"bad":
                raise ValueError("no document")
            return content[0], "" if content[0] == 1 else "Проект"

        def render(self, content, page, dpi):
            return f"{page} at {dpi}".encode()

    return Reader()


def test_documents_are_inspected_and_rendered(spark):
    files = spark.createDataFrame([("A", "a.pdf", 2, bytearray([2, 0])), ("B", "b.c.pdf", 1, bytearray([1])), ("C", "c.pdf", 3, bytearray(b"bad"))], "document_id string, filename string, size_bytes long, content binary")
    found, errors = images.inspect_documents(files, reader())
    assert {r["document_id"]: (r["page_count"], r["title"]) for r in found.collect()} == {"A": (2, "Проект"), "B": (1, "b.c")}
    assert [(r["document_id"], r["error"]) for r in errors.collect()] == [("C", "ValueError: no document")]
    wanted = spark.createDataFrame([("A", 1), ("A", 2), ("A", 2), ("A", 3), ("X", 1)], "document_id string, page int")
    kept = spark.createDataFrame([("A", 1, 300, bytearray(b"kept")), ("A", 2, 90, bytearray(b"other"))], "document_id string, page int, dpi int, content binary")
    pages, errors = images.render_pages(files, wanted, reader(), 999, kept)
    assert {r["page"]: bytes(r["content"]) for r in pages.collect()} == {1: b"kept", 2: b"2 at 300"}
    assert {(r["document_id"], r["page"]): r["error"] for r in errors.collect()} == {("A", 3): "IndexError: page 3 of 2", ("X", 1): "FileNotFoundError: X"}
    assert images.clamped_dpi(10) == 72


def test_store(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    assert store.documents().count() == 0
    with pytest.raises(LookupError):
        store.document("A")
    store.add(spark.createDataFrame([("A", "a.pdf", 2, "a", 9), ("B", "b.pdf", 1, "b", 9)], "document_id string, filename string, page_count int, title string, size_bytes long"))
    store.add(spark.createDataFrame([("A", "a.pdf", 2, "new", 9)], "document_id string, filename string, page_count int, title string, size_bytes long"))
    assert (store.document("A")["title"], store.document("A")["has_result"]) == ("new", False)
    with pytest.raises(LookupError):
        store.result("A")
    rows = spark.createDataFrame([("A", "1", "item", "review"), ("A", "2", "note", "review"), ("B", "3", "item", "edited")], "document_id string, row_id string, row_type string, status string")
    errors = spark.createDataFrame([("A", 2, "no table")], "document_id string, page int, error string")
    store.save(rows, errors)
    store.save(rows.where("row_id = '2'"))
    assert [r["row_id"] for r in store.result("A").collect()] == ["2"]
    assert {r["row_id"] for r in store.results().collect()} == {"2", "3"}
    assert {(r["what"], r["value"]): r["n"] for r in store.summary("A").collect()} == {("total", ""): 1, ("status", "review"): 1, ("row_type", "note"): 1, ("page_errors", ""): 0}
    assert store.clean() == 0
    store.save(rows.where("document_id = 'B'"))
    assert store.clean() == 2  # the rows and the errors of the first save
    assert set(store.results().columns) >= set(COLUMNS)
    state = str(tmp_path / "state.json")
    assert read_json(spark, state, {}) == {}
    for value in ({"title": "Ёлка"}, [1, 2]):
        write_json(spark, state, value)
        assert read_json(spark, state) == value


def test_jobs(spark):
    jobs = Jobs(spark)

    def count(progress):
        progress(1, 2, "половина")
        return spark.range(10).count()

    def fail(progress):
        raise ValueError("нет")

    one, two = jobs.submit(count), jobs.submit(fail)
    done = jobs.wait(one, 60)
    assert (done["status"], done["result"], done["message"], done["current"], done["total"]) == ("completed", 10, "половина", 1, 2)
    assert done["spark_jobs"] >= 1
    lost = jobs.wait(two, 60)
    assert (lost["status"], lost["error"]) == ("failed", "ValueError: нет")
    with pytest.raises(KeyError):
        jobs.state("unknown")
    jobs.close()


def test_no_local_folder_on_a_cluster(spark, monkeypatch):
    from specloom import session

    class Cluster:
        class sparkContext:  # noqa: N801
            master = "spark://host:7077"
            getCheckpointDir = staticmethod(lambda: None)  # noqa: N815
            getConf = staticmethod(lambda: {})  # noqa: N815

        class conf:  # noqa: N801
            get = staticmethod(lambda name, default: None)

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.ensure_checkpoint_dir(Cluster)
    assert session.is_local(spark)


def test_cuts_are_removed(spark):
    from urllib.parse import urlparse

    from specloom import session

    outside = session.cut(spark.range(3))
    with session.cuts_removed(spark):
        inside = session.cut(spark.range(4))
        assert inside.count() == 4
        folder = urlparse(inside.inputFiles()[0]).path.rsplit("/", 1)[0]
    import os

    assert not os.path.exists(folder)
    assert outside.count() == 3
