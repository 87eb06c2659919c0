"""Page images: decoding, ruled lines and the table they make, and what is handed to a reader of words.

The work on one page is numpy and runs in mapInPandas, a row per page; pages that fail give a row of errors and don't
stop the others. Rendering of documents and recognition of words stay behind protocols.
"""

from __future__ import annotations

import shutil
import struct
import zlib
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from pathlib import Path
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from specloom.operators.geometry import horizontal_candidates, line_masks, vertical_candidates
from specloom.schema import COLUMNS, PASS_OF_COLUMN, WIDTH_RATIOS, Profile, reading_plan
from specloom.session import cut
from specloom.sources.files import TOKENS

#: Fixed values. Resolutions that pages are fetched in, at least and at most; the one pages are looked through in.
LEAST_DPI, MOST_DPI, LOOK_DPI = 72, 300, 90
GRID = "document_id string, page int, image_width int, image_height int, x_lines array<int>, y_lines array<int>"
_SIGNATURE = b"\x89PNG\r\n\x1a\n"


class DocumentReader(Protocol):
    """Opens documents; runs in the executors."""

    def inspect(self, content: bytes) -> tuple[int, str]:
        """Number of pages and title, '' without one."""

    def render(self, content: bytes, page: int, dpi: int) -> bytes:
        """A page, counted from 1, as PNG."""


class WordReader(Protocol):
    """Recognises words; runs in the executors."""

    def words(self, image: np.ndarray, language: str, layout: int, allowed: str | None) -> pd.DataFrame:
        """block_num, par_num, line_num, word_num, left, top, width, height, conf, text of a gray image."""


def missing_models(folder: str, languages: Sequence[str] = ("rus", "eng"), ending: str = ".traineddata") -> list[str]:
    """The languages for which a word reader's folder has no model, to be asked before pages are read in accurate mode."""
    return [x for x in languages if not (Path(folder) / f"{x}{ending}").is_file()]


def command_of(named: str | None, usual: Sequence[str]) -> str | None:
    """The program a word reader runs: the one named, else the first usual one that is there; None without any."""
    return next((found for c in (named, *usual) if c and (found := shutil.which(c))), None)


class TableError(ValueError):
    """A page on which no table is found."""


def decode_png(data: bytes) -> np.ndarray:
    """Height × width × channels of a PNG of 8 bits a channel, not interlaced; palettes are resolved."""
    if data[:8] != _SIGNATURE:
        raise ValueError("no PNG")
    at, packed, palette = 8, [], None
    width = height = depth = kind = lace = 0
    while at + 8 <= len(data):
        size, name = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + size]
        if name == b"IHDR":
            width, height, depth, kind, _, _, lace = struct.unpack(">IIBBBBB", body)
        elif name == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif name == b"IDAT":
            packed.append(body)
        at += size + 12
    if depth != 8 or lace:
        raise ValueError("only PNG of 8 bits a channel without interlacing is read")
    channels = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[kind]
    lines = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(height, 1 + width * channels)
    out = np.zeros((height, width, channels), np.uint8)
    above = np.zeros((width, channels), np.int32)
    for y, line in enumerate(lines):
        raw = line[1:].reshape(width, channels).astype(np.int32)
        above = out[y] = _unfiltered(int(line[0]), raw, above)
        above = above.astype(np.int32)
    return palette[out[..., 0]] if kind == 3 and palette is not None else out


def _unfiltered(kind: int, raw: np.ndarray, above: np.ndarray) -> np.ndarray:
    if kind == 0:
        return raw.astype(np.uint8)
    if kind == 1:
        return (np.cumsum(raw, axis=0) & 255).astype(np.uint8)
    if kind == 2:
        return (raw + above & 255).astype(np.uint8)
    left, corner = np.zeros(raw.shape[1], np.int32), np.zeros(raw.shape[1], np.int32)
    out = np.zeros(raw.shape, np.uint8)
    for x in range(len(raw)):
        b = above[x]
        if kind == 3:
            guess = (left + b) >> 1
        else:
            p = left + b - corner
            pa, pb, pc = abs(p - left), abs(p - b), abs(p - corner)
            guess = np.where((pa <= pb) & (pa <= pc), left, np.where(pb <= pc, b, corner))
        left = raw[x] + guess & 255
        out[x], corner = left, b
    return out


def encode_png(gray: np.ndarray) -> bytes:
    """A gray image as PNG."""
    h, w = gray.shape
    chunk = lambda name, body: struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))
    lines = np.hstack([np.zeros((h, 1), np.uint8), gray.astype(np.uint8)])
    return _SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines.tobytes(), 6)) + chunk(b"IEND", b"")


def to_gray(image: np.ndarray) -> np.ndarray:
    """Brightness of an image of 1 to 4 channels; transparency is left out."""
    if image.ndim == 2:
        return image
    if image.shape[2] < 3:
        return image[..., 0]
    return np.rint(image[..., :3].astype(np.float64) @ (0.299, 0.587, 0.114)).astype(np.uint8)


def select_columns(candidates: list[int], width: int, margin: bool, ratios: tuple[float, ...] = WIDTH_RATIOS) -> list[int]:
    """Of the lines found, the ten neighbours whose distances are nearest to the expected shares; see geometry.best_columns for whole tables."""
    n = len(ratios) + 1
    if len(candidates) < n:
        return candidates
    runs = np.lib.stride_tricks.sliding_window_view(np.asarray(candidates, dtype=np.float64), n)
    span = runs[:, -1] - runs[:, 0]
    error = np.abs(np.diff(runs, axis=1) / span[:, None] - np.asarray(ratios)).mean(axis=1)
    if margin:
        error = error + np.abs(runs[:, 0] / width - 0.045) * 0.04
    error = np.where(span >= width * 0.72, np.round(error, 12), np.inf)
    best = int(error.argmin()) if np.isfinite(error).any() else 0
    return candidates[best : best + n]


def trim_lines(lines: list[int]) -> list[int]:
    """Lines up to the first gap, from the third on, that is over 2.15 times the median of the regular ones."""
    if len(lines) < 5:
        return lines
    gaps = np.diff(np.asarray(lines, dtype=np.float64))
    regular = gaps[gaps < np.percentile(gaps, 75)]
    wide = np.flatnonzero(gaps > np.median(regular if len(regular) else gaps) * 2.15)
    wide = wide[wide >= 2]
    return lines[: int(wide[0]) + 1] if len(wide) else lines


def widened(crop: tuple[float, float, float, float], width: int, height: int) -> tuple[int, int, int, int]:
    """left, top, width, height in pixels of a crop in fractions, widened and kept inside; see geometry.expand_crop for columns."""
    x, y, w, h = crop
    px, py = max(8, int(width * 0.03)), max(8, int(height * 0.015))
    left, top = (max(0, min(int(f * size) - pad, size - 1)) for f, size, pad in ((x, width, px), (y, height, py)))
    return left, top, max(20, min(int(w * width) + 2 * px, width - left)), max(20, min(int(h * height) + 2 * py, height - top))


@dataclass(frozen=True)
class Table:
    x_lines: list[int]
    y_lines: list[int]
    image_width: int
    image_height: int


def detect_table(image: np.ndarray, crop: tuple[float, float, float, float] | None = None) -> Table:
    """The ten vertical and four or more horizontal lines of the table on a page, in pixels of the whole page. crop: x, y, width, height as fractions."""
    if image is None or image.size == 0:
        raise TableError("the image of the page is empty")
    gray = to_gray(image)
    height, width = gray.shape
    left = top = 0
    if crop is not None:
        left, top, w, h = widened(crop, width, height)
        gray = gray[top : top + h, left : left + w]
    horizontal, vertical = line_masks(gray)
    xs = select_columns(vertical_candidates(vertical, margin=crop is None), gray.shape[1], margin=crop is None)
    if len(xs) != len(WIDTH_RATIOS) + 1:
        raise TableError(f"nine columns need ten lines, found {len(xs)}")
    ys = trim_lines(horizontal_candidates(horizontal, xs[0], xs[-1]))
    if len(ys) < 4:
        raise TableError(f"rows need four lines at least, found {len(ys)}")
    return Table([x + left for x in xs], [y + top for y in ys], width, height)


def without_lines(gray: np.ndarray) -> np.ndarray:
    """The page with its ruled lines, and a pixel to the right of and below them, painted white."""
    horizontal, vertical = line_masks(gray)
    mask = np.pad(horizontal | vertical, ((1, 0), (1, 0)))
    wide = mask[1:, 1:] | mask[:-1, 1:] | mask[1:, :-1] | mask[:-1, :-1]
    return np.where(wide, np.uint8(255), gray)


def enlarge(gray: np.ndarray, scale: float) -> np.ndarray:
    """Cubic interpolation, the edge pixels repeated."""

    def weights(n: int) -> tuple[np.ndarray, np.ndarray]:
        at = (np.arange(max(1, round(n * scale))) + 0.5) / scale - 0.5
        base = np.floor(at).astype(int)
        taps = base[:, None] + np.arange(-1, 3)
        d = np.abs(at[:, None] - taps)
        a = -0.75
        w = np.where(d <= 1, (a + 2) * d**3 - (a + 3) * d**2 + 1, np.where(d < 2, a * d**3 - 5 * a * d**2 + 8 * a * d - 4 * a, 0.0))
        return np.clip(taps, 0, n - 1), w

    rows, wr = weights(gray.shape[0])
    cols, wc = weights(gray.shape[1])
    tall = np.einsum("ij,ijx->ix", wr, gray.astype(np.float64)[rows])
    return np.clip(np.rint(np.einsum("xj,yxj->yx", wc, tall[:, cols])), 0, 255).astype(np.uint8)


def equalize(gray: np.ndarray, limit: float, tiles: int = 8) -> np.ndarray:
    """Contrast evened out by tiles: cumulative counts clipped at ``limit`` times the mean, blended between the tiles."""
    h, w = gray.shape
    th, tw = -(-h // tiles), -(-w // tiles)
    padded = np.pad(gray, ((0, th * tiles - h), (0, tw * tiles - w)), mode="symmetric" if h > 1 and w > 1 else "edge")
    area = th * tw
    most = max(1, int(limit * area / 256))
    maps = np.empty((tiles, tiles, 256))
    for i in range(tiles):
        for j in range(tiles):
            counts = np.bincount(padded[i * th : (i + 1) * th, j * tw : (j + 1) * tw].ravel(), minlength=256)
            over = int(np.maximum(counts - most, 0).sum())
            counts = np.minimum(counts, most) + over // 256
            if rest := over % 256:
                counts[: 256 // rest * rest : 256 // rest] += 1  # what is left is spread over all levels
            maps[i, j] = np.minimum(np.cumsum(counts) * (255.0 / area), 255)
    fy, fx = (np.arange(h) + 0.5) / th - 0.5, (np.arange(w) + 0.5) / tw - 0.5
    clip = lambda f: (np.clip(np.floor(f).astype(int), 0, tiles - 1), np.clip(np.floor(f).astype(int) + 1, 0, tiles - 1), f - np.floor(f))
    (y0, y1, ay), (x0, x1, ax) = clip(fy), clip(fx)
    at = lambda ys, xs: maps[ys[:, None], xs[None, :], gray]
    upper, lower = at(y0, x0) * (1 - ax) + at(y0, x1) * ax, at(y1, x0) * (1 - ax) + at(y1, x1) * ax
    return np.rint(upper * (1 - ay[:, None]) + lower * ay[:, None]).astype(np.uint8)


def black_and_white(gray: np.ndarray) -> np.ndarray:
    """Split where the variance between the dark and the bright pixels is largest."""
    counts = np.bincount(gray.ravel(), minlength=256).astype(np.float64)
    dark = np.cumsum(counts)
    total, sums = dark[-1], np.cumsum(counts * np.arange(256))
    with np.errstate(divide="ignore", invalid="ignore"):
        between = (sums[-1] * dark - sums * total) ** 2 / (dark * (total - dark))
    split = int(np.nanargmax(np.where(np.isfinite(between), between, -1.0)))
    return np.where(gray > split, np.uint8(255), np.uint8(0))


def black_and_white_local(gray: np.ndarray, size: int = 31, less: float = 11.0) -> np.ndarray:
    """Split at a weighted mean of the pixels around, less a constant."""
    sigma = 0.3 * ((size - 1) * 0.5 - 1) + 0.8
    kernel = np.exp(-((np.arange(size) - size // 2) ** 2) / (2 * sigma * sigma))
    kernel /= kernel.sum()
    r = size // 2
    mean = np.pad(gray.astype(np.float64), r, mode="edge")
    mean = np.apply_along_axis(lambda v: np.convolve(v, kernel, "valid"), 0, mean)
    mean = np.apply_along_axis(lambda v: np.convolve(v, kernel, "valid"), 1, mean)
    return np.where(gray > np.rint(mean) - less, np.uint8(255), np.uint8(0))


#: Fixed values. How much contrast is evened out for columns and for single cells.
COLUMN_LIMIT, CELL_LIMIT = 1.8, 2.0


def column_image(clean: np.ndarray, table: Table, i: int, scale: float, header_rows: int = 2) -> np.ndarray:
    """A column from the first data row down without its border lines, enlarged, in black and white; empty if nothing is left."""
    top = table.y_lines[min(header_rows, len(table.y_lines) - 1)]
    left, right = max(0, table.x_lines[i] + 2), max(table.x_lines[i] + 3, table.x_lines[i + 1] - 2)
    crop = clean[top : table.y_lines[-1], left:right]
    return black_and_white(equalize(enlarge(crop, scale), COLUMN_LIMIT)) if crop.size else crop


def cell_image(clean: np.ndarray, table: Table, row: int, col: int, scale: float, local: bool = False) -> np.ndarray:
    """A cell without its border lines, enlarged, in black and white; empty if nothing is left."""
    crop = clean[table.y_lines[row] + 3 : table.y_lines[row + 1] - 3, table.x_lines[col] + 3 : table.x_lines[col + 1] - 3]
    return (black_and_white_local if local else black_and_white)(equalize(enlarge(crop, scale), CELL_LIMIT)) if crop.size else crop


def _split(out: DataFrame, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows and errors of what was computed once: rendering and recognition cost too much to be done for each of the two."""
    out = cut(out)
    return out.where(F.col("error").isNull()).select(*columns), out.where(F.col("error").isNotNull()).select("document_id", "page", "error")


def _frame(rows: list[dict], names: list[str]) -> pd.DataFrame:
    """Rows as a frame in which what is missing is None."""
    out = pd.DataFrame(rows, columns=names).astype(object)
    return out.where(out.notna(), None)


def _names(schema: str) -> list[str]:
    return [x.strip().split(" ")[0] for x in schema.split(", ")]


def _each_page(pages: DataFrame, work: Callable[..., list[dict]], schema: str, *further: str) -> tuple[DataFrame, DataFrame]:
    """(rows, errors) of a function of the content of each page, its document and number, and further columns."""
    names = ["error", *_names(schema)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for content, document, page, *rest in zip(*(b[c] for c in ("content", "document_id", "page", *further))):
                try:
                    rows = work(content, document, int(page), *rest)
                except Exception as problem:  # noqa: BLE001 - whatever is wrong with a page is its own
                    rows = [{"document_id": document, "page": page, "error": f"{type(problem).__name__}: {problem}"}]
                yield _frame(rows, names)

    return _split(pages.select("document_id", "page", "content", *further).mapInPandas(run, f"error string, {schema}"), names[1:])


def inspect_documents(files: DataFrame, reader: DocumentReader) -> tuple[DataFrame, DataFrame]:
    """(document_id, filename, page_count, title, size_bytes; errors) of files (document_id, filename, size_bytes, content). Without a title of its own a document has the name of its file."""
    schema = "document_id string, filename string, page_count int, title string, size_bytes long, error string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for document, name, size, content in zip(b["document_id"], b["filename"], b["size_bytes"], b["content"]):
                row = {"document_id": document, "filename": name, "size_bytes": size}
                try:
                    count, title = reader.inspect(bytes(content))
                    row |= {"page_count": count, "title": title or (name or "").rsplit(".", 1)[0]}
                except Exception as problem:  # noqa: BLE001 - a broken file is its own error
                    row |= {"error": f"{type(problem).__name__}: {problem}"}
                yield _frame([row], _names(schema))

    out = cut(files.select("document_id", "filename", "size_bytes", "content").mapInPandas(run, schema))
    return out.where(F.col("error").isNull()).drop("error"), out.where(F.col("error").isNotNull()).select("document_id", "filename", "error")


def clamped_dpi(dpi: int, least: int = LEAST_DPI, most: int = MOST_DPI) -> int:
    return max(least, min(dpi, most))


def render_pages(files: DataFrame, wanted: DataFrame, reader: DocumentReader, dpi: int, kept: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(document_id, page, dpi, content; errors) of wanted pages (document_id, page) in a resolution within the bounds.

    kept: pages that were rendered before, same columns; those of the same resolution aren't rendered again. A page that
    a document doesn't have is an error. Documents are read once for all their pages that one task renders.
    """
    dpi = clamped_dpi(dpi)
    todo = wanted.select("document_id", "page").distinct()
    if kept is not None:
        todo = todo.join(kept.where(F.col("dpi") == dpi).select("document_id", "page"), ["document_id", "page"], "left_anti")
    of = todo.join(files.select("document_id", "content"), "document_id", "left")

    def render(content: bytes, document: str, page: int) -> list[dict]:
        if content is None:
            raise FileNotFoundError(document)
        count, _ = reader.inspect(bytes(content))
        if not 1 <= page <= count:
            raise IndexError(f"page {page} of {count}")
        return [{"document_id": document, "page": page, "dpi": dpi, "content": reader.render(bytes(content), page, dpi)}]

    new, errors = _each_page(of, render, "document_id string, page int, dpi int, content binary")
    if kept is not None:
        held = kept.where(F.col("dpi") == dpi).join(wanted.select("document_id", "page").distinct(), ["document_id", "page"], "left_semi")
        new = new.unionByName(held.select("document_id", "page", "dpi", "content"))
    return new, errors


def detect_tables(pages: DataFrame, crop: tuple[float, float, float, float] | None = None) -> tuple[DataFrame, DataFrame]:
    """(grid, errors) of pages (document_id, page, content): the lines of each page's table."""

    def detect(content: bytes, document: str, page: int) -> list[dict]:
        t = detect_table(decode_png(bytes(content)), crop)
        return [{"document_id": document, "page": page, "image_width": t.image_width, "image_height": t.image_height, "x_lines": t.x_lines, "y_lines": t.y_lines}]

    return _each_page(pages, detect, GRID)


def _placed(found: pd.DataFrame, document: str, page: int, name: str, ordinal: int, left: float = 0, up: float = 0, scale: float = 1.0) -> list[dict]:
    """Rows of tokens for the words of an image that was enlarged by ``scale`` and begins at (left, up) of the page."""
    out = []
    for w in found.to_dict("records"):
        box = {"left_px": w["left"] / scale + left, "top_px": w["top"] / scale + up, "width_px": w["width"] / scale, "height_px": w["height"] / scale}
        place = {k: int(w[k]) for k in ("block_num", "par_num", "line_num", "word_num")}
        out.append({"document_id": document, "page": page, "pass_name": name, "pass_ordinal": ordinal, "conf": float(w["conf"]), "text": w["text"], **place, **{k: round(v) for k, v in box.items()}})
    return out


def read_words(pages: DataFrame, reader: WordReader, accurate: bool = True, crop: tuple[float, float, float, float] | None = None, profile: Profile = Profile()) -> tuple[DataFrame, DataFrame]:
    """(tokens, errors) of pages (document_id, page, content): the words of all passes over a page and, in accurate mode, over its columns.

    Words of page passes are in pixels of the page; those of column passes in pixels of the enlarged column, for
    cells.column_pass_tokens.
    """
    plan = [p for p in reading_plan(accurate) if not p[0].startswith("cell-")]

    def read(content: bytes, document: str, page: int) -> list[dict]:
        image = decode_png(bytes(content))
        table = detect_table(image, crop)
        clean = without_lines(to_gray(image))
        xs, ys = table.x_lines, table.y_lines
        top = ys[min(profile.header_rows, len(ys) - 1)]
        out: list[dict] = []
        for name, ordinal, key, language, layout, scale, allowed in plan:
            if key is None:
                out += _placed(reader.words(clean[top : ys[-1], xs[0] : xs[-1]], language, layout, allowed), document, page, name, ordinal, xs[0], top)
            elif (part := column_image(clean, table, COLUMNS.index(key), scale, profile.header_rows)).size:
                out += _placed(reader.words(part, language, layout, allowed), document, page, name, ordinal)
        return out

    return _each_page(pages, read, TOKENS)


def read_cells_again(pages: DataFrame, wanted: DataFrame, reader: WordReader, accurate: bool = True, crop: tuple[float, float, float, float] | None = None) -> tuple[DataFrame, DataFrame]:
    """(tokens, errors): the words of single cells (document_id, page, row_no, column_key), in pixels of the page; see cells.wanted_again for which ones."""
    plan = [p for p in reading_plan(accurate) if p[0].startswith("cell-")]
    of_page = wanted.groupBy("document_id", "page").agg(F.collect_set(F.struct("row_no", "column_key")).alias("wanted"))  # at most the cells of a page

    def read(content: bytes, document: str, page: int, cells) -> list[dict]:  # noqa: ANN001
        image = decode_png(bytes(content))
        table = detect_table(image, crop)
        clean = without_lines(to_gray(image))
        out: list[dict] = []
        for row, key in sorted((c["row_no"], c["column_key"]) for c in cells):
            i = COLUMNS.index(key)
            for name, ordinal, k, language, layout, scale, allowed in plan:
                if k == key and (part := cell_image(clean, table, row, i, scale, local=name.endswith("-2"))).size:
                    out += _placed(reader.words(part, language, layout, allowed), document, page, name, ordinal, table.x_lines[i] + 3, table.y_lines[row] + 3, scale)
        return out

    return _each_page(pages.join(of_page, ["document_id", "page"]), read, TOKENS, "wanted")
