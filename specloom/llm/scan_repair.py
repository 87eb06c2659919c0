"""Problem 3: text of scanned cells repaired into continuous text.

Candidates for a misread word come from the intersection of its Levenshtein automaton with a trie of the
vocabulary: the trie is walked with one row of edit distances per node, and a branch ends when its row
holds no value within the bound, so retrieval is complete. Candidates are ranked by a distance that knows
which shapes a scanner confuses and by how often the candidate follows the word before it in the corpus.
Lines that belong to the page are removed, words broken over lines are joined, the rest is reflowed.

The vocabulary is the list of words plus every word that stands in at least ``1 / FREQUENT`` of the distinct texts and in
two of them, unless it is near enough to a listed word to be a misreading of it: copies of a misread cell are one text.
By that rule it can't hold more words than a text has on average times FREQUENT, however large the corpus.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from specloom.llm.lookalikes import Unifier
from specloom.llm.vocabulary import Lexicon
from specloom.session import cut

#: A word that stands in one of so many distinct texts, and in LEAST of them, belongs to the vocabulary.
FREQUENT, LEAST = 500, 2
#: A pair of words counts for the ranking if it is one of so many pairs or more frequent.
PAIRS = 100_000
#: Signs that a scan leaves of ruled lines and dirt.
DIRT = "|~_^*#=¬'`\"{}<>\\"
_DIRT = re.compile(rf"[{re.escape(DIRT)}]")
_ONLY_DIRT = re.compile(rf"^[{re.escape(DIRT)}]+$")
_EDGE = re.compile(r"^([(«]*)(.*?)([)».,;:!?]*)$", re.DOTALL)
_FIGURE = re.compile(r"^(?:[+±-]?\d+(?:[.,]\d+)*|\d+(?:[.,]\d+)?(?:×\d+(?:[.,]\d+)?)+|Ø\d+(?:[.,]\d+)?|[IVX]+|[A-Z]{2,}\d*|[A-ZА-ЯЁ]{1,2}\d*|№\d*|[-–—+/×%°]+|\d+-[а-яё]{1,2})$")
_BREAK = re.compile(r"[-‐‑¬=–]\s*$")

#: Fixed values. Captions that the frame of a sheet has, whole lines; and the code of a specification, which ends in .С or .СО.
STAMP = [
    r"стадия\s+\w{1,3}\s+лист\b.*",
    r"инв\.?\s*№\s*подл\.?\s*\S*",
    r"взам\.?\s*инв\.?\s*№.*",
    r"подп\.?\s*и\s*дата",
    r"изм\.?\s*кол\.?\s*уч.*",
    r"копировал:?",
    r"формат\s*[аa]\d(?:\s*[xх×]\s*\d)?",
    r"спецификация оборудования(?:,? изделий)?(?: и (?:изделий|материалов))?",
]
_STAMP = re.compile(r"^\s*(?:" + "|".join(STAMP) + r")\s*$", re.IGNORECASE)
_SHEET_CODE = re.compile(r"^\s*[А-ЯЁA-Z]{1,4}-\d+(?:-[А-ЯЁA-Z]{1,4})?\.[СC][ОO]?(?:\s+[Лл]ист\s*\d{1,4})?\s*$")
#: Page numbers that are marked as such by signs, by a word, or by the number of all pages.
_SIGNED_NUMBER = re.compile(r"^\s*(?:[-–—‐‑]\s*\d{1,4}\s*[-–—‐‑]|\[\s*\d{1,4}\s*\])\s*$")
_NAMED_NUMBER = re.compile(r"^\s*(?:[Сс]тр\.?|Лист|[Сс]\.)\s*(\d{1,4})(?:\s*из\s*(\d{1,4}))?\.?\s*$")
_NUMBER_OF = re.compile(r"^\s*(\d{1,4})\s+/\s+(\d{1,4})\s*$")
#: What a reference to another sheet ends with before its number.
_REFERS = re.compile(r"(?:^|[\s,;(])(?:см|смотри|по|п|пп|рис|черт)\.?\s*$", re.IGNORECASE)
_SHEET = re.compile(r"(?:лист|стр\.?|с\.)\s*\d", re.IGNORECASE)
_OF_UNIT = re.compile(r"(?:мм|шт|см|м|кг)\b")
#: Fixed values. The captions of the stamp, letters only, for lines that were misread themselves.
CAPTIONS = ["копировал", "формата", "стадиярлистлистов", "взаминвподпидата", "инвподл", "измколучлистдокподпдата", "спецификацияоборудованияиизделий"]
_BARE_NUMBER = re.compile(r"^\d{1,3}$")

#: Fixed values. Groups of signs that a scanner gives for one letter, and single signs taken for another.
GROUPS = {"ь1": "ы", "ь|": "ы", "ьl": "ы", "ь!": "ы", ")к": "ж", ")(": "ж", "гл": "м", "60": "бо", "ис": "к", "рс": "ф", "іо": "ю", "1о": "ю", "|о": "ю", "пп": "п", "л|": "п", "го": "ю", "ср": "ф"}
CONFUSED = ["о0сдаеё", "з3эЗ", "б68в", "т7г", "ч4ц", "иййнпкц", "лпдлаяь", "нкпнх", "уцчу", "шщм", "жх#*", "фрд", "бв8", "яяадел", "еёсо", "рфд", "тгр", "ыь"]
_SAME = {(a, b) for g in CONFUSED for a in g for b in g}


#: Full-width signs and Roman numerals, which problem 4 treats, count as the ordinary ones here.
SIGNS = [chr(c) for c in (*range(0xFF01, 0xFF5F), *range(0x2160, 0x2180), 0xA0, 0x2007, 0x202F, 0x3000, *range(0x2000, 0x200B))]


def letter_set(s: str) -> int:
    out = 0
    for c in s:
        out |= 1 << (ord(c) & 63)
    return out


class Trie:
    """Words by letter. A node is its children, the letters that any and that all of its words hold, their least and greatest length, and the word that ends there."""

    def __init__(self, words: Iterable[str]) -> None:
        self.root: list = [{}, 0, -1, 1 << 30, 0, None]
        for w in words:
            node, letters = self.root, letter_set(w)
            for c in w:
                node = node[0].setdefault(c, [{}, 0, -1, 1 << 30, 0, None])
                node[1] |= letters
                node[2] &= letters
                node[3], node[4] = min(node[3], len(w)), max(node[4], len(w))
            node[5] = w
            self.root[4] = max(self.root[4], len(w))

    def within(self, word: str, k: int) -> list[tuple[str, int]]:
        """All words within k edits of word, each with its distance.

        The automaton of Levenshtein is run as k + 1 bit masks: bit i of mask e says that i letters of word can be read
        with e edits. A branch ends when the last mask, which holds all others, is empty, and where lengths or letters
        alone tell that more than k edits are needed.
        """
        n, own = len(word), letter_set(word)
        if n - self.root[4] > k:
            return []
        at: dict[str, int] = {}
        for i, x in enumerate(word):
            at[x] = at.get(x, 0) | 1 << i
        whole = 1 << n
        mask = 2 * whole - 1
        found: list[tuple[str, int]] = []
        stack = [(self.root, [(2 << e) - 1 & mask for e in range(k + 1)])]
        while stack:
            node, rows = stack.pop()
            if node[5] is not None and rows[k] & whole:
                found.append((node[5], next(e for e, r in enumerate(rows) if r & whole)))
            for c, child in node[0].items():
                if child[3] - n > k or n - child[4] > k or (own & ~child[1]).bit_count() > k or (child[2] & ~own).bit_count() > k:
                    continue
                hit = at.get(c, 0)
                before = rows[0]
                last = (before & hit) << 1
                new = [last]
                for r in rows[1:]:
                    last = (((r & hit) | before | last) << 1 | before) & mask
                    new.append(last)
                    before = r
                if last:
                    stack.append((child, new))
        return found


def bound(word: str) -> int:
    """Edits within which candidates are retrieved; which of them are near enough, their shapes decide."""
    n = len(word)
    return (0 if n < 2 or word.isalpha() else 1) if n < 3 else 1 if n == 3 else n // 3 + 1


def shape_distance(read: str, word: str) -> float:
    """Edit distance with half price for shapes that are confused; a stray sign costs 0.4."""
    row = [float(j) for j in range(len(word) + 1)]
    for i, x in enumerate(read, 1):
        last, row = row, [row[0] + (0.4 if x in DIRT else 1.0)] + [0.0] * len(word)
        for j, y in enumerate(word, 1):
            same = 0.0 if x == y else 0.5 if (x, y) in _SAME or x in DIRT else 1.0
            row[j] = min(last[j - 1] + same, last[j] + (0.4 if x in DIRT else 1.0), row[j - 1] + 1.0)
    return row[-1]


def alternatives(word: str) -> list[str]:
    """word with groups of signs replaced by the letters they are read for: all choices of the groups it holds."""
    out = [word]
    for group, letter in GROUPS.items():
        out += [w.replace(group, letter) for w in out if group in w]
    return list(dict.fromkeys(out))


def lines_of(text: str) -> list[str]:
    return [x.strip() for x in re.split(r"\r\n|\r|\n", text)]


def caption_or_code(line: str) -> bool:
    return bool(_STAMP.match(line) or _SHEET_CODE.match(line))


def page_number(line: str) -> bool:
    """Whether a line has the form of a page number; one of several pages can't be beyond their number."""
    m = _NAMED_NUMBER.match(line) or _NUMBER_OF.match(line)
    return m is not None and (m[2] is None or int(m[1]) <= int(m[2])) or bool(_SIGNED_NUMBER.match(line))


class Repairer:
    """words: the vocabulary in lower case. follows: how often a word follows another; '#' stands for a figure."""

    def __init__(self, words: set[str], follows: dict[tuple[str, str], int]) -> None:
        self.words, self.follows = words, follows
        self.trie = Trie(w for w in words if len(w) > 2)
        self.unifier = Unifier(SIGNS, {}, {})
        self.tokens: dict[tuple[str, str], tuple[str, bool]] = {}
        self.met: dict[str, list[tuple[str, float]]] = {}
        self.captions: dict[str, bool] = {}
        self.before_figure = sum(n for (_, b), n in follows.items() if b == "#")

    def valid(self, core: str) -> bool:
        low = core.lower()
        return low in self.words or bool(_FIGURE.match(core)) or ("-" in core and all(p in self.words for p in low.split("-")))

    def candidates(self, low: str) -> list[tuple[str, float]]:
        """The words a misread one may stand for, each with the price of its shapes."""
        if (hit := self.met.get(low)) is None:
            hit = []
            reach = 6 * self.trie.root[4] + 6  # forms are half as long at least, and edits are a third of a form and one
            for form in alternatives(low) if len(low) <= reach else ():
                for word, _ in self.trie.within(form, bound(form)):
                    if (shapes := shape_distance(form, word)) <= len(form) / 3:
                        hit.append((word, shapes + (0.3 if form != low else 0.0)))
            if len(self.met) > 200_000:
                self.met.clear()
            self.met[low] = hit
        return hit

    def nearest(self, core: str, before: str) -> str | None:
        """The word that a misread one stands for, in its letter case; None if nothing is near."""
        low = core.lower()
        best = min(((price - 0.25 * math.log1p(self.follows.get((before, word), 0)), word) for word, price in self.candidates(low)), default=None)
        if best is None:
            return None
        word = best[1]
        letters = [c for c in core if c.isalpha()]
        if len(letters) > 1 and all(c.isupper() for c in letters):
            return word.upper()
        return word[:1].upper() + word[1:] if core[:1].isupper() or core[:1] == "0" and before in ("", ".") else word

    def figure(self, core: str) -> str | None:
        """A figure whose digits were read as letters."""
        if sum(c.isdigit() for c in core) < 1:
            return None
        fixed = core.translate(str.maketrans("ОоOoЗзlI|БбТт", "0000331116677"))
        fixed = _DIRT.sub("", fixed)
        return fixed if fixed != core and _FIGURE.match(fixed) else None

    def token(self, token: str, before: str) -> tuple[str, bool]:
        """The token as printed, and whether it was misread."""
        key = (token, before)
        if (hit := self.tokens.get(key)) is not None:
            return hit
        if _ONLY_DIRT.match(token):
            out = ("", True)
        else:
            head, core, tail = _EDGE.match(token).groups()  # type: ignore[union-attr]
            out = (token, False)
            if core and not self.valid(core):
                clean = _DIRT.sub("", core)
                parts = core.split("-")
                if clean != core and clean and self.valid(clean):
                    out = (head + clean + tail, True)
                elif len(parts) > 1 and all(parts) and (fixed := [p if p.lower() in self.words else self.nearest(p, "") for p in parts]) and all(fixed):
                    out = (head + "-".join(fixed) + tail, True)  # type: ignore[arg-type]
                elif (near := self.figure(core)) or (near := self.nearest(core + tail if tail[:1] in (")",) else core, before)) or (near := self.nearest(core, before)):
                    out = (head + near + tail, True)
                elif clean != core:
                    out = (head + clean + tail, True)
        if len(self.tokens) > 300_000:
            self.tokens.clear()
        self.tokens[key] = out
        return out

    def caption(self, line: str) -> bool:
        """Whether a line with unknown words is a misread caption of the stamp."""
        if (hit := self.captions.get(line)) is None:
            cores = [_EDGE.match(p).group(2) for p in line.split()]  # type: ignore[union-attr]
            letters = re.sub(r"[^\w]|_", "", re.sub(r"(?<![^\W\d])\d+(?![^\W\d])", "", line.lower()))
            hit = len(letters) < 60 and not all(self.valid(c) for c in cores if c) and any(abs(len(letters) - len(c)) <= len(c) // 4 and shape_distance(letters, c) <= min(5.0, len(c) / 4) for c in CAPTIONS)
            if len(self.captions) > 100_000:
                self.captions.clear()
            self.captions[line] = hit
        return hit

    def due(self, kept: list[str], following: str) -> bool:
        """Whether a figure is due after the lines kept so far: their last word calls for one, and the next line doesn't bring it."""
        if not kept or _BREAK.search(kept[-1]) or kept[-1].endswith((",", ".")) or following[:1].isdigit() and not _BARE_NUMBER.match(following) and not page_number(following):
            return False
        word = re.search(r"([^\W\d_]+)\W*$", kept[-1].lower())
        return word is not None and self.follows.get((word[1], "#"), 0) > 0.002 * max(1, self.before_figure)

    def furniture(self, kept: list[str], lines: list[str], i: int) -> bool:
        """Whether a line belongs to the page.

        The captions of the frame do, also misread; a page number does unless the text has its place for it: after a
        reference, where a figure is due, or, if it is nothing but a number, before a unit or as the only line.
        """
        line, following = lines[i], lines[i + 1] if i + 1 < len(lines) else ""
        if caption_or_code(line):
            return True
        if page_number(line):
            if _NUMBER_OF.match(line):
                return following[:1].isdigit() or not self.due(kept, following)
            return not (kept and _NAMED_NUMBER.match(line) and _REFERS.search(kept[-1]) and not _SHEET.match(following))
        if len(lines) == 1:
            return False
        if not _BARE_NUMBER.match(line):
            return self.caption(line)
        return not (kept and _OF_UNIT.match(following)) and not self.due(kept, following)

    def repair(self, text: str) -> tuple[str, set[str]]:
        """The continuous text and what was wrong: page, broken, misread."""
        wrong: set[str] = set()
        lines = [x for x in lines_of(self.unifier.rewrite("", text))]
        kept = []
        for i, line in enumerate(lines):
            if line and self.furniture(kept, lines, i):
                wrong.add("page")
            elif line:
                kept.append(line)
        if not kept:
            return text, set()
        joined = kept[0]
        for line in kept[1:]:
            if _BREAK.search(joined) and re.search(r"[^\W_][-‐‑¬=–]\s*$", joined):
                stem = _BREAK.sub("", joined)
                left, right = stem.split()[-1].lower(), _EDGE.match(line.split()[0]).group(2).lower()  # type: ignore[union-attr]
                if left + right not in self.words and left in self.words and right in self.words:
                    joined = f"{stem}-{line}"
                else:
                    wrong.add("broken")
                    joined = stem + line
            else:
                joined = f"{joined} {line}"
        out, before = [], ""
        for raw in joined.split():
            new, misread = self.token(raw, before)
            if misread:
                wrong.add("misread")
            if new:
                out.append(new)
                core = _EDGE.match(new).group(2).lower()  # type: ignore[union-attr]
                before = "#" if core[:1].isdigit() or core[:1] == "ø" else core
                if new[-1] in ",;.:":
                    before = "." if new[-1] == "." else ""
        return " ".join(out), wrong


def count_words(rows: DataFrame, columns: list[str], listed: set[str]) -> tuple[set[str], dict[tuple[str, str], int]]:
    """The frequent words of the columns by distinct texts, without those near a listed one, and how often listed words and figures follow each other over all rows."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        plain = Unifier(SIGNS, {}, {})
        seen: Counter[tuple[str, str, str]] = Counter()
        flush = lambda: pd.DataFrame([(*k, n) for k, n in seen.items()], columns=["what", "a", "b", "n"])
        for batch in batches:
            for text, times in zip(batch["text"], batch["times"]):
                if not text.strip():
                    continue
                seen["text", "", ""] += 1
                words: set[str] = set()
                before = ""
                for line in lines_of(plain.rewrite("", text)):
                    if caption_or_code(line) or page_number(line):
                        continue
                    parts = line.split()
                    if parts and _BREAK.search(line):
                        parts.pop()
                    for p in parts:
                        core = _EDGE.match(p).group(2)  # type: ignore[union-attr]
                        low = core.lower()
                        now = "#" if core[:1].isdigit() or core[:1] == "Ø" else low if low in listed else ""
                        if before and now:
                            seen["pair", before, now] += times
                        before = now if p[-1:] not in ",;.:" else ""
                        if low.isalpha() and low not in listed:
                            words.add(low)
                for w in words:
                    seen["word", w, ""] += 1
            if len(seen) > 200_000:
                yield flush()
                seen.clear()
        yield flush()

    distinct = rows.select(F.explode(F.array(*columns)).alias("text")).where(F.col("text") != "").groupBy("text").agg(F.count("*").alias("times"))
    counts = distinct.mapInPandas(count, "what string, a string, b string, n long").groupBy("what", "a", "b").agg(F.sum("n").alias("n"))
    counts = cut(counts)
    total = counts.agg(F.sum(F.when(F.col("what") == "text", F.col("n"))).alias("texts"), F.sum(F.when(F.col("what") == "pair", F.col("n"))).alias("pairs")).first()
    texts, pairs = total["texts"] or 0, total["pairs"] or 0
    often = (F.col("what") == "pair") & (F.col("n") * PAIRS >= pairs) | (F.col("what") == "word") & (F.col("n") >= LEAST) & (F.col("n") * FREQUENT >= texts)
    got = counts.where(often).select("what", "a", "b", "n").collect()  # at most PAIRS pairs, words by the rule of FREQUENT
    by_list = Repairer(listed, {})
    return {r["a"] for r in got if r["what"] == "word" and by_list.nearest(r["a"], "") is None}, {(r["a"], r["b"]): r["n"] for r in got if r["what"] == "pair"}


def repair_text(rows: DataFrame, key: str, columns: list[str], lexicon: DataFrame) -> DataFrame:
    """key, column_key, text, repaired, wrong of every cell of ``columns`` that holds text.

    wrong: the sorted kinds of faults (``broken``, ``misread``, ``page``), empty for a sound cell. Null,
    empty and blank cells give no row. A cell of page lines only is left as it is, for nothing would
    remain. Texts are read whole. Repeated rows give repeated rows; other columns aren't looked at.
    """
    listed = {w.lower() for w in Lexicon.read(lexicon).keys("word")}
    frequent, follows = count_words(rows, columns, listed)
    kind = dict(rows.dtypes)[key]

    def repair(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        repairer = Repairer(listed | frequent, follows)
        for b in batches:
            out = []
            for column in columns:
                for k, text in zip(b[key], b[column]):
                    if text and text.strip():
                        fixed, wrong = repairer.repair(text)
                        out.append((k, column, text, fixed, sorted(wrong)))
            yield pd.DataFrame(out, columns=[key, "column_key", "text", "repaired", "wrong"])

    return rows.select(key, *columns).mapInPandas(repair, f"{key} {kind}, column_key string, text string, repaired string, wrong array<string>")
