"""Problem 4: text that looks the same brought to the same characters.

Look-alike classes are the components of a union-find over code points and strings: a full-width letter
and its ordinary form, a letter with its combining accent and the composed letter, the letters of several
alphabets that look the same, all blanks, all invisible marks and the empty string. The characters that the
corpus holds are counted in one distributed pass; the most frequent member of a class in an alphabet stands
for it there, and the alphabet of a word that leaves it open is the one in which such words are written more
often. Rewriting is greedy, longest pattern first, by an Aho-Corasick automaton over all members.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from specloom.llm.vocabulary import Lexicon

#: Fixed values. For each Latin letter the letters of other alphabets that look like it: Cyrillic with its extensions,
#: Greek, Armenian, Cherokee, Lisu, and Latin letters of phonetic writing.
ALIKE = {
    "A": "АΑᎪꓮ", "B": "ВΒᏴꓐ", "C": "СϹᏟꓚ", "D": "ᎠꓓƊ", "E": "ЕΕᎬꓰ", "F": "ϜꓝҒ", "G": "ԌᏀꓖ", "H": "НΗᎻꓧ", "I": "ІΙӀ", "J": "ЈᎫꓙ", "K": "КΚᏦꓗ",
    "L": "ᏞꓡԼ", "M": "МΜᎷꓟ", "N": "Νꓠ", "O": "ОΟՕꓳ", "P": "РΡᏢꓑ", "Q": "Ԛ", "R": "ᎡᏒꓣ", "S": "ЅՏᏚꓢ", "T": "ТΤᎢꓔ", "U": "Սꓴ", "V": "ᏙꓦѴ", "W": "ԜᎳꓪ",
    "X": "ХΧꓫ", "Y": "УΥҮᎩꓬ", "Z": "ΖᏃꓜ", "Ë": "Ё",
    "a": "аɑ", "c": "сϲᴄ", "d": "ԁ", "e": "еҽ", "g": "ɡց", "h": "һհ", "i": "іı", "j": "јϳ", "l": "ӏ", "n": "ոռ", "o": "оοօᴏ", "p": "рƿ", "q": "ԛգ", "s": "ѕꜱ",
    "u": "սᴜ", "v": "νѵᴠ", "w": "ԝᴡ", "x": "хᕽ", "y": "уүỿ", "z": "ᴢ", "ë": "ё",
}
INVISIBLE = "­​‌‍‎‏‪‫‬‭‮⁠⁡⁢⁣⁤⁦⁧⁨⁩﻿᠎͏؜"
HYPHENS = "‐‑﹣－"
ORDINARY = "×Ø«»№²³°±…–—"

RUSSIAN = set("абвгдежзийклмнопрстуфхцчшщъыьэюяё") | set("абвгдежзийклмнопрстуфхцчшщъыьэюяё".upper())
_LETTERS = re.compile(r"[^\W\d_]+")


class UnionFind:
    """Disjoint sets over strings; the root is the smallest of its set in the order given by ``prefer``."""

    def __init__(self) -> None:
        self.parent: dict[str, str] = {}

    def find(self, x: str) -> str:
        self.parent.setdefault(x, x)
        while self.parent[x] != x:
            self.parent[x] = self.parent[self.parent[x]]
            x = self.parent[x]
        return x

    def union(self, a: str, b: str) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.parent[max(a, b)] = min(a, b)

    def classes(self) -> dict[str, list[str]]:
        out: dict[str, list[str]] = {}
        for x in sorted(self.parent):
            out.setdefault(self.find(x), []).append(x)
        return out


def script(c: str) -> str:
    """latin, russian or other; '' for what is no letter."""
    if c in RUSSIAN:
        return "russian"
    if not c.isalpha():
        return ""
    return "latin" if "LATIN" in unicodedata.name(c, "") and "FULLWIDTH" not in unicodedata.name(c, "") else "other"


def plain(s: str) -> str:
    """What a code point or sequence stands for, alphabets aside: composed, full-width undone, blanks and marks ordinary."""
    if s in ORDINARY or s in "\r\n\t":
        return s
    if s in INVISIBLE:
        return ""
    if s in HYPHENS:
        return "-"
    if unicodedata.category(s[0]) == "Zs":
        return " "
    composed = unicodedata.normalize("NFC", s)
    if len(composed) == 1 and (kind := unicodedata.decomposition(composed).split(" ")[0]):
        ordinary = unicodedata.normalize("NFKC", composed)
        if kind in FORMS or kind == "<compat>" and ordinary.isascii() and ordinary.isalpha():
            return ordinary
    return composed


#: Kinds of decomposition, as the character database names them, by which a character is another form of ordinary ones; so are Roman
#: numerals and ligatures, of kind <compat>, if they stand for Latin letters.
FORMS = {"<wide>", "<narrow>", "<font>", "<initial>", "<medial>", "<final>", "<isolated>"}


def classes_of(observed: Iterable[str]) -> UnionFind:
    """Look-alike classes over everything observed and the fixed pairs; the relation is transitive."""
    uf = UnionFind()
    for latin, others in ALIKE.items():
        for c in others:
            uf.union(latin, c)
    for c in {*INVISIBLE, *HYPHENS, *observed}:
        if (apart := unicodedata.normalize("NFD", c)) != c:
            uf.union(c, apart)
        target = plain(c)
        if target != c and len(target) <= 1:
            uf.union(c, target)
        else:
            uf.find(c)
    return uf


class Unifier:
    """Rewrites texts.

    observed: how often each character outside ASCII occurs. open_counts: (column, script) counts of look-alike letters in
    words that leave the alphabet open.
    """

    def __init__(self, observed: Iterable[str] | dict[str, int], open_counts: dict[tuple[str, str], int], lexicon: dict[str, list[str]]) -> None:
        often = observed if isinstance(observed, dict) else dict.fromkeys(observed, 1)
        self.uf = classes_of(often)
        members = self.uf.classes()
        self.symbol: dict[str, str] = {}
        self.letters: dict[tuple[str, str], str] = {}
        self.automaton = ahocorasick.Automaton()
        for c in "йЙёЁ":
            self.automaton.add_word(unicodedata.normalize("NFD", c), (2, c))
        for root, xs in members.items():
            plains = {plain(x) for x in xs} | set(xs)
            of = lambda k: [c for c in plains if len(c) == 1 and script(c) == k and (k != "latin" or c in ALIKE or unicodedata.normalize("NFD", c)[0].isascii())]
            by = {k: min(cs, key=lambda c: (-often.get(c, 0), c)) for k in ("russian", "latin") if (cs := of(k))}
            for x in xs:
                to = plain(x)
                if len(to) == 1 and script(to) and by and to not in by.values():
                    to = by.get(script(to)) or by.get("latin") or by["russian"]
                if x and to != x:
                    self.automaton.add_word(x, (len(x), to))
            if len(by) == 2:
                for c in by.values():
                    self.symbol[c] = root
                    for k, v in by.items():
                        self.letters[c, k] = v
        for c in often:  # one sign for several letters, such as a Roman numeral
            if len(plain(c)) > 1 and plain(c) != c and c not in self.automaton:
                self.automaton.add_word(c, (len(c), plain(c)))
        self.automaton.make_automaton()
        self.open_counts = open_counts
        self.known = {column: {self.skeleton(run): run for word in reversed(words) for run in _LETTERS.findall(word)} for column, words in lexicon.items()}
        self.cache: dict[tuple[str, str], str] = {}

    def skeleton(self, run: str) -> str:
        return "".join(self.symbol.get(c, c) for c in run)

    def settle(self, text: str) -> str:
        """Everything but the alphabets, until nothing changes: an accent may follow its letter only once a mark between them is gone."""
        while (new := self._settled(text)) != text:
            text = new
        return text

    def _settled(self, text: str) -> str:
        """One pass: composed, then greedy, longest pattern first, left to right."""
        text = text if text.isascii() else unicodedata.normalize("NFC", text)
        out, at = [], 0
        for end, (n, to) in self.automaton.iter_long(text):
            out += (text[at : end - n + 1], to)
            at = end + 1
        return "".join([*out, text[at:]]) if at else text

    def word(self, column: str, run: str) -> str:
        """A run of letters in one alphabet: a listed word's, else that of its clear letters, else the more frequent one."""
        key = (column, run)
        if (hit := self.cache.get(key)) is not None:
            return hit
        known = self.known.get(column, {}).get(self.skeleton(run))
        if known is None:
            clear = Counter(script(c) for c in run if c not in self.symbol)
            if not clear:
                clear = Counter({k: self.open_counts.get((column, k), 0) + (k == "russian") * 0.5 for k in ("russian", "latin")})
            to = max(("russian", "latin"), key=lambda k: clear[k])
            known = "".join(self.letters.get((c, to), c) for c in run)
        if len(self.cache) > 500_000:
            self.cache.clear()
        self.cache[key] = known
        return known

    def rewrite(self, column: str, text: str) -> str:
        return _LETTERS.sub(lambda m: self.word(column, m[0]), self.settle(text))


def census(rows: DataFrame, columns: list[str], lexicon: Lexicon) -> tuple[dict[str, int], dict[tuple[str, str], int]]:
    """How often each character outside ASCII occurs in the columns, and per column how often words that leave the alphabet open are written in each.

    Single code points are counted, so both results are bounded by the number of characters that Unicode has.
    """
    fixed = Unifier([], {}, {})
    listed = {c: {fixed.skeleton(r) for w in lexicon.keys(k) for r in _LETTERS.findall(w)} for c, k in KINDS.items()}

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: Counter[tuple[str, str, str]] = Counter()
        chars: Counter[str] = Counter()
        for b in batches:
            for column in columns:
                for text in b[column]:
                    if not text:
                        continue
                    if not text.isascii():
                        chars.update(text)
                    for run in _LETTERS.findall(text):
                        if all(c in fixed.symbol for c in run) and fixed.skeleton(run) not in listed.get(column, ()):
                            for c in run:
                                seen["open", column, script(c)] += 1
        seen.update({("char", "", c): n for c, n in chars.items() if not c.isascii() and c not in ORDINARY})
        yield pd.DataFrame([(*k, n) for k, n in seen.items()], columns=["what", "column", "item", "n"])

    total = rows.select(*columns).mapInPandas(count, "what string, column string, item string, n long").groupBy("what", "column", "item").agg(F.sum("n").alias("n")).collect()
    return {r["item"]: r["n"] for r in total if r["what"] == "char"}, {(r["column"], r["item"]): r["n"] for r in total if r["what"] == "open"}


#: Which entries of the lexicon are the words of a column as they are meant.
KINDS = {"type_mark": "mark", "manufacturer": "maker"}


def unify_text(rows: DataFrame, key: str, columns: list[str], lexicon: DataFrame) -> DataFrame:
    """key, and for each column its text in one form and ``<column>_changed``.

    Null stays null, an empty text stays empty; neither counts as changed. Line breaks and the ordinary
    signs × Ø « » № stay. Texts are taken whole, however long. Words that mix letters which no alphabet
    has in common keep those letters. Repeated rows give repeated rows; other columns aren't looked at.
    """
    lex = Lexicon.read(lexicon)
    observed, counts = census(rows, columns, lex)
    words = {c: lex.keys(k) for c, k in KINDS.items()}
    schema = f"{key} {dict(rows.dtypes)[key]}, " + ", ".join(f"{c} string, {c}_changed boolean" for c in columns)

    def rewrite(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        unifier = Unifier(observed, counts, words)
        for b in batches:
            out = {key: b[key]}
            for c in columns:
                new = [unifier.rewrite(c, t) if t else t for t in b[c]]
                out[c] = pd.Series(new, dtype=object)
                out[f"{c}_changed"] = [bool(t) and t != n for t, n in zip(b[c], new)]
            yield pd.DataFrame(out)

    return rows.select(key, *columns).mapInPandas(rewrite, schema)


def changed_cells(rows: DataFrame, key: str, columns: list[str], lexicon: DataFrame) -> DataFrame:
    """key, column_key of each cell that isn't in its one form."""
    unified = unify_text(rows, key, columns, lexicon)
    cells = F.array(*[F.when(F.col(f"{c}_changed"), F.lit(c)) for c in columns])
    return unified.select(key, F.explode(F.filter(cells, lambda c: c.isNotNull())).alias("column_key"))
