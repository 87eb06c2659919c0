"""Problem 2: freely typed values mapped to the entries of a reference list, misses reported.

Distinct spellings are found first (a count per spelling, combined on the map side), so each is matched
once however many rows hold it. Each spelling is brought to a plain form and looked up in a dictionary of
symmetric deletes: every form of an entry, and every query, is stored with up to k characters left out;
two strings within k edits share such a variant. Candidates are then ranked by a weighted
Damerau-Levenshtein distance and by how often the entry itself is used. Forms of up to three letters only match
as they are, or read in other letters of the same look; what else a scan makes of them, the table of compact
spellings of the core says.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from specloom.functions.text import UNIT_KEYS
from specloom.llm.vocabulary import Lexicon
from specloom.session import checked_broadcast, cut

NONE = "none"

#: Fixed values. Written forms of units of measure besides the entry and its full name; the key is the
#: full name in the nominative. Endings stand in the list as the language has them.
FORMS = {
    "штука": "шт штуки штук штуке штукой штк pcs pc ea each piece pieces",
    "метр": "м метра метров метры мтр m meter meters metre",
    "комплект": "компл комп кт к-т кт. ком-т к-кт к/т комплекта комплектов комплекты комплд set sets kit",
    "квадратный метр": "м2 м² м^2 кв.м м.кв квм мкв квметр метркв квадратныхметров квадратногометра m2 sqm",
    "килограмм": "кг кило килограмма килограммов килограммы kg kilo kgs",
    "погонный метр": "пм п.м п/м м.п мп мпог погм пметр пмтр погметр погмтр метрпог погонныхметров погонногометра погонныйм lm",
    "кубический метр": "м3 м³ м^3 куб.м м.куб кубм мкуб куб кубов куба кубометр кубометра кубометров кубометры кубметр кубическихметров кубическогометра m3 cum cbm",
    "литр": "л литра литров литры лтр l ltr liter litre liters",
    "упаковка": "упак уп упаковки упаковок упаковку у-ка упк pack pk package",
    "рулон": "рул рулона рулонов рулоны рл roll rolls",
    "лист": "листа листов листы sheet sheets",
    "тонна": "т тн тонны тонн тонну тнн ton t tons tonne",
    "пара": "пары пар пару pair pairs",
    "секция": "секц секции секций секцию сек section",
    "баллон": "бал баллона баллонов баллоны балл cylinder",
    "мешок": "меш мешка мешков мешки мшк bag bags",
}
#: Fixed values. Other units of measure and words that stand in a unit column: nearer to themselves than to any entry.
OTHERS = (
    "мм см дм км мкм нм дюйм фут ярд миля г гр мг мл мкл гл вт квт мвт гвт ква па кпа мпа бар атм в кв а ма гц кгц ом лк лм дж кдж ккал гкал к с сек мин ч час часы сутки смена день месяц год рейс маш-ч чел-ч челч чел-час "
    "об/мин м/с м/ч м/мин м3/ч м³/ч кг/м кг/м3 т/ч л/с л/ч л/мин % °с °c градус усл.ед услед ед едизм руб тысруб контур ячейка зона узел проём проем этаж точка участок стойка место помещение объект система шкаф ряд ветка шаг тройник "
    "смприм поместу нет прочее тыс тысшт mm cm km g mg ml w kw pa kpa h hour inch ft v a hz га ар сот уч кор коробка ящик бухта моток пачка поддон банка ведро куст блок модуль"
)
#: Fixed values. Latin letters that stand for the Cyrillic ones they look like.
_LATIN = str.maketrans("aekmhopctyxb", "аекмнорстухв")
_CYRILLIC = str.maketrans("аекмнорстухвг", "aekmhopctyxbr")
#: Fixed values. Latin letters for the Russian ones that look like them in italics, and Russian ones that differ by a stroke.
_ITALIC = str.maketrans("aekmhopctyxbwunrgщй", "аектнорстухвшипгдши")
#: Fixed values. Rows of the Russian keyboard; neighbours are easily hit for one another.
_KEYS = ("йцукенгшщзхъ", "фывапролджэ", "ячсмитьбю")


def _neighbours() -> dict[str, str]:
    near: dict[str, set[str]] = {}
    for r, row in enumerate(_KEYS):
        for i, c in enumerate(row):
            near.setdefault(c, set()).update(row[max(0, i - 1) : i + 2])
            for other in _KEYS[max(0, r - 1) : r + 2]:
                near[c].update(other[max(0, i - 1) : i + 2])
    return {c: "".join(sorted(x - {c})) for c, x in near.items()}


NEAR = _neighbours()


def fold(value: str) -> str:
    """The plain form of an entered value: compatibility forms, case, signs at the ends and blanks gone."""
    s = unicodedata.normalize("NFKC", value).casefold().replace("ё", "е")
    s = re.sub(r"[\s​-‏⁠﻿­]+", " ", s)
    s = re.sub(r"^[\s.,;:|/_~*()\[\]«»\"'—–-]+|[\s.,;:|/_~*()\[\]«»\"'—–-]+$", "", s)
    return s


def compact(folded: str) -> str:
    """fold() without blanks and dots inside: "п. м" and "пм" are one."""
    return re.sub(r"[\s.^]+", "", folded)


def scripts(s: str) -> tuple[str, ...]:
    """s, s in one alphabet if it mixes letters of two or its letters look alike in both, and s read in italics."""
    return tuple(dict.fromkeys((s, s.translate(_LATIN), s.translate(_CYRILLIC), s.translate(_ITALIC))))


@lru_cache(maxsize=100_000)
def deletes(s: str, k: int) -> tuple[str, ...]:
    """s with up to k characters left out."""
    out = {s}
    for n in range(1, min(k, len(s) - 1) + 1):
        out.update("".join(s[i] for i in range(len(s)) if i not in gone) for gone in combinations(range(len(s)), n))
    return tuple(out)


def allowed(n: int) -> int:
    """Edits allowed for a form of n characters: short forms only match as they are."""
    return 0 if n < 4 else 1 if n < 8 else 2


def weighted_distance(a: str, b: str) -> float:
    """Damerau-Levenshtein distance with cheaper slips: a swap or doubled letter 0.6, a neighbouring key 0.7, else 1."""
    before: list[float] = []
    row = [float(j) for j in range(len(b) + 1)]
    for i in range(1, len(a) + 1):
        last, row = row, [float(i)] + [0.0] * len(b)
        for j in range(1, len(b) + 1):
            x, y = a[i - 1], b[j - 1]
            cut = 0.6 if i > 1 and a[i - 2] == x else 1.0
            add = 0.6 if j > 1 and b[j - 2] == y else 1.0
            row[j] = min(last[j] + cut, row[j - 1] + add, last[j - 1] + (0.0 if x == y else 0.7 if y in NEAR.get(x, "") else 1.0))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                row[j] = min(row[j], before[j - 2] + 0.6)
        before = last
    return row[-1]


def edits(a: str, b: str) -> int:
    """Plain Damerau-Levenshtein distance (adjacent swaps)."""
    before: list[int] = []
    row = list(range(len(b) + 1))
    for i in range(1, len(a) + 1):
        last, row = row, [i] + [0] * len(b)
        for j in range(1, len(b) + 1):
            row[j] = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                row[j] = min(row[j], before[j - 2] + 1)
        before = last
    return row[-1]


def reference_forms(lexicon: Lexicon, kind: str = "unit", forms: dict[str, str] = FORMS, others: str = OTHERS) -> list[tuple[str, str, int]]:
    """(form, entry or ``none``, order): all forms a value may be near to. A form of two entries goes to the first."""
    out: dict[str, tuple[str, int]] = {}
    entries = lexicon.entries.get(kind, [])
    spelt = {compact(fold(key)): (key, i) for i, (key, _) in reversed(list(enumerate(entries)))}
    for i, (key, name) in enumerate(entries):
        for form in (key, name, *forms.get(fold(name), "").split()):
            out.setdefault(compact(fold(form)), (key, i))
    for form in others.split():
        out.setdefault(compact(fold(form)), (NONE, len(entries)))
    for form, unit in UNIT_KEYS.items() if kind == "unit" else ():
        if (entry := spelt.get(compact(fold(unit)))) is not None:
            out.setdefault(compact(fold(form)), entry)
    return [(f, key, i) for f, (key, i) in out.items() if f]


def _dictionary(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """For each form of the list: its deletes."""
    for b in batches:
        rows = [(f, e, p, d) for f, e, p in zip(b["reference"], b["entry"], b["place"]) for d in deletes(f, allowed(len(f)))]
        yield pd.DataFrame(rows, columns=["reference", "entry", "place", "variant"])


def _variants_up_to(longest: int):  # noqa: ANN202
    def variants(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """For each spelling and each of its plain forms: the deletes. A plain form longer than any within the edits of the list has none."""
        for b in batches:
            rows = []
            for value in b["value"]:
                plain = compact(fold(value))
                for script, form in enumerate(scripts(plain)) if len(plain) <= longest else ():
                    rows.extend((value, form, script, d) for d in deletes(form, allowed(len(form))))
            yield pd.DataFrame(rows, columns=["value", "form", "script", "variant"])

    return variants


def _ranked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Drops what shares a variant but lies too far; weighs the rest."""
    for b in batches:
        keep = [(v, e, weighted_distance(f, r) + 0.05 * s, n, o) for v, f, s, r, e, n, o in zip(b["value"], b["form"], b["script"], b["reference"], b["entry"], b["used"], b["place"]) if edits(f, r) <= min(allowed(len(f)), allowed(len(r)))]
        yield pd.DataFrame(keep, columns=["value", "entry", "cost", "used", "place"])


def map_values(values: DataFrame, column: str, lexicon: DataFrame, kind: str = "unit", forms: dict[str, str] = FORMS, others: str = OTHERS, limit: int = 50_000) -> DataFrame:
    """value, rows, entry, cost: each distinct value of ``column``, how many rows hold it, the entry meant or ``none``.

    Null values are left out (nothing was entered); ``''`` and values of signs only map to ``none`` with a
    null cost. The nearest form wins; at equal cost the entry used more often as it stands, then the order
    of the list. Values whose plain form is longer than the longest form of the list and two edits match
    nothing. The dictionary is broadcast only if it has at most ``limit`` rows, else joined by shuffle. An
    empty list maps everything to ``none``.
    """
    return _mapped(values, column, Lexicon.read(lexicon), kind, forms, others, limit)


def _mapped(values: DataFrame, column: str, lex: Lexicon, kind: str, forms: dict[str, str], others: str, limit: int) -> DataFrame:
    spark = values.sparkSession
    distinct = values.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("rows"))
    reference = reference_forms(lex, kind, forms, others)
    dictionary = spark.createDataFrame(reference, "reference string, entry string, place int").mapInPandas(_dictionary, "reference string, entry string, place int, variant string")
    distinct = cut(distinct)
    used = distinct.where(F.col("value").isin(lex.keys(kind) or [NONE])).select(F.col("value").alias("entry"), F.col("rows").alias("used"))
    dictionary = cut(dictionary.join(checked_broadcast(used, limit), "entry", "left").fillna(0, ["used"]))
    longest = max((len(f) for f, *_ in reference), default=0) + allowed(1 << 10)
    variants = distinct.select("value").mapInPandas(_variants_up_to(longest), "value string, form string, script int, variant string")
    found = variants.join(checked_broadcast(dictionary, limit), "variant").select("value", "form", "script", "reference", "entry", "used", "place").distinct()
    ranked = found.mapInPandas(_ranked, "value string, entry string, cost double, used long, place int")
    best = ranked.groupBy("value").agg(F.min(F.struct("cost", (-F.col("used")).alias("u"), "place", "entry")).alias("b")).select("value", F.col("b.entry").alias("entry"), F.col("b.cost").alias("cost"))
    return distinct.join(best, "value", "left").select("value", "rows", F.coalesce("entry", F.lit(NONE)).alias("entry"), "cost")


def is_free_entry(column: Column, keys: list[str]) -> Column:
    """A value that isn't null, empty or an entry as it stands."""
    return column.isNotNull() & (column != "") & ~column.isin(keys or [NONE])


def mapped_rows(rows: DataFrame, lexicon: DataFrame, column: str = "unit", kind: str = "unit") -> DataFrame:
    """raw_id, value, entry of every row with a free entry.

    One value may stand in a third of all rows: the mapping of distinct values is joined back broadcast
    when small, else by a join whose hot keys adaptive execution splits.
    """
    lex = Lexicon.read(lexicon)
    free = rows.where(is_free_entry(F.col(column), lex.keys(kind))).select("raw_id", F.col(column).alias("value"))
    mapping = cut(_mapped(rows.select(column), column, lex, kind, FORMS, OTHERS, 50_000).select("value", "entry"))
    return free.join(checked_broadcast(mapping), "value").select("raw_id", "value", "entry")
