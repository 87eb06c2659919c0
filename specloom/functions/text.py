"""Scalar rules as column expressions; all of them stay in the JVM.

Missing text is the empty string: each function treats null as ''.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from specloom.schema import COLUMNS, NUMERIC, UNITS
from specloom.session import cut

W = r"[\p{L}\p{N}_]"
#: Fixed values. A word that reads as ГОСТ in any mix of alphabets and digits.
GOST = r"[гgrГGR][оo0ОO][сcsСCS][тtТT]"
#: Fixed values. Compact spellings of units and the unit meant.
UNIT_KEYS = {
    "шт": "шт.", "шг": "шт.", "шм": "шт.", "wm": "шт.", "штт": "шт.",
    "м": "м", "мп": "м", "м2": "м²", "м²": "м²", "м3": "м³", "м³": "м³",
    "компл": "компл.", "комплект": "компл.", "комп": "компл.", "компд": "компл.", "комплд": "компл.", "компп": "компл.",
    "кг": "кг", "пм": "п.м.", "л": "л", "кт": "к-т",
}
#: Fixed values. Latin letters inside Russian words and the letters they stand for.
LATIN, CYRILLIC = "ABCEHKMOPTXYabcdekmoptxy", "АВСЕНКМОРТХУавсдекмортху"
NUMBER = r"^-?\d+(?:[.,]\d+)?$"
ORDINARY = r"""[^\p{L}\p{N}_\s.,;:()\-+/×Ø№²³"']"""


def text(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def strip(c: Column | str) -> Column:
    """Without blanks of any kind at the ends; '' for null."""
    return F.regexp_replace(text(c), r"(?U)^\s+|\s+$", "")


def each(c: Column, rules: Iterable[tuple[str, str]]) -> Column:
    for pattern, to in rules:
        c = F.regexp_replace(c, pattern, to)
    return c


#: Fixed values. The steps of clean_text in order, as (pattern, replacement); EDGE is put where an abbreviation may end.
EDGE = "EDGE"
CLEAN_RULES = [
    (r"[ \t]+", " "),
    (r"\.{2,}", "."),
    (r"[”\"»]+(?=:)", ""),
    (r"(?U)\s*\n\s*", "\n"),
    (r"\n{3,}", "\n\n"),
    (r"(?U)(?<=\d)\s*[xXхХ]\s*(?=\d)", "×"),
    (rf"(?U)(?<!{W})[\$§](?=\s*\d)", "Ø"),
    (rf"(?iU)(?<!{W})м\s*2(?!{W})", "м²"),
    (rf"(?iU)(?<!{W})м\s*3(?!{W})", "м³"),
    (rf"(?iU)(?<!{W})шт{EDGE}\s*\.*", "шт."),
    (rf"(?iU)(?<!{W})компл{EDGE}\s*\.*", "компл."),
    (rf"(?<!{W}){GOST}(?!{W})", "ГОСТ"),
]
#: Fixed values. Codes and names of models that are read in the wrong letters.
MODEL_RULES = [
    (r"(?iU)\bAPH(?=\s*\d)", "АРН"),
    (r"(?iU)\bKBK(?=\s*\d)", "КВК"),
    (r"(?iU)\b6APC(?=\d)", "6АРС"),
    (r"(?iU)SOLARIS Lite [XХ]P(?=\s)", "SOLARIS Lite XP"),
    (r"(?iU)(SOLARIS Lite XP \d+-\d+/)\\\.(\d+)", "$1V.$2"),
]
#: Fixed values. Other rules by column: a leading dash with dirt, a 6 for в before a kit, a proper name, ООО read as zeros.
LEADING_DASH, SIX_FOR_IN = (r"(?U)^[-–—]\s*[_~]+\s*", "- "), (r"(?iU)\b6\s+(?=компл\.)", "в ")
PROPER_NAME, ZEROS = (r"(?iU)нахимобскии", "Нахимовский"), (r"(?U)^0{2,3}(?=\s|$)", "ООО")
#: Fixed value. The last rule of every column.
CLOSING = (r"(?iU)\bвозд\.\s*Клапана\b", "возд.клапана")


#: What a text that a step of clean_text changes holds at least; most texts hold nothing of it and are spared the steps.
UNCLEAN = rf"(?U)[\u00a0\u2014\u2013\u00ad\ufb01\ufb02\t\n$§]|  |\.\.|[”\"»]:|[xXхХ]\s*\d|[мМ]\s*[23]|[шШ][тТ]|[кК][оО][мМ][пП][лЛ]|{GOST}|^[ |_]|[ |_]$"


def clean_text(c: Column | str, compat: bool = False) -> Column:
    """Blanks, dashes, signs and common abbreviations in one form. compat: шт and компл also inside longer words."""
    t = text(c)
    return F.when(t.rlike(UNCLEAN), clean_steps(t, compat)).otherwise(t)


def clean_steps(t: Column, compat: bool = False) -> Column:
    """All steps of clean_text, whether a text needs them or not."""
    s = F.translate(t, "\u00a0\u2014\u2013\u00ad", " --")
    s = F.replace(F.replace(s, F.lit("ﬁ"), F.lit("fi")), F.lit("ﬂ"), F.lit("fl"))
    s = each(s, [(p.replace(EDGE, "" if compat else rf"(?!{W})"), to) for p, to in CLEAN_RULES])
    return F.regexp_replace(s, r"^[ \n|_]+|[ \n|_]+$", "")


def match_case(source: Column, replacement: Column) -> Column:
    """replacement in the letter case of source: all capitals, a capital first, or as it is."""
    upper = (F.upper(source) == source) & (F.lower(source) != source)
    first = F.substring(source, 1, 1)
    capital = (F.upper(first) == first) & (F.lower(first) != first)
    return F.when(upper, F.upper(replacement)).when(capital, F.concat(F.upper(F.substring(replacement, 1, 1)), F.substring(replacement, 2, 1 << 20))).otherwise(replacement)


def numeric_text(c: Column | str) -> Column:
    """Digits, minus and the first dot; a comma counts as a dot, further dots are dropped and what they parted joined."""
    s = each(text(c), [(" ", ""), (",", "."), (r"[^0-9.\-]", "")])
    head, rest = F.substring_index(s, ".", 1), F.regexp_replace(s, r"^[^.]*\.?", "")
    return F.when(F.instr(s, ".") > 0, F.concat(head, F.lit("."), F.replace(rest, F.lit("."), F.lit("")))).otherwise(s)


def unit_text(c: Column | str) -> Column:
    """The unit meant by a known compact spelling, else the text as it is."""
    compact = F.regexp_replace(F.lower(text(c)), r"[^а-яёa-z0-9²³]+", "")
    pairs = F.create_map(*[F.lit(x) for kv in UNIT_KEYS.items() for x in kv])
    return F.coalesce(F.try_element_at(pairs, compact), text(c))


def normalize_cell(key: str, c: Column | str, compat: bool = False) -> Column:
    """The text of a cell by the rules of its column; spelling correction is an operator of its own."""
    return column_rules(key, clean_text(c, compat))


def column_rules(key: str, s: Column, closing: bool = True) -> Column:
    """The rules of a column for a text that is clean already; without the closing one if spelling correction is still to come."""
    if key in ("name", "note"):
        s = each(s, [LEADING_DASH, SIX_FOR_IN])
    if key == "manufacturer":
        s = each(s, [PROPER_NAME, ZEROS])
    if key in ("type_mark", "code", "manufacturer"):
        s = F.regexp_replace(s, rf"(?U)(?<!{W}){GOST}(?=\s*\d)", "ГОСТ")
    if key == "type_mark":
        s = each(s, MODEL_RULES)
    if key in NUMERIC:
        s = numeric_text(s)
    if key == "unit":
        s = unit_text(s)
    return close(s) if closing else s


def close(s: Column) -> Column:
    return F.when(F.contains(F.lower(s), F.lit("возд")), F.regexp_replace(s, *CLOSING)).otherwise(s)


def normalize_by_key(df: DataFrame, key: str, value: str, correct: Callable[[DataFrame, str], DataFrame] | None = None) -> DataFrame:
    """df with ``value`` normalised by the column that each row names, in two steps so that no rule is computed twice.

    correct: the spelling correction of a column of df; it comes after the rules of names and notes and before those of others.
    """

    def ruled(keys: Iterable[str]) -> Column:
        out = F.col("_clean")
        for k in keys:
            out = F.when(F.col(key) == k, column_rules(k, F.col("_clean"), closing=False)).otherwise(out)
        return out

    keys = list(COLUMNS)
    clean = df.withColumn("_clean", clean_text(value))
    if correct is not None:
        first = [k for k in keys if k in ("name", "note")]
        clean = correct(cut(clean.withColumn("_clean", ruled(first))), "_clean")
        keys = [k for k in keys if k not in first]
    return clean.withColumn("_clean", ruled(keys)).withColumn(value, close(F.col("_clean"))).drop("_clean")


def plausibility(key: Column, value: Column) -> Column:
    """Bonus or penalty of a normalised text in its column."""
    strange = F.regexp_count(value, F.lit(ORDINARY))
    letters = lambda p: F.regexp_count(value, F.lit(p))
    return (
        F.when(value == "", -12.0)
        .when(key.isin("quantity", "mass"), F.when(value.rlike(NUMBER), 22.0).otherwise(-35.0))
        .when(key == "unit", F.when(value.isin(*UNITS), 22.0).otherwise(-18.0))
        .when(key == "position_no", F.when(value.rlike("[0-9IVXLСА-ЯA-Z]"), 8.0).otherwise(-10.0))
        .when(key.isin("name", "note"), F.least(F.lit(16.0), letters("[А-Яа-яЁё]") * 0.35) - letters("[A-Za-z]") * 0.08 - strange * 3.0)
        .when(key.isin("type_mark", "code", "manufacturer"), 8.0 - strange * 3.0)
        .otherwise(0.0)
    )


def export_number(c: Column | str) -> tuple[Column, Column]:
    """(number, text): the number of a quantity, and the original text where there is one that is no number."""
    s = numeric_text(clean_text(c))
    number = F.when(s.isin("", "-", "."), None).otherwise(F.expr("cast(null as double)"))
    number = F.when(s.rlike(r"^-?(?:\d+\.?\d*|\.\d+)$"), s.try_cast("double")).otherwise(number)
    return number, F.when(~s.isin("", "-", ".") & number.isNull(), text(c))


def round1(x: Column) -> Column:
    """x to one decimal by its exact binary value, a true tie to the even side: 66.65, which is a little more in binary, becomes 66.7.

    x * 20 is computed with its rounding error, which says on which side of a middle x lies.
    """

    def rounded(v: Column) -> Column:
        big = v * 134217729.0
        high = big - (big - v)
        p = v * 20.0
        error = (high * 20.0 - p) + (v - high) * 20.0
        below = F.floor(p / 2.0)
        up = F.when(error > 0, 1).when(error < 0, 0).otherwise(F.abs(below % 2))
        return F.when(F.abs(p % 2) == 1.0, below + up).otherwise(F.floor((p + 1.0) / 2.0)) / 10.0

    return F.get(F.transform(F.array(x), rounded), F.lit(0))  # x is computed once


def confidence(c: Column | str) -> Column:
    """A confidence of 0 at least; 0 for null and NaN."""
    v = F.col(c) if isinstance(c, str) else c
    return F.greatest(F.coalesce(F.nanvl(v.cast("double"), F.lit(0.0)), F.lit(0.0)), F.lit(0.0))


def safe_filename(c: Column | str, default: str = "specification.xlsx") -> Column:
    """The last part of a path with signs replaced, an .xlsx ending, 160 characters at most."""
    s = F.when(text(c) == "", F.lit(default)).otherwise(F.regexp_replace(text(c), r"^.*/", ""))
    s = F.regexp_replace(s, r"[^\p{L}\p{N}_\-. ()]", "_")
    return F.substring(F.when(F.lower(s).endswith(".xlsx"), s).otherwise(F.concat(s, F.lit(".xlsx"))), 1, 160)


def indel_ratio(a: Column, b: Column) -> Column:
    """100 * 2 * LCS / (|a| + |b|), 100 for two empty texts: similarity where a replaced letter costs two."""
    chars = F.split(b, "")
    zero = F.transform(F.concat(F.array(F.lit("")), chars), lambda _: F.lit(0))

    def row(last: Column, x: Column) -> Column:
        def cell(new: Column, j: Column) -> Column:
            same = F.when(F.element_at(chars, j) == x, F.element_at(last, j) + 1).otherwise(F.greatest(F.element_at(last, j + 1), F.element_at(new, j)))
            return F.concat(new, F.array(same))

        return F.aggregate(F.sequence(F.lit(1), F.size(chars)), F.array(F.lit(0)), cell)

    lcs = F.element_at(F.aggregate(F.split(a, ""), zero, row), -1)
    total = F.length(a) + F.length(b)
    return F.when(total == 0, 100.0).when((F.length(a) == 0) | (F.length(b) == 0), 0.0).otherwise(lcs * 200.0 / total)
