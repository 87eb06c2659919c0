import pytest
from pyspark.sql import functions as F

from specloom.functions import text as fx


def one(spark, expr, value):
    return spark.createDataFrame([(value,)], "v string").select(expr(F.col("v")).alias("r")).collect()[0]["r"]


@pytest.mark.parametrize(
    ("raw", "clean"),
    [("Воздуховод 1000 x 700", "Воздуховод 1000×700"), ("$315", "Ø315"), ("a$5", "a$5"), ("5 м2", "5 м²"), ("шт...", "шт."), ("штуцер", "штуцер"), ("компл", "компл."), ("комплект", "комплект"), ("rocт 14918-2020", "ГОСТ 14918-2020"), ("а — б", "а - б"), ("|_ x _|", "x"), (None, ""), ("", ""), ("a \n\n\n\n b", "a\nb")],
)
def test_clean_text(spark, raw, clean):
    got = one(spark, fx.clean_text, raw)
    assert got == clean


def test_texts_spared_the_steps_are_clean(spark):
    """The pattern that tells unclean texts overlooks none: on random texts the steps alone give the same."""
    import random

    rng = random.Random(8)
    bits = ["м", "М", "2", "3", "²", " ", "  ", "\t", "\n", "\u2003", "x", "Х", "×", "5", "$", "§", "а", "б", ".", "..", ":", "»", '"', "шт", "Шт", "компл", "КОМПЛ", "гост", "r0cт", "—", "\u00a0", "\u00ad", "ﬁ", "|", "_", ",", "е", "кг"]
    df = spark.createDataFrame([("".join(rng.choice(bits) for _ in range(rng.randint(1, 6))),) for _ in range(6000)], "v string")
    for compat in (False, True):
        assert df.where(fx.clean_text("v", compat) != fx.clean_steps(F.col("v"), compat)).collect() == []


def test_clean_text_compat(spark):
    assert one(spark, lambda c: fx.clean_text(c, compat=True), "штуцер") == "шт.уцер"


@pytest.mark.parametrize(("raw", "unit"), [("шт", "шт."), ("м2", "м²"), ("- КОМПЛ..", "компл."), ("wm.", "шт."), ("рулон", "рулон"), (None, "")])
def test_units(spark, raw, unit):
    assert one(spark, lambda c: fx.normalize_cell("unit", c), raw) == unit


@pytest.mark.parametrize(("raw", "number", "rest"), [("12,5", 12.5, None), ("18", 18.0, None), ("", None, None), ("-", None, None), ("1-2", None, "1-2"), ("1.000,5", 1.0005, None), (None, None, None)])
def test_numbers(spark, raw, number, rest):
    r = spark.createDataFrame([(raw,)], "v string").select(*[c.alias(n) for c, n in zip(fx.export_number("v"), "ab")]).collect()[0]
    assert (r["a"], r["b"]) == (number, rest)


def test_indel_ratio(spark):
    r = lambda a, b: spark.range(1).select(fx.indel_ratio(F.lit(a), F.lit(b)).alias("r")).collect()[0]["r"]
    assert r("abcd", "abxd") == 75.0
    assert r("клапан", "клапан") == 100.0
    assert r("", "") == 100.0
    assert r("a", "") == 0.0


def test_match_case(spark):
    r = lambda s, t: spark.range(1).select(fx.match_case(F.lit(s), F.lit(t)).alias("r")).collect()[0]["r"]
    assert [r("ОТБОД", "отвод"), r("Отбод", "отвод"), r("отбод", "отвод")] == ["ОТВОД", "Отвод", "отвод"]


def test_filename(spark):
    assert one(spark, fx.safe_filename, "a/b:c?.xlsx") == "b_c_.xlsx"
    assert one(spark, fx.safe_filename, None) == "specification.xlsx"
    assert len(one(spark, fx.safe_filename, "x" * 500)) == 160


GOLDEN = [
    ("name", "Воздухобвод оцинкованноц стали, троцник круглыц", "Воздуховод оцинкованной стали, тройник круглый"),
    ("name", "Воздуховод 1000 x 700", "Воздуховод 1000×700"),
    ("name", "— __ опора", "- опора"),
    ("name", "6 компл. с фультром", "в компл. с фультром"),
    ("note", "Реле дабления", "Реле давления"),
    ("name", "bo3d. knanaha", "возд.клапана"),
    ("manufacturer", "000 Apkmuka", "ООО Арктика"),
    ("manufacturer", "НАХИМОБСКИИ", "НАХИМОВСКИЙ"),
    ("type_mark", "roct 14918-2020", "ГОСТ 14918-2020"),
    ("type_mark", "$315", "Ø315"),
    ("type_mark", "APH 1100x800", "АРН 1100×800"),
    ("type_mark", "KBK 355", "КВК 355"),
    ("type_mark", "6APC1500", "6АРС1500"),
    ("type_mark", "solaris lite ХP 10-20/\\.5", "solaris lite ХP 10-20/\\.5"),
    ("type_mark", "SOLARIS Lite ХP 10-20/\\.5", "SOLARIS Lite XP 10-20/V.5"),
    ("code", "гост30", "ГОСТ30"),
    ("quantity", "1 200,5 шт", "1200.5"),
    ("unit", "- КОМПЛ..", "компл."),
    ("position_no", " 1.2 |", "1.2"),
    ("name", None, ""),
]


def test_columns_with_built_in_lexicon(spark):
    from specloom.operators import spelling

    none = spark.createDataFrame([], "kind string, lex_key string, lex_value string, ordinal int")
    df = spark.createDataFrame([(i, k, v) for i, (k, v, _) in enumerate(GOLDEN)], "i int, k string, v string")
    correct = lambda d, c: spelling.correct_texts(d, c, spelling.with_built_in(none), F.col("k").isin(*spelling.CORRECTED))
    got = {r["i"]: r["v"] for r in fx.normalize_by_key(df, "k", "v", correct).collect()}
    assert [got[i] for i in range(len(GOLDEN)) if i != 13] == [to for i, (*_, to) in enumerate(GOLDEN) if i != 13]


def test_plausibility_judges_normalised_texts(spark):
    from specloom.operators import cells

    df = spark.createDataFrame([("unit", "шт"), ("unit", "xx"), ("quantity", "1 2,5"), ("quantity", "нет"), ("name", "Кран"), ("name", None), ("code", "a~b")], "column_key string, text string")
    got = [round(r[0], 2) for r in cells.with_judged(df).select(fx.plausibility(F.col("column_key"), F.col("judged"))).collect()]
    assert got == [22.0, -18.0, 22.0, -12.0, 1.4, -12.0, 5.0]


def test_candidates_by_shared_pairs_lose_nothing(spark):
    """The count of shared pairs leaves out no pair of words of the similarity asked for, repeated letters included."""
    import random

    from specloom.operators import spelling

    rng = random.Random(12)
    base = ["".join(rng.choice("аабвгд") for _ in range(rng.randint(4, 12))) for _ in range(60)]
    words = set()
    for b in base:
        for _ in range(6):
            s = list(b)
            for _ in range(rng.randint(0, 2)):
                s[rng.randrange(len(s))] = rng.choice(["", "а", "вг", "е"])
            words.add("".join(s))
    got = {r["word"]: (r["corrected"], r["score"]) for r in spelling.correct_words(spark.createDataFrame([(w,) for w in words], "word string"), spark.createDataFrame([(b, i) for i, b in enumerate(base)], "entry string, ordinal int")).collect()}

    def alike(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
            row = new
        return 200.0 * row[-1] / (len(a) + len(b))

    want = {}
    for w in words:
        if len(w) >= 4:
            ranked = sorted(((-alike(w, b), i, b) for i, b in {b: (i, b) for i, b in reversed(list(enumerate(base)))}.values()))
            best, second = -ranked[0][0], -ranked[1][0]
            if best >= (93 if len(w) <= 4 else 88 if len(w) <= 7 else 84) and (best - second >= 5 or best >= 96):
                want[w] = (ranked[0][2], round(best, 6))
    assert got == want
