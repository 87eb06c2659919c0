import random
from datetime import datetime
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from specloom.llm import format_dups, lookalikes, mixing, name_link, reading_level, scan_repair, survivorship, tokenize, unit_map

LEXICON = [("unit", "шт.", "штука"), ("unit", "м", "метр"), ("unit", "кг", "килограмм"), ("mark", "СКВ", "СКВ"), ("mark", "XBT", "XBT"), ("maker", "Вихрена", "Вихрена"), ("maker", "KAPTOXE", "KAPTOXE")]
WORDS = "клапан отсекатель стальной длина фланцевая муфта сталь окрашенная монтаж место заказчик уточнить длину шумозащитный".split()


@pytest.fixture(scope="module")
def lexicon(spark):
    rows = [(k, a, b, i) for i, (k, a, b) in enumerate(LEXICON)] + [("word", w, w, i) for i, w in enumerate(WORDS)]
    return spark.createDataFrame(rows, "kind string, lex_key string, lex_value string, ordinal int")


@pytest.fixture(scope="module")
def no_lexicon(lexicon):
    return lexicon.limit(0)


# 1


READING = "cell_id long, result_id long, column_key string, text string, confidence double, source string, read_at timestamp, extra string"


def test_survivor(spark, lexicon):
    t = [datetime(2031, 2, d) for d in range(1, 9)]
    rows = [
        (1, 1, "name", "Клапан стальной", 90.0, "page-rus", t[0], "x"),
        (1, 2, "name", "Клапан стальной, длина 5", 60.0, "page-rus", t[0], "x"),
        (1, 3, "name", "Клапан стальной, длина 5 | шт", 99.0, "page-rus", t[0], "x"),
        (1, 4, "name", "Клалан стальной, длина 5", 99.0, "page-rus", t[0], "x"),
        (1, 5, "name", "Клапан стальной, длина 5", 60.0, "page-rus", t[1], "x"),
        (1, 6, "name", "Клапан стальной, длина 5", 60.0, "page-rus", t[1], "x"),
        (2, 7, "quantity", "12", 80.0, "page-rus", None, None),
        (2, 8, "quantity", "345", 60.0, "page-rus", t[0], None),
        (2, 9, "quantity", "12 шт", 99.0, None, t[0], None),
        (3, 10, "unit", None, None, None, None, None),
        (None, 11, "unit", "шт.", 90.0, "page-rus", t[0], None),
        (4, 12, "note", "", 5.0, "none", None, None),
        (4, 13, "note", " ", float("nan"), "none", None, None),
    ]
    df = spark.createDataFrame(rows, READING)
    got = {r["cell_id"]: (r["result_id"], r["readings"]) for r in survivorship.best_readings(df, lexicon).collect()}
    assert got[1] == (5, 6)
    assert got[2] == (7, 3)
    assert got[3] == (10, 1)
    assert set(got) == {1, 2, 3, 4}
    gold = {r["cell_id"]: r for r in survivorship.golden_cells(df, lexicon).collect()}
    assert (gold[1]["text"], gold[1]["confidence"]) == ("Клапан стальной, длина 5", 90.0)
    assert survivorship.best_readings(df.limit(0), lexicon).count() == 0


# 2


def test_units(spark, lexicon, no_lexicon):
    values = ["шт", "ШТ.", "шткуа", "  м.", "метор", "кило", "г", "мм", "", None, "???", "kг", "шт.", "x" * 100_000, "шт" + " " * 300, "." * 500 + " метор", "wт", "щт", "шг"]
    df = spark.createDataFrame([(i, v, "e") for i, v in enumerate(values)], "raw_id long, unit string, entry string")
    got = {r["raw_id"]: r["entry"] for r in unit_map.mapped_rows(df, lexicon).collect()}
    assert got == {0: "шт.", 1: "шт.", 2: "шт.", 3: "м", 4: "м", 5: "кг", 6: "none", 7: "none", 10: "none", 11: "кг", 13: "none", 14: "шт.", 15: "м", 16: "шт.", 17: "шт.", 18: "шт."}
    assert {r["entry"] for r in unit_map.map_values(df, "unit", no_lexicon).collect()} == {"none"}
    assert unit_map.mapped_rows(df.limit(0), lexicon).count() == 0


def test_typos_are_found_by_distance(spark, lexicon):
    """One typo in a word of eight letters or more, at random: swapped, dropped, doubled or hit beside; no list holds these."""
    rng = random.Random(22)
    words = {"килограмм": "кг", "комплект": "компл.", "погонный метр": "п.м.", "квадратный метр": "м²", "кубический метр": "м³", "упаковка": "упак."}
    entries = [("unit", k, w, i) for i, (w, k) in enumerate(words.items())]
    lex = spark.createDataFrame(entries, "kind string, lex_key string, lex_value string, ordinal int")
    typed = []
    for w, key in words.items():
        for _ in range(60):
            i, kind = rng.randrange(1, len(w) - 1), rng.randrange(4)
            near = unit_map.NEAR.get(w[i], w[i])
            typed.append((w[: i - 1] + w[i] + w[i - 1] + w[i + 1 :] if kind == 0 else w[:i] + w[i + 1 :] if kind == 1 else w[:i] + w[i] + w[i:] if kind == 2 else w[:i] + rng.choice(near) + w[i + 1 :], key))
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(typed)], "raw_id long, unit string")
    got = {r["raw_id"]: r["entry"] for r in unit_map.mapped_rows(df, lex).collect()}
    assert all(got.get(i, key) == key for i, (_, key) in enumerate(typed))


def test_deletes_find_all_within_bound():
    rng = random.Random(2)
    words = ["".join(rng.choice("абв") for _ in range(rng.randint(4, 9))) for _ in range(60)]
    for a, b in combinations(words, 2):
        k = min(unit_map.allowed(len(a)), unit_map.allowed(len(b)))
        if unit_map.edits(a, b) <= k:
            assert set(unit_map.deletes(a, unit_map.allowed(len(a)))) & set(unit_map.deletes(b, unit_map.allowed(len(b))))


# 3


def test_trie_is_complete():
    rng = random.Random(3)
    words = {"".join(rng.choice("абвг") for _ in range(rng.randint(3, 7))) for _ in range(200)}
    trie = scan_repair.Trie(words)

    def plain(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, last = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(row[-1] + 1, last[j] + 1, last[j - 1] + (x != y)))
        return row[-1]

    for q in list(words)[:20] + ["абвгабв", "", "г"]:
        assert dict(trie.within(q, 2)) == {w: plain(q, w) for w in words if plain(q, w) <= 2}


def test_repair(spark, lexicon, no_lexicon):
    cases = {
        "Клапан стальной": ("Клапан стальной", []),
        "Кла-\nпан стальной": ("Клапан стальной", ["broken"]),
        "Клапан\nстальной": ("Клапан стальной", []),
        "Кл0пан стальной": ("Клапан стальной", ["misread"]),
        "Клапан стальной |": ("Клапан стальной", ["misread"]),
        "Стр. 12\nКлапан стальной": ("Клапан стальной", ["page"]),
        "Клапан-отсекатель": ("Клапан-отсекатель", []),
        "Kлaпан стальной": ("Клапан стальной", []),
    }
    df = spark.createDataFrame([(i, t, None, "x") for i, t in enumerate([*cases, None, "", " \n "])], "raw_id long, name string, note string, text string")
    got = {r["text"]: (r["repaired"], r["wrong"]) for r in scan_repair.repair_text(df, "raw_id", ["name", "note"], lexicon).collect()}
    assert got == cases
    assert scan_repair.repair_text(df.limit(0), "raw_id", ["name"], lexicon).count() == 0
    assert scan_repair.repair_text(df, "raw_id", ["name"], no_lexicon).count() == len(cases)
    long = spark.createDataFrame([(1, "клапан " * 50_000), (2, "клапан" * 50_000), (3, "".join(scan_repair.GROUPS) * 5_000)], "raw_id long, name string")
    assert {r["raw_id"]: "broken" in r["wrong"] or "page" in r["wrong"] for r in scan_repair.repair_text(long, "raw_id", ["name"], lexicon).collect()} == {1: False, 2: False, 3: False}


def test_page_lines_and_text_that_looks_like_them():
    """A line is taken for the page's only where the text has no place for it; the words after them were met before figures."""
    repairer = scan_repair.Repairer(set(WORDS) | {"чертёж", "узла", "лист", "см"}, {("узла", "#"): 50, ("лист", "#"): 50, ("длина", "#"): 50})
    kept = ["Муфта переходная\n32/25", "Муфта переходная\n25/32", "Труба стальная\nс 20", "Отвод\nВН-12-а", "чертёж узла 17, см.\nлист 8", "чертёж узла 17, см.\nЛист 8", "Муфта\nстадия монтажа", "Клапан, длина\n150\nмм", "чертёж узла\n150", "17", "Муфта\nспецификация оборудования прилагается"]
    for text in kept:
        assert "page" not in repairer.repair(text)[1], text
    cut = {"чертёж узла 17, см.\nСтр. 3\nлист 8": "чертёж узла 17, см. лист 8", "чертёж узла\n12\n150, см. лист 3": "чертёж узла 150, см. лист 3", "чертёж узла 17, см. лист 8\n12": "чертёж узла 17, см. лист 8", "12 / 58\nКлапан": "Клапан", "Клапан\nстр. 4 из 58": "Клапан", "Клапан\n- 4 -": "Клапан", "[4]\nКлапан": "Клапан", "Клапан\nОВ-12.СО": "Клапан", "Клапан\nСО-12-ОВ.С  лист 4": "Клапан", "Клапан\nИнв. № подл. 12": "Клапан", "Стадия Р  Лист 5  Листов 9\nКлапан": "Клапан", "Клапан\nИзм. Кол.уч. Лист № док. Подп. Дата": "Клапан"}
    for text, to in cut.items():
        assert repairer.repair(text) == (to, {"page"}), text


def test_equal_cells_in_a_larger_corpus(spark, lexicon):
    """Cells come out alike alone and among many others, misread ones and copies included."""
    few = ["Клалан стальной", "Кла-\nпан, длина 5", "Муфта\nСтр. 4", "Клапан длнна 15", "монтаж|место", "хкгз для муфты"]
    more = few * 3 + [f"Клалан {w} длина {i}" for i, w in enumerate(WORDS * 20)] + [f"Муфта для {w}\n{i}" for i, w in enumerate(WORDS * 5)]
    alone, among = ({r["text"]: (r["repaired"], r["wrong"]) for r in scan_repair.repair_text(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "raw_id long, name string"), "raw_id", ["name"], lexicon).collect()} for texts in (few, more))
    assert {t: among[t] for t in few} == alone


def test_all_groups_of_a_token_are_read():
    """Five groups for five letters: only the form with all of them replaced is near the word."""
    assert len(scan_repair.alternatives("гль1)кппср")) == 32
    assert scan_repair.Repairer({"мыжпф"}, {}).nearest("гль1)кппср", "") == "мыжпф"


def test_copies_of_a_misreading_are_no_words(spark, lexicon):
    """One text many times, and one word misread alike in many texts; a word that is near no listed one stays as it is."""
    texts = ["Клалан стальной"] * 40 + [f"Муфта стальнся {i}" for i in range(30)] + [f"Клапан кгрвщшф {i}" for i in range(30)] + ["Муфта"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "raw_id long, name string")
    got = {r["raw_id"]: (r["repaired"], " ".join(r["wrong"])) for r in scan_repair.repair_text(df, "raw_id", ["name"], lexicon).collect()}
    assert {got[i] for i in range(40)} == {("Клапан стальной", "misread")}
    assert {got[i] for i in range(40, 70)} == {(f"Муфта стальной {i}", "misread") for i in range(30)}
    assert {got[i] for i in range(70, 101)} == {(t, "") for t in texts[70:]}
    assert scan_repair.count_words(df, ["name"], set(WORDS))[0] == {"кгрвщшф"}


# 4


def test_lookalikes(spark, lexicon):
    cases = [
        ("name", "Клaпaн", "Клапан"), ("name", "ста​ль", "сталь"), ("name", "а́б", "а́б"), ("name", "й", "й"), ("name", "и​̆", "й"), ("name", "１２", "12"), ("name", "a б в", "а б в"),
        ("name", "× Ø « » №\r\n", "× Ø « » №\r\n"), ("name", "исполнение Ⅱ", "исполнение II"), ("name", "ɡate", "gate"), ("name", "Ꭺвтомат", "Автомат"), ("name", "ԁoor", "door"), ("name", "насᎾс", "насᎾс"), ("name", "𝐊лапан", "Клапан"), ("name", "ﬁne", "fine"), ("name", "é", "é"), ("name", "и\u0306\u0301", "й\u0301"), ("type_mark", "CKB-1", "СКВ-1"), ("type_mark", "ХВТ-1", "XBT-1"), ("manufacturer", "КАРТОХЕ", "KAPTOXE"), ("manufacturer", "Bиxpeнa", "Вихрена"),
    ]
    rows = [(i, *[t if c == k else None for c in ("name", "type_mark", "manufacturer")], "x") for i, (k, t, _) in enumerate(cases)] + [(99, "", None, "", None)]
    df = spark.createDataFrame(rows, "raw_id long, name string, type_mark string, manufacturer string, column_key string")
    columns = ["name", "type_mark", "manufacturer"]
    got = {r["raw_id"]: r for r in lookalikes.unify_text(df, "raw_id", columns, lexicon).collect()}
    for i, (k, t, to) in enumerate(cases):
        assert (got[i][k], got[i][f"{k}_changed"]) == (to, t != to), t
    assert (got[99]["name"], got[99]["type_mark"], got[99]["name_changed"]) == ("", None, False)
    changed = {(r["raw_id"], r["column_key"]) for r in lookalikes.changed_cells(df, "raw_id", columns, lexicon).collect()}
    assert changed == {(i, k) for i, (k, t, to) in enumerate(cases) if t != to}
    assert lookalikes.changed_cells(df.limit(0), "raw_id", columns, lexicon).count() == 0


def test_long_runs_of_accents(spark, lexicon):
    """A base with any number of marks adds nothing to what is brought to the driver but the marks themselves."""
    df = spark.createDataFrame([(i, "и" + "\u0306" * i, None, None) for i in range(1, 300)], "raw_id long, name string, type_mark string, manufacturer string")
    counts, _ = lookalikes.census(df, ["name"], lookalikes.Lexicon.read(lexicon))
    assert set(counts) == {"и", "\u0306"}
    assert {r["name"] for r in lookalikes.unify_text(df, "raw_id", ["name"], lexicon).collect()} == {"й" + "\u0306" * i for i in range(299)}


def test_classes_are_transitive():
    uf = lookalikes.classes_of(["Ａ", "Α"])
    assert len({uf.find(c) for c in ("A", "А", "Α", "Ａ")}) == 1


# 5


def test_format_duplicates(spark):
    groups = [
        [("Муфта осевая, Ø90, сталь", "XBT-2025"), ("сталь; МУФТА  осевая | Ø90", "xbt 2025"), ("XBT.2025", "Муфта осевая / Ø90, «сталь»")],
        [("Муфта осевая, 5,2 мм", "A-1")], [("Муфта осевая, 52 мм", "A-1")], [("осевая Муфта, 5,2 мм", "A-1")],
        [("Лист", None), ("лист.", "")],
        [("200×540", "A-7")], [("540×200", "A-7")],
    ]
    rows = [(i, *x) for i, x in enumerate((x for g in groups for x in g), 1)] + [(90, None, ""), (91, " ", "-"), (None, "Лист", None)]
    df = spark.createDataFrame([(*r, "k") for r in rows], "row_order long, name string, type_mark string, key string")
    for hot in (1000, 3):  # at 3 a key of more than a third of the rows is hot
        got = {tuple(r) for r in format_dups.copies(df, hot_share=hot, salts=3).collect()}
        assert got == {(1, 2), (1, 3), (7, 8)}
        counted = sorted(tuple(r) for r in format_dups.copy_groups(df, hot_share=hot, salts=3).collect())
        assert counted == [(1, 3), (4, 1), (5, 1), (6, 1), (7, 2), (9, 1), (10, 1)]
    assert format_dups.copies(df.limit(0)).count() == 0
    twice = spark.createDataFrame([(1, "Лист 2, сталь 3", None), (5, "Сталь 3; лист 2", ""), (5, "Сталь 3; лист 2", ""), (7, None, "сталь 3 | лист 2")], "row_order long, name string, type_mark string")
    for hot in (1000, 1):
        assert sorted(tuple(r) for r in format_dups.copies(twice, hot_share=hot).collect()) == [(1, 5), (1, 7)]
    figures = spark.createDataFrame([(1, "Лист 2000×3000, сталь 315", "АБВ"), (2, "АБВ", "сталь 315 | лист 2000×3000"), (3, "Лист 2000×3000", "АБ/В")], "row_order long, name string, type_mark string")
    assert [tuple(r) for r in format_dups.copies(figures).collect()] == [(1, 2)]
    skewed = spark.range(1, 3001).select(F.col("id").alias("row_order"), F.when(F.col("id") % 3 == 0, "Лист").otherwise(F.concat(F.lit("Лист "), F.col("id"))).alias("name"), F.lit("").alias("type_mark"))
    assert format_dups.copies(skewed).agg(F.count("*"), F.min("first_id"), F.max("first_id")).collect()[0] == (999, 3, 3)


# 6


def test_name_variants(spark):
    one = ["ООО «Тидипо-Лерустрой»", "Лерустрой Тидипо", "Тидипо - Лерустрой, г. Старокрутск", "TIDIPO LERUSTROY", "тидиполерустрой ООО", "Тиидпо-Лерустрой", "Тидипо Лер.", "Тидипо-Л.", "з-д Тидипо", "Тидипо (Старокрутск)", "Общество с ограниченной ответственностью Фирма Тидипо-Лерустрой"]
    two = ["АО «Вягамя-Боватех»", "Вягамя"]
    near = ["ПК «Тадипа-Лорустрой»"]
    nobody = ["н/д", "", "-", "Уточнить", "по выбору заказчика", None]
    entries = [*one, *two, *near, *nobody, one[0]]
    df = spark.createDataFrame([(i, v, "l") for i, v in enumerate(entries)] + [(None, one[0], "l")], "edit_id long, manufacturer string, label string")
    got = {tuple(r) for r in name_link.entry_pairs(df).collect()}
    first = [i for i, v in enumerate(entries) if v in one]
    assert got == set(combinations(first, 2)) | {(len(one), len(one) + 1)}
    links = {r["id"]: r["links"] for r in name_link.linked_entries(df).collect()}
    assert links[0] == len(first) - 1
    assert links[len(one) + 2] == 0
    assert name_link.entry_pairs(df.limit(0)).count() == 0


@pytest.mark.parametrize("block", [20_000, 3])
def test_trie_join_is_complete(spark, block):
    rng = random.Random(6)
    base = ["".join(rng.choice("бвгд") + rng.choice("аеи") for _ in range(6)) for _ in range(12)]
    names = set(base)
    for b in base:
        for _ in range(4):
            s = list(b)
            for _ in range(rng.randint(1, 2)):
                i = rng.randrange(len(s))
                s[i : i + 1] = rng.choice(["", "з", s[i] * 2])
            names.add("".join(s))
    df = spark.createDataFrame([(n, None) for n in sorted(names)], "full string, words array<string>")
    got = {tuple(r) for r in name_link.trie_join(df, block).collect()}

    def plain(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, last = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(row[-1] + 1, last[j] + 1, last[j - 1] + (x != y)))
        return row[-1]

    for a, b in combinations(sorted(names), 2):
        if len(min(a, b, key=len)) >= 8 and plain(a, b) <= 2:
            assert (a, b) in got


def test_trie_join_finds_all_that_is_allowed(spark):
    """Swaps at any place, also beside other edits, and three slips: the pairs are those of a comparison all against all."""
    rng = random.Random(16)
    names = set()
    for length in (2, 3, 4, 5, 7, 8, 9, 11, 12, 13, 14, 16, 19):
        b = "".join(rng.choice("бвгдклмнрст") + rng.choice("аеиоу") for _ in range(10))[:length]
        names.add(b)
        for n in range(1, length):
            swap = b[: n - 1] + b[n] + b[n - 1] + b[n + 1 :]
            names |= {swap, "".join(c for i, c in enumerate(swap) if i != rng.randrange(length))}
            s = list(b)
            for i in rng.sample(range(length), min(3, length)):
                s[i] = rng.choice(["", s[i] * 2, "з"])
            names.add("".join(s))
            t, at = list(b), rng.sample(range(length - 1), min(3, length - 1))
            for i in at:
                t[i], t[i + 1] = t[i + 1], t[i]
            names.add("".join(t))
    names.discard("")
    rows = [(n, n[len(n) // 2 :] + n[: len(n) // 2] if i % 3 == 0 else None) for i, n in enumerate(sorted(names))]
    data = [(n, [n[: len(n) // 2], n[len(n) // 2 :]] if m else None) for n, m in rows]
    got = {tuple(r) for r in name_link.trie_join(spark.createDataFrame(data, "full string, words array<string>"), 20_000).collect()}

    def edits(a, b):
        d = {(i, j): i + j for i in range(len(a) + 1) for j in range(len(b) + 1) if not i * j}
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
                if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                    d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
        return d[len(a), len(b)]

    want = set()
    for name, swapped in rows:
        for form in [name, swapped] if swapped else [name]:
            for other, _ in rows:
                most = min([0 if len(x) < 4 else 1 if len(x) < 8 else 2 if len(x) < 12 else 3 for x in (form, other)])
                if other != name and abs(len(form) - len(other)) <= most and (n := edits(form, other)) <= most and (n < 3 or name_link.slips(form, other) <= 2.5):
                    want.add((min(name, other), max(name, other)))
    assert got == want


def test_all_orders_of_words(spark):
    """Three, four and six words in any order, with slips; also words after the fourth tell makers apart, and hot classes are joined in blocks."""
    words = ["тидипо", "лерустрой", "вамотех", "борейка", "кувозе", "сапром"]
    rng = random.Random(5)
    entries = []
    for g, n in enumerate((3, 4, 6)):
        entries.append((" ".join(words[:n]), g))
        for _ in range(6):
            some = rng.sample(words[:n], n)
            i = rng.randrange(n)
            some[i] = some[i][:2] + some[i][3:] if rng.random() < 0.5 else some[i][1] + some[i][0] + some[i][2:]
            entries.append((" ".join(some), g))
    entries += [(" ".join([*words[:4], "жухлица", "зяблик"]), 3), ("Бохрев Куперт Дюнкер", 4), ("Дюнкер Бохрев Куперт", 4)]
    df = spark.createDataFrame([(i, m) for i, (m, _) in enumerate(entries)], "edit_id long, manufacturer string")
    want = {(i, j) for i, j in combinations(range(len(entries)), 2) if entries[i][1] == entries[j][1]}
    for block in (4096, 2):
        got = [tuple(r) for r in name_link.entry_pairs(df, block=block).collect()]
        assert len(got) == len(set(got))
        assert set(got) == want


def test_names_of_very_many_words(spark):
    """Thousands of words, in another order and with three slips: one maker; four words changed: another."""
    rng = random.Random(77)
    words = ["".join(rng.choice("бвгдклмнрст") + rng.choice("аеиоу") for _ in range(4)) for _ in range(3000)]
    other = rng.sample(words, len(words))
    for i in (5, 100, 2000):
        other[i] = other[i][1] + other[i][0] + other[i][2:]
    far = [*words[:-4], *("жухлицаш", "зябликуш", "фонарищеш", "чайникуш")]
    names = [" ".join(words), " ".join(other), " ".join(far), "б" * 50_000, "б" * 50_001, None, ""]
    df = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "edit_id long, manufacturer string")
    assert {tuple(r) for r in name_link.entry_pairs(df).collect()} == {(0, 1), (3, 4)}


def test_short_names(spark):
    """Misread kept words, also of one-word makers, and a cut word that tells two makers with the same word apart."""
    groups = [["Тидипо-Лерустрой", "Тидипо Лерустрой", "ООО Тидипо Лерустрой", "Тидипо"], ["Тидипо-Вамотех", "Тидипо В.", "Тидпио-Вам."], ["Борейка", "Борекка", "ООО Борейка"], ["Кувозе-Сапром", "Куовзе"]]
    entries = [(m, g) for g, names in enumerate(groups) for m in names]
    df = spark.createDataFrame([(i, m) for i, (m, _) in enumerate(entries)], "edit_id long, manufacturer string")
    got = {tuple(r) for r in name_link.entry_pairs(df).collect()}
    assert got == {(i, j) for i, j in combinations(range(len(entries)), 2) if entries[i][1] == entries[j][1]}


def test_components(spark):
    nodes = spark.createDataFrame([(f"n{i:02d}",) for i in range(30)], "node string")
    edges = spark.createDataFrame([(f"n{i:02d}", f"n{i + 1:02d}") for i in range(24) if i != 10], "a string, b string")
    got = {r["node"]: r["label"] for r in name_link.components(nodes, edges).collect()}
    assert {got[f"n{i:02d}"] for i in range(11)} == {"n00"}
    assert {got[f"n{i:02d}"] for i in range(11, 25)} == {"n11"}
    assert got["n29"] == "n29"


# 7


def test_tokenizer_round_trip(spark):
    tiktoken = pytest.importorskip("tiktoken")
    enc = tokenize.encoder()
    reference = tiktoken.Encoding("reference", pat_str=tokenize.PATTERN, mergeable_ranks=enc.ranks, special_tokens={})
    rng = random.Random(7)
    alphabet = "abcdeinrst АБабвгдеёжий 0123456789\n\t.,'-éü€😀中<|>"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 60))) for _ in range(500)] + ["<|endoftext|>", "it's we'll", "  \n ", "ab" * 20_000]
    for t in texts:
        assert enc.encode(t) == reference.encode_ordinary(t)
    df = spark.createDataFrame([(i, t, [1]) for i, t in enumerate([*texts, None, ""])], "doc_id long, text string, ids array<int>")
    encoded = tokenize.encode_texts(df)
    got = {r["doc_id"]: r["ids"] for r in encoded.collect()}
    assert got[len(texts)] == got[len(texts) + 1] == []
    assert {r["doc_id"]: r["text"] for r in tokenize.decode_ids(encoded).collect()} == {i: t or "" for i, t in enumerate([*texts, None, ""])}
    assert tokenize.encode_texts(df.limit(0)).count() == 0


def test_decoder_on_broken_bytes():
    d = tokenize.Decoder({i: bytes((i,)) for i in range(256)})
    rng = random.Random(8)
    for _ in range(500):
        data = bytes(rng.choice((0x41, 0xC3, 0xA9, 0xE2, 0x82, 0xAC, 0xF0, 0x9F, 0x98, 0x80, 0xFF, 0xED, 0xA0)) for _ in range(rng.randint(1, 8)))
        assert d.decode(list(data)) == data.decode("utf-8", "replace")


# 8


def test_mix(spark):
    rng = random.Random(9)
    rows = [(i, " ".join(rng.choice("вода насос клапан труба".split()) for _ in range(rng.randint(5, 60))) + f" {i}", s) for s, n in (("a", 300), ("b", 60), ("c", 30)) for i in range(len(s) * 1000 + ord(s) * 10_000, len(s) * 1000 + ord(s) * 10_000 + n)]
    rows += [(1, rows[0][1], "b"), (2, None, "a"), (3, " ", "a"), (4, "x", None), (5, "y", "other")]
    docs = spark.createDataFrame([(*r, 7) for r in rows], "doc_id long, text string, source string, copies int")
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.3, 3), ("c", 0.1, 4), ("d", 0.1, 2)], "source string, target_share double, max_repeats int")
    mixed = mixing.mix(docs, targets)
    kept = {r["doc_id"]: r for r in mixed.collect()}
    assert all(0 <= r["copies"] <= r["cap"] for r in kept.values())
    assert not {2, 3, 4, 5} & set(kept)
    assert (1 in kept) != (rows[0][0] in kept)
    reached = {r["source"]: r["reached_share"] for r in mixing.shares(mixed, targets).collect()}
    for s, share in (("a", 0.5), ("b", 0.3), ("c", 0.1)):
        assert abs(reached[s] - share / 0.9) < 0.01
    assert reached["d"] == 0
    assert mixing.mix(docs.limit(0), targets).count() == 0
    assert mixing.mix(docs, targets.limit(0)).count() == 0


# 9


def test_isotonic():
    import numpy as np

    knots, values = reading_level.isotonic(np.array([1.0, 2, 3, 4]), np.array([1.0, 3, 2, 4]))
    assert values.tolist() == [1.0, 2.5, 4.0]
    assert knots.tolist() == [1.0, 2.5, 4.0]


def test_levels(spark):
    easy = "Вот кот. Тут дом. Он тут. Там пол. "
    hard = "Аэродинамическое сопротивление воздухораспределительной сети, подтверждённое испытаниями, обеспечивает поддержание нормируемых параметров микроклимата при одновременном функционировании резервируемых установок. "
    rng = random.Random(1)
    rows = [(i, easy * rng.randint(1, 4) if i % 2 else hard * rng.randint(1, 4)) for i in range(80)] + [(100, None), (101, ""), (102, " \n"), (103, "12 !!"), (104, hard * 300)]
    docs = spark.createDataFrame([(*r, 3) for r in rows], "doc_id long, text string, level int")
    labels = spark.createDataFrame([(i, 1 if i % 2 else 5) for i in range(60)] + [(61, None), (None, 4), (999, 2)], "doc_id long, grade int")
    got = {r["doc_id"]: r["level"] for r in reading_level.reading_levels(docs, labels).collect()}
    assert {got[i] for i in range(61, 80, 2)} == {1}
    assert {got[i] for i in range(60, 80, 2)} == {5}
    assert [got[i] for i in (100, 101, 102, 103)] == [None] * 4
    assert got[104] == 5
    assert {r["level"] for r in reading_level.reading_levels(docs, labels.limit(0)).collect()} == {None, 3}
    assert reading_level.reading_levels(docs.limit(0), labels).count() == 0
