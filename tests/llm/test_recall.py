"""Recall on made-up names and texts with noise that none of the tables holds; the figures of the README come from here."""

import random
from itertools import combinations

import pytest

from specloom.llm import lookalikes, name_link, scan_repair, unit_map

VOWELS, CONSONANTS = "аеиоуыя", "бвгдзклмнпрст"


def made_up(rng, least, most):
    n = rng.randint(least, most)
    return "".join(rng.choice(CONSONANTS if i % 2 == 0 else VOWELS) for i in range(n))


def slip(rng, s):
    """One typing error: swapped, dropped, doubled or wrong."""
    i, kind = rng.randrange(1, len(s) - 1), rng.randrange(4)
    return s[:i] + s[i + 1] + s[i] + s[i + 2 :] if kind == 0 else s[:i] + s[i + 1 :] if kind == 1 else s[:i] + s[i] + s[i:] if kind == 2 else s[:i] + rng.choice(VOWELS + CONSONANTS) + s[i + 1 :]


def makers(rng, count):
    """Makers of two words, no two of which could be taken for each other: any two cores differ by seven edits or more."""
    words: list[str] = []
    while len(words) < 2 * count:
        w = made_up(rng, 7, 10)
        if all(unit_map.edits(w, x) >= 4 for x in words):
            words.append(w)
    return [(words[2 * i], words[2 * i + 1]) for i in range(count)]


TO_LATIN = {"а": "a", "б": "b", "в": "v", "г": "g", "д": "d", "е": "e", "з": "z", "и": "i", "к": "k", "л": "l", "м": "m", "н": "n", "о": "o", "п": "p", "р": "r", "с": "s", "т": "t", "у": "u", "ы": "y", "я": "ya"}


def test_recall_of_name_variants(spark):
    rng = random.Random(61)
    entries = []
    for g, (a, b) in enumerate(makers(rng, 60)):
        full = f"{a.capitalize()}-{b.capitalize()}"
        forms = [full, f"ООО «{full}»", f"{b} {a}", f"{a}{b}", slip(rng, full.lower()), slip(rng, slip(rng, full.lower())), f"{slip(rng, b)} {a}".upper(), "".join(TO_LATIN[c] for c in a + b), f"завод {a} {b[:3]}.", f"{full}, г. Приморск"]
        entries += [(f, g) for f in forms]
    rng.shuffle(entries)
    df = spark.createDataFrame([(i, f) for i, (f, _) in enumerate(entries)], "edit_id long, manufacturer string")
    got = {tuple(r) for r in name_link.entry_pairs(df).collect()}
    want = {(i, j) for i, j in combinations(range(len(entries)), 2) if entries[i][1] == entries[j][1]}
    print("p6 recall", len(got & want) / len(want), "precision", len(got & want) / len(got))
    assert len(got & want) >= 0.97 * len(want)
    assert len(got & want) >= 0.99 * len(got)


@pytest.mark.parametrize("confused", [True, False])
def test_recall_of_misread_words(spark, confused):
    """One sign of a word of six letters or more misread: for one of like shape, or for any digit or sign."""
    rng = random.Random(31)
    words: list[str] = []
    while len(words) < 300:
        w = made_up(rng, 6, 12)
        if all(unit_map.edits(w, x) >= 3 for x in words):
            words.append(w)
    like = {c: [x for g in scan_repair.CONFUSED if c in g for x in g if x != c and not x.isupper()] for c in VOWELS + CONSONANTS}
    rows, want = [], {}
    for i in range(1500):
        w = rng.choice(words)
        at = rng.randrange(1, len(w) - 1)
        new = rng.choice(like[w[at]] or ["0"]) if confused else rng.choice("0123456789|*~^#")
        rows.append((i, f"{rng.choice(words)} {w[:at]}{new}{w[at + 1 :]} {rng.randint(1, 99)}"))
        want[i] = w
    lexicon = spark.createDataFrame([("word", w, w, i) for i, w in enumerate(words)], "kind string, lex_key string, lex_value string, ordinal int")
    got = {r["raw_id"]: r["repaired"].split()[1] for r in scan_repair.repair_text(spark.createDataFrame(rows, "raw_id long, name string"), "raw_id", ["name"], lexicon).collect()}
    right = sum(got[i] == w for i, w in want.items())
    print("p3 recall", confused, right / len(want))
    assert right >= 0.97 * len(want)


def test_recall_of_look_alikes(spark):
    """Letters of words replaced by look-alikes of other alphabets, with invisible signs and accents apart."""
    rng = random.Random(41)
    russian = {c: next((x, *others) for x, others in lookalikes.ALIKE.items() if c in others) for c in "АВЕКМНОРСТХУаеосрху"}
    rows, want = [], []
    for i in range(1000):
        w = "".join(rng.choice("аеорсухбдлжиймп") for _ in range(rng.randint(5, 10))) + "ж"
        spots = [k for k, c in enumerate(w) if c in russian]
        at = rng.choice(spots) if spots else 0
        bad = w[:at] + rng.choice([x for x in russian[w[at]] if x != w[at]]) + w[at + 1 :] if spots else w
        bad = bad.replace("\u0439", "\u0438\u0306") if rng.random() < 0.5 else bad
        bad = bad[:2] + rng.choice(["\u200b", "\u00ad", ""]) + bad[2:]
        rows.append((i, bad))
        want.append(w)
    empty = spark.createDataFrame([], "kind string, lex_key string, lex_value string, ordinal int")
    got = {r["raw_id"]: r["name"] for r in lookalikes.unify_text(spark.createDataFrame(rows, "raw_id long, name string"), "raw_id", ["name"], empty).collect()}
    right = sum(got[i] == w for i, w in enumerate(want))
    print("p4 recall", right / len(want))
    assert right == len(want)
