"""Problem 6: entries that mean the same organisation under different spellings.

Each distinct spelling is brought to its core: alphabet, case, quotes, legal form and place gone. Full
cores are then joined by edit distance in a trie join: the cores are sharded by their length and a segment of
their letters, each shard is a trie, and a query walks it with the rows of its Levenshtein automaton. A core
that allows k edits is cut into k + 1 segments. Edits within segments leave one of them whole, number i from 0
with i edits to its left and at most k - i to its right; a swap over a border counts for neither segment, as
queries also come with the letters of a border swapped back. So every pair that is allowed meets in a shard.
Names are queried in every order of their words: all permutations up to ORDERS words. Of two longer ones at most
TOUCHED words differ; put in an order of their own, then two of the first TOUCHED + 2 words of the one are among those
of the other, so such names meet in the shards of two words, and the words they don't share are compared in all orders.
Cores joined this way form classes; shortened names are then attached by the word they keep, which meets the words of
cores in a trie join of its own.

A shard with more than BLOCK cores or queries is split both ways, and each part of the queries visits each block of
the cores; nothing is cut off.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import combinations, permutations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from specloom.session import LOOKUP_ROWS, checked_broadcast, cut

#: Edits allowed between two full cores.
K = 2
#: One edit more is accepted between cores of this length if the edits are slips (letters dropped, doubled or
#: swapped, at most one replaced): names of different makers differ by letters replaced.
LONG = 12
SLIP, SLIPS = 0.75, 2.5
#: Cores in one trie, and queries that one task puts to it.
BLOCK = 20_000
#: Words up to which a name is queried in all their orders; beyond, edits touch at most TOUCHED words, as many as edits are allowed.
ORDERS, TOUCHED = 4, 3
#: Entries of one class in a block of the join that gives its pairs.
PAIR_BLOCK = 4096
#: A place named by one entry in so many counts as a place wherever it stands.
PLACE_SHARE = 1000

#: Fixed values. Legal forms and words that say what kind of organisation it is.
FORMS = [
    "общество с ограниченной ответственностью", "публичное акционерное общество", "закрытое акционерное общество", "открытое акционерное общество", "акционерное общество",
    "научно-производственное объединение", "научно-производственное предприятие", "производственный кооператив", "торговый дом", "группа компаний", "индивидуальный предприниматель",
    "ооо", "оао", "зао", "пао", "ао", "пк", "нпо", "нпп", "тд", "гк", "ип", "тк", "завод", "з-д", "фирма", "ф-ма", "компания", "комп", "корпорация", "холдинг", "концерн", "предприятие", "пр-во",
    "llc", "jsc", "npo", "pk", "td", "gk", "ltd", "inc", "gmbh", "company", "co", "group",
]
#: Fixed values. Entries that name no maker.
NOBODY = {
    "", "не указан", "не указано", "не указана", "не задан", "не определен", "не известен", "неизвестно", "нд", "н д", "нет", "нет данных", "аналог", "или аналог", "аналоги", "уточнить", "уточняется", "согласовать",
    "по выбору заказчика", "по выбору", "на выбор заказчика", "заказчик", "по проекту", "по согласованию", "по месту", "по факту", "любой", "разные", "прочее", "прочие", "отсутствует", "см примечание", "см прим", "то же", "импорт", "na", "none", "n a", "tbd", "unknown",
}
#: Fixed values. How Russian letters are written in Latin ones, longest first.
LATIN = [("shch", "щ"), ("sch", "щ"), ("zh", "ж"), ("kh", "х"), ("ts", "ц"), ("ch", "ч"), ("sh", "ш"), ("yu", "ю"), ("ya", "я"), ("yo", "е"), ("ye", "е"), ("ju", "ю"), ("ja", "я"), *zip("abvgdeziyklmnoprstufhcjwxq", ["а", "б", "в", "г", "д", "е", "з", "и", "й", "к", "л", "м", "н", "о", "п", "р", "с", "т", "у", "ф", "х", "к", "ж", "в", "кс", "к"])]
_LATIN = re.compile("|".join(a for a, _ in LATIN))
_FORMS = re.compile(r"(?<![\w-])(?:" + "|".join(re.escape(f) for f in FORMS) + r")(?![\w-])\.?")
_TO_CYRILLIC = dict(LATIN)
_ALIKE = str.maketrans("aekmhopctyxb", "аекмнорстухв")
_PLACE = r"(?U)(?<!\w)г\.\s*([^,;()«»\"“”„']+)"


def plain(raw: str) -> str:
    s = unicodedata.normalize("NFKC", raw)
    s = re.sub(r"(?<=[a-zа-яё])(?=[A-ZА-ЯЁ])", " ", s).casefold().replace("ё", "е")
    s = re.sub(r"[«»\"“”„'’`]", " ", s)
    s = re.sub(r"[\s_]+", " ", re.sub(r"[‐-―−]", "-", s))
    return s.strip()


def cyrillic(word: str) -> str:
    """A word in Russian letters; э and е, which the Latin spelling doesn't tell apart, become one."""
    if re.search(r"[a-z]", word):
        word = word.translate(_ALIKE) if re.search(r"[а-я]", word) else _LATIN.sub(lambda m: _TO_CYRILLIC[m[0]], word)
    return word.replace("э", "е")


def core(raw: str | None, places: set[str]) -> tuple[str, list[str]]:
    """full, short or '' (names nobody), and the words of the name; for short ones the kept word, then the cut ones."""
    s = plain(raw or "")
    if re.sub(r"[^\w]+", " ", s).strip() in NOBODY:
        return "", []
    s = re.sub(r"(?<!\w)г\.\s*[^,;()]+", " ", s)
    pieces = [p.strip(" .-") for p in re.split(r"[,;()]", s)]
    pieces = [p for p in pieces if p and p not in places]
    s = re.sub(r"\s+", " ", _FORMS.sub(" ", f" {' '.join(pieces)} ")).strip()
    words = [(cyrillic(w.strip("-")), dot) for w, dot in re.findall(r"([^\W\d_]+)(\.?)", s)]
    words = [(w, dot) for w, dot in words if w]
    if not words or " ".join(w for w, _ in words) in NOBODY:
        return "", []
    cut_off = [w for w, dot in words if len(w) <= 3 or (dot and len(w) <= 4 and len(words) > 1)]
    whole = [w for w, _ in words if w not in cut_off]
    if len(whole) >= 2:
        return "full", whole
    if not whole:
        return "full", ["".join(w for w, _ in words)]
    if not cut_off and len(whole[0]) >= 10:
        return "full", whole
    return "short", whole + cut_off


def slips(a: str, b: str) -> float:
    """The distance with dropped, added and swapped letters at SLIP each, replaced ones at 1."""
    before: list[float] = []
    row = [SLIP * j for j in range(len(b) + 1)]
    for i in range(1, len(a) + 1):
        last, row = row, [SLIP * i] + [0.0] * len(b)
        for j in range(1, len(b) + 1):
            row[j] = min(last[j] + SLIP, row[j - 1] + SLIP, last[j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                row[j] = min(row[j], before[j - 2] + SLIP)
        before = last
    return row[-1]


def letter_set(s: str) -> int:
    out = 0
    for c in s:
        out |= 1 << (ord(c) & 63)
    return out


@lru_cache(maxsize=None)
def _bands(more: int, k: int) -> tuple[int, int, list[int]]:
    """For names that are ``more`` letters longer and k edits: the lowest shift, the mask of all shifts, and for each number of edits those that the rest can even out."""
    slack = (k - abs(more)) // 2
    low, high = min(0, more) - slack, max(0, more) + slack
    width = range(high - low + 1)
    return low, (1 << len(width)) - 1, [sum(1 << x for x in width if abs(more - low - x) <= k - e) for e in range(k + 1)]


class NameTrie:
    """Names of one length. A node is its children by letter, the letters that any and that all of its names hold, and the name that ends there."""

    def __init__(self) -> None:
        self.root: list = [{}, 0, -1, None]
        self.size = 0

    def add(self, form: str) -> None:
        node, self.size, letters = self.root, len(form), letter_set(form)
        for c in form:
            node = node[0].setdefault(c, [{}, 0, -1, None])
            node[1] |= letters
            node[2] &= letters
        node[3] = form

    def within(self, name: str, k: int) -> Iterator[tuple[str, int]]:
        """Names within k edits, a swap of neighbours counting as one.

        The automaton is run as one bit mask for each number of edits: bit x says that as many letters of the name are read
        as of the trie, and x + low more. A mask holds only what the edits left can still bring to equal lengths. A branch
        ends when all masks are empty, or when its names lack more than k letters of the name or all hold more than k others.
        """
        n, more = len(name), len(name) - self.size
        if abs(more) > k or not self.root[0]:
            return
        low, window, bands = _bands(more, k)
        end, own, at = 1 << (more - low), letter_set(name), {}
        for i, c in enumerate(name):
            at[c] = at.get(c, 0) | 1 << i

        def hits(c: str, start: int) -> int:
            return (at.get(c, 0) >> start if start >= 0 else at.get(c, 0) << -start) & window

        first = [((2 << e) - 1 << -low) & window & bands[e] for e in range(k + 1)]
        stack = [(self.root, "", 0, [0] * (k + 1), first)]
        while stack:
            node, before, depth, above, rows = stack.pop()
            if node[3] is not None:
                if (d := next((e for e, r in enumerate(rows) if r & end), None)) is not None:
                    yield node[3], d
                continue
            start = depth + low
            swapped = hits(before, start) if before else 0
            for c, child in node[0].items():
                if (own & ~child[1]).bit_count() > k or (child[2] & ~own).bit_count() > k:
                    continue
                hit = hits(c, start)
                swap = swapped & hits(c, start - 1)
                alive = last = rows[0] & hit & bands[0]
                new = [last]
                for e in range(1, k + 1):
                    r = rows[e - 1]
                    last = (rows[e] & hit | r | r >> 1 | last << 1 | above[e - 1] & swap) & bands[e]
                    alive |= last
                    new.append(last)
                if alive:
                    stack.append((child, c, depth + 1, rows, new))


def _allowed(n: int) -> int:
    """Edits for a core of n letters; none below four, for initials that differ are different makers."""
    return K + (n >= LONG) if n >= 8 else int(n >= 4)


def _segments(n: int) -> list[tuple[int, int]]:
    """Where the segments of a core of n letters begin and end: one more than edits, each of two letters or more where
    there are several. The last takes what remains, for many names end alike."""
    m = _allowed(n) + 1
    return [(n // m * i, n // m * (i + 1) if i + 1 < m else n) for i in range(m)]


def _probes(form: str, longest: int) -> set[str]:
    """The shards in which the cores of at most ``longest`` letters are that form may be joined with."""
    n, out = len(form), set()
    for size in range(max(1, n - _allowed(n)), min(n + _allowed(n), longest) + 1):
        k, more, segments = min(_allowed(n), _allowed(size)), n - size, _segments(size)
        for i, (start, end) in enumerate(segments[: k + 1]):
            for shift in range(-i, i + 1):
                a, b = start + shift, end + shift
                spare = k - i - abs(more - shift)
                if spare < 0 or a < 0 or b > n:
                    continue
                at, part = f"{size} {i} ", form[a:b]
                out.add(at + part)
                left, right = i > 0 and a > 0, i + 1 < len(segments) and b < n
                if spare and left:
                    out.add(at + form[a - 1] + part[1:])
                if spare and right:
                    out.add(at + part[:-1] + form[b])
                if spare > 1 and left and right:
                    out.add(at + form[a - 1] + part[1:-1] + form[b])
    return out


def _orders(words: list[str]) -> list[str]:
    """A name of two to ORDERS words in all orders but its own."""
    own = "".join(words)
    return list(dict.fromkeys(form for p in permutations(words) if (form := "".join(p)) != own)) if 2 <= len(words) <= ORDERS else []


def _long_rows(words: list[str], name: str) -> Iterator[tuple[str, bool, str, str]]:
    """The rows of a name of more than ORDERS words: in the shards of any two of its first words by their checksums."""
    first = sorted(words, key=lambda w: (zlib.crc32(w.encode()), w))[: TOUCHED + 2]
    for shard in dict.fromkeys(f"w {len(words)} {a} {b}" for a, b in combinations(first, 2)):
        yield shard, True, " ".join(words), name
        yield shard, False, " ".join(words), name


def _words_apart(a: str, b: str) -> bool:
    """Whether two names of equally many words differ by the edits allowed in at most TOUCHED of them, in any order."""
    own, its = Counter(a.split(" ")), Counter(b.split(" "))
    left, right = list((own - its).elements()), list((its - own).elements())
    if len(left) > TOUCHED:
        return False
    form, k = "".join(left), min(_allowed(len(a)), _allowed(len(b)))
    for p in permutations(right):
        other = NameTrie()
        other.add("".join(p))
        if not left or any(d <= K or slips(form, met) <= SLIPS for met, d in other.within(form, k)):
            return True
    return False


def _shards(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """For each core its index rows and its query rows, by shard. In its own order of words it asks for cores that aren't longer; those ask for it."""
    for b in batches:
        rows = []
        for name, words in zip(b["full"], b["words"]):
            words = [] if words is None else list(words)
            rows += [(f"{len(name)} {i} {name[start:end]}", True, name, name) for i, (start, end) in enumerate(_segments(len(name)))]
            rows += [(shard, False, name, name) for shard in _probes(name, len(name))]
            for form in _orders(words):
                rows += [(shard, False, form, name) for shard in _probes(form, len(form) + K + 1)]
            if len(words) > ORDERS:
                rows += _long_rows(words, name)
        yield pd.DataFrame(rows, columns=["shard", "is_index", "form", "name"])


def _word_shards(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The rows of words that are held by cores, and of kept ones that ask for them."""
    for b in batches:
        rows = []
        for word, held in zip(b["word"], b["held"]):
            if held:
                rows += [(f"{len(word)} {i} {word[start:end]}", True, word, word) for i, (start, end) in enumerate(_segments(len(word)))]
            else:
                rows += [(shard, False, word, word) for shard in _probes(word, len(word) + K + 1)]
        yield pd.DataFrame(rows, columns=["shard", "is_index", "form", "name"])


def _walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Shard by shard, index rows first: builds the trie, then walks it with each query."""
    at, trie, names = None, NameTrie(), {}
    for b in batches:
        out = set()
        for shard, block, part, is_query, form, name in zip(b["shard"], b["block"], b["part"], b["is_query"], b["form"], b["name"]):
            if (shard, block, part) != at:
                at, trie, names = (shard, block, part), NameTrie(), {}
            if not is_query:
                if form not in names and not shard.startswith("w "):
                    trie.add(form)
                names.setdefault(form, []).append(name)
            elif shard.startswith("w "):
                out.update((min(name, other), max(name, other)) for met, others in names.items() if met != form and _words_apart(form, met) for other in others if other != name)
            else:
                for met, d in trie.within(form, min(_allowed(len(form)), _allowed(trie.size))):
                    if d <= K or slips(form, met) <= SLIPS:
                        out.update((min(name, other), max(name, other)) for other in names[met] if other != name)
        yield pd.DataFrame(sorted(out), columns=["a", "b"])


def trie_join(cores: DataFrame, block: int = BLOCK, shards: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]] = _shards) -> DataFrame:
    """a, b: the distinct pairs of ``full`` strings within the edits allowed, in any order of ``words``. Wants distinct full with words, or what ``shards`` reads."""
    rows = cut(cores.repartition(cores.sparkSession.sparkContext.defaultParallelism).mapInPandas(shards, "shard string, is_index boolean, form string, name string"))
    parts_of = lambda c: F.greatest(F.lit(1), F.ceil(F.col(c) / block)).cast("int")
    held = rows.where("is_index").groupBy("shard").agg(F.count("*").alias("cores")).select("shard", parts_of("cores").alias("blocks"))
    rows = cut(rows.join(checked_broadcast(cut(held), 4 * LOOKUP_ROWS), "shard"))  # most shards that are asked for hold nothing
    heavy = rows.where(~F.col("is_index")).groupBy("shard").agg(F.count("*").alias("queries")).where(F.col("queries") > block).select("shard", parts_of("queries").alias("parts"))
    rows = rows.join(checked_broadcast(heavy), "shard", "left").fillna(1, ["parts"])
    own = lambda n: F.array(F.pmod(F.xxhash64("form", "name"), F.col(n)).cast("int"))
    every = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    rows = rows.withColumn("block", F.explode(F.when(F.col("is_index"), own("blocks")).otherwise(every("blocks"))))
    rows = rows.withColumn("part", F.explode(F.when(F.col("is_index"), every("parts")).otherwise(own("parts"))))
    place = ["shard", "block", "part"]
    sorted_rows = rows.select(*place, (~F.col("is_index")).alias("is_query"), "form", "name").repartition(*place).sortWithinPartitions(*place, "is_query")
    return sorted_rows.mapInPandas(_walk, "a string, b string").distinct()


def components(nodes: DataFrame, edges: DataFrame, rounds: int = 50) -> DataFrame:
    """node, label: the smallest node of each connected component. Labels travel along edges and jump to the label's label."""
    both = cut(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    linked = both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("label"))
    labels = cut(linked)
    for _ in range(rounds):
        heard = both.join(labels, both["b"] == labels["node"]).groupBy(both["a"].alias("node")).agg(F.min("label").alias("heard"))
        hops = labels.select(F.col("node").alias("via"), F.col("label").alias("far"))
        new = labels.join(heard, "node", "left").join(hops, F.col("label") == F.col("via"), "left").select("node", F.col("label").alias("old"), F.least("label", "heard", "far").alias("label"))
        new = cut(new)
        labels = new.select("node", "label")
        if new.where(F.col("old") != F.col("label")).isEmpty():
            break
    else:
        raise RuntimeError(f"components not settled after {rounds} rounds")
    return nodes.select("node").join(labels, "node", "left").select("node", F.coalesce("label", "node").alias("label"))


def _attach_short(short: DataFrame, of_full: DataFrame) -> DataFrame:
    """value, label of shortened names (value, words: the kept word, then cut ones), given value, n, words, label of full ones."""
    short = short.select("value", F.col("words")[0].alias("kept"), F.expr("slice(words, 2, size(words))").alias("cuts"))
    held = of_full.select(F.explode("words").alias("word"), "words", "label", "n")
    held = cut(held.groupBy("word", "label").agg(F.sum("n").alias("n"), F.array_distinct(F.flatten(F.collect_set(F.array_except("words", F.array("word"))))).alias("others")))
    asked = cut(short.select("kept", "cuts").distinct())
    words = held.select("word", F.lit(True).alias("held")).unionByName(asked.select(F.col("kept").alias("word"), F.lit(False).alias("held"))).distinct()
    near = cut(trie_join(words, shards=_word_shards))
    same = asked.select("kept", F.col("kept").alias("word"), F.lit(0).alias("far")).distinct()
    met = same.unionByName(near.select(F.col("a").alias("kept"), F.col("b").alias("word"), F.lit(1).alias("far"))).unionByName(near.select(F.col("b").alias("kept"), F.col("a").alias("word"), F.lit(1).alias("far")))
    fits = F.size(F.filter("cuts", lambda c: F.exists("others", lambda o: o.startswith(c))))
    found = asked.join(met, "kept").join(held, "word").withColumn("fits", fits).where((F.col("far") == 0) | (F.col("fits") > 0) | (F.size("cuts") == 0))
    best = found.groupBy("kept", "cuts").agg(F.min(F.struct((-F.col("fits")).alias("f"), "far", (-F.col("n")).alias("m"), "label")).alias("b")).select("kept", "cuts", "b.label")
    labelled = cut(asked.join(best, ["kept", "cuts"], "left"))
    alone = labelled.where(F.col("label").isNull()).select(F.col("kept").alias("full"), F.lit(None).cast("array<string>").alias("words")).distinct()
    own = components(alone.select(F.col("full").alias("node")), trie_join(alone)).select(F.col("node").alias("kept"), F.col("label").alias("own"))
    labelled = labelled.join(own, "kept", "left").select("kept", "cuts", F.coalesce("label", "own").alias("label"))
    return short.join(labelled, ["kept", "cuts"]).select("value", "label")


def spelling_classes(rows: DataFrame, column: str = "manufacturer") -> DataFrame:
    """value, label: each distinct spelling that names someone, and its class.

    Nulls, empty values and entries that name nobody are left out. Ties never decide: a class is labelled by
    its smallest core. A shortened name goes to a class that holds its kept word or one within the edits allowed: to one
    whose other words begin with its cut ones if there is such a class, then to one with the same word, then to the one with
    most rows, and at a tie to the smallest label. A word that isn't the same counts only if a cut one fits or there
    is none. Without such a class it forms one with those whose kept words are joined.
    """
    total = rows.count()
    named = rows.select(F.lower(F.regexp_extract(F.col(column), _PLACE, 1)).alias("place")).where(F.col("place") != "")
    places = {re.sub(r"\s+", " ", r["place"].replace("ё", "е")).strip(" .-") for r in named.groupBy("place").agg(F.count("*").alias("n")).where(F.col("n") * PLACE_SHARE >= total).select("place").collect()}  # at most PLACE_SHARE
    values = rows.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for value, n in zip(b["value"], b["n"]):
                kind, words = core(value, places)
                if kind == "full":
                    out.append((value, n, "".join(words), words))
                elif kind == "short":
                    out.append((value, n, None, words))
            yield pd.DataFrame(out, columns=["value", "n", "full", "words"])

    parsed = cut(values.mapInPandas(parse, "value string, n long, full string, words array<string>"))
    full = parsed.where(F.col("full").isNotNull())
    cores = full.groupBy("full").agg(F.max("words").alias("words"))
    edges = trie_join(cores)
    label = cut(components(full.select(F.col("full").alias("node")).distinct(), edges))
    of_full = full.join(label, full["full"] == label["node"]).select("value", "n", "words", "label")
    of_short = _attach_short(parsed.where(F.col("full").isNull()).select("value", "words"), of_full)
    return of_full.select("value", "label").unionByName(of_short)


def linked_entries(rows: DataFrame, identifier: str = "edit_id", column: str = "manufacturer") -> DataFrame:
    """id, label, links: each entry that names someone, its class and how many other entries the class has."""
    classes = cut(spelling_classes(rows, column))
    entries = rows.where(F.col(identifier).isNotNull()).select(F.col(identifier).alias("id"), F.col(column).alias("value")).distinct()
    labelled = cut(entries.join(checked_broadcast(classes), "value").select("id", "label").distinct())
    sizes = labelled.groupBy("label").agg((F.count("*") - 1).alias("links"))
    return labelled.join(checked_broadcast(sizes), "label").select("id", "label", "links")


def entry_pairs(rows: DataFrame, identifier: str = "edit_id", column: str = "manufacturer", block: int = PAIR_BLOCK) -> DataFrame:
    """a, b: every pair of entries of one class, a < b.

    Entries of a class are dealt to blocks by hash, and each pair of blocks is a group of the join, so no task has to
    hold more than two blocks of a class however large it is.
    """
    links = cut(linked_entries(rows, identifier, column).where(F.col("links") > 0))
    blocks = F.ceil((F.col("links") + 1) / block).cast("int")
    dealt = links.select("id", "label", blocks.alias("n"), F.pmod(F.xxhash64("id"), blocks).cast("int").alias("own"))
    left = dealt.select(F.col("id").alias("x"), "label", F.col("own").alias("i"), F.explode(F.sequence(F.col("own"), F.col("n") - 1)).alias("j"))
    right = dealt.select(F.col("id").alias("y"), "label", F.explode(F.sequence(F.lit(0), F.col("own"))).alias("i"), F.col("own").alias("j"))
    met = left.join(right, ["label", "i", "j"]).where((F.col("i") < F.col("j")) | (F.col("x") < F.col("y")))
    return met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
