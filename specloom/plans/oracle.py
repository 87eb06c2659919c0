"""The SQL that says the same as each query, for DuckDB."""

from __future__ import annotations

from specloom.functions.lexicon import entries
from specloom.plans.queries import FILTERS

# What the rules hold constant is written out here again, so that a slip there shows; only the built-in lexicon is taken over.
COLUMNS = ("position_no", "name", "type_mark", "code", "manufacturer", "unit", "quantity", "mass", "note")
EXPORTED = ("name", "type_mark", "manufacturer", "unit", "quantity", "note")
UNITS = ("шт.", "м", "м²", "м³", "кг", "компл.", "п.м.", "л", "к-т")
UNIT_KEYS = dict(zip("шт шг шм wm штт м мп м2 м² м3 м³ компл комплект комп компд комплд компп кг пм л кт".split(), "шт. шт. шт. шт. шт. м м м² м² м³ м³ компл. компл. компл. компл. компл. компл. кг п.м. л к-т".split()))
THRESHOLDS = {"position_no": 55, "name": 62, "type_mark": 58, "code": 55, "manufacturer": 58, "unit": 78, "quantity": 82, "mass": 80, "note": 48}
SECTION_STEMS = ("вентиляц", "кондиционир", "отоплен", "теплоснабжен", "холодоснабжен")
WIDTH_RATIOS = (0.051, 0.329, 0.152, 0.089, 0.111, 0.051, 0.051, 0.061, 0.105)
TITLES = ("Позиция", "Наименование и техническая характеристика", "Тип / марка / обозначение", "Код оборудования", "Производитель", "Единица измерения", "Количество", "Масса единицы, кг", "Примечание", "Раздел", "Система", "Тип строки", "Страница PDF", "Уверенность, %", "Статус")
CATALOG = tuple(zip((*COLUMNS, "section_name", "system_name", "row_type", "page", "confidence", "status"), TITLES))
TITLE = dict(CATALOG)
LATIN, CYRILLIC = "ABCEHKMOPTXYabcdekmoptxy", "АВСЕНКМОРТХУавсдекмортху"

ORDINARY = r"""[^\p{L}\p{N}_\s.,;:()\-+/×Ø№²³"'']"""
NUMBER = r"^-?[0-9]+(?:[.,][0-9]+)?$"
SYSTEM = r"(?i)^(?:[ПВКЕBPK]{1,4}[0-9]+(?:[.,][0-9]+)?|К[0-9]+(?:\.[0-9]+)*)$"
POSITION = "[0-9IVXLСА-ЯA-Z]"


def _t(c: str) -> str:
    return f"coalesce({c}, '')"


def _tr(c: str) -> str:
    return rf"regexp_replace(coalesce({c}, ''), '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')"


def _list(values: tuple[str, ...] | list[str]) -> str:
    return ", ".join(f"'{v}'" for v in values)


def _chain(c: str, rules: list[tuple[str, str]]) -> str:
    for pattern, to in rules:
        c = f"regexp_replace({c}, '{pattern}', '{to}', 'g')"
    return c


_UNITS = _list(UNITS)
_CONF = "greatest(CASE WHEN confidence IS NULL OR isnan(confidence) THEN 0.0 ELSE confidence END, 0.0)"

def _strange(v: str) -> str:
    return f"len(regexp_extract_all({v}, '{ORDINARY}'))"


def _plausible(key: str, v: str) -> str:
    """Plausibility of a normalised text."""
    return f"""CASE WHEN {v} = '' THEN -12.0::DOUBLE
  WHEN {key} IN ('quantity', 'mass') THEN CASE WHEN regexp_matches({v}, '{NUMBER}') THEN 22.0 ELSE -35.0 END
  WHEN {key} = 'unit' THEN CASE WHEN {v} IN ({_UNITS}) THEN 22.0 ELSE -18.0 END
  WHEN {key} = 'position_no' THEN CASE WHEN regexp_matches({v}, '{POSITION}') THEN 8.0 ELSE -10.0 END
  WHEN {key} IN ('name', 'note') THEN least(16.0::DOUBLE, len(regexp_extract_all({v}, '[А-Яа-яЁё]')) * 0.35::DOUBLE) - len(regexp_extract_all({v}, '[A-Za-z]')) * 0.08::DOUBLE - {_strange(v)} * 3.0::DOUBLE
  WHEN {key} IN ('type_mark', 'code', 'manufacturer') THEN 8.0::DOUBLE - {_strange(v)} * 3.0::DOUBLE ELSE 0.0 END"""


_BONUS = "CASE WHEN source LIKE 'cell-%' THEN 10.0 WHEN source LIKE 'accurate-column%' THEN 2.0 ELSE 0.0 END"


def _noise(key: str, t: str, c: str) -> str:
    return f"""CASE WHEN {key} NOT IN ('quantity', 'mass') AND lower({_tr(t)}) IN ('о', 'o', '0', '_', '|', '.') AND {c} < 72 THEN ''
  WHEN {key} = 'unit' AND lower({t}) NOT IN ({_UNITS}, 'комплект') AND length({t}) <= 5 THEN ''
  WHEN {key} = 'position_no' AND NOT regexp_matches({t}, '{POSITION}') THEN '' ELSE {t} END"""


_LIMITS = "CASE column_key " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in THRESHOLDS.items()) + " ELSE 55 END"
_DOUBTFUL = f"""CASE WHEN t = '' THEN column_key IN ('unit', 'quantity', 'mass') WHEN c < {_LIMITS} THEN true
  WHEN column_key IN ('quantity', 'mass') THEN NOT regexp_matches(t, '{NUMBER}') WHEN column_key = 'unit' THEN t NOT IN ({_UNITS})
  WHEN column_key IN ('name', 'note') THEN {_strange("t")} >= 2 ELSE false END"""

_N = r"[^\p{L}\p{N}_]"
_G = "[гgrГGR][оo0ОO][сcsСCS][тtТT]"
_X = r"([0-9])[\s\p{Z}]*[xXхХ][\s\p{Z}]*([0-9])"


def _clean(c: str, compat: bool = False) -> str:
    s = f"replace(replace(translate(replace({_t(c)}, chr(173), ''), chr(160) || '—–', ' --'), 'ﬁ', 'fi'), 'ﬂ', 'fl')"
    rules = [(r"[ \t]+", " "), (r"\.{2,}", "."), (r"[”\"»]+:", ":"), (r"[\s\p{Z}]*\n[\s\p{Z}]*", r"\n"), (r"\n{3,}", r"\n\n"), (_X, r"\1×\2"), (_X, r"\1×\2"), (rf"(^|{_N})[$§]([\s\p{{Z}}]*[0-9])", r"\1Ø\2")]
    for digit, up in (("2", "²"), ("3", "³")):
        rules += [(rf"(^|{_N})[мМ][\s\p{{Z}}]*{digit}({_N}|$)", rf"\1м{up}\2")] * 2
    rules += _short("шт", "шт.", compat) + _short("компл", "компл.", compat)
    rules += [(rf"(^|{_N}){_G}({_N}|$)", r"\1ГОСТ\2")] * 2
    s = _chain(s, [(p, t.replace(r"\n", "\n")) for p, t in rules])
    return f"regexp_replace(regexp_replace({s}, '^[ \\n|_]+', ''), '[ \\n|_]+$', '')"


def _short(word: str, to: str, compat: bool) -> list[tuple[str, str]]:
    """word at the edges of a word, or at its beginning, with the blanks and then dots that follow."""
    cased = "".join(f"[{c}{c.upper()}]" for c in word)
    if compat:
        return [(rf"(^|{_N}){cased}[\s\p{{Z}}]*\.*", rf"\1{to}")] * 2
    return [(rf"(^|{_N}){cased}({_N}|$)", r"\1" + chr(0x2402) + r"\2")] * 2 + [(rf"{chr(0x2402)}[\s\p{{Z}}]*\.*", to)]


def _unit(c: str) -> str:
    return f"CASE regexp_replace(lower({c}), '[^а-яёa-z0-9²³]+', '', 'g') " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in UNIT_KEYS.items()) + f" ELSE {c} END"


def _number(c: str) -> str:
    s = f"regexp_replace(replace(replace({c}, ' ', ''), ',', '.'), '[^0-9.\\-]', '', 'g')"
    return f"CASE WHEN instr({s}, '.') > 0 THEN substr({s}, 1, instr({s}, '.')) || replace(substr({s}, instr({s}, '.') + 1), '.', '') ELSE {s} END"


def _cast(c: str) -> tuple[str, str]:
    s = f"({_number(_clean(c))})"
    good = rf"regexp_matches({s}, '^-?(?:[0-9]+\.?[0-9]*|\.[0-9]+)$')"
    return f"CASE WHEN {good} THEN try_cast({s} AS DOUBLE) END", f"CASE WHEN {s} NOT IN ('', '-', '.') AND NOT {good} THEN {_t(c)} END"


_B = r"[\s\p{Z}]"
_LEADING = [(rf"^[-–—]{_B}*[_~]+{_B}*", "- "), (rf"(^|{_N})6{_B}+([кК][оО][мМ][пП][лЛ]\.)", r"\1в \2")]
_MAKER = [("(?i)нахимобскии", "Нахимовский"), (rf"^0{{2,3}}({_B}|$)", r"ООО\1")]
_BEFORE_DIGITS = [(rf"(^|{_N}){_G}({_B}*[0-9])", r"\1ГОСТ\2")] * 2
_MODELS = [(rf"(?i)(^|{_N})APH({_B}*[0-9])", r"\1АРН\2"), (rf"(?i)(^|{_N})KBK({_B}*[0-9])", r"\1КВК\2"), (rf"(?i)(^|{_N})6APC([0-9])", r"\g6АРС\2".replace(r"\g", r"\1")), (rf"(?i)SOLARIS Lite [XХ]P({_B})", r"SOLARIS Lite XP\1"), (r"(?i)(SOLARIS Lite XP [0-9]+-[0-9]+/)\\\.([0-9]+)", r"\1V.\2")]


def _closing(c: str) -> str:
    return rf"regexp_replace({c}, '(?i)(^|{_N})возд\.{_B}*Клапана({_N}|$)', '\1возд.клапана\2', 'g')"


def _ruled(key: str, c: str) -> str:
    """The rules of a column for a clean text, without the closing one."""
    if key in ("name", "note"):
        return _chain(c, _LEADING)
    if key == "manufacturer":
        return _chain(c, _MAKER + _BEFORE_DIGITS)
    if key in ("type_mark", "code"):
        return _chain(c, _BEFORE_DIGITS + (_MODELS if key == "type_mark" else []))
    if key in ("quantity", "mass"):
        return _number(c)
    return _unit(c) if key == "unit" else c


def _by_key(c: str, keys: tuple[str, ...] = COLUMNS) -> str:
    return "CASE column_key " + " ".join(f"WHEN '{k}' THEN {_ruled(k, c)}" for k in keys) + f" ELSE {c} END"


_READINGS = f"SELECT *, {_closing(_by_key('cl'))} AS j FROM (SELECT *, coalesce(text, '') AS t, {_CONF} AS c, {_clean('text')} AS cl FROM cell_results)"


def _best(by: str, where: str = "true") -> str:
    """The chosen reading by the columns given."""
    return f"""SELECT {by}, coalesce(max(t) FILTER (r = 1 AND t <> ''), '') AS text, coalesce(max(c) FILTER (r = 1 AND t <> ''), 0.0) AS confidence, coalesce(max(s) FILTER (r = 1 AND t <> ''), 'none') AS source
FROM (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY (t <> '') DESC, score DESC, ordinal, t DESC, c DESC, s DESC) AS r FROM (
  SELECT *, coalesce(source, 'none') AS s, c + ({_plausible('column_key', 'j')}) + {_BONUS} AS score FROM ({_READINGS}) WHERE {where}))
GROUP BY {by}"""


def _round1(x: str) -> str:
    """To one decimal by the binary value; the part of a product that is lost in rounding says on which side of a middle it lies."""
    high = "(v * 134217729.0::DOUBLE - (v * 134217729.0::DOUBLE - v))"
    lost = f"(({high} * 20.0::DOUBLE - v * 20.0::DOUBLE) + (v - {high}) * 20.0::DOUBLE)"
    below = "floor(v * 20.0::DOUBLE / 2.0::DOUBLE)"
    return f"list_transform([({x})::DOUBLE], lambda v: CASE WHEN abs((v * 20.0::DOUBLE) % 2.0::DOUBLE) = 1 THEN {below} + CASE WHEN {lost} > 0 THEN 1 WHEN {lost} < 0 THEN 0 ELSE abs({below} % 2) END ELSE floor((v * 20.0::DOUBLE + 1.0::DOUBLE) / 2.0::DOUBLE) END / 10.0::DOUBLE)[1]"


_ANY = lambda *cs: "(" + " || ".join(_tr(c) for c in cs) + ") <> ''"
_STEMS = "|".join(SECTION_STEMS)
_CLASS = f"""CASE WHEN regexp_matches(lower({_tr("name")}), '{_STEMS}') AND NOT {_ANY("quantity")} THEN 'section'
  WHEN (regexp_matches(replace({_tr("name")}, ' ', ''), '{SYSTEM}') OR regexp_matches(replace({_tr("position_no")}, ' ', ''), '{SYSTEM}')) AND NOT {_ANY("quantity", "unit")} THEN 'system'
  WHEN regexp_matches({_tr("name")}, '^[\\-–—•]') THEN 'component'
  WHEN {_ANY("quantity", "unit", "type_mark", "manufacturer")} THEN 'item' WHEN {_ANY("name", "position_no")} THEN 'note' ELSE 'skip' END"""
_LABEL = f"CASE WHEN {_tr('name')} <> '' THEN {_tr('name')} ELSE {_tr('position_no')} END"
_VALUES = "list_filter([" + ", ".join(f"CASE WHEN {_tr(c)} <> '' THEN confidences['{c}'] END" for c in COLUMNS) + "], lambda v: v IS NOT NULL)"
_SURE = lambda n: f"CASE WHEN confidence >= {n} THEN 'recognized' ELSE 'review' END"
_STATUS = f"""CASE WHEN row_type = 'system' AND NOT regexp_matches(replace({_LABEL}, ' ', ''), '{SYSTEM}') THEN 'review'
  WHEN row_type IN ('section', 'system', 'note', 'component') THEN {_SURE(55)}
  WHEN {_t("name")} <> '' AND {_t("quantity")} || {_t("unit")} <> '' THEN {_SURE(68)} WHEN {_t("name")} <> '' THEN 'review' ELSE 'unrecognized' END"""
_RAW = "SELECT *, try_cast(regexp_extract(source_row, '^[0-9]+') AS INTEGER) AS line FROM raw_rows"
_OWN = "position_no || type_mark || code || manufacturer || unit || quantity || mass <> ''"
_PLACED = f"""cols AS (SELECT document_id, page, i AS col_no, x_lines[i + 1] AS x0, x_lines[i + 2] AS x1 FROM (SELECT *, unnest(range(0, len(x_lines) - 1)) AS i FROM page_grid) WHERE i < 9),
rows_ AS (SELECT document_id, page, i AS row_no, y_lines[i + 1] AS y0, y_lines[i + 2] AS y1 FROM (SELECT *, unnest(range(0, len(y_lines) - 1)) AS i FROM page_grid) WHERE i >= 2),
words AS (SELECT DISTINCT t.document_id, t.page, r.row_no, c.col_no, pass_name, pass_ordinal, block_num, par_num, line_num, word_num, {_tr('text')} AS t, greatest(CASE WHEN conf IS NULL OR isnan(conf) THEN 0.0 ELSE conf END, 0.0) AS c
  FROM tokens t JOIN cols c ON t.document_id = c.document_id AND t.page = c.page AND left_px + width_px / 2 > x0 AND left_px + width_px / 2 <= x1
  JOIN rows_ r ON t.document_id = r.document_id AND t.page = r.page AND top_px + height_px / 2 > y0 AND top_px + height_px / 2 <= y1 WHERE {_tr('text')} <> ''),
cell AS (SELECT document_id, page, row_no, col_no, pass_name, pass_ordinal, string_agg(t, ' ' ORDER BY block_num, par_num, line_num, word_num, t, c) AS text, list_reduce(list(c ORDER BY block_num, par_num, line_num, word_num, t, c), lambda a, b: a + b, 0.0::DOUBLE) / count(*) AS confidence FROM words GROUP BY ALL)"""


def _fold(c: str) -> str:
    mean = _round1("(a + b) / CASE WHEN a <> 0 AND b <> 0 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END")
    return f"list_reduce(list_filter(list_transform(p, lambda x, i: CASE WHEN i = 1 OR x['{c}'] <> '' THEN x['c_{c}'] END), lambda v: v IS NOT NULL), lambda a, b: {mean})"


def _joined(c: str) -> str:
    return f"coalesce(array_to_string(list_filter(list_transform(p, lambda x: x['{c}']), lambda t: t <> ''), ' '), '') AS {c}"


def _merge_ctes(source: str, page: str, order: str) -> str:
    """CTEs up to mf: one row per island of rows that continue each other, p holding its rows in order."""
    return f"""mr AS (SELECT raw_id, {page}, line, source_row, bbox, confidences, {", ".join(f"{_tr(c)} AS {c}" for c in COLUMNS)} FROM ({source})),
ma AS (SELECT *, row_number() OVER w AS n, {_OWN} AS own FROM mr WINDOW w AS (PARTITION BY {page} ORDER BY {order})),
mb AS (SELECT *, CASE WHEN name <> '' THEN regexp_matches(name, '[,;-]$') WHEN own OR n = 1 THEN false END AS tail FROM ma),
mc AS (SELECT *, coalesce(last_value(tail IGNORE NULLS) OVER (PARTITION BY {page} ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS punct FROM mb),
md AS (SELECT *, n > 1 AND NOT own AND NOT regexp_matches(name, '^[\\-–—•]') AND ((name = '' AND type_mark || code || note <> '') OR punct) AS joins FROM mc),
me AS (SELECT *, sum(CASE WHEN joins THEN 0 ELSE 1 END) OVER (PARTITION BY {page} ORDER BY n) AS island FROM md),
mf AS (SELECT {page}, island, arg_min(raw_id, n) AS raw_id, arg_min(line, n) AS line, string_agg(source_row, '+' ORDER BY n) AS source_row, count(*) AS k, arg_min(bbox.y, n) AS y, arg_min(bbox.height, n) AS h, max(bbox.y + bbox.height) AS bottom,
  list({{{", ".join(f"'{c}': {c}, 'c_{c}': coalesce(confidences['{c}'], 0.0::DOUBLE)" for c in COLUMNS)}}} ORDER BY n) AS p FROM me GROUP BY {page}, island)"""


_MERGE = f"""WITH {_merge_ctes(_RAW, "document_id, page", "line, raw_id")}
SELECT raw_id, document_id, page, source_row, {", ".join(_joined(c) for c in COLUMNS)}, {_fold("name")} AS name_confidence, {_fold("note")} AS note_confidence, round(CASE WHEN k > 1 THEN bottom - y ELSE h END, 6) AS height FROM mf"""

_OTHERS = [c for c in COLUMNS if c not in ("name", "position_no")]
_AMOUNT = f"({_t('unit')} || {_t('quantity')} || {_t('manufacturer')}) <> ''"
def _context(source: str, order: str, keep: str) -> str:
    """SELECT of keep, row_type, section_name and system_name over a table expression, in the order given within a document."""
    part = f"(PARTITION BY document_id ORDER BY {order} ROWS BETWEEN UNBOUNDED PRECEDING AND"
    above, here = f"{part} 1 PRECEDING)", f"{part} CURRENT ROW)"
    bare = f"regexp_replace({_tr('name')}, '[:*]+$', '')"
    return f"""WITH a AS (SELECT *, {_CLASS} AS t0, {_LABEL} AS label FROM ({source})),
b AS (SELECT *, coalesce(bool_or(t0 = 'section') OVER {above}, false) AS seen FROM a),
c AS (SELECT *, CASE WHEN t0 = 'note' AND seen AND NOT {_ANY(*_OTHERS)} AND (({_tr("name")} <> '')::INT + ({_tr("position_no")} <> '')::INT) = 1 AND length(label) <= 5 THEN 'system' ELSE t0 END AS t1 FROM b),
d AS (SELECT *, coalesce(last_value(CASE WHEN {_AMOUNT} THEN t1 = 'item' AND contains(lower({_tr("name")}), 'компл') AND {_t("quantity")} <> '' END IGNORE NULLS) OVER {above}, false) AS active FROM c),
e AS (SELECT *, CASE WHEN active AND NOT {_AMOUNT} AND t1 NOT IN ('section', 'system') AND {_t("name")} || {_t("type_mark")} <> '' THEN 'component' ELSE t1 END AS row_type FROM d)
SELECT {keep}, row_type, coalesce(last_value(CASE WHEN row_type = 'section' THEN CASE WHEN {bare} <> '' THEN {bare} ELSE {_tr("position_no")} END END IGNORE NULLS) OVER {here}, '') AS section_name,
  coalesce(last_value(CASE WHEN row_type = 'system' THEN label END IGNORE NULLS) OVER {here}, '') AS system_name FROM e"""


_CONTEXT = _context(_RAW, "page, line, raw_id", "raw_id")

# Spelling. The measure is computed pair by pair, so pairs that can't reach what counts by their lengths are left out first.
_DELIMITERS = r"\s\p{Z},;:()\[\]{}/."
_LEX = "lex AS (SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{a}', {'NULL' if v is None else repr(v)}, {i})" for k, a, v, i in entries()) + f") b(kind, lex_key, lex_value, ordinal) UNION ALL SELECT kind, lex_key, lex_value, ordinal + {len(entries())} FROM lexicon)"


def _ratio(a: str, b: str) -> str:
    row = f"list_reduce(range(1, length({b}) + 1), lambda got, j: list_append(got, CASE WHEN ({b})[j] = x THEN above[j] + 1 ELSE greatest(above[j + 1], got[j]) END), [0::BIGINT])"
    lcs = f"list_reduce(string_split({a}, ''), lambda above, x: {row}, list_transform(range(0, length({b}) + 1), lambda i: 0::BIGINT))[-1]"
    return f"CASE WHEN {a} = '' AND {b} = '' THEN 100.0::DOUBLE WHEN {a} = '' OR {b} = '' THEN 0.0::DOUBLE ELSE {lcs} * 200.0::DOUBLE / (length({a}) + length({b})) END"


def _cased(s: str, r: str) -> str:
    return f"CASE WHEN upper({s}) = {s} AND lower({s}) <> {s} THEN upper({r}) WHEN upper(({s})[1]) = ({s})[1] AND lower(({s})[1]) <> ({s})[1] THEN upper(({r})[1]) || ({r})[2:] ELSE {r} END"


_FORM = f"CASE WHEN NOT (length(word) < 4 OR regexp_matches(word, '\\p{{Nd}}') OR (upper(word) = word AND lower(word) <> word AND length(word) <= 8) OR NOT regexp_matches(translate(word, '{LATIN}', '{CYRILLIC}'), '^[А-Яа-яЁё-]+$')) THEN lower(translate(word, '{LATIN}', '{CYRILLIC}')) END"


def _pieces(c: str) -> str:
    return f"regexp_extract_all({c}, '[{_DELIMITERS}]+|[^{_DELIMITERS}]+')"


def _near_ctes(words: str) -> str:
    """CTEs up to near: word, corrected, score, from a SELECT of distinct words."""
    return f"""{_LEX},
forms AS (SELECT * FROM (SELECT word, {_FORM} AS form FROM ({words})) WHERE form IS NOT NULL),
entry AS (SELECT lex_key AS entry, min(ordinal) AS place FROM lex WHERE kind = 'word' AND length(lex_key) > 1 GROUP BY ALL),
pairs AS (SELECT *, {_ratio("form", "entry")} AS score FROM (SELECT DISTINCT form FROM forms) JOIN entry ON least(length(form), length(entry)) * 200 >= 79 * (length(form) + length(entry))),
ranked AS (SELECT *, row_number() OVER (PARTITION BY form ORDER BY score DESC, place, entry) AS r FROM pairs),
top AS (SELECT form, max(entry) FILTER (r = 1) AS entry, max(score) FILTER (r = 1) AS best, coalesce(max(score) FILTER (r = 2), 0) AS second FROM ranked GROUP BY form),
near AS (SELECT word, entry AS corrected, round(best, 6) AS score FROM forms JOIN top USING (form) WHERE best >= CASE WHEN length(form) <= 4 THEN 93 WHEN length(form) <= 7 THEN 88 ELSE 84 END AND (best - second >= 5 OR best >= 96))"""


def _correct_ctes(texts: str) -> str:
    """CTEs up to fixed: text, new of the texts that change, from a SELECT of texts."""
    words = "SELECT DISTINCT piece AS word FROM pieces WHERE regexp_matches(piece, '[A-Za-zА-Яа-яЁё]')"
    return f"""texts AS (SELECT DISTINCT text FROM ({texts}) WHERE text <> ''),
pieces AS (SELECT text, unnest(ps) AS piece, generate_subscripts(ps, 1) AS i FROM (SELECT text, {_pieces("text")} AS ps FROM texts)),
{_near_ctes(words)},
known AS (SELECT lower(lex_key) AS low, arg_min(lex_value, ordinal) AS value FROM lex WHERE kind = 'exact' GROUP BY ALL),
spelt AS (SELECT text, string_agg(coalesce({_cased("piece", "coalesce(value, corrected)")}, piece), '' ORDER BY i) AS spelt FROM pieces LEFT JOIN near ON piece = word LEFT JOIN known ON lower(piece) = low GROUP BY text),
lows AS (SELECT *, lower({_tr("spelt")}) AS low FROM spelt),
phrases AS (SELECT lower(lex_key) AS phrase, ordinal FROM lex WHERE kind = 'phrase'),
whole AS (SELECT text, arg_min(phrase, (ordinal, phrase)) AS phrase FROM lows JOIN phrases ON abs(length(low) - length(phrase)) <= 5 WHERE regexp_matches(low, '[^\\s\\p{{Z}}][\\s\\p{{Z}}]+[^\\s\\p{{Z}}]') AND NOT contains(low, phrase) AND {_ratio("low", "phrase")} >= 91 GROUP BY text),
fixed AS (SELECT text, regexp_replace(coalesce({_cased("spelt", "phrase")}, spelt), '\\.{{2,}}', '.', 'g') AS new FROM lows LEFT JOIN whole USING (text))"""


_SPELT = ("name", "note", "manufacturer")
_RECOGNIZE = f"""WITH {_PLACED},
k AS (SELECT document_id, page, row_no, [{_list(COLUMNS)}][col_no + 1] AS column_key, pass_name AS source, pass_ordinal, confidence AS c, {_clean("text")} AS cl FROM cell),
f AS (SELECT *, {_by_key("cl", ("name", "note"))} AS ft FROM k),
{_correct_ctes(f"SELECT ft AS text FROM f WHERE column_key IN ({_list(_SPELT)})")},
g AS (SELECT f.*, CASE WHEN column_key IN ({_list(_SPELT)}) THEN coalesce(new, ft) ELSE ft END AS ct FROM f LEFT JOIN fixed ON fixed.text = ft),
h AS (SELECT *, {_closing(_by_key("ct", tuple(x for x in COLUMNS if x not in ("name", "note"))))} AS t FROM g),
s AS (SELECT *, row_number() OVER (PARTITION BY document_id, page, row_no, column_key ORDER BY c + ({_plausible("column_key", "t")}) + {_BONUS} DESC, pass_ordinal, t DESC, c DESC, source DESC) AS r FROM h WHERE t <> ''),
n AS (SELECT document_id, page, row_no, column_key, {_noise("column_key", "t", "c")} AS t, c FROM s WHERE r = 1),
w AS (SELECT document_id, page, row_no, {", ".join(f"coalesce(max(t) FILTER (column_key = '{x}'), '') AS {x}" for x in COLUMNS)}, map([{_list(COLUMNS)}], [{", ".join(f"coalesce(max(CASE WHEN t <> '' THEN {_round1('c')} ELSE 0.0 END) FILTER (column_key = '{x}'), 0.0::DOUBLE)" for x in COLUMNS)}]) AS confidences FROM n GROUP BY ALL),
raw AS (SELECT 0 AS raw_id, document_id, page, row_no AS line, row_no::VARCHAR AS source_row, {{'y': 0.0::DOUBLE, 'height': 0.0::DOUBLE}} AS bbox, confidences, {", ".join(COLUMNS)} FROM w WHERE {_ANY(*COLUMNS)}),
{_merge_ctes("SELECT * FROM raw", "document_id, page", "line")},
merged AS (SELECT document_id, page, line, source_row, {", ".join(_joined(x) for x in COLUMNS)}, map([{_list(COLUMNS)}], [{", ".join(_fold(x) for x in COLUMNS)}]) AS confidences FROM mf),
placed AS ({_context("SELECT * FROM merged", "page, line", "* EXCLUDE (row_type)")}),
rated AS (SELECT *, CASE WHEN len({_VALUES}) > 0 THEN {_round1(f"list_reduce({_VALUES}, lambda a, b: a + b, 0.0::DOUBLE) / len({_VALUES})")} ELSE 0.0 END AS confidence FROM placed)
SELECT document_id, md5(concat_ws('/', document_id, page::VARCHAR, source_row)) AS row_id, page::BIGINT * 100000 + line AS row_order, {", ".join(COLUMNS)}, section_name, system_name, row_type, page, confidence, {_STATUS} AS status, source_row FROM rated"""

_QUANTITY = _cast("quantity")
_HOLDS = "(" + " OR ".join(f"({_QUANTITY[0]}) IS NOT NULL OR coalesce({_QUANTITY[1]}, '') <> ''" if c == "quantity" else f"{_t(c)} <> ''" for c in EXPORTED) + ")"
_CHOSEN = "selected IS DISTINCT FROM false"
_EXPORTABLE = f"coalesce(row_type, '') NOT IN ('section', 'system', 'note', 'skip') AND {_CHOSEN} AND {_HOLDS}"
_SELECTED = "coalesce(selected, row_type IN ('item', 'component'))"
_ALL = (*COLUMNS, "section_name", "system_name", "row_type", "page", "confidence", "status")


def _filter(row_type: str | None, status: str | None, search: str | None) -> str:
    asked = [f"row_type = '{row_type}'"] if row_type else []
    asked += [f"status = '{status}'"] if status else []
    asked += ["(" + " OR ".join(f"contains(lower(coalesce({c}::VARCHAR, '')), '{search.lower()}')" for c in _ALL) + ")"] if search else []
    return " AND ".join(asked) or "true"


def _quantile(g: str, q: float) -> str:
    at = f"((len({g}) - 1) * {q}::DOUBLE)"
    s = f"list_sort({g})"
    return f"({s}[floor({at})::INT + 1] + ({s}[least(floor({at})::INT + 2, len({g}))] - {s}[floor({at})::INT + 1]) * ({at} - floor({at})))"


def _trimmed(lines: str) -> str:
    """Lines up to the gap, from a table l(document_id, page, l) of arrays."""
    return f"""SELECT document_id, page, array_to_string(CASE WHEN len(l) < 5 OR cut IS NULL THEN l ELSE l[1:cut + 1] END, ',') AS lines FROM (
  SELECT *, list_min(list_filter(range(2, len(g)), lambda i: g[i + 1] > m * 2.15)) AS cut FROM (
    SELECT *, CASE WHEN len(reg) > 0 THEN {_quantile("reg", 0.5)} ELSE {_quantile("g", 0.5)} END AS m FROM (
      SELECT *, list_filter(g, lambda x: x < q3) AS reg FROM (
        SELECT *, {_quantile("g", 0.75)} AS q3 FROM (SELECT *, list_transform(range(1, len(l)), lambda i: (l[i + 1] - l[i])::DOUBLE) AS g FROM ({lines}))))))"""


_RATIOS = "[" + ", ".join(map(str, WIDTH_RATIOS)) + "]::DOUBLE[]"
_SEQUENCE = f"""WITH c AS (SELECT DISTINCT document_id, page, image_width, unnest(list_concat(x_lines, list_transform(range(1, len(x_lines)), lambda i: ((x_lines[i + 1] + x_lines[i]) // 2)::INTEGER))) AS x FROM page_grid),
w AS (SELECT *, list(x) OVER (PARTITION BY document_id, page ORDER BY x ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING) AS s, row_number() OVER (PARTITION BY document_id, page ORDER BY x) AS k FROM c),
e AS (SELECT *, CASE WHEN len(s) = 10 AND s[10] - s[1] >= image_width * 0.72 THEN round(list_sum(list_transform(range(1, 10), lambda i: abs((s[i + 1] - s[i]) / (s[10] - s[1])::DOUBLE - ({_RATIOS})[i]))) / 9 + abs(s[1] / image_width::DOUBLE - 0.045) * 0.04, 12) END AS error FROM w)
SELECT document_id, page, array_to_string(coalesce(arg_min(s, (error, k)) FILTER (error IS NOT NULL), arg_min(s, k)), ',') AS lines FROM e GROUP BY document_id, page"""

_NUM, _REST = _cast("quantity")
ORACLE: dict[str, str] = {
    "recognize_rows": _RECOGNIZE,
    "token_cells": f"WITH {_PLACED} SELECT * REPLACE (round(confidence, 8) AS confidence) FROM cell",
    "candidate_top1": f"SELECT * REPLACE (round(confidence, 4) AS confidence) FROM ({_best('cell_id')})",
    "candidate_union": f"WITH {_PLACED} SELECT document_id, page, row_no, col_no, row_number() OVER (PARTITION BY document_id, page, row_no, col_no ORDER BY CASE WHEN pass_name LIKE 'page-%' THEN 0 WHEN pass_name LIKE 'accurate-column-%' THEN 1 ELSE 2 END, pass_ordinal, pass_name)::INT AS place, pass_name, text FROM cell",
    "column_pass_cells": f"""WITH {_PLACED.replace("cell AS (", "c0 AS (")}, lines AS (SELECT document_id, page, y_lines[least(3, len(y_lines))] AS top FROM page_grid),
sc AS (SELECT * FROM (VALUES (1, 1.55::DOUBLE), (2, 1.55::DOUBLE), (6, 2.0::DOUBLE)) v(col_no, scale)),
big AS (SELECT t.document_id, t.page, c.col_no, scale, top, pass_ordinal, block_num, par_num, line_num, word_num, {_tr("text")} AS t, greatest(CASE WHEN conf IS NULL OR isnan(conf) THEN 0.0 ELSE conf END, 0.0) AS c, round((top_px - top) * scale)::INT AS y, round(height_px * scale)::INT AS h
  FROM tokens t JOIN cols c ON t.document_id = c.document_id AND t.page = c.page AND left_px + width_px / 2 > x0 AND left_px + width_px / 2 <= x1 JOIN rows_ r ON t.document_id = r.document_id AND t.page = r.page AND top_px + height_px / 2 > y0 AND top_px + height_px / 2 <= y1
  JOIN lines l ON t.document_id = l.document_id AND t.page = l.page JOIN sc ON sc.col_no = c.col_no WHERE {_tr("text")} <> ''),
w AS (SELECT DISTINCT b.document_id, b.page, r.row_no, b.col_no, pass_ordinal, block_num, par_num, line_num, word_num, t, c FROM big b JOIN rows_ r ON b.document_id = r.document_id AND b.page = r.page AND top + (y + h / 2) / scale > y0 AND top + (y + h / 2) / scale <= y1)
SELECT document_id, page, row_no, col_no, pass_ordinal, string_agg(t, ' ' ORDER BY block_num, par_num, line_num, word_num, t, c) AS text FROM w GROUP BY ALL""",
    "reading_plan": """WITH n AS (SELECT source AS pass_name, column_key, count(*) AS readings FROM cell_results GROUP BY ALL), x AS (SELECT *, column_key IN ('name', 'type_mark', 'manufacturer', 'note') AS wide, CASE WHEN column_key IN ('quantity', 'mass') THEN 'eng' WHEN column_key = 'unit' THEN 'rus' WHEN column_key IN ('name', 'note') THEN 'rus+eng' ELSE 'eng+rus' END AS lang FROM n),
p AS (SELECT *, pass_name LIKE 'cell-%' AND (pass_name IN ('cell-accurate-1', 'cell-standard-1') OR (pass_name = 'cell-accurate-2' AND wide)) AS of_cell, pass_name = 'accurate-column-' || column_key AS of_column FROM x)
SELECT pass_name, column_key, CASE WHEN pass_name = 'page-mixed' THEN 'rus+eng' WHEN pass_name = 'page-rus' THEN 'rus' WHEN of_cell OR of_column THEN lang END AS language, CASE WHEN pass_name IN ('page-mixed', 'page-rus') THEN 6 WHEN of_column THEN 11 WHEN of_cell THEN CASE WHEN column_key IN ('name', 'note') THEN 6 ELSE 7 END END AS layout,
  CASE WHEN pass_name IN ('page-mixed', 'page-rus') THEN 1.0 WHEN of_column THEN CASE WHEN wide THEN 1.55 ELSE 2.0 END WHEN of_cell THEN CASE WHEN column_key IN ('unit', 'quantity', 'mass', 'position_no') THEN 4.5 ELSE 3.0 END END::DOUBLE AS scale,
  CASE WHEN of_cell THEN CASE WHEN column_key IN ('quantity', 'mass') THEN '0123456789.,-' WHEN column_key = 'unit' THEN 'штмкгкомпл.²³-п' END END AS allowed, readings FROM p""",
    "noise_filter": f"SELECT result_id, {_noise('column_key', 't', 'c')} AS kept FROM ({_READINGS})",
    "refine_budget": f"SELECT * FROM (SELECT result_id, row_number() OVER (PARTITION BY document_id, page ORDER BY try_cast(regexp_extract(source_row, '^[0-9]+') AS INTEGER), cell_id, ordinal, result_id) AS turn FROM ({_READINGS}) WHERE {_DOUBTFUL}) WHERE turn <= 8",
    "numeric_fallback": f"SELECT result_id, text FROM cell_results WHERE column_key IN ('quantity', 'mass') AND coalesce(text, '') <> '' AND NOT regexp_matches(text, '{NUMBER}')",
    "back_fill": f"""WITH b AS ({_best("document_id, page, source_row, column_key", "column_key IN ('unit', 'quantity')")}),
w AS (SELECT document_id, page, source_row, max(text) FILTER (column_key = 'unit') AS ua, max(confidence) FILTER (column_key = 'unit') AS uc, max(text) FILTER (column_key = 'quantity') AS qa FROM b GROUP BY ALL),
r AS (SELECT raw_id, {_t("name")} || {_t("type_mark")} || {_t("manufacturer")} <> '' AS item, {_t("unit")} AS u, {_t("quantity")} AS q, coalesce(ua, '') AS ua, coalesce(uc, 0.0) AS uc, coalesce(qa, '') AS qa FROM raw_rows LEFT JOIN w USING (document_id, page, source_row)),
f AS (SELECT *, CASE WHEN item AND q <> '' AND u = '' AND ua <> '' THEN {_noise("'unit'", "ua", "uc")} ELSE u END AS unit FROM r)
SELECT raw_id, unit, CASE WHEN item AND unit <> '' AND q = '' AND qa <> '' THEN qa ELSE q END AS quantity FROM f""",
    "column_titles": f"SELECT column_key, title, count(*) AS readings FROM cell_results JOIN (VALUES {', '.join(f"('{k}', '{t}')" for k, t in CATALOG)}) v(column_key, title) USING (column_key) GROUP BY ALL",
    "clean_text": f"SELECT raw_id, {', '.join(f'{_clean(c)} AS {c}' for c in ('name', 'type_mark', 'unit', 'note'))} FROM raw_rows",
    "clean_text_compat": f"SELECT raw_id, {', '.join(f'{_clean(c, True)} AS {c}' for c in ('name', 'type_mark', 'unit', 'note'))} FROM raw_rows",
    "normalize_cells": "SELECT raw_id, " + ", ".join(f"{_closing(_ruled(c, _clean(c)))} AS {c}" for c in COLUMNS) + " FROM raw_rows",
    "normalize_units": f"SELECT raw_id, {_unit(_t('unit'))} AS unit FROM raw_rows",
    "letter_case": f"SELECT raw_id, {_cased(_t('name'), 'lower(' + _t('manufacturer') + ')')} AS manufacturer FROM raw_rows",
    "look_alikes": f"SELECT DISTINCT word, {_FORM} AS form FROM (SELECT unnest({_pieces(_t('name'))}) AS word FROM raw_rows) WHERE {_FORM} IS NOT NULL",
    "indel_ratio": f"SELECT document_id, round({_ratio('a', 'b')}, 6) AS ratio FROM (SELECT document_id, {_t('title')} AS a, {_t('filename')} AS b FROM doc_meta)",
    "fuzzy_correct": f"WITH {_near_ctes(f'SELECT DISTINCT unnest(ps) AS word FROM (SELECT {_pieces("x")} AS ps FROM (SELECT DISTINCT unnest([{_t("name")}, {_t("note")}, {_t("manufacturer")}]) AS x FROM raw_rows))')} SELECT * FROM near",
    "correct_texts": f"WITH cells AS (SELECT raw_id, unnest(['name', 'note', 'manufacturer']) AS column_key, unnest([name, note, manufacturer]) AS t FROM raw_rows), {_correct_ctes('SELECT t AS text FROM cells')} SELECT raw_id, column_key, CASE WHEN t <> '' THEN coalesce(new, t) ELSE t END AS text FROM cells LEFT JOIN fixed ON text = t",
    "numeric_cast": f"SELECT raw_id, {_NUM} AS number, {_REST} AS not_number FROM raw_rows",
    "plausibility": f"SELECT result_id, round({_plausible('column_key', 'j')}, 4) AS plausibility FROM ({_READINGS})",
    "safe_filenames": r"""SELECT document_id, left(CASE WHEN lower(s) LIKE '%.xlsx' THEN s ELSE s || '.xlsx' END, 160) AS filename FROM (SELECT document_id, regexp_replace(CASE WHEN coalesce(title, '') = '' THEN 'specification.xlsx' ELSE regexp_replace(title, '^.*/', '') END, '[^\p{L}\p{N}_\-. ()]', '_', 'g') AS s FROM doc_meta)""",
    "classify_rows": f"SELECT raw_id, {_CLASS} AS row_type FROM raw_rows",
    "row_status": f"SELECT raw_id, row_type, confidence, {_STATUS} AS status FROM (SELECT *, {_CLASS} AS row_type, CASE WHEN len({_VALUES}) > 0 THEN {_round1(f'list_reduce({_VALUES}, lambda a, b: a + b, 0.0::DOUBLE) / len({_VALUES})')} ELSE 0.0 END AS confidence FROM raw_rows)",
    "continuation_merge": _MERGE,
    "context_carry": _CONTEXT,
    "result_summary": "SELECT 'total' AS what, '' AS value, count(*) AS n FROM result_rows HAVING count(*) > 0 UNION ALL SELECT 'status', coalesce(status, ''), count(*) FROM result_rows GROUP BY ALL UNION ALL SELECT 'row_type', coalesce(row_type, ''), count(*) FROM result_rows GROUP BY ALL UNION ALL SELECT 'page_errors', '', count(*) FROM (SELECT DISTINCT document_id, page FROM cell_results c WHERE NOT EXISTS (SELECT 1 FROM page_grid g WHERE g.document_id = c.document_id AND g.page = c.page))",
    "review_counters": f"SELECT document_id, count(*) AS total, count(*) FILTER (status IN ('recognized', 'verified', 'edited')) AS ready, count(*) FILTER (status IN ('review', 'unrecognized')) AS review, count(*) FILTER ({_SELECTED}) AS selected FROM result_rows GROUP BY document_id",
    "review_filter": " UNION ALL ".join(f"SELECT {i} AS filter_id, row_id FROM result_rows WHERE {_filter(*f)}" for i, f in enumerate(FILTERS)),
    "rows_by_id": "SELECT raw_id, document_id, page, source_row FROM raw_rows WHERE raw_id IN (SELECT raw_id FROM maker_edits WHERE raw_id IS NOT NULL)",
    "default_selection": f"SELECT row_id, {_SELECTED} AS chosen FROM result_rows",
    "save_merge": "SELECT raw_id, coalesce(e.m, r.manufacturer) AS manufacturer, e.m IS NOT NULL AND e.m IS DISTINCT FROM r.manufacturer AS edited FROM raw_rows r LEFT JOIN (SELECT raw_id, arg_max(manufacturer, (edited_at, edit_id)) AS m FROM maker_edits WHERE raw_id IS NOT NULL AND manufacturer IS NOT NULL GROUP BY raw_id) e USING (raw_id)",
    "status_after_edit": "SELECT row_id, CASE WHEN edited AND status <> 'verified' THEN 'edited' ELSE status END AS status FROM result_rows",
    "first_messages": "SELECT user_id, string_agg(event_type, '; ' ORDER BY r) AS messages FROM (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY min((ts, event_id)), event_type) AS r FROM events GROUP BY user_id, event_type) WHERE r <= 3 GROUP BY user_id",
    "export_rows": f"SELECT row_order, {', '.join(EXPORTED[:-2])}, {_NUM} AS quantity, {_REST} AS quantity_text, note FROM result_rows WHERE {_EXPORTABLE}",
    "export_titles": "SELECT row_order, " + ", ".join(f'{c} AS "{TITLE[c]}"' for c in EXPORTED) + f" FROM result_rows WHERE {_EXPORTABLE}",
    "export_repeated": f"SELECT row_order, {_NUM} AS quantity, {_REST} AS quantity_text, name, {_NUM} AS quantity_2, {_REST} AS quantity_2_text FROM result_rows WHERE {_CHOSEN} AND (({_NUM}) IS NOT NULL OR coalesce({_REST}, '') <> '' OR {_t('name')} <> '')",
    "column_order": f"SELECT row_number() OVER (ORDER BY n DESC NULLS LAST, pos)::INT AS place, column_key, title FROM (VALUES {', '.join(f"('{k}', '{t}', {i})" for i, (k, t) in enumerate(CATALOG))}) v(column_key, title, pos) LEFT JOIN (SELECT column_key, count(*) AS n FROM cell_results GROUP BY ALL) USING (column_key)",
    "export_metadata": f"SELECT 'Программа' AS parameter, 'specloom' AS value UNION ALL SELECT 'Дата экспорта', strftime(max(updated_at), '%d.%m.%Y %H:%M') FROM result_rows UNION ALL SELECT 'Экспортировано строк', count(*)::VARCHAR FROM result_rows WHERE {_EXPORTABLE} UNION ALL SELECT 'Столбцы', '{', '.join(EXPORTED)}'",
    "tsv_export": "SELECT row_order, concat_ws(chr(9), " + ", ".join(f"regexp_replace({_t(c)}, '[\\t\\r\\n]+', ' ', 'g')" for c in EXPORTED) + f") AS line FROM result_rows WHERE {_SELECTED} AND {_EXPORTABLE}",
    "mask_islands": "SELECT document_id, page, round_even(avg(top_px), 0)::BIGINT AS line FROM (SELECT *, top_px - row_number() OVER (PARTITION BY document_id, page ORDER BY top_px) AS g FROM (SELECT DISTINCT document_id, page, top_px FROM tokens)) GROUP BY document_id, page, g",
    "column_sequence": _SEQUENCE,
    "footer_trim": f"SELECT document_id, page, false AS with_gap, lines FROM ({_trimmed('SELECT document_id, page, y_lines AS l FROM page_grid')}) UNION ALL SELECT document_id, page, true, lines FROM ({_trimmed('SELECT document_id, page, list_concat(y_lines, [y_lines[-1] + 900, y_lines[-1] + 960]) AS l FROM page_grid')})",
    "page_geometry": """SELECT document_id, page, x0, x1, y0, y1, l::INTEGER AS "left", t::INTEGER AS top, greatest(20, least(floor((x1 - x0) * image_width) + px * 2, image_width - l))::INTEGER AS width, greatest(20, least(floor((y1 - y0) * image_height) + py * 2, image_height - t))::INTEGER AS height
FROM (SELECT *, greatest(0, least(floor(x0 * image_width) - px, image_width - 1)) AS l, greatest(0, least(floor(y0 * image_height) - py, image_height - 1)) AS t FROM (SELECT *, greatest(8, floor(image_width * 0.03::DOUBLE)) AS px, greatest(8, floor(image_height * 0.015::DOUBLE)) AS py,
  round(x_lines[1] / image_width::DOUBLE, 6) AS x0, round(x_lines[-1] / image_width::DOUBLE, 6) AS x1, round(y_lines[1] / image_height::DOUBLE, 6) AS y0, round(y_lines[-1] / image_height::DOUBLE, 6) AS y1 FROM page_grid))""",
    "suggest_pages": "SELECT document_id, page FROM page_grid WHERE len(x_lines) = 10 AND len(y_lines) >= 6",
    "page_ranges": "SELECT DISTINCT document_id, unnest(list_concat(range(greatest(1, page_count - 3), page_count + 1), [1]))::INTEGER AS page FROM doc_meta WHERE page_count > 0",
    "page_problems": """WITH d AS (SELECT DISTINCT document_id, page FROM result_rows WHERE page IS NOT NULL), r AS (SELECT document_id, min(page) AS a, max(page) AS b FROM (SELECT *, page - row_number() OVER (PARTITION BY document_id ORDER BY page) AS g FROM d) GROUP BY document_id, g),
l AS (SELECT document_id, max(b) AS last FROM r GROUP BY ALL), n AS (SELECT document_id, unnest([last - 1, last]) AS page_count FROM l)
SELECT document_id, page_count, arg_min(CASE WHEN a = b THEN a::VARCHAR ELSE a::VARCHAR || '-' || b::VARCHAR END, a) FILTER (a < 1 OR b > page_count) AS problem FROM n JOIN r USING (document_id) GROUP BY document_id, page_count""",
    "compact_ranges": "SELECT document_id, string_agg(CASE WHEN a = b THEN a::VARCHAR ELSE a::VARCHAR || '-' || b::VARCHAR END, ', ' ORDER BY a) AS ranges FROM (SELECT document_id, min(page) AS a, max(page) AS b FROM (SELECT *, page - row_number() OVER (PARTITION BY document_id ORDER BY page) AS g FROM (SELECT DISTINCT document_id, page FROM cell_results WHERE page IS NOT NULL)) GROUP BY document_id, g) GROUP BY document_id",
    "known_pages": "SELECT DISTINCT document_id, page FROM cell_results SEMI JOIN page_grid USING (document_id, page)",
    "drop_empty_rows": f"SELECT raw_id FROM raw_rows WHERE {_ANY(*COLUMNS)}",
    "document_list": r"SELECT document_id, CASE WHEN trim(coalesce(title, '')) <> '' THEN title ELSE regexp_replace(coalesce(filename, ''), '\.[^.]*$', '') END AS title, page_count, document_id IN (SELECT document_id FROM result_rows WHERE document_id IS NOT NULL) AS has_result FROM doc_meta",
}
