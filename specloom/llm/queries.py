"""The pN_ queries: each problem's operator over its whole tables, and SQL where SQL can say the same."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from specloom.llm import format_dups, lookalikes, mixing, name_link, reading_level, scan_repair, survivorship, tokenize, unit_map
from specloom.session import table

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return survivorship.best_readings(table(spark, d, "cell_results"), table(spark, d, "lexicon")).where("readings > 1").select("cell_id", "result_id")


def p1_golden(spark: SparkSession, d: str) -> DataFrame:
    return survivorship.golden_cells(table(spark, d, "cell_results"), table(spark, d, "lexicon"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return unit_map.mapped_rows(table(spark, d, "raw_rows"), table(spark, d, "lexicon")).select("raw_id", F.col("entry").alias("unit_key"))


def p2_report(spark: SparkSession, d: str) -> DataFrame:
    return unit_map.map_values(table(spark, d, "raw_rows"), "unit", table(spark, d, "lexicon")).select("value", "rows", F.col("entry").alias("unit_key"), F.col("entry").eqNullSafe(unit_map.NONE).alias("missed"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return p3_repaired(spark, d).where(F.size("wrong") > 0).select("raw_id", "column_key")


def p3_repaired(spark: SparkSession, d: str) -> DataFrame:
    return scan_repair.repair_text(table(spark, d, "raw_rows"), "raw_id", ["name", "note"], table(spark, d, "lexicon"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return lookalikes.changed_cells(table(spark, d, "raw_rows"), "raw_id", ["name", "type_mark", "manufacturer"], table(spark, d, "lexicon"))


def p4_unified(spark: SparkSession, d: str) -> DataFrame:
    return lookalikes.unify_text(table(spark, d, "raw_rows"), "raw_id", ["name", "type_mark", "manufacturer"], table(spark, d, "lexicon"))


def _records(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "result_rows").where(F.col("row_type").isin("item", "component"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return format_dups.copies(_records(spark, d)).select(F.col("first_id").alias("first_row_order"), F.col("id").alias("row_order"))


def p5_groups(spark: SparkSession, d: str) -> DataFrame:
    return format_dups.copy_groups(_records(spark, d)).select(F.col("first_id").alias("first_row_order"), "copies")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return name_link.entry_pairs(table(spark, d, "maker_edits")).select(F.col("a").alias("edit_a"), F.col("b").alias("edit_b"))


def p6_links(spark: SparkSession, d: str) -> DataFrame:
    return name_link.linked_entries(table(spark, d, "maker_edits")).select(F.col("id").alias("edit_id"), "label", "links")


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokenize.encode_texts(table(spark, d, "documents"))


def p7_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Texts decoded from their ids; equal to the texts, with '' for null."""
    return tokenize.decode_ids(p7_ids(spark, d))


def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "source_targets"))


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.shares(p8_mix(spark, d), table(spark, d, "source_targets"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    levels = reading_level.reading_levels(table(spark, d, "documents"), table(spark, d, "level_labels"))
    return levels.where(F.col("calibrated") >= reading_level.DEMANDING).select("doc_id")


def p9_levels(spark: SparkSession, d: str) -> DataFrame:
    return reading_level.reading_levels(table(spark, d, "documents"), table(spark, d, "level_labels"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (p1_found, p1_golden, p2_found, p2_report, p3_found, p3_repaired, p4_found, p4_unified, p5_found, p5_groups, p6_found, p6_links, p7_ids, p7_round_trip, p8_mix, p8_shares, p9_found, p9_levels)
}


def _bare(chars: str) -> str:
    """DuckDB: the kept characters of a list of lower-case ones."""
    kept = rf"""regexp_full_match(c, '[\p{{L}}\p{{N}}]') OR (NOT regexp_full_match(c, '[\s\p{{Z}}]') AND i > 1 AND regexp_full_match({chars}[i - 1], '[0-9]') AND regexp_full_match(coalesce({chars}[i + 1], ''), '[0-9]'))"""
    return f"coalesce(array_to_string(list_filter({chars}, lambda c, i: {kept}), ''), '')"


def _parts(chars: str) -> str:
    """DuckDB: the parts between separators of a list of characters."""
    between = f"i > 1 AND regexp_full_match({chars}[i - 1], '[0-9]') AND regexp_full_match(coalesce({chars}[i + 1], ''), '[0-9]')"
    return f"string_split(array_to_string(list_transform({chars}, lambda c, i: CASE WHEN c IN (',', ';', '/', '|') AND NOT ({between}) THEN chr(1) ELSE c END), ''), chr(1))"


def _wordy(chars: str) -> str:
    return rf"(len(list_filter({_parts(chars)}, lambda s: len(regexp_extract_all(s, '\p{{L}}')) >= 3)) > 1)"


def _canonical_sql(result: str) -> str:
    return rf"""
WITH r AS (
  SELECT row_order, string_split(lower(coalesce(name, '')), '') AS nc, string_split(lower(coalesce(type_mark, '')), '') AS tc
  FROM result_rows WHERE row_type IN ('item', 'component') AND row_order IS NOT NULL),
b AS (SELECT row_order, nc, tc, {_bare("nc")} AS nb, {_bare("tc")} AS tb FROM r),
o AS (
  SELECT row_order, nc, tc, nb, tb,
    coalesce(length(regexp_replace(nb, '[^0-9]', '', 'g')) / nullif(length(nb), 0)::DOUBLE, 0) AS ns,
    coalesce(length(regexp_replace(tb, '[^0-9]', '', 'g')) / nullif(length(tb), 0)::DOUBLE, 0) AS ts FROM b),
x AS (
  SELECT row_order, CASE WHEN sw THEN tc ELSE nc END AS lc, CASE WHEN sw THEN nb ELSE tb END AS code
  FROM (SELECT *, tb <> '' AND (nb = '' OR CASE WHEN {_wordy("nc")} <> {_wordy("tc")} THEN {_wordy("tc")} ELSE (ns > ts OR (ns = ts AND (length(nb) < length(tb) OR (length(nb) = length(tb) AND list_sort(string_split(nb, '')) < list_sort(string_split(tb, '')))))) END) AS sw FROM o)),
p AS (
  SELECT row_order, code, {_parts("lc")} AS parts FROM x),
q AS (SELECT row_order, code, list_transform(parts, lambda s: string_split(s, '')) AS parts FROM p),
k AS (SELECT row_order, array_to_string(list_sort(list_filter(list_transform(parts, lambda s: {_bare("s")}), lambda s: s <> '')), '|') || '#' || code AS key FROM q),
g AS (SELECT row_order, min(row_order) OVER (PARTITION BY key) AS first_row_order, count(*) OVER (PARTITION BY key) AS copies FROM k WHERE key <> '#')
{result}"""


_LETTER = "A-Za-zÀ-ÖØ-öø-ÿА-Яа-яЁё"
_FIGURE = r"^([+№]?[0-9]+([.,][0-9]+)?|[0-9]+(×[0-9]+)+|Ø[0-9]+([.,][0-9]+)?|[IVX]+|[A-Z]{2,}[0-9]*|[А-ЯЁA-Z][0-9]*)$"
#: Readings with what decides among them, from left to right: a text, a pass, unreadable tokens, length, confidence, time.
_READINGS = rf"""w AS (SELECT list(lower(lex_key)) AS words FROM lexicon WHERE kind = 'word'),
m AS (SELECT string_agg('\Q' || lex_key || '\E', '|' ORDER BY length(lex_key) DESC, lex_key) AS marks FROM lexicon WHERE kind = 'mark'),
x AS (SELECT cell_id, result_id, column_key, text, read_at, source, CASE WHEN NOT isnan(confidence) THEN confidence END AS conf, coalesce(text, '') AS t,
  list_transform(list_filter(string_split(regexp_replace(coalesce(text, ''), '[,;:«»\s\p{{Z}}]+', ' ', 'g'), ' '), lambda v: v <> ''), lambda v: regexp_replace(v, '^\(|\)$|\.$', '', 'g')) AS tokens FROM cell_results WHERE cell_id IS NOT NULL),
y AS (SELECT x.*, trim(t, ' ') <> '' AS held, coalesce(source, 'none') <> 'none' AS passed, CASE
  WHEN column_key IN ('name', 'note') THEN len(list_filter(tokens, lambda v: NOT (list_contains(words, lower(v)) OR regexp_matches(v, '^[а-яё]{{1,3}}$') OR (regexp_matches(lower(v), '^[а-яё]{{1,3}}$') AND regexp_matches(v, '^[{_LETTER}][а-яё]*$')) OR regexp_matches(v, '{_FIGURE}') OR len(list_filter(string_split(v, '-'), lambda p: NOT list_contains(words, lower(p)))) = 0))) + CASE WHEN regexp_matches(t, '[|~^_#*=¬{{}}<>$@]|[\s\p{{Z}}]$') THEN 1 ELSE 0 END
  WHEN column_key = 'type_mark' THEN CASE WHEN regexp_matches(t, '^(' || marks || ')([- ./×]?[0-9]+)*([- ][A-ZА-ЯЁ]| исп\. [IVX]+)?$') THEN 0 ELSE 1 END
  WHEN column_key = 'manufacturer' THEN CASE WHEN t IN (SELECT lex_key FROM lexicon WHERE kind = 'maker') THEN 0 ELSE 1 END
  WHEN column_key = 'unit' THEN CASE WHEN t IN (SELECT lex_key FROM lexicon WHERE kind = 'unit') THEN 0 ELSE 1 END
  WHEN column_key IN ('quantity', 'mass') THEN CASE WHEN regexp_matches(t, '^[+-]?[0-9]+([.,][0-9]+)?$') THEN 0 ELSE 1 END ELSE 0 END AS odd,
  CASE WHEN column_key IN ('quantity', 'mass') THEN 0 ELSE length(trim(t, ' ')) END AS size,
  CASE WHEN source LIKE 'cell-%' THEN 3 WHEN source LIKE 'accurate-column%' THEN 2 WHEN source LIKE 'page-%' THEN 1 ELSE 0 END AS trust FROM x, w, m)"""


def _values(rows: list[tuple]) -> str:
    quoted = lambda v: "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)
    return ", ".join("(" + ", ".join(map(quoted, r)) + ")" for r in rows)


def _units_sql(result: str) -> str:
    """Free units: forms of the list and of the entries as values, all pairs within the edits allowed, distances by rows. The lists and keyboard are the operator's own."""
    same = [(c, k) for c in map(chr, (*range(0xA0, 0x100), *range(0x2000, 0x2200), *range(0xFF01, 0xFF5F))) if (k := unicodedata.normalize("NFKC", c)) != c and len(k) == 1 and k != "'"]
    fold = lambda c: f"replace(lower(translate({c}, '{''.join(a for a, _ in same)}', '{''.join(b for _, b in same)}')), 'ё', 'е')"
    edge = r"""[\s\p{Z}.,;:|/_~*()\[\]«»"''—–-]+"""
    plain = lambda c: rf"regexp_replace(regexp_replace(regexp_replace({fold(c)}, '[\s\p{{Z}}\x{{200B}}-\x{{200F}}\x{{2060}}\x{{FEFF}}\x{{AD}}]+', ' ', 'g'), '^{edge}|{edge}$', '', 'g'), '[\s.^]+', '', 'g')"
    forms = [(unit_map.fold(name), unit_map.compact(unit_map.fold(f)), j) for name, fs in unit_map.FORMS.items() for j, f in enumerate(fs.split(), 2)]
    others = [(unit_map.compact(unit_map.fold(f)), j) for j, f in enumerate(unit_map.OTHERS.split())]
    keys = [(f, unit_map.compact(unit_map.fold(u)), j) for j, (f, u) in enumerate(unit_map.UNIT_KEYS.items())]
    near = "|" + "|".join(sorted(x + y for x, ys in unit_map.NEAR.items() for y in ys)) + "|"
    table = lambda t: ("".join(map(chr, t)), "".join(map(chr, t.values())))
    read = lambda t: "translate(f, '{}', '{}')".format(*table(t))
    allowed = lambda c: f"CASE WHEN length({c}) < 4 THEN 0 WHEN length({c}) < 8 THEN 1 ELSE 2 END"

    def distance(cut: str, add: str, other: str, swap: float) -> str:
        swapped = f"CASE WHEN i > 1 AND j > 1 AND f[i] = r[j - 1] AND f[i - 1] = r[j] THEN st.above[j - 1] + {swap}::DOUBLE ELSE 99.0::DOUBLE END"
        row = f"list_reduce(range(1, length(r) + 1), lambda got, j: list_append(got, least(st.last[j + 1] + {cut}, got[j] + {add}, st.last[j] + CASE WHEN f[i] = r[j] THEN 0.0::DOUBLE ELSE {other} END, {swapped})), [i::DOUBLE])"
        first = "list_transform(range(0, length(r) + 1), lambda v: v::DOUBLE)"
        return f"list_reduce(range(1, length(f) + 1), lambda st, i: {{'above': st.last, 'last': {row}}}, {{'above': {first}, 'last': {first}}}).last[-1]"

    one = "1.0::DOUBLE"
    weighted = distance("CASE WHEN i > 1 AND f[i - 1] = f[i] THEN 0.6::DOUBLE ELSE 1.0::DOUBLE END", "CASE WHEN j > 1 AND r[j - 1] = r[j] THEN 0.6::DOUBLE ELSE 1.0::DOUBLE END", f"CASE WHEN contains('{near}', '|' || f[i] || r[j] || '|') THEN 0.7::DOUBLE ELSE 1.0::DOUBLE END", 0.6)
    return f"""WITH src AS (SELECT unit AS value, count(*) AS rows FROM raw_rows WHERE unit IS NOT NULL GROUP BY unit),
entry AS (SELECT lex_key, {plain('lex_key')} AS k, {plain('lex_value')} AS n, {fold('lex_value')} AS named, row_number() OVER (ORDER BY ordinal, lex_key) - 1 AS i FROM lexicon WHERE kind = 'unit'),
allf AS (SELECT k AS form, lex_key AS entry, i AS place, i * 1000 AS p FROM entry UNION ALL SELECT n, lex_key, i, i * 1000 + 1 FROM entry
  UNION ALL SELECT form, lex_key, i, i * 1000 + j FROM entry JOIN (VALUES {_values(forms)}) v(named, form, j) USING (named)
  UNION ALL SELECT form, 'none', (SELECT count(*) FROM entry), 1000000 + j FROM (VALUES {_values(others)}) v(form, j)
  UNION ALL SELECT form, arg_min(lex_key, i), min(i), 2000000 + j FROM entry JOIN (VALUES {_values(keys)}) v(form, k, j) USING (k) GROUP BY form, j),
ref AS (SELECT form AS r, arg_min(entry, p) AS entry, arg_min(place, p) AS place FROM allf WHERE form <> '' GROUP BY form),
spelt AS (SELECT value, rows, {plain('value')} AS f FROM src),
four AS (SELECT value, unnest([f, {read(unit_map._LATIN)}, {read(unit_map._CYRILLIC)}, {read(unit_map._ITALIC)}]) AS f, unnest([0, 1, 2, 3]) AS pos FROM spelt),
scripts AS (SELECT value, f, row_number() OVER (PARTITION BY value ORDER BY min(pos)) - 1 AS script FROM four GROUP BY value, f),
near AS (SELECT f, r, entry, place, {weighted} AS d FROM (SELECT DISTINCT f FROM scripts WHERE length(f) <= 80) JOIN ref ON abs(length(f) - length(r)) <= 2 WHERE f = r OR (least({allowed('f')}, {allowed('r')}) > 0 AND {distance(one, one, one, 1.0)} <= least({allowed('f')}, {allowed('r')}))),
best AS (SELECT scripts.value, arg_min(near.entry, (d + 0.05::DOUBLE * script, -coalesce(src.rows, 0), place, near.entry)) AS entry FROM scripts JOIN near USING (f) LEFT JOIN src ON near.entry = src.value GROUP BY scripts.value),
mapped AS (SELECT value, rows, coalesce(entry, 'none') AS unit_key FROM src LEFT JOIN best USING (value))
{result}"""


_LATEST = "conf DESC NULLS LAST, read_at DESC NULLS LAST, result_id"


def _first(value: str, order: str) -> str:
    return f"list({value} ORDER BY {order})[1]"


ORACLE: dict[str, str] = {
    "p1_found": f"WITH {_READINGS} SELECT cell_id, {_first('result_id', f'held DESC, passed DESC, odd, size DESC, {_LATEST}')} AS result_id FROM y GROUP BY cell_id HAVING count(*) > 1",
    "p2_found": _units_sql("SELECT raw_id, unit_key FROM raw_rows JOIN mapped ON unit = value WHERE unit <> '' AND unit NOT IN (SELECT lex_key FROM entry)"),
    "p2_report": _units_sql("SELECT value, rows, unit_key, unit_key = 'none' AS missed FROM mapped"),
    "p1_golden": f"WITH {_READINGS} SELECT cell_id, {_first('text', f'held DESC, passed DESC, odd, size DESC, {_LATEST}')} AS text, {_first('conf', f'held DESC, passed DESC, odd = 0 DESC, {_LATEST}')} AS confidence, {_first('source', f'held DESC, passed DESC, odd = 0 DESC, trust DESC, {_LATEST}')} AS source, max(read_at) AS read_at FROM y GROUP BY cell_id",
    "p5_found": _canonical_sql("SELECT first_row_order, row_order FROM g WHERE row_order > first_row_order"),
    "p5_groups": _canonical_sql("SELECT first_row_order, copies FROM g WHERE row_order = first_row_order"),
    "p7_round_trip": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
}
