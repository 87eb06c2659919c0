"""The built-in lexicon of spelling correction: words, phrases and known misreadings of engineering sheets."""

from __future__ import annotations

#: Fixed values. Words that a nearly equal one is corrected to, in order.
WORDS = (
    "антивибрационный вентилятор вентиляционный воздушный воздуховод врезка вытяжной гибкий датчик диффузор дренажный дроссель заглушка измерения клапан комплект "
    "кондиционер круглый нагреватель нагревательный насос наружный обратный оборудование отвод оцинкованный оцинкованной переход подобрать привод приточный "
    "приточная прямоугольный решетка решётка реле стали теплоизоляция тройник трубка управления фильтр цвет шумоглушитель щит"
).split()
#: Fixed values. Phrases that a nearly equal text is replaced by, in order.
PHRASES = ("антивибрационный комплект", "гибкие вставки", "дроссель-клапан", "канальный датчик", "привод воздушного клапана", "реле давления", "теплоизоляция", "щит управления")
#: Fixed values. Misreadings and the words they stand for.
EXACT = {
    "воздухобвод": "воздуховод", "воздухопод": "воздуховод", "троцник": "тройник", "отбод": "отвод", "фультр": "фильтр", "приуточная": "приточная", "приуточноя": "приточная",
    "прубод": "привод", "круглыц": "круглый", "оцинкованноц": "оцинкованной", "оцинкобанноц": "оцинкованной", "компл.ект": "комплект", "дренажныц": "дренажный", "цбет": "цвет",
    "дамчик": "датчик", "устанобка": "установка", "моновлочная": "моноблочная", "моноблочноая": "моноблочная", "боздушныц": "воздушный", "боздушнычц": "воздушный",
    "упрабления": "управления", "дабления": "давления", "wymoenywummenb": "шумоглушитель", "quuabmp": "фильтр", "e2udkue": "гибкие", "bcmabku": "вставки", "wum": "щит",
    "npubod": "привод", "bo3d": "возд.", "knanaha": "клапана", "dud": "диф.", "pene": "реле", "pewemka": "решетка", "apkmuka": "Арктика", "kqhoabhoy": "канальной",
    "kqhoabhou": "канальной", "damyuk": "датчик", "эстабкиу": "вставки", "2udkue": "гибкие", "wwymmoenywumenb": "шумоглушитель", "mohoonoyhaa": "моноблочная",
    "кональной": "канальной", "канальноцу": "канальной", "щелебая": "щелевая", "нахимобскии": "Нахимовский", "kaanaha": "клапана", "nod": "под", "ubem": "цвет", "цбем": "цвет",
    "облицовку": "облицовки",
}


def entries() -> list[tuple[str, str, str | None, int]]:
    """kind, lex_key, lex_value, ordinal of the built-in lexicon."""
    rows = [("word", w, None) for w in WORDS] + [("phrase", p, None) for p in PHRASES] + [("exact", a, b) for a, b in EXACT.items()]
    return [(*r, i) for i, r in enumerate(rows)]
