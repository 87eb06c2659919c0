"""Correction of words that are nearly words of a list.

Distinct words are corrected once and joined back. Candidates share pairs of neighbouring letters with the word, as
many as every pair of words of the similarity asked for does, so the comparison is a hash join with a count, not all
against all, and the costly measure is taken of the few that are left.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from specloom.functions.lexicon import entries
from specloom.functions.text import CYRILLIC, LATIN, indel_ratio, match_case, strip
from specloom.session import checked_broadcast, cut

DELIMITERS = r"\s,;:()\[\]{}/."
#: Columns whose texts are corrected.
CORRECTED = ("name", "note", "manufacturer")


#: Similarity that a runner-up has at least if it is to be near the best: 5 less than the least a best one has.
RUNNER_UP = 79
#: Similarity from which a text is taken for a phrase.
PHRASE = 91


def with_built_in(lexicon: DataFrame) -> DataFrame:
    """The built-in lexicon, then the rows of ``lexicon``."""
    own = lexicon.sparkSession.createDataFrame(entries(), "kind string, lex_key string, lex_value string, ordinal int")
    return own.unionByName(lexicon.select("kind", "lex_key", "lex_value", (F.col("ordinal") + len(entries())).cast("int").alias("ordinal")))


def words_of(c: Column) -> Column:
    """The pieces between delimiters, and the delimiters, in turn."""
    return F.regexp_extract_all(c, F.lit(rf"(?U)([{DELIMITERS}]+|[^{DELIMITERS}]+)"), F.lit(1))


def candidate_form(word: Column) -> Column:
    """The form that is compared: look-alike Latin letters in Russian; null for what is left alone."""
    russian = F.translate(word, LATIN, CYRILLIC)
    leave = (F.length(word) < 4) | word.rlike(r"(?U)\d") | ((F.upper(word) == word) & (F.lower(word) != word) & (F.length(word) <= 8)) | ~russian.rlike(r"^[А-Яа-яЁё-]+$")
    return F.when(~leave, F.lower(russian))


def pairs_of(c: Column) -> Column:
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(c) - 1), lambda i: F.substring(c, i, F.lit(2))))


def threshold(c: Column) -> Column:
    return F.when(F.length(c) <= 4, 93).when(F.length(c) <= 7, 88).otherwise(84)


def lost(here: Column, there: Column, common: Column) -> Column:
    """How many of its pairs a text of ``here`` letters can lack in one of ``there`` letters that has ``common`` in common: a letter of its own costs two at most, one put between others a pair."""
    return 2 * (here - common) + (there - common)


def correct_words(words: DataFrame, vocabulary: DataFrame, word: str = "word", entry: str = "entry", place: str = "ordinal") -> DataFrame:
    """word, corrected, score: distinct words that are near enough to one entry and clearly nearer than to any other.

    Near enough: 93, 88 or 84 of 100 by length; clearly: 5 more than the runner-up, or 96. Ties go to the
    entry that comes first. Words of three letters or with digits, and short capitals, are left alone.
    """
    w = words.select(F.col(word).alias("word")).where(F.col("word").isNotNull()).distinct().withColumn("form", candidate_form(F.col("word"))).where(F.col("form").isNotNull())
    v = vocabulary.select(F.col(entry).alias("entry"), F.col(place).alias("place")).where(F.length("entry") > 1).groupBy("entry").agg(F.min("place").alias("place"))
    left = w.withColumn("own", pairs_of(F.col("form"))).select("word", "form", F.size("own").alias("own"), F.explode("own").alias("pair"))
    right = v.withColumn("its", pairs_of(F.col("entry"))).select("entry", "place", F.size("its").alias("its"), F.explode("its").alias("pair"))
    a, b = F.length("form"), F.length("entry")
    common = F.ceil((a + b) * RUNNER_UP / 200)  # letters in common that the similarity asks for
    met = left.join(checked_broadcast(right), "pair").where((common <= a) & (common <= b)).groupBy("word", "form", "entry", "place", "own", "its").agg(F.count("*").alias("shared"))
    met = met.where((F.col("shared") >= F.col("own") - lost(a, b, common)) & (F.col("shared") >= F.col("its") - lost(b, a, common)))
    spread = met.repartition(met.sparkSession.sparkContext.defaultParallelism, "word", "form")  # few bytes but much to compute; serves the window too
    scored = spread.withColumn("score", indel_ratio(F.col("form"), F.col("entry")))
    ranked = scored.withColumn("r", F.row_number().over(Window.partitionBy("word", "form").orderBy(F.desc("score"), "place", "entry"))).where(F.col("r") <= 2)
    top = ranked.groupBy("word", "form").agg(F.max(F.when(F.col("r") == 1, F.struct("entry", "score"))).alias("a"), F.coalesce(F.max(F.when(F.col("r") == 2, F.col("score"))), F.lit(0.0)).alias("second"))
    sure = (F.col("a.score") >= threshold(F.col("form"))) & ((F.col("a.score") - F.col("second") >= 5) | (F.col("a.score") >= 96))
    return top.where(sure).select("word", F.col("a.entry").alias("corrected"), F.round("a.score", 6).alias("score"))


def correct_texts(df: DataFrame, value: str, lexicon: DataFrame, of: Column | None = None) -> DataFrame:
    """df with the texts of ``value`` corrected, in the rows for which ``of`` holds.

    lexicon: kind, lex_key, lex_value, ordinal. An entry of kind ``exact`` replaces a word whatever its nearness to those
    of kind ``word``; the letter case stays. A text of two words or more that is then at least 91 of 100 like one of
    kind ``phrase``, is at most five signs longer or shorter and doesn't hold it, becomes the first such phrase. Runs
    of dots become one. Distinct texts are corrected once; null and empty ones are left alone.
    """
    of = F.lit(True) if of is None else of
    texts = cut(df.where(of & (F.col(value) != "")).select(F.col(value).alias("text")).distinct())
    pieces = texts.select("text", F.posexplode(words_of(F.col("text"))).alias("i", "piece"))
    words = cut(pieces.where(F.col("piece").rlike("[A-Za-zА-Яа-яЁё]")).select(F.col("piece").alias("word")).distinct())
    near = correct_words(words, lexicon.where(F.col("kind") == "word").select(F.col("lex_key").alias("entry"), "ordinal")).select("word", "corrected")
    exact = lexicon.where(F.col("kind") == "exact").groupBy(F.lower("lex_key").alias("low")).agg(F.min_by("lex_value", "ordinal").alias("exact"))
    both = words.join(near, "word", "left").join(checked_broadcast(exact), F.lower("word") == F.col("low"), "left")
    new = both.select("word", match_case(F.col("word"), F.coalesce("exact", "corrected")).alias("new")).where(F.col("new") != F.col("word"))
    put = pieces.join(checked_broadcast(cut(new)), F.col("piece") == F.col("word"), "left").select("text", F.struct("i", F.coalesce("new", "piece").alias("piece")).alias("p"))
    spelt = cut(put.groupBy("text").agg(F.array_join(F.transform(F.array_sort(F.collect_list("p")), lambda p: p["piece"]), "").alias("spelt")).withColumn("low", F.lower(strip("spelt"))))
    phrases = lexicon.where(F.col("kind") == "phrase").select(F.lower("lex_key").alias("phrase"), "ordinal").where(F.length("phrase") > 0)
    phrases = phrases.withColumn("its", pairs_of(F.col("phrase"))).withColumn("size", F.explode(F.sequence(F.greatest(F.lit(2), F.length("phrase") - 5), F.length("phrase") + 5)))
    several = spelt.where(F.col("low").rlike(r"(?U)\S\s+\S")).withColumn("own", pairs_of(F.col("low")))
    alike = several.join(checked_broadcast(cut(phrases)), F.length("low") == F.col("size")).where(~F.contains("low", "phrase"))
    a, b = F.length("low"), F.length("phrase")
    common = F.ceil((a + b) * PHRASE / 200)
    shared = F.size(F.array_intersect("own", "its"))
    alike = alike.where((shared >= F.size("own") - lost(a, b, common)) & (shared >= F.size("its") - lost(b, a, common)))
    alike = alike.where(indel_ratio(F.col("low"), F.col("phrase")) >= PHRASE).groupBy("text").agg(F.min(F.struct("ordinal", "phrase")).alias("first"))
    whole = spelt.join(alike, "text", "left").withColumn("new", F.coalesce(match_case(F.col("spelt"), F.col("first.phrase")), "spelt"))
    fixed = whole.select(F.col("text").alias("_text"), F.regexp_replace("new", r"\.{2,}", ".").alias("_new")).where(F.col("_new") != F.col("_text"))
    return df.join(checked_broadcast(cut(fixed)), of & (F.col(value) == F.col("_text")), "left").withColumn(value, F.coalesce("_new", value)).drop("_text", "_new")
