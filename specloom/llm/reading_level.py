"""Problem 9: the reading level of a text.

A linear ranker is learned from pairs of graded documents: of two, the one graded higher must score higher.
Its features are of syntax (lengths of sentences and words, clauses, signs) and of vocabulary (the share of
the text's words that falls on each hashed word stem). Isotonic regression on graded documents that the
ranker hasn't seen turns scores into levels. Fitting takes a bounded, documented sample of graded
documents; scoring is a map over all documents, whole texts, without a shuffle.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Graded documents that the ranker and the levels are fitted on at most; the ones of smallest hash.
GRADED = 8000
#: Hashed stems; a stem is a word's first STEM letters.
STEMS, STEM = 1024, 6
#: Share of the graded documents that is kept for the levels.
HELD = 0.3
STEPS, PAIRS, RATE, RIDGE = 400, 4096, 0.05, 1e-4
LEVELS = (1, 5)
DEMANDING = 3.5

_WORD = re.compile(r"[^\W\d_]+(?:[-'’][^\W\d_]+)*")
_DIGIT = re.compile(r"[\d²³¹⁰⁴-⁹₀-₉]")
_SENTENCE = re.compile(r"[.!?…]+(?:\s|$)|\n\s*\n")
#: Fixed values. Words that open a clause, Russian and English.
CLAUSES = frozenset("что чтобы который которая которое которые которых которым если когда поскольку хотя пока так как ибо буде причём вследствие тот та чей кто кому that which who whom whose if when because although while whereas whereby unless since until so as".split())
VOWELS = frozenset("аеёиоуыэюяaeiouyäöüéè")
SYNTAX = 14


#: What is known of a word: letters, syllables, whether it opens a clause, the place of its stem. Emptied at KEPT words.
_KNOWN: dict[str, tuple[int, int, bool, int]] = {}
KEPT = 300_000


def _known(word: str) -> tuple[int, int, bool, int]:
    if (hit := _KNOWN.get(word)) is None:
        if len(_KNOWN) > KEPT:
            _KNOWN.clear()
        hit = _KNOWN[word] = (len(word), sum(c in VOWELS for c in word) or 1, word in CLAUSES, SYNTAX + zlib.crc32(word[:STEM].encode()) % STEMS)
    return hit


def fill_features(text: str | None, out: np.ndarray) -> bool:
    """Puts SYNTAX numbers on syntax, then the shares of the hashed stems, into a row of zeros; False for a text without words."""
    words = [w.lower() for w in _WORD.findall(text)] if text else []
    if not words:
        return False
    n, counts = len(words), Counter(words)
    letters = squares = syllables = clauses = long7 = long10 = long13 = short = 0
    stems: dict[int, int] = {}
    for w, k in counts.items():
        size, spoken, opens, stem = _known(w)
        letters += k * size
        squares += k * size * size
        syllables += k * spoken
        clauses += k * opens
        long7 += k * (size >= 7)
        long10 += k * (size >= 10)
        long13 += k * (size >= 13)
        short += k * (size <= 3)
        stems[stem] = stems.get(stem, 0) + k
    sentences = max(1, sum(1 for s in _SENTENCE.split(text) if _WORD.search(s)))
    mean = letters / n
    out[:SYNTAX] = (
        np.log(n / sentences), mean, long7 / n, long10 / n, long13 / n, short / n, syllables / n, text.count(",") / n * 5, text.count(":") / n * 10,
        clauses / n * 10, len(counts) / n, np.log(n), max(0.0, squares / n - mean * mean) ** 0.5, len(_DIGIT.findall(text)) / len(text) * 10,
    )
    for stem, k in stems.items():
        out[stem] = k / n * 20
    return True


def features(text: str | None) -> np.ndarray:
    """The features of one text; all zero for a text without words."""
    out = np.zeros(SYNTAX + STEMS, dtype=np.float32)
    fill_features(text, out)
    return out


#: Texts that are scored as one matrix.
ROWS = 1024


@dataclass(frozen=True)
class LevelModel:
    """score = weights · (features - mean) / scale; levels rise in steps at the knots."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    knots: np.ndarray
    values: np.ndarray

    def scores(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) / self.scale) @ self.weights

    def calibrated(self, scores: np.ndarray) -> np.ndarray:
        if not len(self.knots):
            return np.full(len(scores), sum(LEVELS) / 2)
        return np.interp(scores, self.knots, self.values)


def isotonic(scores: np.ndarray, grades: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: the rising function of the score nearest to the grades, as knots and values."""
    order = np.argsort(scores, kind="stable")
    blocks: list[list[float]] = []  # sum, count, score sum
    for s, g in zip(scores[order], grades[order]):
        blocks.append([float(g), 1.0, float(s)])
        while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]:
            a = blocks.pop()
            blocks[-1] = [x + y for x, y in zip(blocks[-1], a)]
    return np.array([b[2] / b[1] for b in blocks]), np.array([b[0] / b[1] for b in blocks])


def rank_weights(x: np.ndarray, grades: np.ndarray, steps: int = STEPS, pairs: int = PAIRS) -> np.ndarray:
    """Weights of the logistic loss over random pairs of different grade, by Adam; the seed is fixed."""
    rng = np.random.default_rng(9)
    w, m, v = (np.zeros(x.shape[1], dtype=np.float32) for _ in range(3))
    for t in range(1, steps + 1):
        i, j = rng.integers(0, len(x), pairs), rng.integers(0, len(x), pairs)
        gap = grades[i] - grades[j]
        keep = np.abs(gap) >= 0.5
        if not keep.any():
            continue
        diff = (x[i[keep]] - x[j[keep]]) * np.sign(gap[keep])[:, None]
        weight = 1 / (1 + np.exp(np.clip(diff @ w, -30, 30)))
        grad = -(diff * weight[:, None]).mean(0) + RIDGE * w
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        w = w - RATE * (0.1 if t > steps * 0.7 else 1) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w.astype(np.float32)


def _feature_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        yield pd.DataFrame({"doc_id": b["doc_id"], "grade": b["grade"], "x": [features(t).astype("<f4").tobytes() for t in b["text"]]})


def graded_features(documents: DataFrame, labels: DataFrame, limit: int = GRADED) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """doc_ids, features and mean grades of at most ``limit`` graded documents with words. Null grades say nothing."""
    grades = labels.where(F.col("grade").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.avg("grade").alias("grade")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    texts = documents.where(F.col("text").isNotNull() & F.col("text").rlike(r"(?U)\p{L}")).select("doc_id", "text")
    rows = texts.join(F.broadcast(grades), "doc_id").select("doc_id", "grade", "text").mapInPandas(_feature_rows, f"doc_id {dict(documents.dtypes)['doc_id']}, grade double, x binary").orderBy(F.xxhash64("doc_id"), "doc_id").collect()  # at most limit rows
    x = np.frombuffer(b"".join(bytes(r["x"]) for r in rows), dtype="<f4").reshape(len(rows), SYNTAX + STEMS)
    return np.array([r["doc_id"] for r in rows]), x, np.array([r["grade"] for r in rows], dtype=np.float32)


def fit(x: np.ndarray, grades: np.ndarray) -> LevelModel:
    """The ranker on the first rows, the levels on the HELD share at the end; on all rows both if there are under 100."""
    if not len(x):
        size = SYNTAX + STEMS
        return LevelModel(np.zeros(size), np.ones(size), np.zeros(size), np.array([]), np.array([]))
    k = len(x) if len(x) < 100 else int(len(x) * (1 - HELD))
    mean, scale = x[:k].mean(0), x[:k].std(0) + 0.05
    w = rank_weights((x[:k] - mean) / scale, grades[:k])
    held = slice(k, None) if k < len(x) else slice(None)
    knots, values = isotonic(((x[held] - mean) / scale) @ w, grades[held])
    return LevelModel(mean, scale, w, knots, values)


def score_documents(documents: DataFrame, model: LevelModel) -> DataFrame:
    """doc_id, score, calibrated, level of every document; null for null, empty and blank texts and texts without words.

    Repeated rows give repeated rows. Other columns aren't looked at.
    """

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            for at in range(0, len(whole), ROWS):
                b = whole.iloc[at : at + ROWS]
                x = np.zeros((len(b), SYNTAX + STEMS), dtype=np.float32)
                empty = ~np.fromiter((fill_features(t, row) for t, row in zip(b["text"], x)), dtype=bool, count=len(b))
                s = model.scores(x).astype(np.float64)
                c = np.asarray(model.calibrated(s), dtype=np.float64)
                columns = {"score": s, "calibrated": c, "level": np.clip(np.floor(c + 0.5), *LEVELS)}
                kinds = {"score": "Float64", "calibrated": "Float64", "level": "Int32"}
                yield pd.DataFrame({"doc_id": b["doc_id"].to_numpy()} | {k: pd.Series(v).mask(empty).astype(kinds[k]) for k, v in columns.items()})

    return documents.select("doc_id", "text").mapInPandas(score, f"doc_id {dict(documents.dtypes)['doc_id']}, score double, calibrated double, level int")


def reading_levels(documents: DataFrame, labels: DataFrame, limit: int = GRADED) -> DataFrame:
    """score_documents with a model fitted on the labels. Without any grade every text with words is in the middle."""
    _, x, grades = graded_features(documents, labels, limit)
    return score_documents(documents, fit(x, grades))
