"""Problem 8: a mix of sources in target shares of tokens.

Every distinct text gets a rate, the expected number of its copies. Rates are the closest to one copy each,
in relative entropy, that give each source its tokens: exponentially tilted in the text's size and cut at
the source's cap. The tilts solve a convex dual, separable by source, by Newton iterations whose sums are
distributed aggregations over the table of sizes; only one row per source reaches the driver. Rates are
rounded into copies with a threshold per source that makes the sum of tokens come out.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from specloom.llm.tokenize import VOCABULARY, encoder
from specloom.session import collect_bounded, cut, ship_file

#: Sources of a mix; each is one row of the target table.
SOURCES = 1_000
ROUNDS = 60
#: Steps of the rounding threshold.
STEPS = 4096


@dataclass(frozen=True)
class Target:
    share: float
    repeats: int


def targets_of(targets: DataFrame) -> dict[str, Target]:
    """Rows without a source, a positive share or a cap of one at least ask for nothing and are left out; the last of a repeated source counts."""
    rows = collect_bounded(targets.select("source", "target_share", "max_repeats").orderBy("source", "target_share", "max_repeats"), SOURCES, "table of targets")
    return {r["source"]: Target(r["target_share"], r["max_repeats"]) for r in rows if r["source"] is not None and (r["target_share"] or 0) > 0 and (r["max_repeats"] or 0) > 0}


def sizes(documents: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """doc_id, source, text_hash, n_tokens of every document with a source and a text that isn't blank. A map without shuffle."""

    ship_file(documents.sparkSession, path)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for b in batches:
            texts = b.column("text").to_pylist()
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("source"), pa.array([hashlib.md5(t.encode("utf-8", "replace")).digest() for t in texts], pa.binary()), pa.array([len(enc.encode(t)) for t in texts], pa.int64())],
                names=["doc_id", "source", "text_hash", "n_tokens"],
            )

    wanted = documents.where(F.col("source").isNotNull() & F.col("text").isNotNull() & F.col("text").rlike(r"(?U)\S")).select("doc_id", "source", "text")
    return wanted.mapInArrow(measure, f"doc_id {dict(documents.dtypes)['doc_id']}, source string, text_hash binary, n_tokens long")


def by_source(values: dict[str, float], default: float = 0.0) -> Column:
    """A value per source as an expression."""
    if not values:
        return F.lit(default)
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in sorted(values.items()) for x in kv]), F.col("source")), F.lit(default))


def distinct_texts(measured: DataFrame, targets: dict[str, Target]) -> DataFrame:
    """doc_id, source, n_tokens, cap: each distinct text once, under the source of its smallest doc_id.

    A text found in several sources keeps the smallest of their caps, so that no source's limit is passed.
    """
    caps = {s: float(t.repeats) for s, t in targets.items()}
    known = measured.where(F.col("source").isin(list(targets) or [""])).withColumn("cap", by_source(caps))
    one = known.groupBy("text_hash").agg(F.min(F.struct("doc_id", "source")).alias("first"), F.min("n_tokens").alias("n_tokens"), F.min("cap").alias("cap"))
    return one.select(F.col("first.doc_id").alias("doc_id"), F.col("first.source").alias("source"), "n_tokens", "cap")


def rate(tilt: Column, scale: Column) -> Column:
    """Copies expected of a text, before the cap is looked at: one, tilted by its size."""
    return F.exp(F.least(tilt * F.col("n_tokens") / scale, F.lit(50.0)))


def solve_tilts(table: DataFrame, wanted: dict[str, float], mean: dict[str, float], rounds: int = ROUNDS) -> dict[str, float]:
    """For each source the tilt at which its expected tokens are as wanted.

    table: source, n_tokens, cap, texts, the counts of equal texts. Newton steps on the dual; a step that
    leaves the bracket known so far is replaced by its middle, so the iteration always ends.
    """
    tilt = dict.fromkeys(wanted, 0.0)
    low, high = dict.fromkeys(wanted, -50.0), dict.fromkeys(wanted, 50.0)
    open_ = set(wanted)
    for _ in range(rounds):
        if not open_:
            break
        r = rate(by_source(tilt), by_source(mean, 1.0))
        tokens = F.sum(F.col("texts") * F.col("n_tokens") * F.least(r, F.col("cap"))).alias("tokens")
        slope = F.sum(F.when(r < F.col("cap"), F.col("texts") * F.col("n_tokens") * r * F.col("n_tokens") / by_source(mean, 1.0)).otherwise(0.0)).alias("slope")
        for row in table.where(F.col("source").isin(sorted(open_))).groupBy("source").agg(tokens, slope).collect():  # a row per source
            s, gap = row["source"], row["tokens"] - wanted[row["source"]]
            if abs(gap) <= 1e-6 * max(1.0, wanted[s]) or high[s] - low[s] < 1e-9:
                open_.discard(s)
                continue
            (high if gap > 0 else low)[s] = tilt[s]
            step = tilt[s] - gap / row["slope"] if row["slope"] else math.inf
            tilt[s] = step if low[s] < step < high[s] else (low[s] + high[s]) / 2
    return tilt


def mix(documents: DataFrame, targets: DataFrame, total: float | None = None, path: str = VOCABULARY) -> DataFrame:
    """doc_id, source, n_tokens, copies, cap: how often each distinct text goes into the mix, 0 included.

    total: tokens of the mix; unset, the most at which every source that has texts can give its share. A
    source without texts gives nothing, and the others keep their proportions. A source that can't give its
    share of a set total gives all it has. Null sources, sources without a target and blank texts have no
    part. Equal texts count as one, so no text is used more often than its source's cap. Empty tables give
    an empty mix.
    """
    wanted_of = targets_of(targets)
    texts = cut(distinct_texts(sizes(documents, path), wanted_of))
    table = cut(texts.groupBy("source", "n_tokens", "cap").agg(F.count("*").alias("texts")))
    have = {r["source"]: r for r in table.groupBy("source").agg(F.sum(F.col("texts") * F.col("n_tokens") * F.col("cap")).alias("most"), F.sum(F.col("texts") * F.col("n_tokens")).alias("tokens"), F.sum("texts").alias("n")).collect()}  # a row per source
    have = {s: r for s, r in have.items() if r["most"] > 0}
    whole = sum(wanted_of[s].share for s in have)
    size = total if total is not None else min((r["most"] * whole / wanted_of[s].share for s, r in have.items()), default=0.0)
    goal = {s: size * wanted_of[s].share / whole for s in have}
    mean = {s: r["tokens"] / r["n"] for s, r in have.items()}
    full = {s for s, r in have.items() if goal[s] >= r["most"] * (1 - 1e-9)}
    tilt = solve_tilts(table, {s: g for s, g in goal.items() if s not in full}, mean)
    tilt |= dict.fromkeys(full, math.inf)
    rated = texts.withColumn("rate", F.when(F.col("source").isin(sorted(full) or [""]), F.col("cap")).otherwise(F.least(F.col("cap"), rate(by_source({s: t for s, t in tilt.items() if t < math.inf}), by_source(mean, 1.0)))))
    rated = rated.withColumn("floor", F.floor("rate").cast("double")).withColumn("chance", (F.pmod(F.xxhash64("doc_id", F.lit("mix")), F.lit(1 << 40)) / float(1 << 40)) - (F.col("rate") - F.col("floor")))
    shift = _thresholds(rated, goal)
    copies = F.least(F.col("cap"), F.col("floor") + F.when(F.col("chance") < by_source(shift), 1.0).otherwise(0.0))
    return rated.select("doc_id", "source", "n_tokens", copies.cast("int").alias("copies"), F.col("cap").cast("int").alias("cap"))


def _thresholds(rated: DataFrame, goal: dict[str, float]) -> dict[str, float]:
    """For each source the threshold of rounding up at which its tokens are nearest to the goal.

    Tokens are summed by steps of the chance, at most 2 * STEPS for a source, and a window over these sums finds the
    step; a row per source comes to the driver.
    """
    step = F.floor(F.col("chance") * STEPS).cast("int")
    rows = rated.groupBy("source", step.alias("step")).agg(F.sum(F.when(F.col("floor") < F.col("cap"), F.col("n_tokens")).otherwise(0)).alias("more"), F.sum(F.col("floor") * F.col("n_tokens")).alias("sure"))
    of = Window.partitionBy("source")
    sure, want = F.sum("sure").over(of), by_source(goal)
    rows = rows.withColumn("gap", F.abs(sure + F.sum("more").over(of.orderBy("step")) - want)).withColumn("without", F.abs(sure - want))
    best = rows.groupBy("source").agg(F.min(F.struct("gap", "step")).alias("best"), F.first("without").alias("without")).collect()  # a row per source
    return dict.fromkeys(goal, -1.0) | {r["source"]: (r["best"]["step"] + 1) / STEPS if r["best"]["gap"] < r["without"] else -1.0 for r in best if r["source"] in goal}


def shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """source, target_share, texts, tokens, most_copies, reached_share: a row for each target, with 0 for a source that gave nothing."""
    used = mixed.where(F.col("copies") > 0).groupBy("source").agg(F.count("*").alias("texts"), F.sum(F.col("copies") * F.col("n_tokens")).alias("tokens"), F.max("copies").alias("most_copies"))
    asked = targets.where(F.col("source").isNotNull()).groupBy("source").agg(F.max("target_share").alias("target_share"))
    joined = asked.join(F.broadcast(used), "source", "left").fillna(0, ["texts", "tokens", "most_copies"])  # a row per source
    total = joined.agg(F.sum("tokens").alias("total"))
    return joined.crossJoin(F.broadcast(total)).select("source", "target_share", "texts", "tokens", "most_copies", F.when(F.col("total") > 0, F.round(F.col("tokens") / F.col("total"), 6)).otherwise(0.0).alias("reached_share"))
