"""Toxicity: cumulative-link ordinal regression from sparse word features to an expected severity.

Grades 0 to TOP are ordered. One weight vector gives every text a score s, and ordered thresholds cut the scores:
P(grade <= k) = sigmoid(threshold_k - s). All thresholds share the weights, so a word that raises the chance of
grade 1 raises that of grades 2 and 3 too. The output is the expected grade, the sum of P(grade > k).

Labels say toxic or not. Among toxic training rows the grade is the third in which their number of marked words
falls: marked words have a key (below) that occurs in at least MARKED_ROWS training rows, nearly all of them toxic.

Features are words and word beginnings of 3 to 8 characters (insults of inflected languages share a root), each
at the LEVELS "occurs once, twice, four times or more". The FEATURES of them whose occurrence differs most between
toxic and other training rows, by the z statistic of two proportions, are kept. Words are lower-cased and
stripped of punctuation.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm._shared import one_each, stored, tidied
from quillon.llm.byte_cnn import held_out

TOP, FEATURES, MARKED_ROWS, MARKED_SHARE = 3, 1_024, 5, 0.9
LEVELS = (1, 2, 4)
STRIP = "".join(map(chr, range(33, 48))) + ":;<=>?@[\\]^_`{|}~«»“”‘’…¡¿"
#: Words that a worker remembers before it starts afresh.
REMEMBERED = 500_000


def tokens(text: str | None) -> list[str]:
    """Words in order, lower-cased, without punctuation at either end; none for a null or blank text."""
    return [w for w in (raw.strip(STRIP) for raw in (text or "").lower().split()) if w]


def keys(word: str) -> list[str]:
    """The word, and its beginnings, which end in a star."""
    return [word, *(word[:k] + "*" for k in range(3, min(9, len(word))))]


def occurrences(text: str | None) -> dict[str, int]:
    """How often each key of a text occurs."""
    found: dict[str, int] = {}
    for w in tokens(text):
        found[w] = found.get(w, 0) + 1
    out: dict[str, int] = {}
    for w, n in found.items():
        for k in keys(w):
            out[k] = out.get(k, 0) + n
    return out


@dataclass
class Severity:
    """Features as (key, level) with their weights, and the thresholds in ascending order."""

    features: list[tuple[str, int]] = field(default_factory=list)
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    thresholds: np.ndarray = field(default_factory=lambda: np.full(TOP, 10.0))

    def above(self, score: float | np.ndarray) -> np.ndarray:
        """P(grade > k) for k = 0 .. TOP - 1."""
        return 1 / (1 + np.exp(np.clip(self.thresholds - np.expand_dims(score, -1), -30, 30)))


def fit_ordinal(x: np.ndarray, grade: np.ndarray, steps: int = 500, rate: float = 0.05, ridge: float = 5e-5) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ascending thresholds of the cumulative-link model, by full-batch Adam on the penalised likelihood.

    Thresholds are a first value and positive gaps, so they cannot cross. Grades that no row has leave their
    threshold to the penalty on gaps.
    """
    n, d = x.shape
    p = np.zeros(d + TOP)
    p[d] = 2.0
    first, second = np.zeros_like(p), np.zeros_like(p)
    top, bottom = grade == TOP, grade == 0
    for t in range(1, steps + 1):
        gaps = np.exp(p[d + 1 :])
        cut = p[d] + np.concatenate([[0.0], np.cumsum(gaps)])
        s = (x @ p[:d].astype(x.dtype)).astype(float)
        up = np.where(top, 1.0, 1 / (1 + np.exp(-np.clip(cut[np.minimum(grade, TOP - 1)] - s, -30, 30))))
        low = np.where(bottom, 0.0, 1 / (1 + np.exp(-np.clip(cut[np.maximum(grade, 1) - 1] - s, -30, 30))))
        chance = np.maximum(up - low, 1e-9)
        d_up, d_low = up * (1 - up) / chance, low * (1 - low) / chance
        g_cut = np.zeros(TOP)
        np.add.at(g_cut, np.minimum(grade, TOP - 1), -np.where(top, 0, d_up))
        np.add.at(g_cut, np.maximum(grade, 1) - 1, np.where(bottom, 0, d_low))
        tail = np.cumsum(g_cut[::-1])[::-1]
        g = np.concatenate([(d_up - d_low).astype(x.dtype) @ x, tail[:1], tail[1:] * gaps]) / n
        g[:d] += ridge * p[:d]
        g[d + 1 :] += 1e-4 * p[d + 1 :]
        first = 0.9 * first + 0.1 * g
        second = 0.999 * second + 0.001 * g * g
        p -= rate * (1 - 0.9 * t / steps) * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-9)
    return p[:d], p[d] + np.concatenate([[0.0], np.cumsum(np.exp(p[d + 1 :]))])


def fit(df: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", max_rows: int = 12_000) -> Severity:
    """Learn from at most max_rows labelled rows that are not held out, those whose hashed key is smallest.

    Of rows of df that share a labelled key the one with the least text is taken, so that repeats do not add to the sample.
    Rows are counted by feature over the sample in Spark; the driver sees FEATURES features and, for each sampled
    row, which of them it has. With one class only, or no rows, every text has a severity near that class's.
    """
    few = (
        labels.where(F.col(label).isNotNull() & F.col(key).isNotNull() & ~held_out(F.col(key)))
        .groupBy(F.col(key).alias("_k"))
        .agg(F.max(label).cast("int").alias("toxic"))
        .orderBy(F.xxhash64("_k"), "_k")
        .limit(max_rows)
    )
    rows = df.select(F.col(key).alias("_k"), F.col(text).alias("text")).join(F.broadcast(few), "_k")  # max_rows pairs of numbers
    rows = one_each(rows, "_k", "text", "toxic")
    rows = stored(rows.select(F.xxhash64("_k", "text").alias("at"), "toxic", "text"), "toxicity-sample")
    totals = {r.toxic: r.n for r in rows.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    n1, n0 = totals.get(1, 0), totals.get(0, 0)
    if not n1 or not n0:
        return Severity(thresholds=np.array([-10.0, 10.0, 10.0]) if n1 else np.full(TOP, 10.0))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, int], list[int]] = {}

        def told() -> pa.RecordBatch:
            columns = [pa.array([k for k, _ in held], pa.string()), pa.array([v for _, v in held], pa.int32()), pa.array([x[0] for x in held.values()], pa.int64()), pa.array([x[1] for x in held.values()], pa.int64())]
            return pa.RecordBatch.from_arrays(columns, ["key", "level", "in_toxic", "n"])

        for batch in batches:
            for toxic, raw in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                for k, n in occurrences(raw).items():
                    for level in LEVELS:
                        if n >= level:
                            own = held.setdefault((k, level), [0, 0])
                            own[0] += toxic
                            own[1] += 1
                if len(held) > REMEMBERED:
                    yield told()
                    held = {}
        yield told()

    found = rows.mapInArrow(tidied(counted), "key string, level int, in_toxic long, n long").groupBy("key", "level").agg(F.sum("in_toxic").alias("in_toxic"), F.sum("n").alias("n"))
    share = F.col("n") / F.lit(float(n1 + n0))
    gap = F.col("in_toxic") / F.lit(float(n1)) - (F.col("n") - F.col("in_toxic")) / F.lit(float(n0))
    z = gap / F.sqrt(share * (1 - share) * F.lit(1 / n1 + 1 / n0) + F.lit(1e-12))
    chosen = found.select("key", "level", "in_toxic", "n", F.abs(z).alias("z")).orderBy(F.col("z").desc(), "key", "level").limit(FEATURES).collect()
    features = [(r.key, r.level) for r in chosen]
    marked = {r.key for r in chosen if r.level == 1 and r.in_toxic >= MARKED_ROWS and r.in_toxic >= MARKED_SHARE * r.n}

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            had, counts = [], []
            for raw in batch.column(2).to_pylist():
                seen = occurrences(raw)
                had.append([i for i, (k, level) in enumerate(features) if seen.get(k, 0) >= level])
                counts.append(sum(any(k in marked for k in keys(w)) for w in tokens(raw)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(counts, pa.int64()), pa.array(had, pa.list_(pa.int32()))], ["at", "toxic", "marks", "has"])

    sample = sorted(rows.mapInArrow(tidied(vectors), "at long, toxic int, marks long, has array<int>").collect(), key=lambda r: (r.at, r.toxic))
    x = np.zeros((len(sample), len(features)), np.float32)
    for i, r in enumerate(sample):
        x[i, r.has] = 1
    toxic, marks = np.array([r.toxic for r in sample]), np.array([r.marks for r in sample])
    thirds = np.quantile(marks[toxic == 1], [1 / 3, 2 / 3])
    level = np.where(toxic == 1, 1 + np.searchsorted(thirds, marks, side="left"), 0)
    return Severity(features, *fit_ordinal(x, level))


def grade(df: DataFrame, model: Severity, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, held_out, severity, grade, score, predicted: one row for each row of df.

    severity is the expected grade (0 to TOP), grade the most probable one (the lower of equals), score the
    probability of grade 1 or more and predicted whether that is 0.5 or more. Whole texts are read; a null or
    blank text has no features. Other columns of df are not read.
    """
    places: dict[str, int] = {}
    for k, _ in model.features:
        places.setdefault(k, len(places))
    weights = np.zeros((len(places) + 1, len(LEVELS)))
    for (k, level), w in zip(model.features, model.weights, strict=True):
        weights[places[k], LEVELS.index(level)] = w
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple[int, ...]] = {}  # the places of the keys of a raw word

        def found(raw: str) -> tuple[int, ...]:
            if len(known) >= REMEMBERED:
                known.clear()
            w = raw.strip(STRIP)
            known[raw] = out = tuple(places[k] for k in keys(w) if k in places) if w else ()
            return out

        for batch in batches:
            scores = np.zeros(batch.num_rows)
            row = 0
            for at in range(0, batch.num_rows, 256):
                for t in batch.column(1).slice(at, 256).to_pylist():
                    held = [p for w in (t or "").lower().split() for p in (known[w] if w in known else found(w))]
                    if held:
                        where, counts = np.unique(held, return_counts=True)
                        scores[row] = sum(weights[where[counts >= level], i].sum() for i, level in enumerate(LEVELS))
                    row += 1
            above = model.above(scores)
            chances = np.concatenate([1 - above[:, :1], above[:, :-1] - above[:, 1:], above[:, -1:]], axis=1)
            columns = [pa.array(above.sum(axis=1)), pa.array(chances.argmax(axis=1), pa.int32()), pa.array(above[:, 0])]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["_k", "severity", "grade", "score"])

    told = df.select(F.col(key).alias("_k"), F.col(text).alias("_text")).mapInArrow(tidied(run), f"_k {kind}, severity double, grade int, score double")
    return told.select(F.col("_k").alias(key), held_out(F.col("_k")).alias("held_out"), "severity", "grade", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
