"""Quality rules: a learned, ordered list of threshold conjunctions, applied as one Spark CASE expression.

Sequential covering in the RIPPER manner. Labelled statistics are split by a hash of the key into rows to grow
on and rows to prune on. A rule grows by the threshold test with the best information gain until it covers no
kept row, is pruned from its end while that raises its precision on the pruning rows, and is accepted if it is
precise enough there; the rows it covers leave, and the next rule starts. Documents that no rule rejects stay.

Statistics and verdicts are DataFrame functions only. The learner sees a bounded sample of labelled rows (ten
numbers each) on the driver, where covered rows are bits of Python integers.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm._shared import SPACE, WORD, let, one_each, spaced

#: The numbers that a rule may test, each a Column of the statistics below.
MEASURES = ("n_words", "mean_word_chars", "symbol_share", "dup_line_share", "repeat_share", "upper_share", "bang_share", "words_a_line")


def _repeated_words(words: Column) -> Column:
    """Words that lie in a 3-word window found twice or more in the same text, the first one included.

    Windows are compared by 64-bit hashes. Texts without an equal pair of hashes, nearly all, stop at a hash
    set; the others sort (hash, position) and mark the neighbours that agree.
    """
    windows = F.when(F.size(words) < 3, F.array().cast("array<bigint>")).otherwise(
        F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))
    )

    def covered(found: Column) -> Column:
        ordered = F.sort_array(F.transform(found, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        twice = let(ordered, lambda s: F.transform(F.filter(s, lambda x, k: (F.get(s, k - 1)["h"] == x["h"]) | (F.get(s, k + 1)["h"] == x["h"])), lambda x: x["i"]))
        return F.size(F.array_distinct(F.flatten(F.transform(twice, lambda i: F.array(i, i + 1, i + 2)))))

    return let(windows, lambda w: F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0)).otherwise(covered(w)))


def statistics(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long) and the MEASURES, of whole texts.

    A null or blank text has no words: all counts are 0 and all shares 0.0. Other columns of df are not read.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    without = lambda pattern: F.length(whole) - F.length(F.regexp_replace(whole, pattern, ""))
    lines = F.filter(F.split(whole, "\n"), lambda x: x.rlike(WORD))
    word_list = F.array_remove(F.split(spaced(F.col(text)), " "), "")
    counts = df.select(
        F.col(key),
        let(word_list, lambda w: F.struct(F.size(w).cast("long").alias("words"), _repeated_words(w).cast("long").alias("repeated"))).alias("_w"),
        let(lines, lambda x: F.struct(F.size(x).cast("long").alias("lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("again"))).alias("_l"),
        F.length(F.regexp_replace(whole, SPACE, "")).cast("long").alias("word_chars"),
        without(r"[#*$%&|<>]").cast("long").alias("n_symbols"),
        without(r"\p{Lu}").cast("long").alias("_upper"),
        without("!").cast("long").alias("_bang"),
    )
    share = lambda part, whole_: F.col(part) / F.greatest(F.col(whole_), F.lit(1))
    return (
        counts.select(
            key,
            F.col("_w.words").alias("n_words"),
            "word_chars",
            "n_symbols",
            F.col("_l.again").alias("n_dup_lines"),
            F.col("_w.repeated").alias("n_repeat_words"),
            F.col("_l.lines").alias("_lines"),
            "_upper",
            "_bang",
        )
        .select(
            "*",
            share("word_chars", "n_words").alias("mean_word_chars"),
            share("n_symbols", "word_chars").alias("symbol_share"),
            share("n_dup_lines", "_lines").alias("dup_line_share"),
            share("n_repeat_words", "n_words").alias("repeat_share"),
            share("_upper", "word_chars").alias("upper_share"),
            share("_bang", "word_chars").alias("bang_share"),
            share("n_words", "_lines").alias("words_a_line"),
        )
        .drop("_lines", "_upper", "_bang")
    )


def base_failed() -> Column:
    """The fixed floor under the learned rules."""
    return (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)


@dataclass(frozen=True)
class Test:
    """One threshold: measure > cut, or measure <= cut."""

    measure: str
    above: bool
    cut: float

    def column(self) -> Column:
        c = F.col(self.measure)
        return c > F.lit(self.cut) if self.above else c <= F.lit(self.cut)

    def holds(self, row: dict[str, float]) -> bool:
        return (row[self.measure] > self.cut) == self.above

    def __str__(self) -> str:
        return f"{self.measure} {'>' if self.above else '<='} {self.cut:.6g}"


@dataclass
class DecisionList:
    """Ordered rules; the first that holds rejects, and a row that none rejects is kept."""

    rules: list[tuple[Test, ...]] = field(default_factory=list)

    def kept(self) -> Column:
        verdict = None
        for rule in self.rules:
            test = rule[0].column()
            for more in rule[1:]:
                test = test & more.column()
            verdict = F.when(test, F.lit(False)) if verdict is None else verdict.when(test, F.lit(False))
        return F.lit(True) if verdict is None else verdict.otherwise(F.lit(True))

    def keeps(self, row: dict[str, float]) -> bool:
        return not any(all(t.holds(row) for t in rule) for rule in self.rules)

    def __str__(self) -> str:
        return "\n".join([*("reject if " + " and ".join(map(str, r)) for r in self.rules), "keep"])


def _gain(rejects: int, keeps: int, p: int, n: int) -> float:
    """FOIL's gain of going from (rejects, keeps) covered to (p, n)."""
    if not p:
        return -1.0
    return p * (math.log2(p / (p + n)) - math.log2(rejects / (rejects + keeps)))


def learn(rows: list[dict], label: str = "quality", cuts: int = 48, max_rules: int = 16, max_tests: int = 4, precision: float = 0.9, least: int = 3) -> DecisionList:
    """A decision list from labelled statistics; label 0 is to be rejected.

    rows: the MEASURES, the label, and `fold` (0, 1: grow; 2: prune). Thresholds are midpoints at `cuts`
    quantiles of each measure. A rule is accepted if, on the pruning rows it covers, at least `precision` are
    to be rejected and at least `least` of all rows it covers are. Rows without a label (null) are ignored;
    with one class only, or no rows, the list is empty and keeps everything.
    """
    rows = [r for r in rows if r[label] is not None]
    bits = lambda test: sum(1 << i for i, r in enumerate(rows) if test(r))
    bad, grow = bits(lambda r: r[label] == 0), bits(lambda r: r["fold"] != 2)
    everything = (1 << len(rows)) - 1
    good, prune = everything & ~bad, everything & ~grow
    masks: dict[Test, int] = {}
    for m in MEASURES:
        values = sorted({r[m] for r in rows})
        places = sorted({round(k * (len(values) - 2) / max(1, cuts - 1)) for k in range(cuts)}) if len(values) > 1 else []
        for k in places:
            cut = (values[k] + values[k + 1]) / 2
            masks[Test(m, True, cut)] = up = bits(lambda r, m=m, cut=cut: r[m] > cut)
            masks[Test(m, False, cut)] = everything & ~up

    rules: list[tuple[Test, ...]] = []
    left = everything
    while len(rules) < max_rules and (left & bad & grow):
        covered, rule = left, []
        while len(rule) < max_tests and (covered & good & grow):
            p0, n0 = (covered & grow & bad).bit_count(), (covered & grow & good).bit_count()
            best = max(masks, key=lambda t: _gain(p0, n0, (masks[t] & covered & grow & bad).bit_count(), (masks[t] & covered & grow & good).bit_count()), default=None)
            if best is None or _gain(p0, n0, (masks[best] & covered & grow & bad).bit_count(), (masks[best] & covered & grow & good).bit_count()) <= 0:
                break
            rule.append(best)
            covered &= masks[best]

        def worth(tests: list[Test], left: int = left) -> float:
            at = left & prune
            for t in tests:
                at &= masks[t]
            p, n = (at & bad).bit_count(), (at & good).bit_count()
            return (p + 1) / (p + n + 2)

        while len(rule) > 1 and worth(rule[:-1]) >= worth(rule):
            rule.pop()
        covered = left
        for t in rule:
            covered &= masks[t]
        p, n = (covered & bad).bit_count(), (covered & good).bit_count()
        if not rule or p < least or p < precision * (p + n) or worth(rule) < min(precision, 0.8):
            break
        rules.append(tuple(rule))
        left &= ~covered
    return DecisionList(rules)


def fit(df: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", max_rows: int = 20_000) -> DecisionList:
    """Learn from at most max_rows labelled rows, those whose hashed key is smallest (a bounded, repeatable sample).

    Labelled keys without a document, and null labels or keys, teach nothing; of rows with the same key the one with
    the least text does. The sample is at most max_rows
    pairs of numbers, so it can be broadcast; texts outside it are not measured here.
    """
    sample = (
        labels.where(F.col(label).isNotNull() & F.col(key).isNotNull())
        .groupBy(F.col(key).alias("_labelled"))
        .agg(F.min(label).cast("int").alias("_label"))
        .orderBy(F.xxhash64("_labelled"), "_labelled")
        .limit(max_rows)
    )
    chosen = df.select(F.col(key).alias("_labelled"), F.col(text).alias("_text")).join(F.broadcast(sample), "_labelled")
    chosen = one_each(chosen, "_labelled", "_text")
    measured = statistics(chosen, "_labelled", "_text").join(F.broadcast(sample), "_labelled")
    measured = measured.select(*(F.col(m).cast("double").alias(m) for m in MEASURES), F.col("_label").alias(label), F.pmod(F.xxhash64(F.lit(7), "_labelled"), F.lit(3)).cast("int").alias("fold"))
    return learn(sorted((r.asDict() for r in measured.collect()), key=lambda r: tuple(r[m] for m in MEASURES)), label)


def judge(df: DataFrame, rules: DecisionList, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, the five counts, base_failed, kept (false where base_failed, else the list's verdict) and the MEASURES.

    One row for each row of df, null and repeated keys included; other columns of df are not read.
    """
    told = statistics(df, key, text).withColumn("base_failed", base_failed())
    return told.select(
        key,
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        (~F.col("base_failed") & rules.kept()).alias("kept"),
        *(m for m in MEASURES if m != "n_words"),
    )
