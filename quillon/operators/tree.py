"""Exact decision trees, grown level by level: one aggregation finds every node's best split.

A node's candidates are midpoints between neighbouring distinct values of a feature. Rows are first counted by
(node, feature, value, class); the running class counts then see distinct values, not rows. `bins` replaces a
feature by that many approximate quantiles first, where it has more distinct values than one task should sort.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def impurity(counts: list[Column], criterion: str = "gini", n: Column | None = None) -> Column:
    """Gini 1 - sum p^2, or entropy -sum p log2 p, of class counts; 0 for no rows. n is their sum, if it is at hand."""
    n = sum(counts[1:], counts[0]) if n is None else n
    total = F.lit(0.0)
    for c in counts:
        p = F.try_divide(c.cast("double"), n.cast("double"))
        term = p * p if criterion == "gini" else F.when(c > 0, -p * F.log2(p)).otherwise(F.lit(0.0))
        total = total + F.coalesce(term, F.lit(0.0))
    return F.when(n == 0, F.lit(0.0)).otherwise(F.lit(1.0) - total if criterion == "gini" else total)


def best_splits(df: DataFrame, node: str, features: list[str], label: str, classes: list, criterion: str = "gini") -> DataFrame:
    """(node, feature, threshold, gain, n) of each node's best split with a positive gain.

    Equal gains go to the earlier feature, then to the smaller threshold. Values <= threshold go left.
    """
    long = df.select(F.col(node).alias("node"), F.col(label).alias("label"), F.explode(F.array(*(F.struct(F.lit(i).alias("feature"), F.col(f).cast("double").alias("value")) for i, f in enumerate(features)))).alias("f"))
    per = [F.sum((F.col("label") == c).cast("long")).alias(f"c{i}") for i, c in enumerate(classes)]
    counts = long.select("node", "label", "f.feature", "f.value").where("value is not null").groupBy("node", "feature", "value").agg(*per)
    order = Window.partitionBy("node", "feature").orderBy("value")
    upto, all_ = order.rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy("node", "feature")
    left = [F.sum(f"c{i}").over(upto) for i in range(len(classes))]
    whole = [F.sum(f"c{i}").over(all_) for i in range(len(classes))]
    cut = counts.select("node", "feature", "value", F.lead("value").over(order).alias("next"), *(c.alias(f"l{i}") for i, c in enumerate(left)), *(c.alias(f"a{i}") for i, c in enumerate(whole))).where("next is not null")
    ls, as_ = [F.col(f"l{i}") for i in range(len(classes))], [F.col(f"a{i}") for i in range(len(classes))]
    rs = [a - x for a, x in zip(as_, ls, strict=True)]
    cut = cut.select("*", sum(as_[1:], as_[0]).alias("n"), sum(ls[1:], ls[0]).alias("nl")).withColumn("nr", F.col("n") - F.col("nl"))
    parts = [impurity(cs, criterion, F.col(n)).alias(f"i{n}") for cs, n in ((as_, "n"), (ls, "nl"), (rs, "nr"))]
    gain = F.col("in") - (F.col("nl") * F.col("inl") + F.col("nr") * F.col("inr")) / F.col("n")
    scored = cut.select("node", "feature", "value", "next", "n", "nl", "nr", *parts)
    scored = scored.select("node", "feature", ((F.col("value") + F.col("next")) / 2).alias("threshold"), F.round(gain, 12).alias("gain"), "n")
    # the condition stands inside the aggregate: as a filter the optimizer would copy the whole gain into it, again and again
    best = F.min(F.when(F.col("gain") > 0, F.struct((-F.col("gain")).alias("g"), "feature", "threshold", "n"))).alias("b")
    return scored.groupBy("node").agg(best).where("b IS NOT NULL").select("node", "b.feature", "b.threshold", (-F.col("b.g")).alias("gain"), "b.n")


@dataclass
class Tree:
    """A fitted tree; nodes are numbered like a heap, the root 1."""

    features: list[str]
    label: str
    criterion: str = "gini"
    max_depth: int = 5
    bins: int | None = None
    splits: dict[int, tuple[int, float, float, int]] = field(default_factory=dict)
    leaves: dict[int, object] = field(default_factory=dict)
    classes: list = field(default_factory=list)

    def node(self) -> Column:
        """The leaf that a row falls into."""

        def at(k: int) -> Column:
            if k not in self.splits:
                return F.lit(k).cast("long")
            feature, threshold, _, _ = self.splits[k]
            return F.when(F.col(self.features[feature]).cast("double") <= F.lit(threshold), at(2 * k)).otherwise(at(2 * k + 1))

        return at(1)

    def fit(self, df: DataFrame) -> Tree:
        rows = df.select(*self.features, self.label)
        if self.bins:
            for f, cuts in zip(self.features, rows.approxQuantile(self.features, [i / self.bins for i in range(self.bins + 1)], 0.001), strict=True):
                at = F.lit(None).cast("double")
                for c in sorted(set(cuts), reverse=True):
                    at = F.when(F.col(f) <= c, F.lit(c)).otherwise(at)
                rows = rows.withColumn(f, at)
        rows = rows.persist()
        self.classes = sorted(r[0] for r in rows.select(self.label).where(F.col(self.label).isNotNull()).distinct().collect())
        growing = {1}
        for _ in range(self.max_depth):
            at = rows.withColumn("_node", self.node()).where(F.col("_node").isin(*growing))
            found = best_splits(at, "_node", self.features, self.label, self.classes, self.criterion).collect()  # one row a node
            if not found:
                break
            self.splits |= {r["node"]: (r["feature"], r["threshold"], r["gain"], r["n"]) for r in found}
            growing = {c for r in found for c in (2 * r["node"], 2 * r["node"] + 1)}
        counts = rows.withColumn("_node", self.node()).groupBy("_node", self.label).agg(F.count(F.lit(1)).alias("n"))
        best = counts.groupBy("_node").agg(F.min(F.struct((-F.col("n")).alias("n"), F.col(self.label).alias("label"))).alias("b"))
        self.leaves = {r["_node"]: r["b"]["label"] for r in best.collect()}
        rows.unpersist()
        return self

    def predict(self) -> Column:
        """The majority label of the row's leaf (of equal ones the first in order), as nested conditions."""

        def at(k: int) -> Column:
            if k not in self.splits:
                return F.lit(self.leaves.get(k))
            feature, threshold, _, _ = self.splits[k]
            return F.when(F.col(self.features[feature]).cast("double") <= F.lit(threshold), at(2 * k)).otherwise(at(2 * k + 1))

        return at(1)

    def importances(self) -> list[float]:
        """Each feature's gain times the share of rows it splits, over real splits only, adding up to 1."""
        total = [0.0] * len(self.features)
        if not self.splits:
            return total
        for feature, _, gain, n in self.splits.values():
            total[feature] += gain * n / self.splits[1][3]
        whole = math.fsum(total)
        return [x / whole for x in total]

    def dot(self) -> str:
        """The tree as a Graphviz graph."""
        lines = ["digraph tree {"]
        lines += [f'  n{k} [label="{self.features[f]} <= {t:.6g}\\ngain {g:.4f}, rows {n}"];' for k, (f, t, g, n) in sorted(self.splits.items())]
        lines += [f'  n{k} [label="{v}", shape=box];' for k, v in sorted(self.leaves.items())]
        lines += [f"  n{k} -> n{c};" for k in sorted(self.splits) for c in (2 * k, 2 * k + 1)]
        return "\n".join([*lines, "}"])
