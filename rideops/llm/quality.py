"""Quality by a sparse ensemble of rules over text statistics, compiled to column expressions."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rideops.llm.common import fold_of
from rideops.session import cut_lineage

#: Expected number of labelled rows fitted, trees, their depth, cut points per statistic, lasso penalty.
TRAIN_ROWS, TREES, DEPTH, CUTS, PENALTY = 20_000, 12, 3, 32, 2e-3
SYMBOLS = "#$%&*+<=>@\\^_{|}~"


def statistics(text: Column) -> dict[str, Column]:
    """Statistics of a whole text; null counts as empty, ratios of an empty text are 0."""
    t = F.coalesce(text, F.lit(""))
    words = F.filter(F.split(t, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    n, k = F.length(t).cast("double"), F.size(words).cast("double")

    def without(chars: str) -> Column:
        return n - F.length(F.translate(t, chars, ""))

    def ratio(a: Column, b: Column) -> Column:
        return F.coalesce(a / F.nullif(b, F.lit(0.0)), F.lit(0.0))

    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return {
        "chars": n, "words": k, "word_length": ratio(n - without(" \n\t\r"), k), "upper": ratio(without(upper), n),
        "digits": ratio(without("0123456789"), n), "symbols": ratio(without(SYMBOLS), n), "marks": ratio(without("!?"), n),
        "stops": ratio(without(".,;:"), k), "bars": ratio(without("|"), k), "line_length": ratio(n, without("\n") + 1),
        "distinct": ratio(F.size(F.array_distinct(words)).cast("double"), k),
    }


@dataclass(frozen=True)
class Rule:
    """A conjunction of (statistic, is greater, cut)."""

    terms: tuple[tuple[int, bool, float], ...]

    def holds(self, x: np.ndarray) -> np.ndarray:
        return reduce(np.logical_and, [(x[:, f] > c) == up for f, up, c in self.terms])

    def column(self, names: list[str]) -> Column:
        return reduce(lambda a, b: a & b, [F.col(names[f]) > c if up else F.col(names[f]) <= c for f, up, c in self.terms])


def _best_split(binned: np.ndarray, target: np.ndarray) -> tuple[float, int, int]:
    """(gain, statistic, bin) of the least squared error."""
    best, n, total = (0.0, -1, -1), len(target), target.sum()
    for f in range(binned.shape[1]):
        count = np.bincount(binned[:, f], minlength=CUTS + 1)[:-1].cumsum()
        value = np.bincount(binned[:, f], target, minlength=CUTS + 1)[:-1].cumsum()
        ok = (count >= 10) & (n - count >= 10)
        if ok.any():
            gain = np.where(ok, value ** 2 / np.maximum(count, 1) + (total - value) ** 2 / np.maximum(n - count, 1), -np.inf) - total ** 2 / n
            if gain.max() > best[0] + 1e-9:
                best = (float(gain.max()), f, int(gain.argmax()))
    return best


def tree_rules(x: np.ndarray, y: np.ndarray, seed: int = 7) -> list[Rule]:
    """All root-to-node paths of boosted regression trees, each on half of the rows."""
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, CUTS + 2)[1:-1])) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, f], "left") for f, c in enumerate(cuts)], 1)
    rng, margin, rules = np.random.default_rng(seed), np.zeros(len(y)), {}
    for _ in range(TREES):
        rest = y - 1 / (1 + np.exp(-margin))
        half = rng.random(len(y)) < 0.5
        todo = [((), np.ones(len(y), bool))]
        while todo:
            path, rows = todo.pop()
            fit = rows & half
            gain, f, b = _best_split(binned[fit], rest[fit]) if len(path) < DEPTH and fit.sum() >= 20 else (0.0, -1, -1)
            if f < 0 or b >= len(cuts[f]):
                margin[rows] += 0.5 * 4 * rest[fit].mean() if fit.any() else 0.0
                continue
            for up in (False, True):
                inner = rows & ((binned[:, f] > b) == up)
                todo.append(((*path, (f, up, float(cuts[f][b]))), inner))
                rules[Rule((*path, (f, up, float(cuts[f][b]))))] = None
    return list(rules)


def lasso_weights(z: np.ndarray, y: np.ndarray, penalty: float = PENALTY, steps: int = 600) -> tuple[float, np.ndarray]:
    """Logistic regression with an absolute penalty, by accelerated proximal gradient steps."""
    n = len(y)
    rate = 4.0 / max(np.linalg.norm(np.column_stack([np.ones(n), z]), 2) ** 2 / n, 1e-9)
    w = np.zeros(z.shape[1] + 1)
    v, t = w.copy(), 1.0
    for _ in range(steps):
        error = 1 / (1 + np.exp(-np.clip(v[0] + z @ v[1:], -30, 30))) - y
        new = v - rate * np.append(error.mean(), z.T @ error / n)
        new[1:] = np.sign(new[1:]) * np.maximum(np.abs(new[1:]) - rate * penalty, 0)
        after = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, w, t = new + (t - 1) / after * (new - w), new, after
    return float(w[0]), w[1:]


@dataclass
class Model:
    names: list[str]
    intercept: float
    rules: list[tuple[Rule, float]]

    def score(self) -> Column:
        """The ensemble as one Spark expression over the statistics' columns."""
        margin = reduce(lambda a, b: a + b, [F.when(r.column(self.names), w).otherwise(0.0) for r, w in self.rules], F.lit(self.intercept))
        return 1 / (1 + F.exp(-margin))


def train(rows: DataFrame, names: list[str], bound: int = TRAIN_ROWS) -> Model:
    """Fit on (doc_id, quality, statistics), about ``bound`` rows drawn by a hash of the id.

    The bounded sample of numbers is fitted on the driver. Without both labels the model is the
    smoothed share of label 1.
    """
    known = rows.where(F.col("quality").isin(0, 1))
    share = min(1.0, bound / max(known.count(), 1))
    drawn = known.where(F.pmod(F.xxhash64(F.lit("quality"), F.col("doc_id")), F.lit(1 << 20)) < F.lit(int(share * (1 << 20))))
    sample = drawn.select("doc_id", "quality", *names).toPandas().sort_values(["doc_id", *names])
    x, y = sample[names].to_numpy(float), sample["quality"].to_numpy(float)
    prior = (y.sum() + 1) / (len(y) + 2)
    if len(set(y.tolist())) < 2:
        return Model(names, float(np.log(prior / (1 - prior))), [])
    rules = tree_rules(x, y)
    if not rules:
        return Model(names, float(np.log(prior / (1 - prior))), [])
    intercept, weights = lasso_weights(np.stack([r.holds(x) for r in rules], 1).astype(float), y)
    return Model(names, intercept, [(r, float(w)) for r, w in zip(rules, weights) if abs(w) > 1e-6])


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Train on labelled documents whose fold of three is not 1, score all: one row per input row.

    Statistics are computed once, kept as a narrow checkpoint, and read by training and scoring.
    Null and empty texts have statistics 0 and are scored like any other; repeated rows stay.
    """
    stats = statistics(F.col("text"))
    names = [f"_s_{n}" for n in stats]
    held_out = (fold_of("doc_id", 3) == 1).alias("held_out")
    rows = cut_lineage(docs.select("doc_id", held_out, *[c.alias(f"_s_{n}") for n, c in stats.items()]))
    known = labels.where(fold_of("doc_id", 3) != 1).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    model = train(rows.where(~F.col("held_out")).join(known, "doc_id"), names)
    return rows.withColumn("score", model.score()).select(
        "doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
