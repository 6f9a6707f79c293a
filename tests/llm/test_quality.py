"""The rule ensemble: statistics in plain Python, rules in numpy, weights by their optimality conditions."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from rideops.llm import quality
from tests.llm import brute


def plain(text: str | None) -> list[float]:
    t = text or ""
    words, n = [w for w in re.split(r"[\x20\x09-\x0D]+", t) if w], len(t)

    def ratio(a, b):
        return a / b if b else 0.0

    def share(chars, of):
        return ratio(sum(c in chars for c in t), of)

    return [n, len(words), ratio(sum(c not in " \n\t\r" for c in t), len(words)), share("ABCDEFGHIJKLMNOPQRSTUVWXYZ", n), share("0123456789", n), share(quality.SYMBOLS, n),
            share("!?", n), share(".,;:", len(words)), share("|", len(words)), ratio(n, t.count("\n") + 1), ratio(len(set(words)), len(words))]


def test_statistics_equal_plain_ones(spark):
    rows = brute.corpus(11) + [(900, "A|B!! 12,3.\nÜ;? x\r\ny\x0bz", None, None, None)]
    stats = quality.statistics(F.col("text"))
    out = spark.createDataFrame(rows, brute.DOCS).select("doc_id", *[c.alias(n) for n, c in stats.items()])
    for r in out.collect():
        assert list(r)[1:] == pytest.approx(plain(dict((x[0], x[1]) for x in rows)[r.doc_id]))


def test_scores_equal_rules_in_numpy(spark):
    """The compiled expression against the rules one by one; weights meet the lasso's conditions."""
    rng, words = random.Random(3), [f"w{i}" for i in range(50)]
    rows = []
    for i in range(900):
        n, marks = rng.randint(5, 60), rng.choice([0, 0, rng.randint(1, 9)])
        text = " ".join(rng.choice(words) for _ in range(n)) + "!" * marks + "|" * rng.randint(0, 3)
        rows.append((i, text, int((n > 30 and marks < 4) != (rng.random() < 0.15))))
    stats = quality.statistics(F.col("text"))
    names = list(stats)
    df = spark.createDataFrame(rows, "doc_id long, text string, quality int").select("doc_id", "quality", *[c.alias(n) for n, c in stats.items()]).cache()
    model = quality.train(df, names)
    assert len(model.rules) > 3
    got = df.withColumn("score", model.score()).orderBy("doc_id").toPandas()
    x = np.array([plain(t) for _, t, _ in rows])
    margin = np.full(len(rows), model.intercept)
    for rule, weight in model.rules:
        margin += weight * np.array([all((row[f] > cut) == up for f, up, cut in rule.terms) for row in x])
    assert got["score"].to_numpy() == pytest.approx(1 / (1 + np.exp(-margin)))

    y = np.array([r[2] for r in rows], float)
    z = np.stack([r.holds(x) for r in quality.tree_rules(x, y)], 1).astype(float)
    b, w = quality.lasso_weights(z, y, steps=6000)
    grad = z.T @ (1 / (1 + np.exp(-(b + z @ w))) - y) / len(y)
    assert np.abs(grad[w == 0]).max() <= quality.PENALTY + 1e-4
    assert grad[w != 0] == pytest.approx(-quality.PENALTY * np.sign(w[w != 0]), abs=2e-4)
