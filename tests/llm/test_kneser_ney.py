"""The class models of the toxicity score against Kneser-Ney with dictionaries."""

from __future__ import annotations

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from rideops.llm import toxicity


def corpus(seed: int) -> list[tuple]:
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7))) for _ in range(60)] + ["the"] * 30
    rows = []
    for i in range(220):
        label = rng.choice([0, 0, 1, None])
        text = [rng.choice(words) for _ in range(rng.randint(0, 40))]
        if label:
            text += ["foulest", "of", "foul"] * rng.randint(0, 4)
        rows.append((i, " ".join(text) if i % 50 else None, label, False))
    return rows


def plain(rows) -> dict:
    """(previous word, word) -> log ratio, by the definition, over every pair of the corpus."""
    D, stem = toxicity.DISCOUNT, lambda w: w.encode()[:toxicity.STEM]
    pairs, seen = {1: Counter(), 0: Counter()}, defaultdict(set)
    for _, text, label, _ in rows:
        w = (text or "").split()
        for v, x in zip([None, *w], w):
            seen[x].add(v)
            if label is not None:
                pairs[label][v, x] += 1
    cont = {w: len(vs) for w, vs in seen.items()}
    stem_cont = Counter()
    for w, n in cont.items():
        stem_cont[stem(w)] += n
    word, stems, context, low_context = ({c: Counter() for c in (1, 0)} for _ in range(4))
    for c in (1, 0):
        for (v, w), n in pairs[c].items():
            word[c][w] += n
            stems[c][stem(w)] += n
            context[c][v] += n
            low_context[c][v] += min(n, D)

    def smoothed(counts, key, base):
        return (max(counts[key] - D, 0) + sum(min(n, D) for n in counts.values()) * base) / sum(counts.values())

    def p(c, v, w):
        f = smoothed(stems[c], stem(w), stem_cont[stem(w)] / sum(cont.values()))
        unigram = smoothed(word[c], w, f * cont[w] / stem_cont[stem(w)])
        gamma = low_context[c][v] / context[c][v] if context[c][v] else 1.0
        return max(pairs[c][v, w] - D, 0) / max(context[c][v], 1) + gamma * unigram

    return {(v, w): math.log(p(1, v, w) / p(0, v, w)) for w, vs in seen.items() for v in vs}


@pytest.mark.parametrize(("pack", "bucket_bytes", "hot"), [(1 << 20, 1 << 20, 1000), (500, 200, 10)])
def test_log_likelihoods(spark, monkeypatch, pack, bucket_bytes, hot):
    """Small packs, many buckets, and words so hot that their pairs are spread over all buckets."""
    monkeypatch.setattr(toxicity, "PACK", pack)
    monkeypatch.setattr(toxicity, "BUCKET_BYTES", bucket_bytes)
    monkeypatch.setattr(toxicity, "HOT", hot)
    rows = corpus(4)
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int, calibrate boolean").repartition(5)
    calibrating = [(1000 + i, "foulest of foul" if i % 2 else "the", i % 2, True) for i in range(10)]
    model = toxicity.train(df.unionByName(spark.createDataFrame(calibrating, df.schema)))
    if hot == 10:
        assert len(toxicity.hot_words(df)) >= 1
    want, hasher = plain(rows), toxicity.WordHasher()
    for _, text, *_ in rows:
        if not text:
            continue
        raw = np.frombuffer(text.encode(), np.uint8)
        h, before, stem, _ = toxicity._words(hasher, raw, np.array([0, len(raw)]))
        w = text.split()
        assert model.ratios(h, before, stem) == pytest.approx([want[pair] for pair in zip([None, *w], w)], abs=2e-5)
