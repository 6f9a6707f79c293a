"""Naive Bayes over character n-grams against dictionaries of n-grams."""

from __future__ import annotations

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from rideops.llm import language
from tests.llm import brute

TEXTS = {
    "en": ["The weather is fine today", "we went to the market and bought bread", "nothing was said about THE matter", "she reads a book every week"],
    "el": ["Ο καιρός είναι καλός σήμερα", "πήγαμε στην αγορά και αγοράσαμε ψωμί", "ΔΕΝ ΕΙΠΑΝ ΤΙΠΟΤΑ για το θέμα", "διαβάζει ένα βιβλίο κάθε εβδομάδα"],
    "ja": ["今日は天気がいいです", "市場へ行ってパンを買いました", "その件については何も言わなかった", "彼女は毎週本を読みます"],
}


def grams(text: str) -> list[tuple[int, str]]:
    low = "".join(c.lower() if len(c.lower()) == 1 and ord(c) < 1 << 16 else c for c in text)
    return [(n, low[i:i + n]) for n in language.SIZES for i in range(len(low) - n + 1)]


def bucket(n: int, gram: str) -> int:
    h, mask, factor = 0, (1 << 64) - 1, 0xD6E8FEB86659FD93
    for c in gram:
        h = (h << 21 | ord(c)) & mask
    h ^= n << 60
    for _ in range(2):
        h = (h ^ h >> 32) * factor & mask
    return (h ^ h >> 32) % language.BUCKETS


@pytest.mark.parametrize("texts", [["aÄé", "", "日本語💥x", "İstanbul ΣΊΣΥΦΟΣ", "𝒳y"], ["", ""], ["z"]])
def test_characters_and_buckets(texts):
    raw = [t.encode() for t in texts]
    data, at = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])
    chars, ends = language.code_points(data, at)
    assert ["".join(map(chr, chars[a:b])) for a, b in zip(ends, ends[1:])] == ["".join(c.lower() if len(c.lower()) == 1 and ord(c) < 1 << 16 else c for c in t) for t in texts]
    got, doc = language.gram_buckets(data, at)
    assert sorted(zip(doc.tolist(), got.tolist())) == sorted((i, bucket(*g)) for i, t in enumerate(texts) for g in grams(t))


def test_scores_equal_a_plain_classifier(spark):
    rows = [(i, (TEXTS[lang][(i * 7) % 4] + " " + TEXTS[lang][i % 4])[i % 5:], lang, None, None) for i, lang in enumerate(["en", "el", "ja", "en", "el"] * 12)]
    rows += [(1000, None, "en", None, None), (1001, "", "en", None, None), (1002, "12 !?", "el", None, None), (1003, "καλός bread", None, None, None), (1003, "καλός bread", None, None, None)]
    counts, documents = defaultdict(Counter), Counter()
    for i, text, lang, *_ in rows:
        if zlib.crc32(str(i).encode()) % 4 != 2 and lang and text is not None:
            counts[lang].update(bucket(*g) for g in grams(text))
            documents[lang] += 1
    langs = sorted(counts)
    whole = {k: sum(counts[k].values()) + language.SMOOTHING * language.BUCKETS for k in langs}
    want = []
    for i, text, *_ in rows:
        held = zlib.crc32(str(i).encode()) % 4 == 2
        if not any(c.isalpha() for c in text or ""):
            want.append((i, held, language.UNKNOWN, 0.0))
            continue
        log = {k: math.log(documents[k] / sum(documents.values())) + sum(math.log((counts[k][bucket(*g)] + language.SMOOTHING) / whole[k]) for g in grams(text)) for k in langs}
        best = max(langs, key=log.get)
        want.append((i, held, best, 1 / sum(math.exp(v - log[best]) for v in log.values())))
    out = language.identify(spark.createDataFrame(rows, brute.DOCS)).collect()
    for got, row in zip(sorted(map(tuple, out)), sorted(want)):
        assert got[:3] == row[:3] and got[3] == pytest.approx(row[3], abs=1e-4)
    assert len(out) == len(want)
