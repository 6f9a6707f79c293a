"""Periodic runs against their definition."""

from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import pytest

from rideops.llm import periodic
from tests.llm import brute


def runs_of(words: list) -> list[tuple[int, int, int]]:
    """Every lag, every stretch; a stretch counts for its smallest period."""
    found = {}
    for q in range(1, len(words) // 4 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(6, 4 * q) and j > i:
                found.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted((i, j - i, q) for (i, j), q in found.items() if not any(
        q % d == 0 and all(words[x] == words[x + d] for x in range(i, j - d)) for d in range(1, q)))


def planted(doc_id, words: list) -> list:
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not words:
        return words
    n, g = len(words), h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def collapsed(words: list, runs: list) -> str:
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def random_texts(seed: int, count: int) -> list[list[int]]:
    rng, out = random.Random(seed), []
    for _ in range(count):
        text = []
        for _ in range(rng.randint(0, 5)):
            kind, letters = rng.random(), rng.choice([1, 2, 3, 50])
            if kind < 0.5:
                q = rng.choice([1, 2, 3, 5, 8, 9, 12, 16, 17, 31, 40, 64, 65, 100])
                period = [rng.randrange(letters) for _ in range(q)]
                text += (period * 12)[:rng.randint(0, 6 * q)]
            else:
                text += [rng.randrange(letters) for _ in range(rng.randint(0, 60))]
        out.append(text)
    return out


@pytest.mark.parametrize("seed", range(6))
def test_runs_equal_the_definition(seed):
    texts = random_texts(seed, 60)
    want = [(d, *r) for d, t in enumerate(texts) for r in runs_of(t)]
    codes = np.array([w for t in texts for w in t], np.uint64)
    got = periodic.periodic_runs(codes, np.cumsum([0, *map(len, texts)]))
    assert [tuple(r) for r in got.T.tolist()] == want


def test_self_similar_words():
    """Thue-Morse and Fibonacci words, and equal documents side by side."""
    morse = [bin(i).count("1") & 1 for i in range(600)]
    a, b = [0], [0, 1]
    while len(b) < 700:
        a, b = b, b + a
    texts = [morse, b, b, morse * 5, [7] * 500, ([1] * 20 + [2]) * 9, [1, 2] * 3, [1, 1, 1, 1, 1], [1] * 6]
    want = [(d, *r) for d, t in enumerate(texts) for r in runs_of(t)]
    got = periodic.periodic_runs(np.array(sum(texts, []), np.uint64), np.cumsum([0, *map(len, texts)]))
    assert [tuple(r) for r in got.T.tolist()] == want


def test_query_columns(spark, tmp_path):
    from rideops.llm.queries import op11_periodic_runs

    rng = random.Random(5)
    odd = [(5000 + i, " \t".join(f"w{x}é" for x in t), None, None, None) for i, t in enumerate(random_texts(9, 80))]
    long = [(9000, "a b " * 60_000 + "c " * 400_000, None, None, None), (None, "x " * 30, None, None, None), (9000, "again " * 7, None, None, None)]
    rows = brute.corpus(5) + odd + long + [(7000 + i, " ".join(str(rng.randrange(9)) for _ in range(rng.randrange(60))), None, None, None) for i in range(60)]
    spark.createDataFrame(rows, brute.DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((tuple(r) for r in op11_periodic_runs(spark, str(tmp_path)).collect()), key=str)
    want = []
    for doc_id, text, *_ in rows:
        words = planted(doc_id, (text or "").encode().split())
        words = [w.decode() for w in words]
        runs = [(0, 120_000, 2), (120_000, 400_000, 1)] if doc_id == 9000 and len(words) > 9 else runs_of(words)
        s, length, q = max(runs, key=lambda r: (r[1], -r[0], -r[2])) if runs else (None,) * 3
        lines = "".join(f"{a},{b},{c}\n" for a, b, c in runs)
        want.append((doc_id, len(runs), s, length, q, 1000 * length // q if runs else None, hashlib.sha256(lines.encode()).hexdigest(),
                     hashlib.sha256(collapsed(words, runs).encode()).hexdigest()))
    assert got == sorted(want, key=str)
    assert op11_periodic_runs(spark, str(tmp_path)).where("n_runs > 0").count() > 30


def test_empty_table_and_clashing_names(spark):
    docs = spark.createDataFrame([(1, None, "x"), (2, "", "y"), (2, "", "y"), (3, "q " * 9, "z")], "doc_id long, text string, runs string")
    got = [tuple(r) for r in periodic.find_runs(docs).collect()]
    assert got == [(1, 0, [], ""), (2, 0, [], ""), (2, 0, [], ""), (3, 9, [(0, 9, 1)], "q")]
    assert periodic.run_columns(periodic.find_runs(periodic.with_planted_tails(docs.limit(0)))).count() == 0
