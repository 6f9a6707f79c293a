"""Secret scans: base patterns against a plain scan, guess costs against all segmentations."""

from __future__ import annotations

import hashlib
import itertools
import math
import random
import re

import pytest

from rideops.llm import secrets
from tests.llm import brute

RANKS = {w: i + 1 for i, w in enumerate(("the", "of", "pass", "word", "password", "summer", "dragon", "required", "correct", "horse"))}


def base_of(text: str) -> list[str]:
    """The base patterns character by character (keys by a search of their own)."""
    found = []
    lower = "".join(c.lower() if c.isascii() else c for c in text)
    i = 0
    while i < len(text):
        end = None
        for key in ("password", "passwd", "secret", "token", "api_key", "apikey"):
            if not lower.startswith(key, i):
                continue
            j = i + len(key)
            j += text[j:j + 1] in ('"', "'") and j < len(text)
            while text[j:j + 1] == " ":
                j += 1
            if text[j:j + 1] not in (":", "="):
                continue
            j += 1
            while text[j:j + 1] == " ":
                j += 1
            j += text[j:j + 1] in ('"', "'") and j < len(text)
            k = j
            while k < len(text) and text[k].isascii() and (text[k].isalnum() or text[k] in "+/_.=-"):
                k += 1
            if k > j:
                end = k
                if k - j >= 6:
                    found.append((i, 0, k))
                break
        i = end or i + 1
    i = 0
    while i < len(text):
        j = i + 4
        if text.startswith("AKIA", i):
            while j < len(text) and text[j].isascii() and (text[j].isdigit() or text[j].isupper()):
                j += 1
            if j > i + 4:
                if j - i >= 20:
                    found.append((i, 1, j))
                i = j
                continue
        i += 1
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if m.end() - m.start() >= 24]
    return [f"{secrets.KINDS[k]}:{lo}:{hi}" for lo, k, hi in sorted(found)]


def random_text(rng: random.Random) -> str:
    parts = ["password", "PassWD", "secret", "toKen", "api_key", "apikey", "\"", "'", " ", "  ", ":", "=", "AKIA", "AKIAAKIA", "ABCDEF0123456789", "0123456789abcdef",
             "deadbeef", "x", "é", "ſecret", "toKen", "\n", "abc123", "+/_.=-", "🔑", "A" * 16, "f" * 24, "key", "hunter2!"]
    return "".join(rng.choice(parts) for _ in range(rng.randint(0, 25)))


def test_base_spans_equal_a_plain_scan(spark, tmp_path):
    from rideops.llm.queries import op12_secret_scan

    rng = random.Random(4)
    rows = brute.corpus(6) + [(3000 + i, random_text(rng), None, None, None) for i in range(600)]
    rows += [(None, "token: abcdef1", None, None, None), (3000, "x", None, None, None), (9999, "filler " * 200_000 + "secret = abcdefg", None, None, None)]
    spark.createDataFrame(rows, brute.DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, op12_secret_scan(spark, str(tmp_path)).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans").collect()), key=str)
    want = []
    for i, text, *_ in rows:
        base = base_of(text or "")
        n = [sum(s.startswith(k) for s in base) for k in secrets.KINDS[:3]]
        want.append((i, *n, hashlib.sha256(",".join(base).encode()).hexdigest(), ",".join(base)))
    want.sort(key=str)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert [",".join(s for s in g[5].split(",") if not s.startswith("guess")) for g in got] == [w[5] for w in want]
    assert sum(w[1] > 0 for w in want) > 50 and sum(w[2] > 0 for w in want) > 20 and sum(w[3] > 0 for w in want) > 50


@pytest.mark.parametrize("seed", range(4))
def test_cheapest_segmentation(seed):
    rng = random.Random(seed)
    parts = ["the", "P4ss", "word", "ab", "qwer", "1999", "12", "zzz", "!", "xY", "1234", "0"]
    for _ in range(60):
        value = "".join(rng.choice(parts) for _ in range(4))[:10]
        known = {}
        for i, j, cost, _ in secrets.segments(value, RANKS):
            known[i, j] = min(cost, known.get((i, j), math.inf))
        per = secrets.alphabet_of(value)
        best = math.inf
        for cuts in itertools.product((0, 1), repeat=len(value) - 1):
            at = [0, *(k + 1 for k, c in enumerate(cuts) if c), len(value)]
            best = min(best, sum(min(known.get((a, b), math.inf), per * (b - a)) for a, b in zip(at, at[1:])) + secrets.SEAM * (len(at) - 2))
        assert secrets.guesses(value, RANKS) == pytest.approx(best)


def test_what_guessers_try_first_is_cheap():
    cheap = ["password1", "P4ssword", "summer2024", "qwertyuiop", "aaaaaaaaaa", "abcabcabc", "2024-01-31", "Dragon!", "zxcvbnm", "thethethe", "abcdefgh"]
    dear = ["Tr0ub4dor&3", "x7#kQ9!vLm", "e3b3ed3cc8548923d6", "qhTz81mmVw"]
    assert max(secrets.guesses(v, RANKS) for v in cheap) < secrets.LEAST < min(secrets.guesses(v, RANKS) for v in dear)


def test_values_in_context():
    def guessed(text):
        return [text[lo:hi] for lo, k, hi, _ in secrets.scan(text, RANKS) if k == 3]

    assert guessed('pwd: "Tr0ub4dor & 3x"') == ["Tr0ub4dor & 3x"]
    assert guessed("The password is x7#kQ9!vLm, he said") == ["x7#kQ9!vLm"]
    assert guessed("db at postgres://app:qhTz81mmVw@host/x") == ["qhTz81mmVw"]
    assert guessed("Authorization: Bearer eyJhbGci.9x8Zk2") == ["eyJhbGci.9x8Zk2"]
    assert guessed("the secret is out, login: required, pwd=summer2024, auth: correcthorse") == []
    assert guessed("passphrase: x7#kQ9!vLm") == ["x7#kQ9!vLm"]
    assert guessed("password=e3b3ed3cc8548923d6") == []  # a base span already
    assert secrets.scan("", RANKS) == []


def test_dictionary_counts_documents_without_the_values(spark):
    texts = ["alpha beta", "alpha alpha alpha", "password: zebrazebra9", "pwd=zebra77x and beta", None, "", "Alpha ünïcode"]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, word int").repartition(3)
    assert secrets.dictionary(docs) == ["alpha", "beta", "and", "password", "pwd", "ünïcode"]
    assert secrets.dictionary(docs, 2) == ["alpha", "beta"]
    assert secrets.find_secrets(docs.limit(0)).count() == 0


def test_long_values_take_work_in_proportion():
    assert secrets.guesses("a1" * 20_000, RANKS) < 12
    assert secrets.guesses("".join(chr(97 + i * i % 23) for i in range(20_000)), RANKS) > 10_000
