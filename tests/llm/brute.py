"""Plain forms of the operators over small lists, and the fixtures they are compared on."""

from __future__ import annotations

import random

LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def shingles(text: str | None, words: int) -> frozenset:
    w = (text or "").encode().translate(LOWER).split()
    if len(w) >= words:
        return frozenset(zip(*(w[j:] for j in range(words))))
    return frozenset([tuple(w)]) if w else frozenset()


def components(nodes, links) -> dict:
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def near_duplicates(docs: dict, words: int) -> dict:
    sets = {d: shingles(t, words) for d, t in docs.items()}
    ids = sorted(d for d in sets if sets[d])
    links = [(a, b) for i, a in enumerate(ids) for b in ids[i + 1:]
             if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    return {d: (len(sets[d]), c) for d, c in components(sets, links).items()}


def without_repeats(docs: dict) -> dict:
    seen, out = set(), {}
    for d in sorted(docs):
        b = (docs[d] or "").encode()
        starts = [b[i:i + 50] for i in range(len(b) - 49)]
        gone = [False] * len(b)
        for i, s in enumerate(starts):
            if s in seen:
                gone[i:i + 50] = [True] * 50
        seen.update(starts)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out[d] = (len(b), sum(gone), spans, bytes(x for x, g in zip(b, gone) if not g))
    return out


def corpus(seed: int = 1, n: int = 120) -> list[tuple]:
    """Random documents with copies, near copies, shared passages and odd texts."""
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefgä") for _ in range(rng.randint(1, 9))) for _ in range(300)]
    passage = " ".join(rng.choice(words) for _ in range(30))
    texts = [None, "", " \t\n", "one", "One", "two words", "12 34 !!", "x" * 200, "ab " * 300, "ß", " ", "tab\tsep\x0bv\x0cf\rr"]
    for _ in range(n):
        kind = rng.random()
        if kind < 0.25 and len(texts) > 20:
            w = (rng.choice(texts[12:]) or "w").split()
            for _ in range(rng.randint(0, 3)):
                w[rng.randrange(len(w))] = rng.choice(words)
            texts.append(" ".join(w))
        elif kind < 0.35:
            texts.append(" ".join(rng.choice(words) for _ in range(20)) + " " + passage + " tail")
        else:
            texts.append(" ".join(rng.choice(words) for _ in range(rng.choice([3, 40, 90]))))
    texts.append(" ".join(rng.choice(words) for _ in range(9000)))
    order = list(range(len(texts)))
    rng.shuffle(order)
    return [(i, texts[j], rng.choice(["aa", "bb", None]), rng.choice(["s", "s", "s", "t", "é", None]), None) for i, j in enumerate(order)]
