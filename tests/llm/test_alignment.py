"""Pair bitmaps against tokens paired one by one."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from rideops.llm import alignment
from tests.llm import brute

public_tokenizers = pytest.importorskip("public_tokenizers")
FILES = [public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model")]
ODD = ["<|endoftext|> and <s>", "<0x41> x", "a ▁ b", "▁", "  two  spaces ", "\x00nul", "emoji 👩‍👩‍👧 ok", "été ñ 中文字符 混合 text", "𝒳" * 5, "\n\n\t x", "ﬁ ½", "don't we'll", "x" * 300, "- - - - -", "the the the the the"]


def plain(rows) -> list[tuple]:
    """Encode, pair and count with the libraries and dictionaries alone."""
    import sentencepiece
    import tokenizers

    first = tokenizers.Tokenizer.from_file(FILES[0])
    first.encode_special_tokens = True
    second = sentencepiece.SentencePieceProcessor(model_file=FILES[1])
    letters = alignment._byte_letters()

    def bytes_a(i):
        return bytes(letters[c] for c in first.id_to_token(i))

    def bytes_b(i):
        piece = second.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if second.is_byte(i) else piece.replace("▁", " ").encode()

    out, links = [], []
    for _, text, *_ in rows:
        a = first.encode(" " + text, add_special_tokens=False).ids if text else []
        b = second.encode(text) if text else []
        if not text or b"".join(map(bytes_a, a)) != (" " + text).encode() or b"".join(map(bytes_b, b)) != (" " + text).encode():
            out.append((0, 0, 0, ""))
            links.append([])
            continue
        ends = [dict(zip(np.cumsum([len(f(i)) for i in ids]).tolist(), range(len(ids)))) for f, ids in ((bytes_a, a), (bytes_b, b))]
        common = sorted(ends[0].keys() & ends[1].keys())
        at = [(ends[0][e], ends[1][e]) for e in common]
        groups = [f"{','.join(map(str, a[i0 + 1:i1 + 1]))}|{','.join(map(str, b[j0 + 1:j1 + 1]))}" for (i0, j0), (i1, j1) in zip([(-1, -1), *at], at)]
        out.append((len(a), len(b), len(groups), ";".join(groups)))
        links.append([(a[i], b[j]) for i, j in at])
    count = Counter(x for ls in links for x in ls)
    best = {}
    for (_, b), c in count.items():
        best[b] = max(best.get(b, 0), c)
    return [(r[0], n_a, n_b, n, len(ls), sum(count[x] == best[x[1]] for x in ls), sum(count[x] for x in ls),
             hashlib.sha256(g.encode()).hexdigest() if n_a else "", g if n_a else None) for r, (n_a, n_b, n, g), ls in zip(rows, out, links)]


def test_equals_pairing_one_by_one(spark):
    rows = brute.corpus(7) + [(1000 + i, t, None, None, None) for i, t in enumerate(ODD)] + [(None, "no id", None, None, None)] + [(1002, "again here", None, None, None)] * 3
    docs = spark.createDataFrame(rows, brute.DOCS).selectExpr("*", "1 AS container", "'x' AS present", "2 AS links").repartition(3)
    got = [tuple(r) for r in alignment.align(docs, *FILES, groups=True).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "groups").collect()]
    want = plain(rows)
    assert sorted(got, key=str) == sorted(want, key=str)
    assert sum(w[1] == 0 for w in want) >= 3 and sum(w[5] > 0 for w in want) > 50


def test_pair_counts_of_many_containers(spark, monkeypatch):
    """Containers of a few documents; copies share their pairs."""
    monkeypatch.setattr(alignment, "CONTAINER_DOCS", 7)
    rng = random.Random(3)
    words = ["the", "of", "alpha", "beta", "ünd", "zz9", "-", "the the"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 40))), None, None, None) for i in range(90)]
    docs = spark.createDataFrame(rows, brute.DOCS).repartition(2)
    got = alignment.align(docs, *FILES, groups=True).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "groups")
    assert sorted(tuple(r) for r in got.collect()) == plain(rows)
    pairs = alignment.pair_counts(alignment.postings_of(alignment.index(docs, *FILES)))
    holders = sum(r.documents for r in pairs.collect())
    assert holders == sum(len({g.split("|")[0].split(",")[-1] + "|" + g.split("|")[1].split(",")[-1] for g in r[8].split(";")}) for r in plain(rows) if r[8])


def test_long_texts_are_cut_where_no_token_crosses(monkeypatch):
    monkeypatch.setattr(alignment, "PIECE", 40)
    aligner = alignment.Aligner(open(FILES[0], encoding="utf-8").read(), open(FILES[1], "rb").read())
    text = "  Many words, don't  you think?\n\n été 中文 字 and  " * 40
    pieces = aligner.words(text)
    parts = [" " + w for words in pieces for w in words]
    assert len(pieces) > 20 and "".join(parts) == " " + text
    assert [i for p in parts for i in aligner.first.encode(p, add_special_tokens=False).ids] == aligner.first.encode(" " + text, add_special_tokens=False).ids
    assert [i for p in parts for i in aligner.second.encode(p[1:])] == aligner.second.encode(text)


def test_a_text_longer_than_a_part(spark, monkeypatch):
    monkeypatch.setattr(alignment, "PIECE", 50)
    monkeypatch.setattr(alignment, "PART", 120)
    monkeypatch.setattr(alignment, "MEMORY", 500)
    rows = [(1, "one two three four " * 200, None, None, None), (2, "good text here " * 50 + " ▁ " + "more text here " * 50, None, None, None), (3, "short", None, None, None)]
    got = alignment.align(spark.createDataFrame(rows, brute.DOCS), *FILES, groups=True)
    assert sorted(tuple(r) for r in got.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "groups").collect()) == plain(rows)


def test_bitmaps():
    rng = np.random.default_rng(1)
    for size in (1, 9, 1000, 65_536):
        for share in (0.001, 0.3, 1.0):
            docs = np.flatnonzero(rng.random(size) < share)
            assert (alignment.unpacked(alignment.packed(docs, size)) == docs).all()


def test_empty_table(spark):
    assert alignment.align(spark.createDataFrame([], brute.DOCS), *FILES).count() == 0
