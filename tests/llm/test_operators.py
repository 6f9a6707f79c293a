"""Every operator against its plain form, on odd rows, repeated rows and empty tables."""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rideops.llm import bpe, chosen_path, flac, language, lattice, licenses, media, mixing, quality, suffix, toxicity
from rideops.llm.components import connected_components
from tests.compare import differences
from tests.llm import brute

public_tokenizers = pytest.importorskip("public_tokenizers")
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def rows():
    return brute.corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    """Extra columns bear names the operators use inside."""
    return spark.createDataFrame(rows, brute.DOCS).withColumns({"_pid": F.lit(1), "size": F.lit("x"), "rep": F.lit(2), "score": F.lit(0)})


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], brute.DOCS)


def texts_of(rows) -> dict:
    return {r[0]: r[1] for r in rows}


def con_of(rows):
    import duckdb

    con = duckdb.connect()
    con.register("t", pa.table({"doc_id": [r[0] for r in rows], "text": pa.array([r[1] for r in rows], pa.string()), "source": pa.array([r[3] for r in rows], pa.string())}))
    con.execute("CREATE VIEW documents AS SELECT * FROM t")
    return con


def test_license_scan(spark, rows, docs, empty):
    mit = licenses.KNOWN[0][1]
    odd = [(1000, "Copyright (c) 2020 Someone\n\n" + mit.upper().replace("LICENSE", "LICENCE"), None, None, None),
           (1001, mit.replace(" ", "  \n"), None, None, None), (1002, "A text.\n released under the MIT licence\nEnd", None, None, None),
           (1003, mit + " but not quite", None, None, None), (1001, mit.replace(" ", "  \n"), None, None, None)]
    all_rows = rows + odd
    out = licenses.license_scan(spark.createDataFrame(all_rows, brute.DOCS))
    assert not differences(out, con_of(all_rows), licenses.SCAN_SQL)
    got = {r.doc_id: r for r in out.collect()}
    assert [got[i].license_id for i in (1000, 1001, 1002, 1003)] == ["MIT", "MIT", None, None]
    assert got[1002].notices == "MIT" and out.count() == len(all_rows)
    assert licenses.license_scan(docs).count() == len(rows)
    assert licenses.license_scan(empty).count() == 0


def test_license_scan_knows_published_texts_and_headers(spark, tmp_path):
    from rideops.llm.queries import op1_license_scan

    folder = licenses.__file__.rsplit("/", 1)[0] + "/license_texts"
    whole = {i: open(f"{folder}/{i}.txt", encoding="utf-8").read() for i in ("Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "MPL-2.0", "Unlicense")}
    apache = ('/*\n * Licensed under the Apache License, Version 2.0 (the "License");\n * you may not use this file except in compliance with the License.\n'
              " * You may obtain a copy of the License at\n *\n *     http://www.apache.org/licenses/LICENSE-2.0\n */\nint x;")
    gpl = ("# This program is free software: you can redistribute it and/or modify\n# it under the terms of the GNU General Public License as published by\n"
           "# the Free Software Foundation, either version 3 of the License, or\n# (at your option) any later version.\n#\n# More.")
    texts = [*whole.values(), "// SPDX-License-Identifier: GPL-2.0-only\nint y;", apache, gpl, whole["GPL-3.0"].split("END OF TERMS")[0], "A license of its own.", None]
    spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(texts)], brute.DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in op1_license_scan(spark, str(tmp_path)).collect()}
    assert [got[i].license_id for i in range(12)] == [*whole, None, None, None, "GPL-3.0", None, None]
    assert [got[i].notices for i in (6, 7, 8, 10, 11)] == ["GPL-2.0-only", "Apache-2.0", "GPL-3.0-or-later", "", ""]


def test_mixing(spark, rows, docs, empty):
    repeated = rows + rows[:5]
    out = mixing.mix(spark.createDataFrame(repeated, brute.DOCS))
    assert not differences(out, con_of(repeated), mixing.MIX_SQL)
    got = mixing.mix(docs).collect()
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mixing.mix(docs).collect()), key=str)
    assert abs(sum({(r.source_size, r.target) for r in got}, ())[1]) >= 0
    largest = max(r.size for r in got)
    by_source = {}
    for r in got:
        assert r.taken <= 3 * r.size
        by_source.setdefault((r.source_size, r.target), []).append(r.taken)
    assert all(abs(sum(t) - k[1]) <= largest for k, t in by_source.items())
    assert mixing.mix(empty).count() == 0
    only = spark.createDataFrame([(1, None, None, None, None), (2, "", None, "a", None)], brute.DOCS)
    assert [(r.size, r.target, r.taken) for r in mixing.mix(only).collect()] == [(0, 0.0, 0)] * 2
    sized = docs.select("doc_id", "source", mixing.word_count().alias("size")).withColumn("_salt", F.lit("x"))
    plan = mixing.mixing_plan(sized)
    small, large = (mixing.with_copies(sized, plan, broadcast_bytes=limit) for limit in (1 << 20, 0))
    assert not small.exceptAll(large).count() and small.count() == large.count() == len(rows)


def test_near_vectors(spark):
    rng = np.random.default_rng(5)
    base = rng.standard_normal((300, 64))
    vectors = list(base)
    for i in range(120):
        x = base[i % 7] / np.linalg.norm(base[i % 7]) + rng.standard_normal(64) * rng.choice([0.0005, 0.02, 0.04])
        vectors.append(x)
    vectors = [v.astype(np.float32).tolist() for v in vectors] + [None, [], [0.0] * 64, [float("nan")] * 64, [1.0, None] * 32, [float("inf")] * 64, [1.0, 2.0], [2.0, 4.0]]
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>").withColumn("class", F.lit("x")).withColumn("label", F.lit(1))
    got = {r.vec_id: r for r in lattice.near_vectors(frame).collect()}
    unit = {i: np.array(v, float) / np.linalg.norm(np.array(v, float)) for i, v in enumerate(vectors)
            if v and None not in v and np.isfinite(v).all() and any(v)}
    links = [(i, j) for i in unit for j in unit if i < j and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= 0.9]
    degree = {i: sum(i in p for p in links) for i in range(len(vectors))}
    want = brute.components(range(len(vectors)), links)
    found = sum(r.n_links for r in got.values())
    assert all(got[i].n_links <= degree[i] for i in degree) and found >= 0.9 * sum(degree.values())
    assert sum(got[i].component_id == want[i] for i in want) >= 0.97 * len(want)
    assert len(got) == len(vectors) and all(r.kept == (r.vec_id == r.component_id) for r in got.values())
    assert lattice.near_vectors(frame.limit(0)).count() == 0
    twice = lattice.near_vectors(frame.where("vec_id = 0").unionAll(frame.where("vec_id = 0"))).collect()
    assert [(r.n_links, r.component_id) for r in twice] == [(0, 0)] * 2


def test_touching_dense_groups_are_linked(spark):
    """Members on facing sides of two classes, their centres far apart, meet by their own cells."""
    rng = np.random.default_rng(21)

    def turned(c, d, degrees):
        return np.cos(np.radians(degrees)) * c + np.sin(np.radians(degrees)) * d

    vectors = []
    for _ in range(60):
        c, d = np.linalg.qr(rng.standard_normal((64, 2)))[0].T
        vectors += [turned(c, d, a) for a in (*rng.normal(0, 0.05, 12), 12, 36, *rng.normal(48, 0.05, 12))]
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    got = {r.vec_id: r.component_id for r in lattice.near_vectors(frame).collect()}
    joined = [got[26 * k + 12] == got[26 * k + 13] for k in range(60)]
    assert np.mean(joined) > 0.95


def test_lattice_points():
    x = np.random.default_rng(1).standard_normal((200, 8)) * 2
    p = lattice.nearest_point(x) / 2
    best = ((x - p) ** 2).sum(1)
    assert len(lattice.MINIMAL) == 240
    assert all((((x - p - m) ** 2).sum(1) >= best - 1e-9).all() for m in lattice.MINIMAL)


def test_bpe(spark, rows, docs, empty):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(TOKENIZER)
    odd = ["<|endoftext|>", "a<|endoftext|> b", "日本語 💥", "it's we'll  \n\n x", "a" * 2000, " " * 99, "é́ ½ ² Ⅷ"]
    more = rows + [(2000 + i, t, None, None, None) for i, t in enumerate(odd)]
    out = {r.doc_id: r for r in bpe.bpe_columns(spark.createDataFrame(more, brute.DOCS), TOKENIZER).collect()}
    for i, t, *_ in more:
        ids = whole.encode(t or "", add_special_tokens=False).ids
        assert out[i].ids == ids and out[i].n_tokens == len(ids)
        assert out[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert out[i].decoded_sha256 == hashlib.sha256(whole.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert bpe.bpe_columns(docs, TOKENIZER).count() == len(rows) and bpe.bpe_columns(empty, TOKENIZER).count() == 0


def test_bpe_pairs_follow_the_merges():
    with open(TOKENIZER, encoding="utf-8") as f:
        e = bpe.Encoder(bpe.Vocabulary(f.read()))
    v, rng = e.vocabulary, np.random.default_rng(3)
    ids = sorted(v.tokens)
    for a, b in zip(rng.choice(ids[:3000], 3000), rng.choice(ids[:3000], 3000)):
        assert e.fits(int(a), int(b)) == (v.by_merges(v.tokens[a] + v.tokens[b]) == [a, b])


def _labelled(spark, good, bad, label: str):
    rng = np.random.default_rng(2)
    words = ["".join(rng.choice(list("abcdefghi"), rng.integers(2, 7))) for _ in range(400)]
    rows = []
    for i in range(900):
        w = list(rng.choice(words, 40))
        rows.append((i, good(w) if i % 3 else bad(w), None, None, None))
    docs = spark.createDataFrame([*rows, (5000, None, None, None, None), (5001, "", None, None, None), (5001, "", None, None, None)], brute.DOCS)
    labels = spark.createDataFrame([(i, int(bool(i % 3))) for i in range(900)], f"doc_id long, {label} int")
    return docs, labels


def test_toxicity(spark, empty):
    def plain(w):
        return " ".join(w)

    def foul(w):
        return " ".join([*w[:20], "vile", *w[20:], "Vilest!"])

    docs, labels = _labelled(spark, foul, plain, "toxic")
    out = toxicity.toxicity(docs.withColumn("toxic", F.lit("x")), labels).toPandas()
    held = out[out.held_out & (out.doc_id < 900)]
    assert ((held.doc_id % 3 > 0) == (held.predicted == 1)).mean() > 0.97 and len(out) == 903
    assert out.score.between(0, 1).all() and ((out.score >= 0.5) == (out.predicted == 1)).all()
    crc = out.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 5 == 0)
    assert (crc == out.held_out).all()
    none = toxicity.toxicity(docs, labels.limit(0)).toPandas()
    assert len(none) == 903 and none.score.between(0, 1).all()
    assert toxicity.toxicity(empty, labels).count() == 0


def test_toxic_passages_of_mild_words():
    """A passage counts though none of its words stands out; a long ordinary text does not drift upward."""
    hasher, rng = toxicity.WordHasher(), np.random.default_rng(8)

    def words(texts):
        raw = [" ".join(t).encode() for t in texts]
        return np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0] + [len(r) for r in raw])

    known = [f"w{i}" for i in range(200)]
    ratio = np.where(np.arange(200) < 40, 0.5, -0.125)
    empty, h = toxicity._Table([], 0.0), toxicity._words(hasher, *words([known]))[0]
    order = np.argsort(h)
    table = toxicity._Table([(h[order], ratio[order].astype(np.float32))], 0.0)
    model = toxicity.Model(empty, table, empty, empty, None)
    texts = [list(rng.choice(known, n)) for n in rng.integers(300, 6000, 300)]
    y = np.arange(300) % 2
    passages = [t[:100] + list(rng.choice(known[:40], 20)) + t[100:] if foul else t for t, foul in zip(texts, y)]
    x = model.features(hasher, *words(passages))
    half = np.arange(300) < 150
    model.weights = toxicity._calibrated(x[half], y[half].astype(float)) if hasattr(toxicity, "_calibrated") else toxicity._logistic(x[half], y[half].astype(float))
    assert ((model.scores(x[~half]) >= 0.5) == (y[~half] == 1)).mean() > 0.97


def test_toxicity_counts_every_labelled_text(spark, monkeypatch):
    """A tiny bound leaves the calibration small, never the counts; a sharded model scores the same."""
    monkeypatch.setattr(toxicity, "TRAIN_ROWS", 300)
    monkeypatch.setattr(toxicity.known_labels if hasattr(toxicity, "known_labels") else toxicity.drawn_labels, "__defaults__", (300,))
    rng = np.random.default_rng(3)
    plain = ["".join(rng.choice(list("abcdefghi"), 6)) for _ in range(300)]
    foul = ["".join(rng.choice(list("pqrstuvw"), 6)) for _ in range(150)]
    rows = [(i, " ".join([*rng.choice(plain, 30), *([foul[i // 2 % 150]] * (i % 2))]), None, None, None) for i in range(3000)]
    docs, labels = spark.createDataFrame(rows, brute.DOCS), spark.createDataFrame([(i, i % 2) for i in range(3000)], "doc_id long, toxic int")
    out = toxicity.toxicity(docs, labels).toPandas().set_index("doc_id")
    held = out[out.held_out]
    assert (held.predicted == held.index % 2).mean() > 0.97
    monkeypatch.setattr(toxicity, "SHARD", 100)
    sharded = toxicity.toxicity(docs, labels).toPandas().set_index("doc_id")
    assert np.allclose(out.score, sharded.score.loc[out.index], atol=1e-6)


def test_quality(spark, empty):
    docs, labels = _labelled(spark, " ".join, lambda w: " | ".join(w[:3] * 12).upper(), "quality")
    out = quality.quality(docs.withColumn("quality", F.lit("x")), labels).toPandas()
    held = out[out.held_out & (out.doc_id < 900)]
    assert ((held.doc_id % 3 > 0) == (held.predicted == 1)).mean() > 0.97 and len(out) == 903
    crc = out.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 3 == 1)
    assert (crc == out.held_out).all() and out.score.between(0, 1).all()
    assert len(quality.quality(docs, labels.limit(0)).toPandas()) == 903 and quality.quality(empty, labels).count() == 0


def test_chosen_paths(spark, rows, docs, empty):
    for words in (2, 5):
        got = {r.doc_id: r for r in chosen_path.near_duplicates(docs, words).collect()}
        want = brute.near_duplicates(texts_of(rows), words)
        assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == want
        assert all(r.kept == (r.doc_id == r.component_id) for r in got.values())
    assert chosen_path.near_duplicates(empty).count() == 0
    again = chosen_path.near_duplicates(docs.unionAll(docs), 2).collect()
    assert len(again) == 2 * len(rows) and {(r.doc_id, r.component_id) for r in again} == {(i, c) for i, (_, c) in brute.near_duplicates(texts_of(rows), 2).items()}
    two = spark.createDataFrame([(1, "a b c"), (2, "x y z"), (2, "a b c"), (3, "x y z"), (None, "a b c")], "doc_id long, text string")
    assert {(r.doc_id, r.component_id) for r in chosen_path.near_duplicates(two, 2).collect()} == {(1, 1), (2, 1), (3, 1), (None, None)}


def test_large_nodes_and_blocks_give_the_same(spark, rows, docs, monkeypatch):
    for name, value in (("LARGE", 8), ("SMALL", 3), ("BLOCK_SHINGLES", 100)):
        monkeypatch.setattr(chosen_path, name, value)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in chosen_path.near_duplicates(docs, 2).collect()}
    assert got == brute.near_duplicates(texts_of(rows), 2)


def test_links_do_not_depend_on_the_size_of_nodes(spark, monkeypatch):
    """One tree: what meets in its nodes is the same whether nodes are whole, dealt into parts or compared row by row."""
    rng = np.random.default_rng(7)
    base = rng.integers(0, 1 << 32, chosen_path.TOKENS, dtype=np.uint32)
    rows = []
    for i in range(400):  # neighbours in a chain are alike, most others are not
        base = np.where(rng.random(chosen_path.TOKENS) < 0.12, rng.integers(0, 1 << 32, chosen_path.TOKENS, dtype=np.uint32), base)
        rows.append((i, 50, base.tobytes()))
    reps = spark.createDataFrame(rows, "rep long, n_shingles long, signature binary")
    monkeypatch.setattr(chosen_path, "TREES", 1)
    found = []
    for large, small in ((20_000, 1000), (4, 2), (7, 1)):
        monkeypatch.setattr(chosen_path, "LARGE", large)
        monkeypatch.setattr(chosen_path, "SMALL", small)
        links = chosen_path.connected_components(chosen_path.candidate_links(reps, 80)).collect()
        found.append({(r.node, r.component) for r in links})
    assert found[0] and found[0] == found[1] == found[2]


def test_loose_cluster_meets_in_bounded_cells(spark, monkeypatch):
    """Documents of similarity about 0.7 to each other chain into one cluster with tiny components."""
    rng = np.random.default_rng(12)
    base = [f"b{i}" for i in range(80)]
    texts = []
    for i in range(150):
        own = base[:66] + [f"u{i}x{j}" for j in range(14)]
        texts += [own] if i % 3 else [own, own[:-1] + [f"v{i}"]]
    order = rng.permutation(len(texts))
    texts = {int(k): " ".join(texts[i]) for k, i in enumerate(order)}
    limit, whole = 1600, chosen_path.full_set_links

    def bounded(texts, words, percent, first=None):
        size = sum(len(t.split()) for t in texts)
        if size > 4 * limit:
            raise AssertionError(f"one group holds {size} words")
        return whole(texts, words, percent, first)

    monkeypatch.setattr(chosen_path, "BLOCK_SHINGLES", limit)
    monkeypatch.setattr(chosen_path, "PIVOTS", 2)
    monkeypatch.setattr(chosen_path, "full_set_links", bounded)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in chosen_path.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), 2).collect()}
    want = brute.near_duplicates(texts, 2)
    assert got == want and len({c for _, c in want.values()}) == 150


def test_components(spark):
    rng = np.random.default_rng(4)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 400, (300, 2))] + [(i, i + 1) for i in range(1000, 1060)] + [(5, 5)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = brute.components({x for a, b in links if a != b for x in (a, b)}, links)
    assert got == want


def test_language(spark, empty):
    rng = np.random.default_rng(6)
    rows = [(i, " ".join("".join(rng.choice(list("abcde" if i % 2 else "vwxyé"), 5)) for _ in range(12)), "aa" if i % 2 else "bb", "s", None) for i in range(300)]
    rows += [(900, None, "aa", None, None), (901, "", None, None, None), (902, "12 !", "bb", None, None), (902, "12 !", "bb", None, None)]
    docs = spark.createDataFrame(rows, brute.DOCS).withColumn("held_out", F.lit("x"))
    out = language.identify(docs).toPandas()
    ok = out[out.doc_id < 900]
    assert (ok.lang_pred == ok.doc_id.map(lambda i: "aa" if i % 2 else "bb")).all() and (ok.score > 0.9).all()
    assert (out.held_out == out.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 4 == 2)).all()
    assert list(out[out.doc_id >= 900].lang_pred) == ["und"] * 4 and len(out) == 304
    assert language.identify(empty).count() == 0
    unnamed = language.identify(docs.withColumn("lang", F.lit(None).cast("string"))).toPandas()
    assert (unnamed.lang_pred == "und").all()


def test_suffixes(spark, rows, docs, empty):
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffix.without_repeats(docs, ("source",)).collect()}
    assert got == brute.without_repeats(texts_of(rows))
    assert suffix.without_repeats(empty).count() == 0
    twice = suffix.without_repeats(docs.unionAll(docs)).collect()
    assert len(twice) == 2 * len(rows) and {(r.doc_id, r.n_removed) for r in twice} == {(i, v[1]) for i, v in got.items()}
    long = "".join(chr(97 + i % 26) for i in range(50))
    odd = spark.createDataFrame([(3, long), (1, long), (None, long + "!"), (2, long[:49])], "doc_id long, text string")
    assert {r.doc_id: r.n_removed for r in suffix.without_repeats(odd).collect()} == {1: 0, 2: 0, 3: 50, None: 50}


def test_media(spark, rows, docs, empty):
    out = {r.doc_id: r for r in media.media_columns(docs).collect()}
    for i, t, *_ in rows:
        raw = (t or "").encode()
        payload = raw + b"\xff" * (-len(raw) % 576 if raw else 576)
        r = out[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest())
        assert r.tail_crc32 == zlib.crc32(payload[-32:]) and r.media_sha256 == hashlib.sha256(r.media).hexdigest() and r.media_bytes == len(r.media)
    assert media.media_columns(empty).count() == 0


def test_flac_blocks_and_damage():
    rng = np.random.default_rng(9)
    payloads = [rng.integers(-128, 128, 576 * 3).astype(np.int8), np.zeros(576, np.int8), (np.cumsum(rng.integers(-1, 2, 1152)) % 100).astype(np.int8),
                np.where(rng.random(576) < 0.01, 127, 0).astype(np.int8)]
    streams = flac.encode(payloads, 576)
    assert all((a == b).all() for a, b in zip(payloads, flac.decode(streams)))
    assert (flac.decode(streams[:1], [(1, 1)])[0] == payloads[0][576:1152]).all()
    bad = bytearray(streams[2])
    bad[-20] ^= 1
    with pytest.raises(flac.Damaged):
        flac.decode([bytes(bad)])


def test_long_documents_are_named_in_pieces(monkeypatch):
    rng = np.random.default_rng(5)
    for size, letters in ((2000, 3), (3000, 40), (500, 1), (701, 2)):
        data = rng.integers(97, 97 + letters, size).astype(np.uint8)
        want = suffix.anchors(data, np.array([0, size]))
        for piece in (64, 100, 333):
            monkeypatch.setattr(suffix, "PIECE", piece)
            assert all((a == b).all() for a, b in zip(suffix._anchors_of_long(data), want))


def test_suffix_groups_follow_the_bytes(spark, rows, monkeypatch):
    monkeypatch.setattr(suffix, "GROUP_BYTES", 2000)
    monkeypatch.setattr(suffix, "PIECE", 300)
    want = brute.without_repeats(texts_of(rows))
    out = suffix.without_repeats(spark.createDataFrame(rows, brute.DOCS)).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in out} == want


def test_license_notices_belong_to_their_row(spark):
    """Rows of one id and one digest differ in their lines; SPDX expressions name several licenses."""
    texts = ["foo\nReleased under the MIT License.", "foo Released under the MIT License.", "// SPDX-License-Identifier: MIT OR Apache-2.0\nx",
             "# SPDX-License-Identifier: (GPL-2.0-only WITH Classpath-exception-2.0) AND bsd-3-clause\ny", "/* SPDX-License-Identifier: GPL-3.0+ */", "SPDX-License-Identifier: Nothing-1.0", None]
    rows = [(1, t, None, None, None) for t in texts]
    got = sorted((r.digest, r.notices) for r in licenses.license_scan(spark.createDataFrame(rows, brute.DOCS), licenses.published(), licenses.HEADERS).collect())
    assert len({d for d, _ in got}) == len(texts) - 1
    assert sorted(n for _, n in got) == ["", "", "", "Apache-2.0,MIT", "BSD-3-Clause,GPL-2.0-only", "GPL-3.0-or-later", "MIT"]


def test_pcm_blocks_by_seek_offset(spark, rows):
    docs = spark.createDataFrame(rows + [(7000, "long text " * 30_000, None, None, None), (7000, "long text " * 30_000, None, None, None)], brute.DOCS)
    stored = media.media_columns(docs).cache()
    out = media.pcm_blocks(stored.select("doc_id", "media"), 100).toPandas().sort_values(["doc_id", "block"], kind="stable")
    streams = {r.doc_id: bytes(r.media) for r in stored.collect()}
    text = {r[0]: (r[1] or "").encode() for r in rows} | {7000: b"long text " * 30_000}
    for doc_id, part in out.groupby("doc_id"):
        part = part.iloc[::2] if doc_id == 7000 else part  # the repeated row's blocks come twice
        want = text[doc_id] + b"\xff" * (max(1, -(-len(text[doc_id]) // 576)) * 576 - len(text[doc_id]))
        assert b"".join(map(bytes, part["pcm"])) == want
        assert part["first_sample"].tolist() == [576 * b for b in range(len(want) // 576)] == (part["block"] * 576).tolist()
        for first, count in ((0, 1), (575, 2), (len(want) - 3, 99), (len(want), 5), (100, 2000)):
            assert media.samples_of(streams[doc_id], first, count) == want[first:first + count]
    assert set(out["doc_id"]) == set(text)
    # Only the blocks that are asked for are read: a damaged one does not keep the others from being read.
    total, offsets = flac.shape(streams[7000])[0], flac._layout(streams[7000])[3]
    damaged = bytearray(streams[7000])
    damaged[int(offsets[5]) + 20] ^= 1
    assert media.samples_of(bytes(damaged), 0, 5 * 576) + media.samples_of(bytes(damaged), 6 * 576, total) == text[7000][:5 * 576] + (text[7000] + b"\xff" * 576)[6 * 576:total]
    with pytest.raises(flac.Damaged):
        media.samples_of(bytes(damaged), 5 * 576 + 3, 1)
    assert media.pcm_blocks(stored.select("doc_id", F.lit(None).cast("binary").alias("media"))).count() == 0
