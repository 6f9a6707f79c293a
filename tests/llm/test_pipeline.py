"""The pipeline against the plain forms of its stages."""

from __future__ import annotations

import re

import corpus_pipeline
from rideops.llm import mixing
from tests.llm import brute


def test_run_equals_plain_stages(spark, tmp_path):
    from public_tokenizers import path
    from tokenizers import Tokenizer

    rows = brute.corpus(3)
    folder = tmp_path / "sf"
    spark.createDataFrame(rows, brute.DOCS).write.parquet(f"{folder}/documents.parquet")
    named = {r[0]: r for r in rows if r[1] and re.search(r"[^\W\d_]", r[1])}
    near = brute.near_duplicates({i: r[1] for i, r in named.items()}, 5)
    kept = {i: r for i, r in named.items() if near[i][1] == i}
    cut = brute.without_repeats({i: r[1] for i, r in kept.items()})
    left = [(i, cut[i][3].decode("utf-8", "ignore"), r[2], r[3], None) for i, r in kept.items()]
    copies = {r.doc_id: r.copies for r in mixing.mix(spark.createDataFrame(left, brute.DOCS)).collect()}
    whole = Tokenizer.from_file(path("byte_bpe_50k.json"))
    want = sorted((i, whole.encode(t, add_special_tokens=False).ids) for i, t, *_ in left for _ in range(copies[i]))
    got = sorted((r.doc_id, r.ids) for r in corpus_pipeline.run(spark, str(folder)).collect())
    assert got == want


def test_stages_keep_the_columns(spark, tmp_path):
    docs = spark.createDataFrame(brute.corpus(4, 20), brute.DOCS)
    empty = docs.limit(0)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.dtypes == empty.dtypes, name
        assert stage(spark, empty, str(tmp_path)).count() == 0
