"""Language identification: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rideops.llm.common import fold_of, mixed, runs_of, text_bytes, tidy

#: Hash buckets, n-gram sizes, smoothing, and the expected number of training documents.
BUCKETS, SIZES, SMOOTHING, TRAIN_ROWS = 1 << 15, (1, 2, 3), 0.5, 30_000
UNKNOWN = "und"
#: Bytes of text whose n-grams are held at once.
RUN_BYTES = 1 << 20
SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double"
_LETTER = regex.compile(r"\p{L}")


#: Lower case of the characters up to U+FFFF, where that is one character.
_LOWER = np.array([ord(c) if len(c := chr(i).lower()) == 1 else i for i in range(1 << 16)], np.int32)


def code_points(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(characters of UTF-8 texts in lower case, offsets of the texts among them)."""
    first = np.flatnonzero((data & 0xC0) != 0x80)
    padded = np.append(data, np.zeros(3, np.uint8)).astype(np.int32)
    lead, more = padded[first], [padded[first + k] & 0x3F for k in (1, 2, 3)]
    code = np.where(lead < 0x80, lead, np.where(
        lead < 0xE0, (lead & 0x1F) << 6 | more[0], np.where(
            lead < 0xF0, (lead & 0x0F) << 12 | more[0] << 6 | more[1], (lead & 0x07) << 18 | more[0] << 12 | more[1] << 6 | more[2])))
    return np.where(code < len(_LOWER), _LOWER[np.minimum(code, len(_LOWER) - 1)], code), np.searchsorted(first, offsets)


def gram_buckets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(buckets of all n-grams of characters, document of each), n-grams never crossing documents.

    An n-gram is its characters in 21 bits each, hashed together with n.
    """
    chars, ends = code_points(data, offsets)
    low, size = chars.astype(np.uint64), np.diff(ends)
    doc = np.repeat(np.arange(len(size)), size)
    left = np.repeat(ends[1:], size) - np.arange(len(low))
    code, buckets, docs = np.zeros(len(low), np.uint64), [], []
    for n in range(1, max(SIZES) + 1):
        code = code[:max(len(low) - n + 1, 0)] << np.uint64(21) | low[n - 1:]
        if n in SIZES:
            keep = left[:len(code)] >= n
            buckets.append((mixed(code[keep] ^ np.uint64(n << 60)) % np.uint64(BUCKETS)).astype(np.int32))
            docs.append(doc[:len(code)][keep])
    return np.concatenate(buckets), np.concatenate(docs)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per language and task: counts of all buckets as packed integers."""
    total: dict[str, np.ndarray] = {}
    for batch in batches:
        data, at = text_bytes(batch.column(1))
        langs = np.array(batch.column(0).to_pylist(), object)
        for lo, hi in runs_of(at, RUN_BYTES):
            bucket, doc = gram_buckets(data[at[lo]:at[hi]], at[lo:hi + 1] - at[lo])
            for lang in set(langs[lo:hi]):
                found = np.bincount(bucket[(langs[lo:hi] == lang)[doc]], minlength=BUCKETS)
                total[lang] = total.get(lang, 0) + found
    if total:
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(total)), pa.array([v.astype("<i8").tobytes() for v in total.values()], pa.binary())], names=["lang", "counts"])


def _summed(key, frame):
    import pandas as pd

    total = sum(np.frombuffer(c, "<i8") for c in frame["counts"])
    return pd.DataFrame({"lang": [key[0]], "counts": [total.astype("<i8").tobytes()]})


class Model:
    """Log-probabilities of buckets (rows) per language (columns) and class priors."""

    def __init__(self, langs: list[str], counts: np.ndarray, documents: np.ndarray) -> None:
        self.langs, self.counts, self.documents = langs, counts, documents
        smooth = counts + SMOOTHING
        self.matrix = np.log(smooth / smooth.sum(1, keepdims=True)).T.astype(np.float32)
        self.prior = np.log(documents / max(documents.sum(), 1))

    def plain(self) -> tuple:
        """What a broadcast carries: the constructor's arguments, no class of this library."""
        return self.langs, self.counts, self.documents

    def log_scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Documents by languages: the sparse matrix (document, bucket) of n-grams times the log-probabilities."""
        n = len(offsets) - 1
        col, row = gram_buckets(data, offsets)
        out = np.empty((n, len(self.langs)))
        for k in range(len(self.langs)):
            out[:, k] = np.bincount(row, np.ascontiguousarray(self.matrix[:, k])[col], n) + self.prior[k]
        return out


def train(labelled: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    """Fit on rows with a non-null ``lang`` and text; about ``rows`` of them, drawn by a hash of the id.

    The bound keeps the model's cost constant at any size; counts are summed over tasks in Spark
    and only languages x buckets reach the driver.
    """
    known = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    n = known.count()
    share = F.lit(int(min(1.0, rows / max(n, 1)) * (1 << 30)))
    drawn = known.where(F.pmod(F.xxhash64(F.lit("language"), F.col("doc_id")), F.lit(1 << 30)) < share)
    size = {r[0]: r[1] for r in drawn.groupBy("lang").count().collect()}
    counts = drawn.select("lang", "text").mapInArrow(tidy(_counts), "lang string, counts binary")
    got = {r[0]: np.frombuffer(r[1], "<i8") for r in counts.groupBy("lang").applyInPandas(_summed, "lang string, counts binary").collect()}
    langs = sorted(got)
    return Model(langs, np.array([got[k] for k in langs]).reshape(len(langs), BUCKETS), np.array([size[k] for k in langs], float))


def language_columns(docs: DataFrame, model: Model, held_out: Column, keep: tuple[str, ...] = ()) -> DataFrame:
    """Predicted language of each whole text, with its posterior probability, without a shuffle.

    Returns doc_id, held_out, lang_pred, score and the columns named in ``keep``, row by row.

    A null text, a text without a letter, and any text under a model that saw no language get
    ``und`` with score 0. Ties go to the language first in code-point order. Repeated rows stay.
    The matrix (128 KB per language) is broadcast; memory holds about one megabyte of text, or
    the longest single text.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model.plain())

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = Model(*shared.value)
        for batch in batches:
            data, at = text_bytes(batch.column(2))
            letters = [bool(t and _LETTER.search(t)) and bool(fitted.langs) for t in batch.column(2).to_pylist()]
            names, scores = [], []
            for lo, hi in runs_of(at, RUN_BYTES):
                if not fitted.langs:
                    names += [UNKNOWN] * (hi - lo)
                    scores += [0.0] * (hi - lo)
                    continue
                log = fitted.log_scores(data[at[lo]:at[hi]], at[lo:hi + 1] - at[lo])
                best = log.argmax(1)
                sure = 1 / np.exp(log - log.max(1, keepdims=True)).sum(1)
                for b, s, ok in zip(best, sure, letters[lo:hi]):
                    names.append(fitted.langs[b] if ok else UNKNOWN)
                    scores.append(float(s) if ok else 0.0)
            yield pa.RecordBatch.from_arrays([
                batch.column(0).cast(pa.int64()), batch.column(1), pa.array(names, pa.string()), pa.array(scores, pa.float64()),
                *batch.columns[3:]], names=["doc_id", "held_out", "lang_pred", "score", *keep])

    kept = docs.select(*keep).schema if keep else []
    schema = ", ".join([SCHEMA, *(f"{f.name} {f.dataType.simpleString()}" for f in kept)])
    return docs.select("doc_id", held_out.alias("held_out"), F.col("text").alias("_text"), *keep).mapInArrow(tidy(convert), schema)


def identify(docs: DataFrame) -> DataFrame:
    """Train on documents whose fold of four is not 2, predict all."""
    held_out = fold_of("doc_id", 4) == 2
    return language_columns(docs, train(docs.where(~held_out)), held_out)
