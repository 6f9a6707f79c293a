"""Toxicity by class-conditional Kneser-Ney models over shared backoff counts.

Each class has a bigram model that backs off to its word model, that to its model of stems (the
first bytes of a word, so that rare forms of an expression are known by its common ones), and that
to one distribution shared by both classes, which counts in how many different words a stem occurs.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from rideops.llm.common import WordHasher, fold_of, measured, mixed, runs_of, text_bytes, tidy, tidy_group
from rideops.session import cut_lineage

#: One part in five of so many labelled documents calibrates (all others are counted), discount of the
#: models, words of the windows, bytes of a stem. The discount is above the usual 0.75 so that words seen by chance in a few
#: documents of the smaller class rest on the shared counts.
TRAIN_ROWS, DISCOUNT, WINDOWS, STEM = 16_000, 3.0, (1, 5, 20, 80), 4
#: Features of a text: the greatest mean of each window, the mean of all words, the logarithm of their number.
FEATURES = len(WINDOWS) + 2
#: Bytes of text whose pairs are packed together, bytes of text for each bucket of words, and the share of all words (1 / HOT) that
#: makes a word hot.
PACK, BUCKET_BYTES, HOT = 8 << 20, 40 << 20, 1000
#: Entries of a model's shard, and shards that a worker keeps in memory; of more it holds one at a time.
SHARD, KEPT = 2_000_000, 6
SCHEMA = "doc_id long, held_out boolean, score double, predicted int, worst_passage double, mean_log_ratio double"

#: A-Z lowered, ASCII punctuation as space.
_FOLD = np.array([c + 32 if 65 <= c <= 90 else 32 if c < 128 and not chr(c).isalnum() else c for c in range(256)], np.uint8)


def _words(hasher: WordHasher, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """(word hashes, previous word's hash or 0 at a document's start, stem hashes, first word of each document)."""
    folded = _FOLD[data]
    parted = np.full(len(data) + len(offsets), 32, np.uint8)
    size = np.diff(offsets)
    parted[np.arange(len(data)) + np.repeat(np.arange(len(size)), size)] = folded
    start, _, h, stem = hasher(parted, STEM)
    first = np.searchsorted(start, offsets[:-1] + np.arange(len(size)))
    before = np.zeros(len(h), np.uint64)
    before[1:] = h[:-1]
    before[first[first < len(h)]] = 0
    return h, before, stem, np.append(first, len(h))


def _pair(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    return mixed(v * np.uint64(0x9FB21C651E98DF25) + w)


@F.pandas_udf(LongType())
def _pair_column(v: pd.Series, w: pd.Series) -> pd.Series:
    return pd.Series(_pair(v.to_numpy(np.int64).view(np.uint64), w.to_numpy(np.int64).view(np.uint64)).view(np.int64))


PACKED = "bucket long, n long, m long, v binary, vi binary, w binary, wn binary, s binary, si binary, labelled binary, t binary, o binary"
SUMS = "kind int, v long, w long, s long, t long, o long, cont long, low_t double, low_o double, hot boolean"
_PARTS = [f.split()[0] for f in PACKED.split(", ")]
WORD, CONTEXT, PAIR, STEM_PART, ALL = range(5)


def _small(x: np.ndarray) -> bytes:
    """Counts or indices in the fewest bytes (1, 2, 4 or 8) that hold them all."""
    top = int(x.max()) if len(x) else 0
    return x.astype(next(t for t in ("<u1", "<u2", "<u4", "<u8") if top < 1 << 8 * np.dtype(t).itemsize)).tobytes()


def _sorted_bytes(x: np.ndarray) -> bytes:
    """Distinct sorted hashes: their differences byte by byte of weight, the upper ones of which are mostly 0."""
    return zlib.compress(np.ascontiguousarray(np.diff(x, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T).tobytes(), 1)


def _sorted(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(raw), np.uint8)
    return np.cumsum(np.ascontiguousarray(planes.reshape(8, -1).T).view(np.uint64).ravel(), dtype=np.uint64)


def _wide(raw: bytes, n: int) -> np.ndarray:
    return np.frombuffer(raw, f"<u{len(raw) // n}").astype(np.int64) if n else np.zeros(0, np.int64)


def _word_shares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, n) of the words that make up 1 / ``HOT`` of a task's words or more, and (null, all its words)."""
    hasher, known, total = WordHasher(), {}, 0
    for batch in batches:
        data, at = text_bytes(batch.column(0))
        for lo, hi in runs_of(at):
            h, n = np.unique(_words(hasher, data[at[lo]:at[hi]], at[lo:hi + 1] - at[lo])[0], return_counts=True)
            total += int(n.sum())
            keep = n * (4 * HOT) >= n.sum()  # less could not add up to the share in all runs
            for w, c in zip(h[keep].view(np.int64).tolist(), n[keep].tolist()):
                known[w] = known.get(w, 0) + c
    found = {w: c for w, c in known.items() if c * 2 * HOT >= total}
    yield pa.RecordBatch.from_arrays([pa.array([*found, None], pa.int64()), pa.array([*found.values(), total], pa.int64())], names=["w", "n"])


def hot_words(texts: DataFrame) -> np.ndarray:
    """Hashes of all words that make up a large share of all words (at most a few thousand).

    They only steer where pairs are counted.
    """
    counts = texts.select("text").mapInArrow(_word_shares, "w long, n long").groupBy("w").agg(F.sum("n").alias("n"))
    total = counts.where("w is null").select("n").first()
    least = F.lit((total[0] if total else 0) // (4 * HOT) + 1)
    return np.sort(np.array([r.w for r in counts.where(F.col("w").isNotNull() & (F.col("n") >= least)).collect()], np.int64).view(np.uint64))


def _bigrams(buckets: int, hot: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Distinct pairs (previous word, word) of about ``PACK`` bytes of text, packed into one row per bucket of words.

    A pair costs an index into the row's previous words; words, stems and previous words stand in
    it once. Counts are those in labelled texts. The pairs of a word share a bucket, those of a hot
    word are spread over all of them.
    """
    def packed(v: np.ndarray, w: np.ndarray, s: np.ndarray, t: np.ndarray, o: np.ndarray) -> pa.RecordBatch:
        bucket = (w >> np.uint64(3)) % np.uint64(buckets)
        if len(hot):
            spread = np.isin(w, hot)
            bucket[spread] = _pair(v[spread], w[spread]) % np.uint64(buckets)
        order = np.lexsort((w, bucket))
        bucket = bucket[order]
        cuts = np.append(np.flatnonzero(np.diff(bucket, prepend=np.uint64(buckets))), len(bucket))
        rows = {c: [] for c in _PARTS}
        for lo, hi in zip(cuts, cuts[1:]):
            i = order[lo:hi]
            words, first, n = np.unique(w[i], return_index=True, return_counts=True)
            before, vi = np.unique(v[i], return_inverse=True)
            stems, si = np.unique(s[i][first], return_inverse=True)
            labelled = np.flatnonzero(t[i] + o[i])
            values = (int(bucket[lo]), len(i), len(labelled), _sorted_bytes(before), _small(vi), _sorted_bytes(words), _small(n), _sorted_bytes(stems), _small(si), _small(labelled),
                      _small(t[i][labelled]), _small(o[i][labelled]))
            for c, x in zip(_PARTS, values):
                rows[c].append(x)
        return pa.RecordBatch.from_arrays([pa.array(rows[c], pa.int64() if c in ("bucket", "n", "m") else pa.binary()) for c in _PARTS], names=_PARTS)

    def counted(parts: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        h, before, stem, label = (np.concatenate(x) for x in zip(*parts))
        _, new, place = np.unique(_pair(before, h), return_index=True, return_inverse=True)
        t, o = (np.bincount(place[label == c], minlength=len(new)).astype(np.int64) for c in (1, 0))
        return packed(before[new], h[new], stem[new], t, o)

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, parts, held = WordHasher(), [], 0
        for batch in batches:
            toxic = batch.column(0).cast(pa.int64()).fill_null(-1).to_numpy(zero_copy_only=False)
            data, at = text_bytes(batch.column(1))
            for lo, hi in runs_of(at):
                h, before, stem, first = _words(hasher, data[at[lo]:at[hi]], at[lo:hi + 1] - at[lo])
                parts.append((h, before, stem, np.repeat(toxic[lo:hi], np.diff(first)).astype(np.int8)))
                held += int(at[hi] - at[lo])
                if held >= PACK:
                    yield counted(parts)
                    parts, held = [], 0
        if parts:
            yield counted(parts)

    return tidy(convert)


def _grouped(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys, and the sums of the values of each."""
    found, place = np.unique(keys, return_inverse=True)
    return found, *(np.bincount(place, v, len(found)) for v in values)


def _sums(hot: np.ndarray) -> Callable[[tuple, pa.Table], pa.Table]:
    """What a bucket's pairs add to: words (those that count), contexts of labelled pairs, pairs above the discount, stems, and all words."""
    def least(x: np.ndarray) -> np.ndarray:
        return np.minimum(x, DISCOUNT)

    def work(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        parts, stems = [], {}
        for row in table.to_pylist():
            n, words = row["n"], _sorted(row["w"])
            t, o = np.zeros(n, np.int64), np.zeros(n, np.int64)
            few = _wide(row["labelled"], row["m"])
            t[few], o[few] = _wide(row["t"], row["m"]), _wide(row["o"], row["m"])
            stem = _sorted(row["s"])[_wide(row["si"], len(words))]
            parts.append((_sorted(row["v"])[_wide(row["vi"], n)], np.repeat(words, _wide(row["wn"], len(words))), t, o))
            stems.setdefault("w", []).append(words)
            stems.setdefault("s", []).append(stem)
        v, w, t, o = (np.concatenate(x) for x in zip(*parts))
        parts.clear()
        _, new, place = np.unique(_pair(v, w), return_index=True, return_inverse=True)
        t, o = (np.bincount(place, x, len(new)) for x in (t, o))
        v, w = v[new], w[new]
        known, first = np.unique(np.concatenate(stems["w"]), return_index=True)
        stem = np.concatenate(stems["s"])[first]
        words, word_t, word_o, cont = _grouped(w, t, o, np.ones(len(w)))
        is_hot = np.isin(words, hot)
        counts = is_hot | (word_t > DISCOUNT) | (word_o > DISCOUNT)
        some = t + o > 0
        contexts = _grouped(v[some], t[some], o[some], least(t[some]), least(o[some]))
        often = (t > DISCOUNT) | (o > DISCOUNT)
        parts_of = _grouped(stem, word_t, word_o, cont)  # words and known are in the same order
        out = [
            _sum_rows(WORD, words[counts], s=stem[counts], t=word_t[counts], o=word_o[counts], cont=cont[counts], hot=is_hot[counts]),
            _sum_rows(CONTEXT, contexts[0], t=contexts[1], o=contexts[2], low_t=contexts[3], low_o=contexts[4]),
            _sum_rows(PAIR, v[often], w=w[often], t=t[often], o=o[often]),
            _sum_rows(STEM_PART, parts_of[0], t=parts_of[1], o=parts_of[2], cont=parts_of[3]),
            _sum_rows(ALL, np.zeros(1, np.uint64), t=word_t[~is_hot].sum(keepdims=True), o=word_o[~is_hot].sum(keepdims=True), cont=cont[~is_hot].sum(keepdims=True),
                      low_t=least(word_t[~is_hot]).sum(keepdims=True), low_o=least(word_o[~is_hot]).sum(keepdims=True))]
        return pa.concat_tables(out)

    return tidy_group(work)


def _sum_rows(kind: int, v: np.ndarray, **columns: np.ndarray) -> pa.Table:
    """Rows of :data:`SUMS`; columns that are not given are 0."""
    n, out = len(v), {}
    for name, kind_of in (f.split() for f in SUMS.split(", ")):
        x = np.full(n, kind) if name == "kind" else v if name == "v" else columns.get(name, np.zeros(n))
        x = x.view(np.int64) if x.dtype == np.uint64 else x
        out[name] = pa.array(x.astype({"int": np.int32, "long": np.int64, "double": np.float64, "boolean": bool}[kind_of]))
    return pa.table(out)


class _Table:
    """Hashes with a value each and a default for the rest.

    ``shards``: the entries by hash modulo their number, each shard (sorted hashes, values) or a
    broadcast of that; a shard that is not ``kept`` is let go after each look-up.
    """

    def __init__(self, shards: list, default: float, kept: bool = True) -> None:
        self.shards, self.default, self.kept = shards, default, kept

    def has(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        known, value = np.zeros(len(keys), bool), np.zeros(len(keys), np.float32)
        for i, shard in enumerate(self.shards):
            mine = np.flatnonzero(keys.view(np.int64) % len(self.shards) == i) if len(self.shards) > 1 else np.arange(len(keys))
            k, v = shard if isinstance(shard, tuple) else shard.value
            if len(k) and len(mine):
                at = np.minimum(np.searchsorted(k, keys[mine]), len(k) - 1)
                hit = k[at] == keys[mine]
                known[mine[hit]], value[mine[hit]] = True, v[at[hit]]
            if not self.kept and not isinstance(shard, tuple):
                shard.__dict__.pop("_value", None)
        return known, value

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        known, value = self.has(keys)
        return np.where(known, value, np.float32(self.default))


def _table(entries: DataFrame, default: float) -> _Table:
    """A table of (key, value) rows. The driver holds one shard at a time."""
    spark = entries.sparkSession
    entries = cut_lineage(entries.select(F.col("key").cast("long").alias("key"), F.col("value").cast("float").alias("value")))
    n, out = max(-(-entries.count() // SHARD), 1), []
    for i in range(n):
        shard = entries.where(F.pmod("key", F.lit(n)) == i).toArrow()  # never as Python rows
        keys = shard["key"].to_numpy().astype(np.int64).view(np.uint64)
        order = np.argsort(keys)
        out.append(spark.sparkContext.broadcast((keys[order], shard["value"].to_numpy().astype(np.float32)[order])))
    return _Table(out, default)


@dataclass
class Model:
    """Log-likelihood ratios of stems, words, contexts and frequent bigrams; calibration weights."""

    stem: _Table
    word: _Table
    context: _Table
    bigram: _Table
    weights: np.ndarray

    def plain(self) -> tuple:
        """What a task carries: broadcasts and numbers, no class of this library."""
        return tuple((t.shards, t.default) for t in (self.stem, self.word, self.context, self.bigram)), self.weights

    @staticmethod
    def of(plain: tuple) -> Model:
        kept = sum(len(shards) for shards, _ in plain[0]) <= KEPT
        return Model(*(_Table(*t, kept) for t in plain[0]), plain[1])

    def run_bytes(self) -> int:
        """Text of a run: more when shards are loaded for each."""
        return 1 << 21 if self.word.kept else 1 << 23

    def ratios(self, h: np.ndarray, before: np.ndarray, stem: np.ndarray) -> np.ndarray:
        """log p(word | previous word, toxic) - log p(word | previous word, ordinary)."""
        known, value = self.word.has(h)
        back = self.context(before) + np.where(known, value, np.float32(self.word.default) + self.stem(stem))
        known, value = self.bigram.has(_pair(before, h))
        return np.where(known, value, back)

    def features(self, hasher: WordHasher, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Per document: greatest mean ratio over the windows of each length, mean of all words, log(1 + words).

        A text shorter than a window is one window.
        """
        h, before, stem, first = _words(hasher, data, offsets)
        size, out = np.diff(first), np.zeros((len(first) - 1, FEATURES))
        total = np.append(0.0, np.cumsum(self.ratios(h, before, stem), dtype=np.float64))
        some = size > 0
        out[some, -2] = (total[first[1:]] - total[first[:-1]])[some] / size[some]
        out[:, -1] = np.log1p(size)
        for k, window in enumerate(WINDOWS):
            out[:, k] = out[:, -2]
            long = np.flatnonzero(size > window)
            if len(long):
                means = (total[window:] - total[:-window]) / window
                cuts = np.stack([first[long], first[long + 1] - window + 1], 1).ravel()
                out[long, k] = np.maximum.reduceat(np.append(means, -np.inf), cuts)[::2]
        return out

    def scores(self, features: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(features @ self.weights[1:] + self.weights[0], -50, 50)))


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Intercept and weights by damped Newton steps with a small ridge."""
    x = np.column_stack([np.ones(len(x)), x])
    w, ridge = np.zeros(x.shape[1]), 1e-2
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) + ridge * w
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), grad)
        w -= step * min(1.0, 4.0 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-8:
            break
    return w


def _calibrated(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Intercept and weights of the features.

    The greatest of more windows is greater by chance, so each window counts by what it exceeds the
    line that ordinary texts of its length follow; the length itself is no evidence.
    """
    level = np.column_stack([np.ones(len(x)), x[:, -1]])
    lines = np.linalg.lstsq(level[y == 0], x[y == 0, :-2], rcond=None)[0] if (y == 0).any() else np.zeros((2, len(WINDOWS)))
    w = _logistic(np.column_stack([x[:, :-2] - level @ lines, x[:, -2]]), y)
    base, length = -(lines @ w[1:-1])
    return np.concatenate([[w[0] + base], w[1:], [length]])


def _worst(x: np.ndarray) -> np.ndarray:
    """Greatest mean ratio of a passage: a window of more than one word, or the whole shorter text."""
    return x[:, 1:len(WINDOWS)].max(1)


def _features(rows: DataFrame, model: Model) -> DataFrame:
    """(toxic, x) of labelled texts."""
    plain = model.plain()

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, fitted = WordHasher(), Model.of(plain)
        for batch in batches:
            data, at = text_bytes(batch.column(1))
            x = np.concatenate([fitted.features(hasher, data[at[lo]:at[hi]], at[lo:hi + 1] - at[lo]) for lo, hi in runs_of(at, fitted.run_bytes())] or [np.zeros((0, FEATURES))])
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int32()), pa.array(list(x), pa.list_(pa.float64()))], names=["toxic", "x"])

    return rows.select("toxic", "text").mapInArrow(convert, "toxic int, x array<double>")


def known_labels(labels: DataFrame, bound: int = TRAIN_ROWS) -> DataFrame:
    """(doc_id, toxic, calibrate) of all labelled ids; the greater of several labels counts.

    About a fifth of ``bound`` ids at most, drawn by a hash of the id, calibrate.
    """
    known = labels.where(F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    share = min(1.0, bound / max(known.count(), 1)) / 5
    drawn = F.pmod(F.xxhash64(F.lit("calibrate"), F.col("doc_id")), F.lit(1 << 20))
    return known.withColumn("calibrate", drawn < F.lit(int(share * (1 << 20))))


def _smoothed(count: Column, whole: Column, low: Column, base: Column) -> Column:
    return (F.greatest(count - DISCOUNT, F.lit(0.0)) + low * base) / whole


def train(rows: DataFrame, texts: DataFrame | None = None) -> Model:
    """Fit on all (doc_id, text, toxic, calibrate) rows; ``toxic`` is null for texts without a label.

    Class counts are those of all labelled texts that do not calibrate, shared counts those of all
    other texts too. Counts, probabilities and ratios are made in Spark. Entries not above the
    discount in either class equal their backoff, so the tables without them are exact; they are
    broadcast in shards of bounded size, as many as it takes. ``texts`` are the same texts without
    their labels, if they can be read more cheaply; they only steer how pairs are dealt.
    """
    texts = rows if texts is None else texts
    counted = rows.where(~F.coalesce("calibrate", F.lit(False)))
    low = [F.sum(F.least(F.col(n), F.lit(DISCOUNT))).alias(f"low_{n}") for n in "to"]
    both = [F.sum(n).alias(n) for n in "to"]
    often = (F.col("t") > DISCOUNT) | (F.col("o") > DISCOUNT)
    hot = hot_words(texts)
    buckets = max(8, -(-(texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // BUCKET_BYTES))
    # One exchange of packed pairs; a bucket's task counts them and sends on only what the model needs.
    packed = counted.select("toxic", "text").mapInArrow(_bigrams(buckets, hot), PACKED)
    sums = cut_lineage(packed.groupBy("bucket").applyInArrow(_sums(hot), SUMS))
    words = sums.where(F.col("kind") == WORD).groupBy(F.col("v").alias("w")).agg(F.max("s").alias("s"), *both, F.sum("cont").alias("cont"), F.max("hot").alias("hot"))
    contexts = sums.where(F.col("kind") == CONTEXT).groupBy("v").agg(*both, *[F.sum(c).alias(c) for c in ("low_t", "low_o")])
    pairs = sums.where(F.col("kind") == PAIR).select("v", "w", "t", "o")
    stems = cut_lineage(sums.where(F.col("kind") == STEM_PART).groupBy(F.col("v").alias("s")).agg(*both, F.sum("cont").alias("cont")))
    all_stems = stems.agg(*both, *low, F.sum("cont").alias("cont")).first()
    rest = sums.where(F.col("kind") == ALL).select("t", "o", "low_t", "low_o")
    each = words.where("hot").select("t", "o", *(F.least(F.col(n), F.lit(DISCOUNT)).alias(f"low_{n}") for n in "to"))
    all_words = rest.unionByName(each).agg(*[F.sum(c).alias(c) for c in ("t", "o", "low_t", "low_o")]).first()
    if not all_words.t or not all_words.o:
        labels = {r[0]: r[1] for r in rows.where(F.col("toxic").isNotNull()).groupBy("toxic").count().collect()}
        empty, prior = _Table([], 0.0), (labels.get(1, 0) + 1) / (sum(labels.values()) + 2)
        return Model(empty, empty, empty, empty, np.append(np.log(prior / (1 - prior)), np.zeros(FEATURES)))

    def smoothed(c: str, total, base: Column) -> Column:
        return _smoothed(F.col(c), F.lit(float(total[c])), F.lit(float(total[f"low_{c}"])), base)

    def ratio(prefix: str) -> Column:
        return F.log(F.col(f"{prefix}t") / F.col(f"{prefix}o")).alias("value")

    z = stems.select("s", "t", "o", F.col("cont").alias("stem_cont"), *(smoothed(c, all_stems, F.col("cont") / F.lit(float(all_stems.cont))).alias(f"f_{c}") for c in "to"))
    w = words.where(often).join(z.select("s", "stem_cont", "f_t", "f_o"), "s")
    w = cut_lineage(w.select("w", *(smoothed(c, all_words, F.col(f"f_{c}") * F.col("cont") / F.col("stem_cont")).alias(f"p_{c}") for c in "to")))
    gamma = [F.when(F.col(c) > 0, F.col(f"low_{c}") / F.col(c)).otherwise(1.0).alias(f"g_{c}") for c in "to"]
    v = cut_lineage(contexts.where(often).select("v", *(F.greatest(F.col(c), F.lit(1)).alias(f"v_{c}") for c in "to"), *gamma))
    b = pairs.join(w, "w").join(v, "v")
    b = b.select(_pair_column("v", "w").alias("key"), *(
        (F.greatest(F.col(c) - DISCOUNT, F.lit(0.0)) / F.col(f"v_{c}") + F.col(f"g_{c}") * F.col(f"p_{c}")).alias(f"q_{c}") for c in "to"))

    def unseen(total) -> float:
        return float(np.log((total.low_t / total.t) / (total.low_o / total.o)))

    model = Model(
        _table(z.where(often).select(F.col("s").alias("key"), ratio("f_")), unseen(all_stems)),
        _table(w.select(F.col("w").alias("key"), ratio("p_")), unseen(all_words)),
        _table(v.select(F.col("v").alias("key"), ratio("g_")), 0.0),
        _table(b.select("key", ratio("q_")), 0.0), np.zeros(FEATURES + 1))
    check = _features(rows.where("calibrate"), model).toPandas()
    model.weights = _calibrated(np.array(check["x"].tolist(), float).reshape(-1, FEATURES), check["toxic"].to_numpy(float))
    return model


def toxicity_columns(docs: DataFrame, model: Model, held_out: Column) -> DataFrame:
    """Score each whole text, without a shuffle: one row per input row.

    A text's log-likelihoods under both models are compared per word: over the whole text and in
    its worst windows of 1, 5, 20 and 80 words, set off against what ordinary texts of that length
    reach by chance. Null and empty texts have ratio 0 and the calibration's score for
    it. Repeated rows stay. Memory holds about two megabytes of text, or the longest single text.
    """
    plain = model.plain()

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, fitted = WordHasher(), Model.of(plain)
        for batch in batches:
            data, at = text_bytes(batch.column(2))
            x = np.concatenate([fitted.features(hasher, data[at[lo]:at[hi]], at[lo:hi + 1] - at[lo]) for lo, hi in runs_of(at, fitted.run_bytes())] or [np.zeros((0, FEATURES))])
            score = fitted.scores(x)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), batch.column(1), pa.array(score), pa.array((score >= 0.5).astype(np.int32)), pa.array(_worst(x)), pa.array(x[:, -2])],
                names=["doc_id", "held_out", "score", "predicted", "worst_passage", "mean_log_ratio"])

    return docs.select("doc_id", held_out.alias("held_out"), "text").mapInArrow(convert, SCHEMA)


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Train on documents whose fold of five is not 0, with all their labels, and score all.

    Labels are a few bytes a row and are broadcast up to a measured number; beyond it every pass
    over the training texts shuffles them to their labels.
    """
    other = fold_of("doc_id", 5) != 0
    known = measured(known_labels(labels.where(other)))
    texts = docs.where(other).select("doc_id", "text")
    return toxicity_columns(docs, train(texts.join(known, "doc_id", "left"), texts), ~other)
