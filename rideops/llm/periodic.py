"""Periodic runs of words, found by minimizers on several scales.

A run is a stretch of words in which words q apart are equal, at least four periods and six words
long, that no neighbour extends. Periods up to ``SHORT`` are found by comparing the words with
themselves at every lag. Each scale P = 16, 32, 64, ... serves the periods above P/2 up to P: every
position bears a hash of its next P words, and the least hash of each window of P/2 positions is
selected. Windows one period apart inside a run hold the same hashes, so selected positions repeat
at that distance; as P words hold a whole period, equal hashes inside a run are whole periods
apart, and neighbours among the selected positions of one hash stand exactly one period apart.
These pairs seed the runs. Seeds of one distance that lie within a window of each other are
extended together by comparing words, so that no hash decides what a run is.

Documents are independent: there is no shuffle, and the work grows with n log n words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rideops.llm.common import WORD, WordHasher, mixed, runs_of, text_bytes

#: Greatest period found by comparing at every lag; the first scale begins above it.
SHORT = 8
#: A run has at least so many periods and words.
PERIODS, WORDS = 4, 6
#: Words compared at a time while seeds are extended.
COMPARED = 1 << 21
RUN = "struct<start:long,length:long,period:long>"
SCHEMA = f"doc_id long, n_words long, runs array<{RUN}>, collapsed string"


def _stretches(equal: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the stretches of True."""
    padded = np.zeros(len(equal) + 2, bool)
    padded[1:-1] = equal
    edge = np.flatnonzero(padded[1:] != padded[:-1])
    return edge[::2], edge[1::2]


def _prime_factors(n: int) -> list[int]:
    out, f = [], 2
    while f * f <= n:
        if n % f == 0:
            out.append(f)
            while n % f == 0:
                n //= f
        f += 1
    return [*out, n] if n > 1 else out


def _short_runs(codes: np.ndarray) -> list[np.ndarray]:
    """(start, length, period) of the runs with a period up to ``SHORT``."""
    found, matches = [], {}
    for q in range(1, min(SHORT, len(codes) - 1) + 1):
        equal = codes[q:] == codes[:-q]
        start, end = _stretches(equal)
        long = end - start >= max(WORDS - q, (PERIODS - 1) * q)
        start, end = start[long], end[long]
        for f in _prime_factors(q):  # a stretch with a shorter period belongs to that one
            whole = matches[q // f]
            other = whole[start + q] - whole[start] != q
            start, end = start[other], end[other]
        if 2 * q <= SHORT:
            matches[q] = np.concatenate([[0], np.cumsum(equal)])
        found.append(np.stack([start, end - start + q, np.full(len(start), q)]))
    return found


def _slide(values: np.ndarray, size: int, pick: np.ufunc) -> np.ndarray:
    """``pick`` over every window of ``size`` (a power of two) values."""
    step = 1
    while step < size:
        values = pick(values[:-step], values[step:])
        step *= 2
    return values


def _seeds(grams: np.ndarray, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """(position, distance) of neighbouring minimizers of one hash, for distances of this scale."""
    window = scale // 2
    least = _slide(grams, window, np.minimum)
    around = np.zeros(len(least) + 2 * (window - 1), np.uint64)
    around[window - 1:window - 1 + len(least)] = least
    at = np.flatnonzero(_slide(around, window, np.maximum) == grams)
    at = at[np.argsort(grams[at], kind="stable")]
    apart = np.diff(at)
    pair = (grams[at[1:]] == grams[at[:-1]]) & (apart > window) & (apart <= scale)
    return at[:-1][pair], apart[pair]


def _extended(codes: np.ndarray, position: np.ndarray, period: np.ndarray, scale: int) -> np.ndarray:
    """The runs around seeds: (start, length, period), each once.

    The outermost seeds of a run lie within a window of its start and within a window and a gram
    of its last period, so the words compared around them hold the mismatches that end it.
    """
    window = scale // 2
    order = np.lexsort((position, period))
    position, period = position[order], period[order]
    fresh = np.ones(len(position), bool)
    fresh[1:] = (period[1:] != period[:-1]) | (np.diff(position) > window)
    first = np.flatnonzero(fresh)
    last = np.append(first[1:], len(position)) - 1
    q = period[first]
    low = np.maximum(position[first] - window, 0)
    size = np.maximum(np.minimum(position[last] + scale + window + 1, len(codes) - q) - low, 0) + 1  # one to part them
    ends = np.cumsum(size)
    found = []
    at = 0
    while at < len(q):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + COMPARED, "right")))
        begin = np.cumsum(size[at:to]) - size[at:to]
        index = np.arange(int(size[at:to].sum())) + np.repeat(low[at:to] - begin, size[at:to])
        lag = np.repeat(q[at:to], size[at:to])
        parts = begin[1:] - 1
        equal = codes[np.minimum(index, len(codes) - 1)] == codes[np.minimum(index + lag, len(codes) - 1)]
        equal[parts] = False
        equal[-1] = False
        start, end = _stretches(equal)
        keep = end - start >= (PERIODS - 1) * lag[start]
        start, end = start[keep], end[keep]
        found.append(np.stack([index[start], end - start + lag[start], lag[start]]))
        at = to
    runs = np.unique(np.concatenate(found, axis=1), axis=1)
    ends_of = runs[0] + runs[1]
    # A stretch cut off by the border of a comparison is whole in another one.
    whole = ((runs[0] == 0) | (codes[runs[0] - 1] != codes[runs[0] - 1 + runs[2]])) & (
        (ends_of == len(codes)) | (codes[np.minimum(ends_of, len(codes) - 1)] != codes[ends_of - runs[2]]))
    runs = runs[:, whole]

    def primitive(start: int, q: int) -> bool:
        return not any((codes[start:start + q] == codes[start + q // f:start + q // f + q]).all() for f in _prime_factors(q))

    return runs[:, [primitive(s, q) for s, _, q in runs.T.tolist()]] if runs.size else runs


def periodic_runs(codes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """(document, start, length, period) of every run, by document, start and period.

    ``codes`` are the words of all documents as 64-bit values, ``bounds`` where documents begin
    and the last one ends. Words of different documents never share a run.
    """
    n = len(bounds) - 1
    # One value of its own after each document: no stretch of two periods can hold it.
    line = np.empty(len(codes) + n, np.uint64)
    begin = bounds[:-1] + np.arange(n)
    words = np.ones(len(line), bool)
    words[bounds[1:] + np.arange(n)] = False
    line[words] = codes
    line[~words] = mixed(np.arange(n, dtype=np.uint64) + np.uint64(0x51ED270B7F4A7C15))
    found = _short_runs(line)

    length, place = np.diff(bounds), np.arange(len(line))
    part, grams, scale, have = line, mixed(line), 2 * SHORT, 1
    while len(length) and PERIODS * (scale // 2 + 1) <= length.max():
        stay = length >= PERIODS * (scale // 2 + 1)
        if not stay.all():  # only documents long enough for this scale
            mask = np.repeat(stay, length + 1)
            part, grams, place, length = part[mask], grams[mask], place[mask], length[stay]
        while have < scale:
            longer = np.zeros(len(grams), np.uint64)
            longer[:-have] = mixed(grams[:-have] * np.uint64(0x9E3779B97F4A7C15) + grams[have:])
            grams, have = longer, 2 * have
        seeds = _seeds(grams, scale)
        if len(seeds[0]):
            runs = _extended(part, *seeds, scale)
            runs[0] = place[runs[0]]
            found.append(runs)
        scale *= 2
    runs = np.concatenate(found, axis=1) if found else np.zeros((3, 0), np.int64)
    doc = np.searchsorted(begin, runs[0], "right") - 1
    runs = np.concatenate([doc[None], (runs[0] - begin[doc])[None], runs[1:]]) if runs.size else np.zeros((4, 0), np.int64)
    return runs[:, np.lexsort((runs[3], runs[1], runs[0]))]


def _parted(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts with a space after each, and where they begin."""
    n = len(at) - 1
    begin = at[:-1] + np.arange(n)
    out = np.full(len(data) + n, 32, np.uint8)
    out[np.arange(len(data)) + np.repeat(np.arange(n), np.diff(at))] = data
    return out, begin


def _gathered(data: np.ndarray, start: np.ndarray, end: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words joined by one space within each document, and the offsets of the documents' bytes."""
    size = end - start + 1
    to = np.cumsum(size)
    index = np.arange(int(size.sum())) + np.repeat(start - (to - size), size)
    out = data[np.minimum(index, max(len(data) - 1, 0))]
    out[to - 1] = 32
    filled = np.diff(bounds) > 0
    inner = np.ones(len(out), bool)
    inner[to[bounds[1:][filled] - 1] - 1] = False  # no space after a document's last word
    sizes = np.concatenate([[0], to])[bounds]
    lengths = np.diff(sizes) - filled
    return out[inner], np.concatenate([[0], np.cumsum(lengths)])


def find_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, runs, collapsed) for every row of ``docs`` (doc_id, text).

    ``runs`` holds start (word number from 0), length and smallest period of every run, by start
    and period. ``collapsed`` is the text without the words that some run contains after its first
    period, the others joined by one space. A null or empty text has no words and no runs, and
    collapses to ''. Repeated rows stay, a null id stays null, other columns are not looked at.
    Words are compared by 64-bit hashes. Memory holds about two megabytes of texts, or the longest
    single text, at a time.
    """

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHasher()
        for batch in batches:
            data, at = text_bytes(batch.column(1))
            for lo, hi in runs_of(at):
                part, begin = _parted(data[at[lo]:at[hi]], at[lo:hi + 1] - at[lo])
                start, end, codes = words(part)
                bounds = np.append(np.searchsorted(start, begin), len(start))
                doc, first, length, period = periodic_runs(codes, bounds)
                change = np.zeros(len(start) + 1, np.int64)
                np.add.at(change, bounds[doc] + first + period, 1)
                np.add.at(change, bounds[doc] + first + length, -1)
                kept = np.cumsum(change)[:-1] == 0
                left = np.concatenate([[0], np.cumsum(kept)])[bounds]
                text, ends = _gathered(part, start[kept], end[kept], left)
                n = hi - lo
                runs = pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in (first, length, period)], ["start", "length", "period"])
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(lo, n).cast(pa.int64()), pa.array(np.diff(bounds), pa.int64()),
                    pa.ListArray.from_arrays(pa.array(np.searchsorted(doc, np.arange(n + 1)), pa.int32()), runs),
                    pa.StringArray.from_buffers(n, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(text))),
                ], names=["doc_id", "n_words", "runs", "collapsed"])

    return docs.select("doc_id", "text").mapInArrow(convert, SCHEMA)


def with_planted_tails(docs: DataFrame) -> DataFrame:
    """(doc_id, text) in which every tenth document, by crc32 of its id, ends periodically.

    Its words from word a on repeat the first p of them; a and p follow from the crc32. A null id
    or a text without words stays as it is.
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)
    chosen = docs.select("doc_id", "text", g.alias("_g"), F.when(h % 10 == 0, F.regexp_extract_all("text", F.lit(WORD), F.lit(0))).alias("_words"))
    n, a = F.size("_words"), F.col("_a")
    p = F.lit(1) + F.floor((n - a) / (3 + F.col("_g") % 8))
    chosen = chosen.withColumn("_a", F.when(n > 0, F.col("_g") % n)).withColumn("_p", p)

    def word(x: Column, i: Column) -> Column:
        return F.when(i < a, x).otherwise(F.get("_words", (a + (i - a) % F.col("_p")).cast("int")))

    return chosen.select("doc_id", F.when(F.col("_a").isNotNull(), F.array_join(F.transform("_words", word), " ")).otherwise(F.col("text")).alias("text"))


def run_columns(found: DataFrame) -> DataFrame:
    """The number of runs, the longest one (ties: smallest start, then period) and digests."""
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r.length.alias("length"), (-r.start).alias("start"), (-r.period).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r.start, r.length, r.period)), "\n")
    out = found.withColumn("_longest", longest)
    length, period = F.col("_longest.length"), -F.col("_longest.period")
    return out.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("_longest.start")).alias("start"), length.alias("length"), period.alias("period"),
        F.floor(1000 * length / period).cast("long").alias("exponent_milli"),
        F.sha2(F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise(F.lit("")), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"))
