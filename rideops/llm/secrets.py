"""Secret scans: patterns, and the guess cost of values in a credential context.

Three patterns find what looks like a secret by itself. Besides, every value that stands where a
credential stands (after a key and a sign, in a URL, after "password is") is priced as an attacker
would guess it: dynamic programming finds its cheapest segmentation into words, dates, repeats,
keyboard walks and brute-force spans. Values that take ``LEAST`` decades of guesses or more are
spans as well, so that `pwd: "Tr0ub4dor&3"` is found and `login: required1` is not.

Words are priced by their rank in the corpus: document frequencies of all texts, without the
values themselves, so that a secret copied often does not become a word. The ranked dictionary has
``DICTIONARY`` entries at most, as a guesser's has; beyond them letters are brute force.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rideops.session import cut_lineage

#: Words in the guesser's dictionary (fixed size, broadcast), and their longest length.
DICTIONARY, LONGEST = 30_000, 24
#: Decades of guesses from which a value is a span, and the shortest such value.
LEAST, SHORTEST = 8.0, 6
#: Words one task counts before it sends them on.
COUNTED = 200_000

# The base patterns, and the order of kinds at one start.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS, HEX = re.compile(r"AKIA[A-Z0-9]+"), re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "guess")

# Where credentials stand; the last group is the value.
CONTEXTS = tuple(re.compile(p, re.ASCII | re.IGNORECASE) for p in (
    r"""(?:pass(?:word|wd|phrase|code|key)?|pwd|secret|token|api[_-]?key|(?:access|private|secret|account)[_-]?key|credentials?|login|auth)["']?[ \t]*(?:=>|:=|[:=])[ \t]*(?:"([^"\r\n]+)"|'([^'\r\n]+)'|([^\s"'<>,;]+))""",
    r"""(?:password|passphrase|passcode|pin|secret) (?:is|was) (?:"([^"\r\n]+)"|'([^'\r\n]+)'|([^\s"'<>,;]+))""",
    r"""://[^\s:/@]+:([^\s/@]+)@""",
    r"""bearer +([A-Za-z0-9._~+/=-]+)""",
))
HINTS = ("pass", "pwd", "secret", "token", "key", "credential", "login", "auth", "pin ", "://", "bearer")
_WORDS = re.compile(r"[^\W\d_]{3,}")
_MIXED = re.compile(r"\d|[^\w\s.,-]|_|[a-z][A-Z]", re.ASCII)

# The keys of a keyboard in its slanted rows, what shift makes of them, letters drawn as signs.
ROWS = ("`1234567890-=", " qwertyuiop[]\\", " asdfghjkl;'", " zxcvbnm,./")
SHIFTED = dict(zip('~!@#$%^&*()_+{}|:"<>?', "`1234567890-=[]\\;',./"))
ALPHABET = "abcdefghijklmnopqrstuvwxyz"
DRAWN = str.maketrans("@4310!5$7+", "aaeioisstt")
DATES = tuple(re.compile(p, re.ASCII) for p in (
    r"(?P<year>\d{4})(?P<sign>[-/._]?)(?P<one>\d{1,2})(?P=sign)(?P<two>\d{1,2})", r"(?P<one>\d{1,2})(?P<sign>[-/._]?)(?P<two>\d{1,2})(?P=sign)(?P<year>\d{4})",
    r"(?P<one>\d{1,2})(?P<sign>[-/._]?)(?P<two>\d{1,2})(?P=sign)(?P<year>\d{2})"))
YEARS = re.compile(r"19\d\d|20\d\d", re.ASCII)
#: Attackers try years around this one first.
YEAR, SPREAD = 2025, 20


PLACE = {c: (r, k) for r, row in enumerate(ROWS) for k, c in enumerate(row) if c != " "}


def _neighbours() -> dict[str, frozenset]:
    at = {p: c for c, p in PLACE.items()}
    near = {}
    for c, (r, k) in PLACE.items():
        steps = ((0, -1), (0, 1), (-1, 0), (-1, 1), (1, -1), (1, 0))
        near[c] = frozenset(at[r + y, k + x] for y, x in steps if (r + y, k + x) in at)
    for a, b in zip(ALPHABET, ALPHABET[1:]):
        near[a], near[b] = near[a] | {b}, near[b] | {a}
    return near


NEAR = _neighbours()
DEGREE = sum(map(len, NEAR.values())) / len(NEAR)
#: What one more segment costs: the guesser does not know where it begins.
SEAM = math.log10(2)


def alphabet_of(value: str) -> float:
    """Decades of guesses one brute-force character takes, by the kinds of characters present."""
    size = 10 * any("0" <= c <= "9" for c in value) + 26 * any("a" <= c <= "z" for c in value) + 26 * any("A" <= c <= "Z" for c in value)
    size += 33 * any(c.isascii() and not c.isalnum() for c in value) + 100 * (not value.isascii())
    return math.log10(max(size, 10))


def _words(value: str, ranks: dict[str, int]) -> Iterator[tuple[int, int, float, str]]:
    low = "".join(c.lower() if len(c.lower()) == 1 else c for c in value)
    drawn = low.translate(DRAWN)
    for i in range(len(value)):
        for j in range(i + 3, min(i + LONGEST, len(value)) + 1):
            for text in {low[i:j], drawn[i:j]}:
                rank = ranks.get(text)
                if rank:
                    signs = sum(a != b for a, b in zip(low[i:j], text))
                    upper = sum(c.isupper() for c in value[i:j])
                    usual = upper in (0, j - i) or (upper == 1 and value[i].isupper())
                    cost = math.log10(rank) + signs * SEAM + (SEAM if usual and upper else 0 if usual else math.log10(math.comb(j - i, upper)))
                    yield i, j, cost, "word"


def _dates(value: str) -> Iterator[tuple[int, int, float, str]]:
    for i, c in enumerate(value):
        if not "0" <= c <= "9":
            continue
        alone = YEARS.match(value, i)
        if alone:
            yield i, i + 4, math.log10(max(abs(int(alone[0]) - YEAR), SPREAD)), "date"
        for m in filter(None, (p.match(value, i) for p in DATES)):
            low, high = sorted((int(m["one"]), int(m["two"])))
            if 1 <= low <= 12 and high <= 31:
                years = max(abs(int(m["year"]) + 2000 * (len(m["year"]) == 2) - YEAR), SPREAD)
                yield i, m.end(), math.log10(365 * years) + (math.log10(4) if m["sign"] else 0), "date"


def _repeats(value: str, ranks: dict[str, int]) -> Iterator[tuple[int, int, float, str]]:
    for unit in range(1, min(8, len(value) // 2) + 1):
        i = 0
        while i + unit < len(value):
            j = i
            while j + unit < len(value) and value[j] == value[j + unit]:
                j += 1
            times = (j - i) // unit + 1
            if times > 1 and times * unit >= 3:
                base = guesses(value[i:i + unit], ranks) if unit > 1 else alphabet_of(value[i])
                for k in range(2, times + 1):
                    if k * unit >= 3:
                        yield i, i + k * unit, base + math.log10(k), "repeat"
                        if k < times:  # an earlier segment may have taken the first units
                            yield i + (times - k) * unit, i + times * unit, base + math.log10(k), "repeat"
            i = max(j, i + 1)


def _line(a: str, b: str) -> tuple[int, int]:
    """Direction of a step between two keys; along the alphabet if they do not touch."""
    (r, k), (s, m) = PLACE[a], PLACE[b]
    return (s - r, m - k) if abs(s - r) <= 1 and abs(m - k) <= 1 else (9, ord(b) - ord(a))


def _walks(value: str) -> Iterator[tuple[int, int, float, str]]:
    keys = [SHIFTED.get(c, c.lower()) for c in value]
    ways = [None] + [_line(a, b) if b in NEAR.get(a, ()) else None for a, b in zip(keys, keys[1:])]
    turned = [0]
    for j, way in enumerate(ways):
        turned.append(turned[-1] + (way is not None and way != ways[j - 1]))
    i = 0
    while i < len(keys):
        j = i + 1
        while j < len(keys) and ways[j] is not None:
            j += 1
        for size in range(4, j - i + 1):
            for lo in {i, j - size}:
                yield lo, lo + size, math.log10(len(NEAR) * size) + (1 + turned[lo + size] - turned[lo + 2]) * math.log10(DEGREE), "walk"
        i = j


def segments(value: str, ranks: dict[str, int]) -> list[tuple[int, int, float, str]]:
    """(start, end, decades of guesses, kind) of everything but brute force that fits somewhere."""
    return [*_words(value, ranks), *_dates(value), *_repeats(value, ranks), *_walks(value)]


def guesses(value: str, ranks: dict[str, int]) -> float:
    """Decades of guesses of the cheapest segmentation: one pass over the ends of segments."""
    per, until = alphabet_of(value), {}
    for i, j, cost, _ in segments(value, ranks):
        until.setdefault(j, []).append((i, cost))
    best, brute = [0.0], [math.inf]
    for j in range(1, len(value) + 1):
        brute.append(per + min(brute[-1], best[-1] + (SEAM if j > 1 else 0)))
        best.append(min([brute[-1], *(best[i] + cost + (SEAM if i else 0) for i, cost in until.get(j, ()))]))
    return best[-1]


def _base(text: str, low: str) -> list[tuple[int, int, int, int]]:
    """(start, order of kind, end, start of the value) of the base spans."""
    found = []
    if any(h in low for h in ("passw", "secret", "token", "api")):
        found += [(m.start(), 0, m.end(), m.start(2)) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end(), m.start()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), 2, m.end(), m.start()) for m in HEX.finditer(text)]
    return found


def values_of(text: str, low: str) -> list[tuple[int, int]]:
    """Spans of the values in a credential context."""
    if not any(h in low for h in HINTS):
        return []
    found = set()
    for pattern in CONTEXTS:
        for m in pattern.finditer(text):
            lo, hi = m.span(m.lastindex)
            while hi > lo and text[hi - 1] in ".,;:!?)]}" and text[lo - 1:lo] not in ('"', "'"):
                hi -= 1
            if hi > lo:
                found.add((lo, hi))
    return sorted(found)


def scan(text: str, ranks: dict[str, int], least: float = LEAST) -> list[tuple[int, int, int, float | None]]:
    """(start, order of kind, end, decades of guesses) of all spans of a text, by start and kind."""
    low = text.lower()
    base, values = _base(text, low), values_of(text, low)
    out = [(lo, k, hi, guesses(text[at:hi], ranks) if k == 0 else None) for lo, k, hi, at in base]
    taken = 0
    for lo, hi in values:
        if lo < taken or hi - lo < SHORTEST or not _MIXED.search(text, lo, hi) or any(a < hi and lo < b for a, _, b, _ in base):
            continue
        cost = guesses(text[lo:hi], ranks)
        if cost >= least:
            out.append((lo, 3, hi, cost))
            taken = hi
    return sorted(out)


def dictionary(docs: DataFrame, size: int = DICTIONARY) -> list[str]:
    """The words of most documents, by falling number (ties by text), counted over all texts.

    Values in a credential context are no words. Numbers of documents are graded in sixteenths of
    a doubling; as many grades are taken from the top as hold ``size`` words at most, so that the
    driver receives a table of grades (a thousand rows) and the dictionary itself, nothing else.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def rows() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])
            held.clear()
            return out

        for batch in batches:
            for text in batch.column(0):
                text = text.as_py()
                if not text:
                    continue
                low = text.lower()
                for lo, hi in reversed(values_of(text, low)):
                    text = text[:lo] + " " + text[hi:]
                held.update({w for w in _WORDS.findall(text.lower()) if len(w) <= LONGEST})
                if len(held) >= COUNTED:
                    yield rows()
        yield rows()

    counts = docs.select("text").mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    counts = cut_lineage(counts).withColumn("grade", F.floor(16 * F.log2("n")))
    held, least = 0, None
    for grade, words in sorted(map(tuple, counts.groupBy("grade").count().collect()), reverse=True):
        held += words
        if held > size:
            break
        least = grade
    if least is None:
        return []
    return [r.word for r in sorted(counts.where(F.col("grade") >= least).select("n", "word").collect(), key=lambda r: (-r.n, r.word))]


SPAN = "struct<kind:string,start:long,end:long,decades:double>"


def find_secrets(docs: DataFrame, size: int = DICTIONARY, least: float = LEAST) -> DataFrame:
    """(doc_id, spans) for every row of ``docs`` (doc_id, text), after one pass for the dictionary.

    ``spans`` holds kind, start and end (code points, end exclusive) of the base patterns and of
    further values (``guess``), and ``decades``, the logarithm of the guesses a value in a
    credential context takes. Null and empty texts have none. Repeated rows stay, a null id stays
    null, other columns are not looked at. One text is held at a time; the work on a value grows
    with its length.
    """
    shared = docs.sparkSession.sparkContext.broadcast({w: i + 1 for i, w in enumerate(dictionary(docs, size))})
    kind = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("decades", pa.float64())])

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = shared.value
        for batch in batches:
            spans = [[(KINDS[k], lo, hi, cost) for lo, k, hi, cost in scan(t.as_py() or "", ranks, least)] for t in batch.column(1)]
            names = ("kind", "start", "end", "decades")
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array([[dict(zip(names, s)) for s in x] for x in spans], pa.list_(kind))],
                                             names=["doc_id", "spans"])

    return docs.select("doc_id", "text").mapInArrow(convert, f"doc_id long, spans array<{SPAN}>")


def secret_columns(found: DataFrame) -> DataFrame:
    """Counts by kind, the digest of the base spans, and all spans as text."""

    def line(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start, s.end)), ",")

    counts = [F.size(F.filter("spans", lambda s: s["kind"] == F.lit(k))).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(line(F.filter("spans", lambda s: s["kind"] != F.lit("guess"))), 256).alias("base_sha256"), line(F.col("spans")).alias("spans"))
