"""Removal of byte strings that also stand in an earlier document, by sorting suffixes in buckets.

Two equal strings of ``LENGTH`` bytes have the same least ``GRAM``-byte gram at the same place (the
gram of least hash, leftmost of equals): their anchor. The anchor names the suffix bucket, so equal
strings always meet in one bucket, and the strings of one anchor are one context of 80 bytes.

1. Documents are dealt into groups by id. Each group sends the hashes of its anchors, once each;
   a hash that only one group has is dropped, unless two documents of the group share it.
2. Each group sends the different contexts of shared anchors with its smallest document id. An
   occurrence in any later document of the group is decided at once, so a passage in a third of
   all documents sends one context per group.
3. A bucket's suffixes are sorted, one offset from the anchor at a time. Sample suffixes at the
   offsets of a difference cover are ranked first, with the common prefix of neighbours. Every
   other suffix is sorted by the few bytes before its next sample; ties are settled by the
   sample's rank, cut at the depth that is left. Equal strings take their smallest document id.
4. The answers go back to the groups, which hold the texts and cut them.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rideops.llm.common import mixed, runs_of, text_bytes, tidy_group, tidy_pair

LENGTH, GRAM = 50, 20
WINDOWS = LENGTH - GRAM + 1
CONTEXT = LENGTH + WINDOWS - 1
#: A difference cover modulo 13: every distance is a difference of two members.
COVER, MODULUS = (0, 1, 3, 9), 13
#: Bits of a position inside a run of documents; windows of a long document that are named at a time.
PLACE, PIECE = 28, 1 << 20
#: Bytes worked on at a time where a byte takes many times its size (hashes of grams, sums over bytes).
RUN = 1 << 19
#: Bytes of text in a group.
GROUP_BYTES = 32 << 20
_LAST = np.iinfo(np.int64).max


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the gram that starts at each byte, by doubling; the last ones are cut short."""
    h, n = data.astype(np.uint64) + np.uint64(1), 1
    base, total = 0x9E3779B97F4A7C15, None
    have = 0
    while True:
        if GRAM & n:  # append a piece of n bytes at offset ``have``
            piece = h[have:] if have else h
            if total is None:
                total = piece
            else:
                total = total[:len(piece)] * np.uint64(pow(base, n, 1 << 64)) + piece
            have += n
        if 2 * n > GRAM:
            break
        h = h[:max(len(h) - n, 0)] * np.uint64(pow(base, n, 1 << 64)) + h[n:]
        n *= 2
    return mixed(total)


def anchors(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor start, its hash, first and last window start) of every run of windows with one anchor."""
    none = np.zeros(0, np.int64)
    if len(data) < LENGTH:
        return none, none.astype(np.uint64), none, none
    h = gram_hashes(data)
    key = h >> np.uint64(PLACE) << np.uint64(PLACE) | np.arange(len(h), dtype=np.uint64)
    have = 1
    while have < WINDOWS:
        step = min(have, WINDOWS - have)
        key = np.minimum(key[:-step], key[step:])
        have += step
    valid = np.zeros(len(data) + 1, np.int64)
    size = np.diff(offsets)
    some = size >= LENGTH
    np.add.at(valid, offsets[:-1][some], 1)
    np.add.at(valid, offsets[1:][some] - LENGTH + 1, -1)
    start = np.flatnonzero(np.cumsum(valid)[:len(key)])
    place = (key[start] & np.uint64((1 << PLACE) - 1)).astype(np.int64)
    new = np.flatnonzero(np.append(True, place[1:] != place[:-1])) if len(place) else none
    last = np.append(new[1:], len(place)) - 1
    return place[new], h[place[new]], start[new], start[last]


def _anchors_of_long(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """:func:`anchors` of one document, its windows taken in pieces; a run cut between two pieces is joined again."""
    parts = []
    for at in range(0, len(data) - LENGTH + 1, PIECE):
        piece = data[at:at + PIECE + LENGTH - 1]
        place, h, first, last = anchors(piece, np.array([0, len(piece)]))
        parts.append([place + at, h, first + at, last + at])
        if len(parts) > 1 and parts[-2][0][-1] == parts[-1][0][0]:
            parts[-1][2][0] = parts[-2][2][-1]
            parts[-2] = [x[:-1] for x in parts[-2]]
            if not len(parts[-2][0]):
                parts.pop(-2)
    return tuple(np.concatenate(x) for x in zip(*parts))


class _Group:
    """The documents of one group in a fixed order, as one byte array."""

    def __init__(self, docs: pa.Table) -> None:
        data, at = text_bytes(docs["text"])
        ids = docs["doc_id"].cast(pa.int64()).fill_null(_LAST).to_numpy(zero_copy_only=False)
        order = np.argsort(ids, kind="stable")
        same = np.flatnonzero(ids[order][1:] == ids[order][:-1])
        if len(same):  # repeated ids: by text as well, so that any order of arrival gives one order
            order = np.array(sorted(range(len(ids)), key=lambda i: (ids[i], data[at[i]:at[i + 1]].tobytes())))
        self.order, self.ids, self.size = order, ids[order], np.diff(at)[order]
        self.offsets = np.append(0, np.cumsum(self.size))
        self.data = np.concatenate([np.zeros(0, np.uint8), *(data[at[i]:at[i + 1]] for i in order)])

    def anchors(self) -> tuple[np.ndarray, ...]:
        """(document, anchor start, hash, first and last window start), all in the group's bytes."""
        out = []
        for lo, hi in runs_of(self.offsets, RUN):
            base = self.offsets[lo]
            body = self.data[base:self.offsets[hi]]
            long = hi - lo == 1 and len(body) > PIECE + LENGTH
            place, h, first, last = _anchors_of_long(body) if long else anchors(body, self.offsets[lo:hi + 1] - base)
            out.append((place + base, h, first + base, last + base))
        place, h, first, last = (np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64),) * 4
        return np.searchsorted(self.offsets, place, "right") - 1, place, h.astype(np.uint64), first, last


def _packed(*arrays: np.ndarray) -> bytes:
    return zlib.compress(b"".join(np.ascontiguousarray(a).tobytes() for a in arrays), 1)


def _unpacked(blob: bytes, *kinds: tuple[str, int]) -> list[np.ndarray]:
    """Arrays of (type, items per row) that share one number of rows."""
    raw = zlib.decompress(blob)
    n, out, at = len(raw) // sum(np.dtype(t).itemsize * k for t, k in kinds), [], 0
    for t, k in kinds:
        size = n * k * np.dtype(t).itemsize
        out.append(np.frombuffer(raw, t, n * k, at).reshape((n, k) if k > 1 else n))
        at += size
    return out


def _rows(schema: pa.Schema, **columns: list) -> pa.Table:
    return pa.Table.from_pydict(columns, schema=schema)


_HASHES = pa.schema([("_bucket", pa.int32()), ("_pid", pa.int64()), ("blob", pa.binary())])
_SHARED = pa.schema([("_pid", pa.int64()), ("_bucket", pa.int32()), ("blob", pa.binary())])
_CONTEXTS = pa.schema([("_local", pa.bool_()), ("_key", pa.int64()), ("_pid", pa.int64()), ("blob", pa.binary()), ("pending", pa.binary())])
_ANSWERS = pa.schema([("_pid", pa.int64()), ("_local", pa.bool_()), ("blob", pa.binary()), ("pending", pa.binary())])
_SQL = {pa.int32(): "int", pa.int64(): "long", pa.binary(): "binary", pa.bool_(): "boolean"}


def _ddl(schema: pa.Schema) -> str:
    return ", ".join(f"{f.name} {_SQL[f.type]}" for f in schema)


def _names(h: np.ndarray, bits: int) -> np.ndarray:
    """The low 32 + bits bits of a hash: bucket in the lowest ``bits``."""
    return h & np.uint64((1 << (32 + bits)) - 1)


def _split(values: np.ndarray, bits: int) -> list[tuple[int, slice, np.ndarray]]:
    """(bucket, place in the order, order) of values by their bucket."""
    bucket = (values & np.uint64((1 << bits) - 1)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    cut = np.flatnonzero(np.append(True, np.diff(bucket[order]) != 0)) if len(order) else np.zeros(0, int)
    ends = np.append(cut[1:], len(order))
    return [(int(bucket[order[a]]), order[a:b]) for a, b in zip(cut, ends)]


def sorted_contexts(contexts: np.ndarray, first: np.ndarray, last: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """For each context the offsets (as bits) whose string also has a smaller document id.

    ``contexts`` holds 80 bytes a row; the string at offset t counts where first <= t <= last.
    """
    n = len(contexts)
    wide = np.zeros((n, CONTEXT + 16), np.uint8)
    wide[:, :CONTEXT] = contexts

    def word(t: int, size: int) -> np.ndarray:
        """``size`` bytes at offset t as one number that sorts like the bytes."""
        w = np.ascontiguousarray(wide[:, t:t + 8]).view(">u8").ravel().astype(np.uint64)
        return w >> np.uint64(64 - 8 * size) if size < 8 else w

    samples = [u for u in range(0, WINDOWS + MODULUS) if u % MODULUS in COVER]
    samples = [u for u in samples if u < WINDOWS] + [next(u for u in samples if u >= WINDOWS)]
    mask = np.zeros(n, np.uint32)
    previous = -1
    for u in samples:
        depth = min(LENGTH, CONTEXT - u)
        words = [word(u + b, min(8, depth - b)) for b in range(0, depth, 8)]
        order = np.lexsort(words[::-1])
        common = np.zeros(max(n - 1, 0), np.int64)  # bytes shared with the row before
        open_ = np.ones(max(n - 1, 0), bool)
        for b, w in zip(range(0, depth, 8), words):
            size = min(8, depth - b)
            differ = w[order][1:] ^ w[order][:-1]
            top = np.zeros(len(differ), np.int64)
            some = differ > 0
            for lower in range(1, size):  # equal leading bytes: the difference fits into the lower ones
                top += some & (differ >> np.uint64(8 * (size - lower)) == 0)
            common += np.where(open_, np.where(some, top, size), 0)
            open_ &= ~some
        for t in range(previous + 1, min(u, WINDOWS - 1) + 1):
            rows = order[(first[order] <= t) & (t <= last[order])]
            group = np.zeros(n, np.int64)
            group[order[1:]] = np.cumsum(common < LENGTH - (u - t))
            if u > t:  # stable: equal leading bytes keep the sample's order
                lead = word(t, u - t)
                rows = rows[np.argsort(lead[rows], kind="stable")]
                new = (lead[rows][1:] != lead[rows][:-1]) | (group[rows][1:] != group[rows][:-1])
            else:
                new = group[rows][1:] != group[rows][:-1]
            if not len(rows):
                continue
            starts = np.flatnonzero(np.append(True, new))
            least = np.repeat(np.minimum.reduceat(docs[rows], starts), np.diff(np.append(starts, len(rows))))
            mask[rows[docs[rows] > least]] |= np.uint32(1 << t)
        previous = u
    return mask


def _local_contexts(group: _Group, doc: np.ndarray, place: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, ...]:
    """(contexts, first, last offset) of occurrences, bytes outside their strings zeroed."""
    start, contexts = place - (WINDOWS - 1), np.zeros((len(place), CONTEXT), np.uint8)
    for b in range(CONTEXT):  # byte by byte: no index of all bytes is held
        at = start + b
        inside = np.flatnonzero((at >= first) & (at < last + LENGTH))
        contexts[inside, b] = group.data[at[inside]]
    return contexts, (first - start).astype(np.uint8), (last - start).astype(np.uint8)


def removed_bytes(turn: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Whether each byte goes, and per document how many go and in how many maximal runs.

    ``turn`` holds at each byte how many more strings begin there than have ended before it, and one entry more for those that end with the data.
    """
    gone, level = np.empty(len(turn) - 1, bool), 0
    for at in range(0, len(gone), RUN):
        upto = level + np.cumsum(turn[at:at + RUN][:len(gone) - at], dtype=np.int64)
        gone[at:at + RUN], level = upto > 0, upto[-1]
    begins = gone.copy()
    begins[1:] &= ~gone[:-1]
    some = offsets[1:] > offsets[:-1]
    inner = offsets[:-1][some]
    begins[inner] = gone[inner]
    removed, spans = (np.zeros(len(some), np.int64) for _ in range(2))
    for out, of in ((removed, gone), (spans, begins)):
        out[some] = [np.count_nonzero(of[a:b]) for a, b in zip(inner, offsets[1:][some])]
    return gone, removed, spans


def without_repeats(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Remove each byte covered by a 50-byte string that also starts in a document of smaller id.

    Strings are judged on the input; matches never cross documents. Returns per input row:
    doc_id, the columns of ``keep``, n_bytes, n_removed, n_spans (maximal removed runs) and kept
    (the remaining bytes). Null and short texts stay as they are. Rows with
    one id count as one document, so they don't take from each other; a null id counts as the
    greatest. Texts are dealt into groups of about ``GROUP_BYTES`` of text, measured by one pass
    over the texts' lengths, so a task's memory does not grow with the input.
    """
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # a group sends one row to each bucket, so there are about as many buckets as groups
    groups = max(2 * tasks, -(-size // GROUP_BYTES))
    bits = max(4, (groups // 2 - 1).bit_length())
    dealt = docs.select("doc_id", "text", *keep).withColumn("_pid", F.pmod(F.xxhash64("doc_id"), F.lit(groups)))
    keep_types = [f"{f.name} {f.dataType.simpleString()}" for f in docs.schema if f.name in keep]

    def hashes(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        pid = key[0].as_py()
        _, _, h, _, _ = _Group(table).anchors()
        names = np.unique(_names(h, bits))
        parts = _split(names, bits)
        return _rows(_HASHES, _bucket=[b for b, _ in parts], _pid=[pid] * len(parts),
                     blob=[(names[i] >> np.uint64(bits)).astype(np.uint32).tobytes() for _, i in parts])

    def shared(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        chunks = [np.frombuffer(b, np.uint32) for b in table["blob"].to_pylist()]
        values, chunk = np.concatenate(chunks), np.repeat(np.arange(len(chunks)), list(map(len, chunks)))
        order = np.argsort(values, kind="stable")
        equal = values[order][1:] == values[order][:-1]
        twice = order[np.append(False, equal) | np.append(equal, False)]
        twice = twice[np.argsort(chunk[twice], kind="stable")]
        cuts = np.searchsorted(chunk[twice], np.arange(len(chunks) + 1))
        pids, out = table["_pid"].to_pylist(), []
        for c in range(len(chunks)):
            if cuts[c + 1] > cuts[c]:
                out.append((pids[c], values[twice[cuts[c]:cuts[c + 1]]].tobytes()))
        return _rows(_SHARED, _pid=[p for p, _ in out], _bucket=[key[0].as_py()] * len(out), blob=[b for _, b in out])

    def contexts(key: tuple[pa.Scalar, ...], table: pa.Table, known: pa.Table) -> pa.Table:
        empty = _rows(_CONTEXTS, _local=[], _key=[], _pid=[], blob=[], pending=[])
        if not len(table):
            return empty
        group = _Group(table)
        doc, place, h, first, last = group.anchors()
        names = _names(h, bits)
        far = [np.frombuffer(b, np.uint32).astype(np.uint64) << np.uint64(bits) | np.uint64(k)
               for k, b in zip(known["_bucket"].to_pylist(), known["blob"].to_pylist())]
        order = np.argsort(names, kind="stable")
        new = np.flatnonzero(np.append(True, np.diff(names[order]) != 0)) if len(order) else np.zeros(0, int)
        low, high = (f.reduceat(doc[order], new) if len(new) else doc[:0] for f in (np.minimum, np.maximum))
        near = names[order][new][low < high]
        wanted = np.unique(np.concatenate([near, *far]))
        at = np.minimum(np.searchsorted(wanted, names), max(len(wanted) - 1, 0))
        some = np.flatnonzero(wanted[at] == names) if len(wanted) else np.zeros(0, int)
        if not len(some):
            return empty
        doc, place, names, first, last = doc[some], place[some], names[some], first[some], last[some]
        text, low, high = _local_contexts(group, doc, place, first, last)
        mark = low.astype(np.uint64) << np.uint64(8) | high
        for b in range(0, CONTEXT, 8):
            mark = mixed(mark * np.uint64(0xC2B2AE3D27D4EB4F) + np.ascontiguousarray(text[:, b:b + 8]).view(np.uint64).ravel())
        ids = group.ids[doc]
        order = np.lexsort((ids, mark))
        lead = np.append(True, np.diff(mark[order]) != 0)
        leader = order[np.flatnonzero(lead)[np.cumsum(lead) - 1]]
        same = (text[order] == text[leader]).all(1) & (low[order] == low[leader]) & (high[order] == high[leader])
        late = order[same & (ids[order] > ids[leader])]
        open_ = order[~(same & (ids[order] > ids[leader]))]
        # one record per context that may still be late; all its places in the first document follow it
        own = np.append(True, (np.diff(mark[open_]) != 0) | (np.diff(ids[open_]) != 0) | (text[open_][1:] != text[open_][:-1]).any(1))
        record, heads = np.cumsum(own) - 1, open_[own]
        parts = _split(names[heads], bits)
        number = np.arange(len(heads), dtype=np.int32)
        rows = [(False, b, _packed(text[heads[i]], low[heads[i]], high[heads[i]], ids[heads[i]], number[i]), None) for b, i in parts]
        rows.append((True, key[0].as_py(), _packed(first[late], last[late] + LENGTH), _packed(place[open_], record.astype(np.int32))))
        return _rows(_CONTEXTS, _local=[r[0] for r in rows], _key=[r[1] for r in rows], _pid=[key[0].as_py()] * len(rows),
                     blob=[r[2] for r in rows], pending=[r[3] for r in rows])

    def answers(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        pids = table["_pid"].to_pylist()
        if key[0].as_py():
            return _rows(_ANSWERS, _pid=pids, _local=[True] * len(pids), blob=table["blob"].to_pylist(), pending=table["pending"].to_pylist())
        parts = [_unpacked(b, ("u1", CONTEXT), ("u1", 1), ("u1", 1), ("i8", 1), ("i4", 1)) for b in table["blob"].to_pylist()]
        text, low, high, ids, number = (np.concatenate(x) for x in zip(*parts))
        mask = sorted_contexts(text, low, high, ids)
        ends, out = np.cumsum([0, *(len(p[1]) for p in parts)]), []
        for c, pid in enumerate(pids):
            s = slice(ends[c], ends[c + 1])
            late = mask[s] > 0
            if late.any():
                out.append((pid, _packed(number[s][late], mask[s][late])))
        return _rows(_ANSWERS, _pid=[p for p, _ in out], _local=[False] * len(out), blob=[b for _, b in out], pending=[None] * len(out))

    def cut(key: tuple[pa.Scalar, ...], table: pa.Table, said: pa.Table) -> pa.Table:
        group = _Group(table)
        turn = np.zeros(len(group.data) + 1, np.int32)
        local = said["_local"].to_pylist()
        blobs = said["blob"].to_pylist()
        for is_local, blob, pending in zip(local, blobs, said["pending"].to_pylist()):
            if is_local:
                start, end = _unpacked(blob, ("i8", 1), ("i8", 1))
                np.add.at(turn, start, 1)
                np.add.at(turn, end, -1)
                place, record = _unpacked(pending, ("i8", 1), ("i4", 1))
                masks = np.zeros(int(record.max()) + 1 if len(record) else 0, np.uint32)
                for other, b in zip(local, blobs):
                    if not other:
                        number, mask = _unpacked(b, ("i4", 1), ("u4", 1))
                        masks[number] = mask
                hit = np.flatnonzero(masks[record])
                bits_of = masks[record[hit]]
                for t in range(WINDOWS):
                    starts = place[hit[(bits_of >> np.uint32(t) & np.uint32(1)) > 0]] - (WINDOWS - 1) + t
                    np.add.at(turn, starts, 1)
                    np.add.at(turn, starts + LENGTH, -1)
        gone, removed, spans = removed_bytes(turn, group.offsets)
        del turn
        kept = pa.array((group.data[a:b][~gone[a:b]].tobytes() if n else group.data[a:b].tobytes()
                         for a, b, n in zip(group.offsets[:-1], group.offsets[1:], removed)), pa.binary())
        rows = table.select(["doc_id", *keep]).take(pa.array(group.order))
        return pa.table({
            "doc_id": rows["doc_id"], **{c: rows[c] for c in keep}, "n_bytes": group.size, "n_removed": removed,
            "n_spans": spans, "kept": kept})

    marks = dealt.groupBy("_pid").applyInArrow(tidy_group(hashes), _ddl(_HASHES))
    known = marks.groupBy("_bucket").applyInArrow(tidy_group(shared), _ddl(_SHARED))
    found = dealt.groupBy("_pid").cogroup(known.groupBy("_pid")).applyInArrow(tidy_pair(contexts), _ddl(_CONTEXTS))
    said = found.groupBy("_local", "_key").applyInArrow(tidy_group(answers), _ddl(_ANSWERS))
    schema = ", ".join(["doc_id long", *keep_types, "n_bytes long, n_removed long, n_spans long, kept binary"])
    return dealt.groupBy("_pid").cogroup(said.groupBy("_pid")).applyInArrow(tidy_pair(cut), schema)
