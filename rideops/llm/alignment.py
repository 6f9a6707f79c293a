"""Cross-tokenizer alignment with inverted bitmaps of token pairs.

Every text is cut by a byte-level BPE (A) and by a piece model (B). Where a token of each ends at
the same byte, the two are linked, and the tokens between such bytes form a group. Which pairs
belong together in the whole corpus follows from an inverted index: documents are numbered inside
containers of bounded size, and each pair has one compressed bitmap of the documents that hold it
per container, with bit planes of the further times they hold it. Bitmaps of a container's parts
are merged by OR, document counts are their population counts, link counts those of the planes as
well, summed over containers. The postings, joined with their pair's count, then return scores to
the documents of their container.

No row is made per link, and no pair's documents are ever gathered over the corpus.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from rideops.llm.bpe import _byte_letters
from rideops.session import shared_folder

#: A container holds so many documents and about so many bytes of text at most.
CONTAINER_DOCS, CONTAINER_BYTES = 1 << 16, 16 << 20
#: Characters of text worked on at a time; longer texts are cut between words, where no token crosses.
PART, PIECE = 1 << 20, 1 << 19
#: Bytes of words and their groups that a worker remembers; beyond them its memory is emptied.
MEMORY = 128 << 20
#: So many plain words, which begin with a space and end in a letter or digit, are encoded as one text.
JOINED = 4096
WORD_EDGES = re.compile(r" \w(?:.*\w)?", re.DOTALL).fullmatch
BETWEEN_WORDS = r"(?<=\w) (?=\w)"
SCHEMA = ("container long, idx int, doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string, groups string, "
          "a int, b int, present binary, planes array<binary>")
RETURNED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string, groups string"


class Tokens:
    """Bytes of a vocabulary's tokens, and their decimal ids, as flat arrays."""

    def __init__(self, tokens: list[bytes]) -> None:
        self.at = np.concatenate([[0], np.cumsum([len(t) for t in tokens])]).astype(np.int64)
        self.body = np.frombuffer(b"".join(tokens), np.uint8)
        ids = np.arange(len(tokens))
        if len(tokens) > 99_999 or (np.diff(self.at) == 0).any():
            raise ValueError("at most 99,999 tokens, none of them empty")
        #: Decimal digits from the left, and how many there are.
        self.digits = np.zeros((len(tokens), 6), np.uint8)
        self.width = np.ones(len(tokens), np.int64)
        for power in (10, 100, 1000, 10_000):
            self.width += ids >= power
        for k in range(5):
            used = k < self.width
            self.digits[used, k] = 48 + ids[used] // 10 ** (self.width[used] - 1 - k) % 10

    def sizes(self, ids: np.ndarray) -> np.ndarray:
        return self.at[ids + 1] - self.at[ids]

    def joined(self, ids: np.ndarray) -> np.ndarray:
        size = self.sizes(ids)
        to = np.cumsum(size)
        return self.body[np.arange(int(size.sum())) + np.repeat(self.at[ids] - (to - size), size)]


class Aligner:
    """Both tokenizers of one worker."""

    def __init__(self, byte_file: str, piece_model: bytes) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        import tokenizers

        self.first = tokenizers.Tokenizer.from_str(byte_file)
        self.first.encode_special_tokens = True
        self.first.no_truncation()
        self.first.no_padding()
        letters, vocabulary = _byte_letters(), json.loads(byte_file)["model"]["vocab"]
        entries = {i: bytes(letters[c] for c in t) for t, i in vocabulary.items()}
        self.a = Tokens([entries.get(i, b"?") for i in range(max(entries) + 1)])
        self.second = sentencepiece.SentencePieceProcessor(model_proto=piece_model)
        pieces = [self.second.id_to_piece(i) for i in range(self.second.vocab_size())]
        self.b = Tokens([bytes([int(p[3:5], 16)]) if self.second.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)])
        # Long texts may be cut before a space only if no piece goes on over it.
        self.cut = re.compile(BETWEEN_WORDS) if not any("▁" in p.lstrip("▁") for p in pieces) else None

        self._forget()

    def _forget(self) -> None:
        self.known, self.lines, self.held = {}, [], 0
        self.good, self.n_a, self.n_b, self.n_groups = np.zeros(0, bool), *(np.zeros(0, np.int64) for _ in range(3))
        self.pairs = np.zeros(0, np.uint64)

    def words(self, text: str) -> list[list[str]]:
        """The text's words, a few hundred thousand characters at a time.

        Both tokenizers encode a word with the space before it apart as they do in the text.
        """
        if not self.cut:
            return [[text]]
        at, out = 0, []
        while at < len(text):
            end = self.cut.search(text, at + PIECE)
            to = end.start() if end else len(text)
            out.append(self.cut.split(text[at:to]))
            at = to + 1
        return out

    def slots(self, words: list[str]) -> np.ndarray:
        """Places of the words in memory; those not seen before are tokenized and aligned."""
        if self.held > MEMORY:
            self._forget()
        fresh = list(set(words).difference(self.known))
        if fresh:
            out = self.align([" " + w for w in fresh])
            self.known.update(zip(fresh, range(len(self.known), len(self.known) + len(fresh))))
            text, ends = out["groups"].tobytes(), out["ends"].tolist()
            self.lines += [text[lo:hi] for lo, hi in zip(ends, ends[1:])]
            for name in ("good", "n_a", "n_b", "n_groups"):
                setattr(self, name, np.concatenate([getattr(self, name), out[name]]))
            self.pairs = np.concatenate([self.pairs, out["a"].astype(np.uint64) << np.uint64(24) | out["b"].astype(np.uint64)])
            self.held += sum(map(len, fresh)) + len(text) + 8 * len(out["a"]) + 250 * len(fresh)
        return np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))

    def align(self, parts: list[str]) -> dict[str, np.ndarray]:
        """Tokens, groups and links of parts that each begin with a space; all of a part or nothing."""
        raw = [p.encode() for p in parts]
        size = np.array([len(r) for r in raw], np.int64)
        ids_a, n_a = self._ids(self.a, parts, size, lambda texts: [e.ids for e in self.first.encode_batch_fast(texts, add_special_tokens=False)])
        ids_b, n_b = self._ids(self.b, parts, size, lambda texts: self.second.encode([t[1:] for t in texts], num_threads=1))
        sums = [np.concatenate([[0], np.cumsum(t.sizes(ids))])[np.concatenate([[0], np.cumsum(n)])] for t, ids, n in
                ((self.a, ids_a, n_a), (self.b, ids_b, n_b))]
        good = (np.diff(sums[0]) == size) & (np.diff(sums[1]) == size)
        for tokens, ids, n in ((self.a, ids_a, n_a), (self.b, ids_b, n_b)):  # equal lengths may still hold other bytes
            text = np.frombuffer(b"".join(r for r, g in zip(raw, good) if g), np.uint8)
            wrong = np.concatenate([[0], np.cumsum(tokens.joined(ids[np.repeat(good, n)]) != text)])
            good[good] = np.diff(wrong[np.concatenate([[0], np.cumsum(size[good])])]) == 0
        ids_a, ids_b = ids_a[np.repeat(good, n_a)], ids_b[np.repeat(good, n_b)]
        n_a, n_b = n_a * good, n_b * good
        end_a, end_b = np.cumsum(self.a.sizes(ids_a)), np.cumsum(self.b.sizes(ids_b))
        common = np.intersect1d(end_a, end_b, assume_unique=True)
        at_a, at_b = np.searchsorted(end_a, common), np.searchsorted(end_b, common)
        part = np.searchsorted(np.cumsum(size * good), common)
        groups, ends = self._lines(ids_a, ids_b, at_a, at_b)
        last = np.searchsorted(part, np.arange(len(parts)), "right")
        return {"good": good, "n_a": n_a, "n_b": n_b, "n_groups": np.bincount(part, minlength=len(parts)), "part": part,
                "a": ids_a[at_a], "b": ids_b[at_b], "groups": groups, "ends": np.concatenate([[0], ends])[np.concatenate([[0], last])]}

    def _ids(self, tokens: Tokens, parts: list[str], size: np.ndarray, encode: Callable[[list[str]], list[list[int]]]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the parts and how many each has. Plain words are encoded many at once, which is cheaper."""
        plain = np.array([WORD_EDGES(p) is not None for p in parts]) if self.cut else np.zeros(len(parts), bool)
        order = np.concatenate([np.flatnonzero(plain), np.flatnonzero(~plain)])
        line, texts, n = [], [], int(plain.sum())
        for at in range(0, n, JOINED):
            texts.append("".join(parts[i] for i in order[at:min(at + JOINED, n)]))
        counts = np.zeros(len(parts), np.int64)
        for k, ids in enumerate(encode(texts)):
            line.append(np.array(ids, np.int64))
            members = order[k * JOINED:min((k + 1) * JOINED, n)]
            # A token belongs to the part in which it ends; a joined text that does not come back whole leaves counts that do not fit.
            ends, to = np.cumsum(tokens.sizes(line[-1])), np.cumsum(size[members])
            counts[members] = np.diff(np.searchsorted(ends, to, "right"), prepend=0)
            if counts[members].sum() < len(ends) or not np.isin(to, ends).all():
                line[-1:], counts[members] = self._alone(encode, [parts[i] for i in members])
        if n < len(parts):
            ids, counts[order[n:]] = self._alone(encode, [parts[i] for i in order[n:]])
            line += ids
        flat = np.concatenate([np.zeros(0, np.int64), *line])
        begin = np.empty(len(parts), np.int64)
        begin[order] = np.cumsum(counts[order]) - counts[order]
        return flat[np.arange(len(flat)) + np.repeat(begin - (np.cumsum(counts) - counts), counts)], counts

    @staticmethod
    def _alone(encode: Callable[[list[str]], list[list[int]]], parts: list[str]) -> tuple[list[np.ndarray], list[int]]:
        ids = encode(parts)
        return [np.array([i for x in ids for i in x], np.int64)], [len(x) for x in ids]

    def _lines(self, ids_a: np.ndarray, ids_b: np.ndarray, at_a: np.ndarray, at_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The groups as text, each closed by a semicolon, and where each group's text ends."""
        held_a, held_b = np.diff(np.concatenate([[-1], at_a])), np.diff(np.concatenate([[-1], at_b]))
        before_b, upto_a = np.cumsum(held_b) - held_b, np.cumsum(held_a)
        rows, width = np.empty((len(ids_a) + len(ids_b), 6), np.uint8), np.empty(len(ids_a) + len(ids_b), np.int64)
        for tokens, ids, place, close, sign in (
                (self.a, ids_a, np.arange(len(ids_a)) + np.repeat(before_b, held_a), at_a, ord("|")),
                (self.b, ids_b, np.arange(len(ids_b)) + np.repeat(upto_a, held_b), at_b, ord(";"))):
            signs = np.full(len(ids), ord(","), np.uint8)
            signs[close] = sign
            line = tokens.digits[ids]
            line[np.arange(len(ids)), tokens.width[ids]] = signs
            rows[place], width[place] = line, tokens.width[ids]
        text = rows[np.arange(6) <= width[:, None]]
        return text, np.cumsum(width + 1)[upto_a + np.cumsum(held_b) - 1]


def packed(docs: np.ndarray, size: int) -> bytes:
    """A bitmap of a container: 0 and the 16-bit numbers of its documents, or 1 and the plain bits."""
    if 2 * len(docs) <= -(-size // 8):
        return b"\0" + docs.astype("<u2").tobytes()
    bits = np.zeros(size, np.uint8)
    bits[docs] = 1
    return b"\1" + np.packbits(bits).tobytes()


def unpacked(bitmap: bytes) -> np.ndarray:
    """Document numbers of a bitmap."""
    if bitmap[0] == 0:
        return np.frombuffer(bitmap, "<u2", offset=1)
    return np.flatnonzero(np.unpackbits(np.frombuffer(bitmap, np.uint8, offset=1)))


def population(bitmap: Column) -> Column:
    """Documents of a bitmap, counted by Spark."""
    return F.when(F.substring(bitmap, 1, 1) == F.lit(b"\0"), F.floor((F.octet_length(bitmap) - 1) / 2)).otherwise(F.bitmap_count(bitmap) - 1)


class Container:
    """Postings of the documents of one container."""

    def __init__(self, number: int) -> None:
        self.number, self.docs, self.bytes = number, 0, 0
        self._keys: list[np.ndarray] = []
        self._times: list[np.ndarray] = []

    def add(self, keys: np.ndarray, times: np.ndarray) -> None:
        """Keys are (a, b, document) in 24, 24 and 16 bits; repeated keys add up."""
        self._keys.append(keys)
        self._times.append(times)

    def rows(self) -> pa.RecordBatch:
        """One row per pair: the OR of its bitmaps and the planes of the times beyond the first."""
        keys, place = np.unique(np.concatenate([np.zeros(0, np.uint64), *self._keys]), return_inverse=True)
        times = np.zeros(len(keys), np.int64)
        np.add.at(times, place, np.concatenate([np.zeros(0, np.int64), *self._times]))
        pair, doc, more = keys >> np.uint64(16), (keys & np.uint64(0xFFFF)).astype(np.int64), times - 1
        first = np.flatnonzero(np.diff(pair, prepend=np.uint64(1 << 63)) != 0) if len(pair) else np.zeros(0, np.int64)
        most = np.maximum.reduceat(more, first) if len(first) else first
        present, planes = [], []
        for lo, hi, top in zip(first.tolist(), [*first[1:].tolist(), len(pair)], most.tolist()):
            present.append(packed(doc[lo:hi], self.docs))
            planes.append([packed(doc[lo:hi][(more[lo:hi] >> j & 1).astype(bool)], self.docs) for j in range(top.bit_length())])
        pair = pair[first]
        return _record({"container": pa.array(np.full(len(first), self.number)), "a": pa.array((pair >> np.uint64(24)).astype(np.int32)),
                        "b": pa.array((pair & np.uint64(0xFFFFFF)).astype(np.int32)), "present": pa.array(present, pa.binary()),
                        "planes": pa.array(planes, pa.list_(pa.binary()))}, len(first))


_TYPES = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(), "array<binary>": pa.list_(pa.binary())}


def _record(columns: dict[str, pa.Array], rows: int, schema: str = SCHEMA) -> pa.RecordBatch:
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([columns.get(name, pa.nulls(rows, _TYPES[kind])) for name, kind in fields], names=[name for name, _ in fields])


def index(docs: DataFrame, byte_file: str, piece_model: str, groups: bool = False) -> DataFrame:
    """Documents and postings of all containers, written once to the shared folder.

    Rows with ``idx`` are documents of a container, rows with ``present`` its postings. The files
    (of fixed size) are read on the driver and broadcast. ``groups`` keeps the groups' text.
    """
    with open(byte_file, encoding="utf-8") as first, open(piece_model, "rb") as second:
        shared = docs.sparkSession.sparkContext.broadcast({"files": (first.read(), second.read())})

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = shared.value
        if "aligner" not in state:
            state["aligner"] = Aligner(*state["files"])
        aligner, number = state["aligner"], TaskContext.get().partitionId() << 32
        container = Container(number)
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                end, size = at, container.bytes
                while end < batch.num_rows and container.docs + end - at < CONTAINER_DOCS and (end == at or size < CONTAINER_BYTES):
                    size += batch.column(1)[end].as_buffer().size if batch.column(1)[end].is_valid else 0
                    end += 1
                yield _documents(aligner, container, batch.slice(at, end - at), groups)
                container.docs, container.bytes, at = container.docs + end - at, size, end
                if container.docs >= CONTAINER_DOCS or container.bytes >= CONTAINER_BYTES:
                    yield container.rows()
                    number += 1
                    container = Container(number)
        yield container.rows()

    folder = f"{shared_folder(docs.sparkSession)}/alignment-{uuid.uuid4().hex}"
    docs.select("doc_id", "text").mapInArrow(convert, SCHEMA).write.parquet(folder)
    return docs.sparkSession.read.parquet(folder)


def _documents(aligner: Aligner, container: Container, batch: pa.RecordBatch, groups: bool) -> pa.RecordBatch:
    """Rows of the next documents of a container; their links go into it."""
    n = batch.num_rows
    counts = {c: np.zeros(n, np.int64) for c in ("n_a", "n_b", "n_groups")}
    good, lines, digests = np.ones(n, bool), [[] for _ in range(n)], [None] * n
    keys, times = [], []
    waiting, owner, size = [], [], 0

    def flush() -> None:
        nonlocal size
        if not waiting:
            return
        slots = aligner.slots([w for words in waiting for w in words])
        doc = np.repeat(owner, [len(words) for words in waiting])
        good[doc[~aligner.good[slots]]] = False
        for c, total in counts.items():
            total += np.bincount(doc, getattr(aligner, c)[slots], n).astype(np.int64)
        at, places = 0, slots.tolist()
        for d, words in zip(owner, waiting):
            text = b"".join(map(aligner.lines.__getitem__, places[at:at + len(words)]))
            at += len(words)
            # A semicolon stands between groups, so a text's last one is held back.
            digests[d].update(b";" + text[:-1]) if digests[d] else digests.__setitem__(d, hashlib.sha256(text[:-1]))
            if groups:
                lines[d].append(text[:-1].decode())
        links = aligner.n_groups[slots]
        to, begin = np.cumsum(links), np.cumsum(aligner.n_groups) - aligner.n_groups
        pairs = aligner.pairs[np.arange(int(links.sum())) + np.repeat(begin[slots] - (to - links), links)]
        key, again = np.unique(pairs << np.uint64(16) | np.repeat(doc + container.docs, links).astype(np.uint64), return_counts=True)
        keys.append(key)
        times.append(again)
        waiting.clear()
        owner.clear()
        size = 0

    for i, text in enumerate(batch.column(1)):
        for words in aligner.words(text.as_py() or ""):
            waiting.append(words)
            owner.append(i)
            size += sum(map(len, words))
            if size >= PART:
                flush()
    flush()
    for key, again in zip(keys, times):
        stay = good[(key & np.uint64(0xFFFF)).astype(np.int64) - container.docs]
        container.add(key[stay], again[stay])
    has = good & (counts["n_a"] > 0)
    return _record({
        "container": pa.array(np.full(n, container.number)), "idx": pa.array((container.docs + np.arange(n)).astype(np.int32)),
        "doc_id": batch.column(0).cast(pa.int64()), **{c: pa.array(total * has) for c, total in counts.items()},
        "groups_sha256": pa.array([d.hexdigest() if h else "" for d, h in zip(digests, has)], pa.string()),
        "groups": pa.array([";".join(x) if h and groups else None for x, h in zip(lines, has)], pa.string())}, n)


def postings_of(indexed: DataFrame) -> DataFrame:
    return indexed.where(F.col("present").isNotNull()).select("container", "a", "b", "present", "planes")


def pair_counts(postings: DataFrame) -> DataFrame:
    """(a, b, documents, links, best) of every linked pair of ids, over all documents.

    ``best`` says whether no other pair of the same b has more links.
    """
    weighted = F.transform("planes", lambda plane, j: F.pow(F.lit(2.0), j).cast("long") * population(plane))
    links = population(F.col("present")) + F.aggregate(weighted, F.lit(0).cast("long"), lambda x, y: x + y)
    pairs = postings.select("a", "b", population(F.col("present")).alias("documents"), links.alias("links")).groupBy("a", "b").agg(
        F.sum("documents").alias("documents"), F.sum("links").alias("links"))
    most = pairs.groupBy("b").agg(F.max("links").alias("_most"))
    return pairs.join(most, "b").select("a", "b", "documents", "links", (F.col("links") == F.col("_most")).alias("best"))


def align(docs: DataFrame, byte_file: str, piece_model: str, groups: bool = False) -> DataFrame:
    """Tokens, groups and pair scores of every row of ``docs`` (doc_id, text).

    n_a and n_b tokens by the two tokenizers, n_groups, n_links, n_best (links whose pair is the
    most frequent of its b, ties included), count_sum (the pair counts of all links), the digest
    of the groups and, if asked for, their text ``a1,a2|b1;a3|b2,b3``. Null and empty texts, and
    texts that a tokenizer does not give back, have zeros and ''. Repeated rows count each; a null
    id stays null; other columns are not looked at. Texts are cut between words, where neither
    tokenizer has a token that crosses, so a long text is never tokenized whole, and a word is
    tokenized and aligned once for all its occurrences that a worker remembers.
    """
    indexed = index(docs, byte_file, piece_model, groups)
    postings = postings_of(indexed)
    scored = postings.join(pair_counts(postings), ["a", "b"]).select(F.col("container").alias("of"), "present", "planes", "links", "best")
    held = indexed.where(F.col("idx").isNotNull()).select("container", "idx", "doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "groups")

    def returned(documents: pa.Table, rows: pa.Table) -> pa.Table:
        n = documents.num_rows
        total, best = np.zeros(n, np.int64), np.zeros(n, np.int64)
        links, top = rows.column("links").to_numpy(), rows.column("best").to_numpy(zero_copy_only=False).astype(np.int64)
        for planes in ("present", *range(64)):
            bitmaps = rows.column("present").to_pylist() if planes == "present" else [
                p[planes] if len(p) > planes else None for p in rows.column("planes").to_pylist()]
            has = [i for i, b in enumerate(bitmaps) if b is not None]
            if not has:
                break
            numbers = [unpacked(bitmaps[i]) for i in has]
            weight = np.repeat(np.array(has), [len(x) for x in numbers])
            where = np.concatenate(numbers).astype(np.int64)
            times = 1 if planes == "present" else 1 << planes
            np.add.at(total, where, links[weight] * times)
            np.add.at(best, where, top[weight] * times)
        place = documents.column("idx").to_numpy()
        columns = {c: documents.column(c).combine_chunks() for c in ("doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "groups")}
        columns |= {"n_links": columns["n_groups"], "n_best": pa.array(best[place]), "count_sum": pa.array(total[place])}
        return pa.Table.from_batches([_record(columns, n, RETURNED)])

    return held.groupBy("container").cogroup(scored.groupBy("of")).applyInArrow(returned, RETURNED)
