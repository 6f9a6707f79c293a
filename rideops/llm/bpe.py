"""BPE encoding and decoding by dynamic programming over prefixes.

For byte-level BPE every prefix of a word has exactly one encoding, and so exactly one last token.
A token that ends at byte i is that last token if and only if it stands, by the merge rules, next
to the last token of the prefix before it. The encoder therefore stores one token per prefix and
walks back from the end; no merge is ever carried out on a word.

Tokens ending at a byte come from a suffix automaton of the vocabulary (each state is a string
that begins some token; its link leads to its longest proper suffix that does too, and its list
names the tokens that end there). Whether two tokens may stand side by side is decided once per
pair, by the merge rules on the two alone, and remembered.
"""

from __future__ import annotations

import hashlib
import json
from array import array
from collections import deque
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from rideops.llm.common import tidy

# Fixed value of the format: how byte-level BPE cuts text into words.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, ids array<int>"
#: Bytes of words and number of token pairs remembered by one Python worker; beyond them its memory is emptied.
MEMORY, PAIRS = 40 << 20, 250_000
#: A pair of ids as one number; and a rank that never comes.
WIDE, NEVER = 1 << 20, (1 << 31) - 1


def _byte_letters() -> dict[str, int]:
    """The printable letters that stand for bytes in the vocabulary file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Bytes and merge ranks of a tokenizer file. Its size is that of the file, not of the data."""

    def __init__(self, text: str) -> None:
        file = json.loads(text)
        model, letters = file["model"], _byte_letters()
        if model.get("ignore_merges") or model.get("dropout") or file.get("normalizer"):
            raise ValueError("only plain byte-level BPE is encoded")
        cut = file.get("pre_tokenizer") or {}
        if cut.get("type") != "ByteLevel" or cut.get("add_prefix_space") or not cut.get("use_regex", True):
            raise ValueError("only the byte-level pre-tokenizer with its own pattern is known")
        if any(t.get(flag) for t in file["added_tokens"] for flag in ("single_word", "lstrip", "rstrip")):
            raise ValueError("added tokens with borders of their own are not known")
        self.tokens: dict[int, bytes] = {i: bytes(letters[c] for c in t) for t, i in model["vocab"].items()}
        self.ids = {b: i for i, b in self.tokens.items()}
        self.added = {t["content"]: t["id"] for t in file["added_tokens"]}
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            left, right = (bytes(letters[c] for c in x) for x in (a, b))
            self.merges.setdefault((self.ids[left], self.ids[right]), (rank, self.ids[left + right]))
        self.made = {made: (rank, pair) for pair, (rank, made) in self.merges.items()}
        if len(self.made) < len(self.merges) or any(
                self.made.get(part, (-1,))[0] >= rank for (rank, pair) in self.made.values() for part in pair):
            raise ValueError("a token with two merges, or one made before its parts")

    def by_merges(self, word: bytes) -> list[int]:
        """The definition: merge the pair of lowest rank, leftmost first, until none is left."""
        ids = [self.ids[word[i:i + 1]] for i in range(len(word))]
        while len(ids) > 1:
            rank, at = min((self.merges.get(p, (1 << 60,))[0], i) for i, p in enumerate(zip(ids, ids[1:])))
            if rank == 1 << 60:
                break
            ids[at:at + 2] = [self.merges[ids[at], ids[at + 1]][1]]
        return ids

    def _chains(self) -> tuple[dict[int, list[tuple[int, int]]], dict[int, list[tuple[int, int]]], list[int]]:
        """Per token its last (first) parts and the rank at which each is merged away; and the tokens that merges arrive at."""
        right: dict[int, list[tuple[int, int]]] = {}
        left: dict[int, list[tuple[int, int]]] = {}
        ranks = {a * WIDE + b: rank for (a, b), (rank, _) in self.merges.items()}
        reached = []
        for i in sorted(self.tokens, key=lambda t: self.made.get(t, (-1,))[0]):
            rank, pair = self.made.get(i, (-1, ()))
            if pair and not (pair[0] in right and pair[1] in right and _crossing(ranks, right[pair[0]], left[pair[1]]) == rank):
                continue  # merges never arrive at it
            for edge, part in ((right, pair[-1:]), (left, pair[:1])):
                inner = [*edge[part[0]][:-1], (part[0], rank)] if part else []
                edge[i] = [*inner, (i, NEVER)]
            reached.append(i)
        return right, left, reached

    def tables(self) -> dict[str, bytes]:
        """Everything an :class:`Encoder` needs, as 32-bit arrays of fixed size (about 10 MB)."""
        right, left, reached = self._chains()
        children: list[dict[int, int]] = [{}]
        owner = [-1]
        for i in reached:
            state = 0
            for byte in self.tokens[i]:
                to = children[state].setdefault(byte, len(children))
                if to == len(children):
                    children.append({})
                    owner.append(-1)
                state = to
            owner[state] = i
        if len(children[0]) < 256:
            raise ValueError("every byte must be a token")
        # Breadth first: places in the double array, suffix links, and suffixes that end a token.
        place, base, check, used, free = {0: 0}, [1], [-1], bytearray(b"\1"), 1
        link, depth, term, order = [0] * len(children), [0] * len(children), [-1] * len(children), deque([0])
        while order:
            state = order.popleft()
            codes = sorted(children[state])
            if codes:
                while free < len(used) and used[free]:
                    free += 1
                at = max(free - codes[0], 1)
                while any(at + c < len(used) and used[at + c] for c in codes):
                    at += 1
                short = at + 257 - len(used)
                if short > 0:
                    used += bytes(short)
                    base += [0] * short
                    check += [-1] * short
                base[place[state]] = at
            for byte in codes:
                to = children[state][byte]
                place[to], used[at + byte], check[at + byte] = at + byte, 1, place[state]
                back = link[state]
                while back and byte not in children[back]:
                    back = link[back]
                link[to] = children[back][byte] if state else 0
                depth[to] = depth[state] + 1
                term[to] = link[to] if owner[link[to]] >= 0 else term[link[to]]
                order.append(to)
        flat = {name: [0] * len(base) for name in ("link", "own", "depth", "term")}
        for state, p in place.items():
            flat["link"][p], flat["own"][p], flat["depth"][p] = place[link[state]], owner[state], depth[state]
            flat["term"][p] = place[term[state]] if term[state] >= 0 else -1
        flat |= {"base": base, "check": check}
        n = max([*self.tokens, *self.added.values()]) + 1
        for side, chains in (("left", left), ("right", right)):
            flat[f"{side}_at"] = [0, *accumulate(len(chains.get(i, ())) for i in range(n))]
            flat[f"{side}_piece"] = [piece for i in range(n) for piece, _ in chains.get(i, ())]
            flat[f"{side}_until"] = [until for i in range(n) for _, until in chains.get(i, ())]
        pairs = sorted(self.merges, key=lambda p: self.merges[p][0])
        flat |= {"first": [a for a, _ in pairs], "second": [b for _, b in pairs]}
        flat["token_at"] = [0, *accumulate(len(self.tokens.get(i, b"")) for i in range(n))]
        return {name: array("i", values).tobytes() for name, values in flat.items()} | {
            "tokens": b"".join(self.tokens.get(i, b"") for i in range(n)), "added": json.dumps(self.added).encode()}


def _crossing(ranks: dict[int, int], left: list[tuple[int, int]], right: list[tuple[int, int]]) -> int | None:
    """Rank of the first merge across the border of two tokens, given their chains of parts, if there is one."""
    i = j = 0
    while True:
        (piece, until), (other, then) = left[i], right[j]
        rank = ranks.get(piece * WIDE + other, NEVER)
        if rank < until and rank <= then and rank != NEVER:  # of equal pairs the leftmost is first
            return rank
        if until == then == NEVER:
            return None
        if until <= then:
            i += 1
        else:
            j += 1


def crossing(ranks: dict[int, int], rights: list[memoryview], left: int, lefts: list[memoryview], right: int) -> int | None:
    """:func:`_crossing` from flat tables: the last parts of ``left`` against the first parts of ``right``."""
    def chain(flat: list[memoryview], i: int) -> list[tuple[int, int]]:
        at, piece, until = flat
        return list(zip(piece[at[i]:at[i + 1]], until[at[i]:at[i + 1]]))

    return _crossing(ranks, chain(rights, left), chain(lefts, right))




class Encoder:
    """Encodes and decodes texts from flat tables, in a few megabytes of a Python worker.

    The suffix automaton is a double array: the state reached from state s by a byte is
    ``base[s] + byte`` if that one's ``check`` is s. ``own`` is the token a state ends (or -1),
    ``term`` the longest proper suffix that ends one.
    """

    def __init__(self, source: Vocabulary | dict[str, bytes]) -> None:
        self.vocabulary = source if isinstance(source, Vocabulary) else None
        tables = source.tables() if self.vocabulary else source
        flat = {k: memoryview(v).cast("i") for k, v in tables.items() if k not in ("tokens", "added")}
        self._automaton = tuple(flat[k] for k in ("base", "check", "link", "own", "depth", "term"))
        self._left, self._right = ([flat[f"{side}_{part}"] for part in ("at", "piece", "until")] for side in ("left", "right"))
        self._merges = dict(zip((a * WIDE + b for a, b in zip(flat["first"], flat["second"])), range(len(flat["first"]))))
        body, at = tables["tokens"], flat["token_at"]
        self._bytes = [body[i:j] for i, j in zip(at, at[1:])]
        self._sizes = [len(b) for b in self._bytes]
        self._added: dict[str, int] = json.loads(tables["added"])
        for text, i in self._added.items():
            self._bytes[i] = text.encode()
        self._pairs: dict[int, bool] = {}
        self._words: dict[str, bytes] = {}
        self._held = 0
        self._find = regex.compile(WORDS).findall
        self._special = regex.compile("|".join(map(regex.escape, sorted(self._added, key=len, reverse=True)))) if self._added else None

    def fits(self, left: int, right: int) -> bool:
        """Whether the two tokens stay as they are side by side."""
        key = left * WIDE + right
        known = self._pairs.get(key)
        if known is None:
            if len(self._pairs) >= PAIRS:
                self._pairs.clear()
            known = self._pairs[key] = crossing(self._merges, self._right, left, self._left, right) is None
        return known

    def word(self, word: bytes) -> list[int]:
        """Token ids of one word."""
        (base, check, link, own, depth, term), pairs, fits = self._automaton, self._pairs, self.fits
        last, state = [-1], 0
        for i, byte in enumerate(word, 1):
            to = base[state] + byte
            while check[to] != state:
                state = link[state]
                to = base[state] + byte
            state = to
            end = state if own[state] >= 0 else term[state]
            while True:
                token, before = own[end], last[i - depth[end]]
                if before < 0:  # the word's first token
                    break
                stays = pairs.get(before * WIDE + token)
                if stays or (stays is None and fits(before, token)):
                    break
                end = term[end]
            last.append(token)
        out, i = [], len(word)
        while i:
            out.append(last[i])
            i -= self._sizes[last[i]]
        return out[::-1]

    def _packed(self, words: list[str]) -> bytes:
        """Ids of words as little-endian 32-bit integers, through the memory of words."""
        known = self._words
        if self._held > MEMORY:
            known.clear()
            self._held = 0
        for w in set(words).difference(known):
            ids = self.word(w.encode())
            known[w] = array("I", ids).tobytes()
            self._held += 180 + 2 * len(w) + 4 * len(ids)
        return b"".join(map(known.__getitem__, words))

    def encode(self, text: str) -> bytes:
        """Ids of a whole text as little-endian 32-bit integers; added tokens count wherever they stand."""
        if self._special is None or not self._special.search(text):
            return self._packed(self._find(text))
        out, at = [], 0
        for m in self._special.finditer(text):
            out += [self._packed(self._find(text[at:m.start()])), self._added[m[0]].to_bytes(4, "little")]
            at = m.end()
        return b"".join([*out, self._packed(self._find(text[at:]))])

    def decode(self, ids: bytes) -> str:
        """Text of packed ids, special tokens included; bytes that are no UTF-8 become U+FFFD."""
        return b"".join(map(self._bytes.__getitem__, memoryview(ids).cast("I"))).decode("utf-8", "replace")


def encoder_of(state: dict) -> Encoder:
    """The worker's encoder: ``state`` is a broadcast value and lives as long as the worker."""
    if "encoder" not in state:
        state["encoder"] = Encoder(state.pop("tables"))
    return state["encoder"]


def bpe_columns(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Encode each whole text (null: empty) and decode its ids again, without a shuffle.

    ``tokenizer`` is the path of a byte-level BPE file on the driver; its content (a vocabulary of
    fixed size) becomes flat tables there, which are broadcast. One row per input row with the ids and digests of ids and
    decoded text; repeated rows stay, an empty text has no tokens, other columns are not looked at.
    """
    with open(tokenizer, encoding="utf-8") as file:
        shared = docs.sparkSession.sparkContext.broadcast({"tables": Vocabulary(file.read()).tables()})

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(shared.value)
        for batch in batches:
            packed = [encoder.encode(t or "") for t in batch.column(1).to_pylist()]
            ends = [0]
            for p in packed:
                ends.append(ends[-1] + len(p) // 4)
            values = pa.Array.from_buffers(pa.int32(), ends[-1], [None, pa.py_buffer(b"".join(packed))])
            yield pa.RecordBatch.from_arrays([
                batch.column(0).cast(pa.int64()),
                pa.array([len(p) // 4 for p in packed], pa.int64()),
                pa.array([hashlib.sha256(p).hexdigest() for p in packed], pa.string()),
                pa.array([hashlib.sha256(encoder.decode(p).encode()).hexdigest() for p in packed], pa.string()),
                pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values),
            ], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"])

    return docs.select("doc_id", "text").mapInArrow(tidy(convert), SCHEMA)
