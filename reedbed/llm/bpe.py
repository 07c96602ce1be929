"""Byte-level BPE as a lazily determinised finite-state transducer, and streaming decoding.

Method: the encoding of a piece of text is the only sequence of tokens in which every two neighbours are
*compatible* (their bytes together encode to just these two), and the encoding of a prefix is the encoding of
a shorter prefix and one more token. A state of the transducer holds, for every place where a token that is
still being read may have begun, the node of the vocabulary's trie and the tokens before it that aren't
emitted yet. States and transitions are made when first met and kept. A token is emitted as soon as all
readings agree on it, so the lookahead is bounded by the longest token.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reedbed.plans.runtime import table

#: Transitions and pieces that a process keeps before it starts over; this bounds memory, not results.
KEPT = 1_000_000
#: Fixed value: the pattern that splits text before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def vocabulary_path(name: str = "byte_bpe_50k.tiktoken") -> str:
    """The place of a vocabulary file of the installed public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Tokens of one vocabulary of ranks (lines of base64 bytes and rank); ids are ranks."""

    def __init__(self, path: str):
        import regex

        with open(path, "rb") as lines:
            self.rank = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.bytes = {b: a for a, b in self.rank.items()}
        self.pieces = regex.compile(PATTERN).findall
        # The trie as one dictionary from (node, byte) to node; node 0 is the root.
        self.child: dict[int, int] = {}
        self.token: dict[int, int] = {}
        nodes = 1
        for word, number in self.rank.items():
            node = 0
            for byte in word:
                step = node << 8 | byte
                node = self.child.get(step, 0)
                if not node:
                    node = self.child[step] = nodes
                    nodes += 1
            self.token[node] = number
        self._halves: dict[int, tuple[int, int] | None] = {}
        self._start_over()

    def _start_over(self) -> None:
        self._fits: dict[tuple[int, int], bool] = {}
        self._states: dict[tuple, int] = {}
        self._content: list[tuple] = []
        self._steps: dict[int, tuple[int, tuple[int, ...]]] = {}
        self._known: dict[str, tuple[int, ...]] = {}
        self._first = self._state((None, ((0, ()),)))

    def _state(self, content: tuple) -> int:
        found = self._states.get(content)
        if found is None:
            found = self._states[content] = len(self._content)
            self._content.append(content)
        return found

    def halves(self, number: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes the token; None for a byte or a token that no merge makes."""
        if number in self._halves:
            return self._halves[number]
        word, out = self.bytes[number], None
        if len(word) > 1:
            parts = [word[k : k + 1] for k in range(len(word))]
            while len(parts) > 2:
                best = min(range(len(parts) - 1), key=lambda k: self.rank.get(parts[k] + parts[k + 1], number))
                if self.rank.get(parts[best] + parts[best + 1], number) >= number:
                    break
                parts[best : best + 2] = [parts[best] + parts[best + 1]]
            if len(parts) == 2:
                out = (self.rank[parts[0]], self.rank[parts[1]])
        self._halves[number] = out
        return out

    def _edge(self, number: int, side: int) -> list[tuple[int, int, float]]:
        """Tokens that once stood at the token's right (1) or left (0) end: each with the ranks of the merges
        that made it and that took it up."""
        out, until = [], float("inf")
        while True:
            parts = self.halves(number)
            out.append((number, number if parts else -1, until))
            if not parts:
                return out
            until, number = number, parts[side]

    def fits(self, left: int | None, right: int) -> bool:
        """Whether the two may be neighbours: no merge over their border comes before those that made them."""
        if left is None:
            return len(self.bytes[right]) == 1 or self.halves(right) is not None
        found = self._fits.get((left, right))
        if found is None:
            found = self.fits(None, right) and not any(
                max(x_made, y_made) < (c := self.rank.get(self.bytes[x] + self.bytes[y], -2)) and c < x_until and c <= y_until
                for x, x_made, x_until in self._edge(left, 1)
                for y, y_made, y_until in self._edge(right, 0)
            )
            self._fits[left, right] = found
        return found

    def _step(self, state: int, byte: int) -> tuple[int, tuple[int, ...]]:
        last, readings = self._content[state]
        after: list[tuple[int, tuple[int, ...]]] = []
        whole: tuple[int, ...] | None = None
        for node, pending in readings:
            node = self.child.get(node << 8 | byte, 0)
            if not node:
                continue
            after.append((node, pending))
            if whole is None and node in self.token and self.fits(pending[-1] if pending else last, self.token[node]):
                whole = (*pending, self.token[node])
        if whole is None:
            raise ValueError("a byte of the text is not in the vocabulary")
        after.append((0, whole))
        agreed = 0
        shortest = min(len(p) for _, p in after)
        while agreed < shortest and len({p[agreed] for _, p in after}) == 1:
            agreed += 1
        out = whole[:agreed]
        content = (out[-1] if out else last, tuple((node, p[agreed:]) for node, p in after))
        return self._state(content), out

    def piece(self, text: str) -> tuple[int, ...]:
        """The ids of a piece of text, read byte by byte."""
        state, out = self._first, []
        steps = self._steps
        for byte in text.encode("utf-8", "surrogatepass"):
            step = state << 8 | byte
            found = steps.get(step)
            if found is None:
                if len(steps) + len(self._fits) > KEPT:
                    # Only the state that the piece is in goes on.
                    content = self._content[state]
                    self._start_over()
                    steps, step = self._steps, self._state(content) << 8 | byte
                found = steps[step] = self._step(step >> 8, byte)
            state = found[0]
            out += found[1]
        out += self._content[state][1][-1][1]
        return tuple(out)

    def encode(self, text: str | None) -> list[int]:
        """Ids of a text; none for null and for an empty text. Names of special tokens are ordinary text."""
        out: list[int] = []
        known = self._known
        for piece in self.pieces(text or ""):
            ids = known.get(piece)
            if ids is None:
                if len(known) + len(self._steps) + len(self._fits) > KEPT:
                    self._start_over()
                ids = self.piece(piece)
                known = self._known
                known[piece] = ids
            out += ids
        return out

    def decode(self, ids: Iterable[int]) -> str:
        decoder = StreamingDecoder(self.bytes.__getitem__)
        return "".join([*map(decoder.feed, ids), decoder.end()])


class StreamingDecoder:
    """Text from tokens as they come: whole characters are given out, a begun one waits for its other bytes.

    An incremental UTF-8 state machine: the state is how many bytes a character still needs and which values
    the next one may have. Bytes that can't be part of a character give U+FFFD."""

    def __init__(self, token_bytes: Callable[[int], bytes]):
        self._bytes = token_bytes
        self._need, self._low, self._high, self._point = 0, 0x80, 0xBF, 0

    def feed(self, number: int) -> str:
        out: list[str] = []
        for byte in self._bytes(number):
            if self._need and not self._low <= byte <= self._high:
                out.append("�")
                self._need = 0
            if self._need:
                self._point, self._need = self._point << 6 | byte & 0x3F, self._need - 1
                self._low, self._high = 0x80, 0xBF
                if not self._need:
                    out.append(chr(self._point))
            elif byte < 0x80:
                out.append(chr(byte))
            elif 0xC2 <= byte <= 0xF4:
                self._need = 1 + (byte >= 0xE0) + (byte >= 0xF0)
                self._point = byte & (0x3F >> self._need)
                self._low = {0xE0: 0xA0, 0xF0: 0x90}.get(byte, 0x80)
                self._high = {0xED: 0x9F, 0xF4: 0x8F}.get(byte, 0xBF)
            else:
                out.append("�")
        return "".join(out)

    def end(self) -> str:
        rest, self._need = "�" * bool(self._need), 0
        return rest


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    """One for each file and Python worker; Spark reuses its workers."""
    return Encoder(path)


def encoded(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, ids): the ids of each document's whole text; an empty list for a null or empty text.

    One narrow pass, no shuffle: rows stay in their partitions, repeated rows each give a row, an empty
    table gives none. Columns but the two named are not read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path).encode
        for batch in batches:
            ids = [np.array(encode(x), np.int32) for x in batch.column(1).to_pylist()]
            ends = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
            values = pa.array(np.concatenate(ids) if ids else np.empty(0, np.int32))
            yield pa.record_batch([batch.column(0), pa.ListArray.from_arrays(pa.array(ends), values)], names=["doc_id", "ids"])

    columns = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    return columns.mapInArrow(run, "doc_id long, ids array<int>")


def round_trips(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, same): whether the decoded ids give the text again (null counts as empty)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for batch in batches:
            texts = [x or "" for x in batch.column(1).to_pylist()]
            ids = [own.encode(x) for x in texts]
            yield pa.record_batch(
                [batch.column(0), pa.array([len(x) for x in ids], pa.int32()), pa.array([own.decode(x) == t for x, t in zip(ids, texts)])],
                names=["doc_id", "n_tokens", "same"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        run, "doc_id long, n_tokens int, same boolean"
    )


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded(table(spark, sf_dir, "documents"), vocabulary_path())


def p6_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trips(table(spark, sf_dir, "documents"), vocabulary_path())


def p6_same(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each document's text comes back from its ids."""
    return p6_roundtrip(spark, sf_dir).select("doc_id", "same")


QUERIES = {"p6_ids": p6_ids, "p6_roundtrip": p6_roundtrip, "p6_same": p6_same}
ORACLES = {"p6_same": "SELECT doc_id, true AS same FROM documents"}
