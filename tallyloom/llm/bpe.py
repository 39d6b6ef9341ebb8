"""Byte-level BPE by dynamic programming over prefixes.

Of every byte prefix of a piece exactly one token can come last in its encoding: the token whose
bytes end the prefix and which stays whole beside the last token of what stands before it. Two
tokens stay whole side by side if undoing their merges, latest first, meets no merge across the
border that would have come earlier. So one last token per prefix is stored, and the encoding of
any prefix is read off backwards. Bytes may be appended at will; after an edit only the prefixes
from there on are computed anew, until as many in a row as the longest token has bytes agree with
those before the edit.

A text is split by the tokenizer's pattern and each piece is encoded by itself; a piece that is a
token as a whole is that token. Results for odd input: null is the empty text, which has no ids.
Repeated rows are each returned.
"""

from __future__ import annotations

import base64
import hashlib
import re
import unicodedata
from collections.abc import Iterator, Sequence
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._util import bounded_batches, claim, slices

#: Pieces kept with their ids by a worker, in two halves of so many, and pairs of tokens.
CACHE = 250_000
RESULT = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Vocabulary:
    """Ranks, the two tokens that each token was merged from, and the rank of each merge."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes = {i: t for t, i in ranks.items()}
        self.parts: dict[int, tuple[int, int]] = {}
        self.merged: dict[tuple[int, int], int] = {}
        self.usable: dict[bytes, int] = {}
        for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
            if len(token) == 1:
                self.usable[token] = rank
            elif (two := self._two(token, rank)) is not None:
                self.parts[rank], self.merged[two], self.usable[token] = two, rank, rank
        self.longest = max(map(len, self.usable), default=0)
        sizes: dict[bytes, set[int]] = {}
        for token in self.usable:
            if len(token) > 3:
                sizes.setdefault(token[-4:], set()).add(len(token))
        #: By their last four bytes, the sizes that tokens may have, the longest first.
        self.sizes = {end: (*sorted(x, reverse=True), 3, 2, 1) for end, x in sizes.items()}
        self.known: dict[int, bool] = {}  # pairs that encode() has met

    def _two(self, token: bytes, rank: int) -> tuple[int, int] | None:
        """The two tokens left when all merges before this rank are done, if just two are left."""
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            best = min(range(len(parts) - 1), key=lambda i: self.ranks.get(parts[i] + parts[i + 1], rank))
            if self.ranks.get(parts[best] + parts[best + 1], rank) >= rank:
                return None
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        a, b = (self.ranks.get(x) for x in parts)
        return None if a is None or b is None else (a, b)

    def encode(self, data: bytes) -> tuple[int, ...]:
        """The same recurrence as in Prefixes, for a piece that is not kept."""
        usable, stay, known, sizes, n = self.usable.get, self.stay, self.known, self.sizes.get, len(data)
        short = (3, 2, 1)
        last, before = [-1] * (n + 1), [0] * (n + 1)
        for i in range(1, n + 1):
            for size in sizes(data[i - 4 : i], short) if i > 3 else short:
                k = i - size
                if k < 0:
                    continue
                token = usable(data[k:i])
                if token is None:
                    continue
                if k:
                    pair = last[k] << 32 | token
                    fits = known.get(pair)
                    if fits is None:
                        fits = known[pair] = stay(last[k], token)
                    if not fits:
                        continue
                last[i], before[i] = token, k
                break
            else:
                raise ValueError("a byte that no token stands for")
        out = []
        while n:
            out.append(last[n])
            n = before[n]
        if len(known) > 2 * CACHE:
            known.clear()
        return tuple(out[::-1])

    def stay(self, left: int, right: int) -> bool:
        """Whether two tokens, each whole by itself, stay whole side by side."""
        # the border's two tokens at each time, from the end of merging to its beginning; `later` is
        # the merge that made one of them into what it is at the end: only earlier merges could pre-empt it
        later_left = later_right = 1 << 62
        merged, parts = self.merged.get, self.parts.get
        while True:
            across = merged((left, right))
            # in a tie the merge further left comes first: the right token's own merge is to the right of the border
            if across is not None and (across < later_left and across <= later_right):
                return False
            undo_left, undo_right = parts(left), parts(right)
            if undo_left is None and undo_right is None:
                return True
            if undo_right is None or (undo_left is not None and left > right):
                later_left, later_right, left = left, min(later_right, left), undo_left[1]
            else:
                later_right, later_left, right = right, min(later_left, right + 1), undo_right[0]


class Prefixes:
    """A piece's bytes with the last token of every prefix."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.vocabulary, self.data, self.last = vocabulary, bytearray(), []
        self.computed = 0  # prefixes computed so far, to see what an edit costs
        self.append(data)

    def append(self, data: bytes) -> None:
        n = len(self.data)
        self.data += data
        self._compute(n, len(self.data))

    def _compute(self, start: int, stop: int) -> None:
        last = self.last
        for i in range(start, stop):
            last.append(self._ending(i + 1))

    def _ending(self, n: int) -> int:
        usable, last, stay = self.vocabulary.usable, self.last, self.vocabulary.stay
        data = bytes(self.data[max(0, n - self.vocabulary.longest) : n])
        self.computed += 1
        for size in range(len(data), 0, -1):
            token = usable.get(data[len(data) - size :])
            if token is not None and (size == n or stay(last[n - size - 1], token)):
                return token
        raise ValueError("a byte that no token stands for")

    def replace(self, start: int, stop: int, data: bytes) -> None:
        """Puts data in the place of bytes start to stop."""
        old, tail = self.last[stop:], len(self.data) - stop
        self.data[start:stop] = data
        del self.last[start:]
        edge, same, reach = start + len(data), 0, self.vocabulary.longest
        for i in range(start, len(self.data)):
            self.last.append(self._ending(i + 1))
            if i >= edge:
                same = same + 1 if self.last[-1] == old[i - edge] else 0
                if same >= reach and i - edge + 1 < tail:  # what follows looks no further back
                    self.last += old[i - edge + 1 :]
                    return

    def ids(self, n: int | None = None) -> list[int]:
        """The encoding of the first n bytes."""
        n, out = len(self.data) if n is None else n, []
        while n:
            out.append(self.last[n - 1])
            n -= len(self.vocabulary.bytes[out[-1]])
        return out[::-1]


#: Python's re has no \\p classes but is faster; its \\w, \\d and \\s class these characters differently.
PLAIN = {r"[^\s\p{L}\p{N}]": r"(?:[^\s\w]|_)", r"\p{L}": r"[^\W\d_]", r"\p{N}": r"\d"}


class _Known(dict):
    """Pieces with their ids, as text and as numbers; finds those of a new piece."""

    def __init__(self, vocabulary: Vocabulary):
        super().__init__()
        self.vocabulary, self.older = vocabulary, {}

    def __missing__(self, piece: str) -> tuple[str, tuple[int, ...]]:
        if (out := self.older.get(piece)) is not None:
            self[piece] = out
            return out
        data = piece.encode()
        whole = self.vocabulary.ranks.get(data)
        ids = (whole,) if whole is not None else self.vocabulary.encode(data)
        out = ",".join(map(str, ids)), ids
        if len(data) <= 64:
            if len(self) >= CACHE:  # what is not met again leaves with the older half
                self.older = dict(self)
                self.clear()
            self[piece] = out
        return out


class Encoder:
    """Encodes and decodes texts; remembers pieces."""

    def __init__(self, vocabulary: Vocabulary, pattern: str):
        self.vocabulary, self.pattern, self._split = vocabulary, pattern, None

    def __getstate__(self) -> dict:
        return {"vocabulary": self.vocabulary, "pattern": self.pattern, "_split": None}

    def _ready(self) -> None:
        import regex

        self._known = _Known(self.vocabulary)
        plain = self.pattern
        for a, b in PLAIN.items():
            plain = plain.replace(a, b)
        odd = [chr(i) for i in range(0x10000) if unicodedata.category(chr(i)) in ("Nl", "No")] + list("\x1c\x1d\x1e\x1f") + ["\U00010000-\U0010ffff"]
        self._odd = re.compile("[" + "".join(odd) + "]") if "\\p" not in plain else re.compile("")
        self._plain = re.compile(plain) if "\\p" not in plain else None
        self._split = regex.compile(self.pattern)

    def forget(self) -> None:
        self._split = self._known = None
        self.vocabulary.known.clear()

    def pieces(self, text: str) -> list[tuple[str, tuple[int, ...]]]:
        if self._split is None:
            self._ready()
        split = self._split if self._odd.search(text) else self._plain
        return list(map(self._known.__getitem__, split.findall(text)))

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(x[1] for x in self.pieces(text)))

    def decode(self, ids: Sequence[int]) -> bytes:
        return b"".join(map(self.vocabulary.bytes.__getitem__, ids))


def digests(documents: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every row."""
    held = documents.sparkSession.sparkContext.broadcast(Encoder(Vocabulary(read_ranks(ranks_path)), pattern))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, sha = held.value, hashlib.sha256
        claim("bpe", encoder.forget)
        for batch in slices(batches, "text"):
            n, said, back = [], [], []
            for text in batch.column(1).to_pylist():
                pieces = encoder.pieces(text or "")
                ids = list(chain.from_iterable(x[1] for x in pieces))
                n.append(len(ids))
                said.append(sha(",".join([x[0] for x in pieces]).encode()).hexdigest())
                back.append(sha(encoder.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(said, pa.string()), pa.array(back, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    bounded_batches(documents.sparkSession)
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, RESULT)


def token_ids(documents: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id and the ids themselves."""
    held = documents.sparkSession.sparkContext.broadcast(Encoder(Vocabulary(read_ranks(ranks_path)), pattern))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            ids = [held.value.encode(x or "") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    bounded_batches(documents.sparkSession)
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, ids array<int>")
