"""Encoding of a corpus with a public byte-level BPE vocabulary by a tokenization automaton.

Compilation (once, on the driver) adds one gadget per merge, in rank order: the merge (u, v) -> t lengthens the path
that spells u by the bytes of v, marks the state at its end as accepting t, and enters the pair in the merge table.
Which pair makes t is found with the merges added so far. Failure arcs then make the automaton deterministic: each
byte leads from any state to the state of the longest suffix that begins a token.

Encoding a pre-split word is one run over its bytes. At each place the accepted tokens are tried from the longest
down; the first that may follow the last token of the text before it is the last token of the text up to here. That
is exactly one, because an encoding is right if and only if each two neighbours in it are: no merge of a rank below
theirs spans their border. The answers are kept in a transition table (last token, next token). Decoding emits the
labels (bytes) of the arcs.

The tables are broadcast: their size is that of the vocabulary. Words are cached per task, so a frequent word costs
one lookup.

Defined cases: null and empty texts give an empty list; the strings of special tokens are ordinary text; texts of
any length are encoded whole, also runs without blanks. Repeated rows give repeated results. Extra columns are ignored.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Where the vocabulary files are; a parameter of everything that needs one.
TOKENIZERS = "/opt/tokenizers"
#: Fixed value: the pre-split pattern of the vocabulary.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words a task keeps.
CACHE = 200_000


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to id from a file of base64 tokens and ranks."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


class Automaton:
    """The compiled tables; see the module's docstring."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        order = sorted(ranks.items(), key=lambda x: x[1])
        self.label = {rank: token for token, rank in order}
        self.left: dict[int, int] = {}
        self.right: dict[int, int] = {}
        self.merge: dict[tuple[int, int], int] = {}
        self.goto: dict[int, int] = {}  # state * 256 + byte -> state
        self.accepts: list[int] = [-1]
        self.table: dict[tuple[int, int], bool] = {}
        state: dict[int, int] = {}
        for token, rank in order:
            if len(token) == 1:
                state[rank] = self._path(0, token)
            else:
                u, v = self._parts(token, rank, ranks)
                self.left[rank], self.right[rank], self.merge[u, v] = u, v, rank
                state[rank] = self._path(state[u], self.label[v])
            self.accepts[state[rank]] = rank
        self._failures()

    def _path(self, state: int, label: bytes) -> int:
        for byte in label:
            nxt = self.goto.get(state << 8 | byte)
            if nxt is None:
                nxt = self.goto[state << 8 | byte] = len(self.accepts)
                self.accepts.append(-1)
            state = nxt
        return state

    def _parts(self, token: bytes, rank: int, ranks: dict[bytes, int]) -> tuple[int, int]:
        """The pair that the merges below `rank` leave of the token."""
        for cut in range(1, len(token)):
            u, v = ranks.get(token[:cut], rank), ranks.get(token[cut:], rank)
            if u < rank and v < rank and self._neighbours(u, v):
                return u, v
        raise ValueError(f"no merge makes {token!r}")

    def _failures(self) -> None:
        """Failure arcs, and for each state the next accepting state among its suffixes."""
        arcs: dict[int, list[tuple[int, int]]] = {}
        for key, target in self.goto.items():
            arcs.setdefault(key >> 8, []).append((key & 255, target))
        self.fail = [0] * len(self.accepts)
        self.shorter = [0] * len(self.accepts)
        level = [0]
        while level:
            below = []
            for state in level:
                for byte, target in arcs.get(state, ()):
                    below.append(target)
                    if state:
                        back = self.fail[state]
                        while back and back << 8 | byte not in self.goto:
                            back = self.fail[back]
                        back = self.goto.get(back << 8 | byte, 0)
                        self.fail[target] = back
                        self.shorter[target] = back if self.accepts[back] >= 0 else self.shorter[back]
            level = below

    def _neighbours(self, left: int, right: int) -> bool:
        """Whether right may follow left: walking down the two edges at their border, no merge of a lower rank joins them."""
        bound = 1 << 60
        while True:
            joined = self.merge.get((left, right))
            if joined is not None and joined < bound:
                return False
            # undo the younger token, of equals the right one, since merges run from left to right; the pair that comes
            # to light would have been joined only by a merge before that
            if left > right:
                if left not in self.left:
                    return True
                bound, left = left, self.right[left]
            else:
                if right not in self.left:
                    return True
                bound, right = right + 1, self.left[right]

    def may_follow(self, left: int, right: int) -> bool:
        known = self.table.get((left, right))
        if known is None:
            if len(self.table) > 2_000_000:
                self.table.clear()
            known = self.table[left, right] = self._neighbours(left, right)
        return known

    def encode(self, word: bytes) -> list[int]:
        goto, fail, accepts, shorter, label = self.goto, self.fail, self.accepts, self.shorter, self.label
        last = [-1] * (len(word) + 1)
        state = 0
        for place, byte in enumerate(word, 1):
            nxt = goto.get(state << 8 | byte)
            while nxt is None:
                state = fail[state]
                nxt = goto.get(state << 8 | byte)
            state = nxt
            at = state if accepts[state] >= 0 else shorter[state]
            while True:
                token = accepts[at]
                start = place - len(label[token])
                if start == 0 or self.may_follow(last[start], token):
                    last[place] = token
                    break
                at = shorter[at]
        ids = []
        place = len(word)
        while place:
            ids.append(last[place])
            place -= len(label[last[place]])
        return ids[::-1]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(self.label[i] for i in ids)


class Encoder(dict):
    """Words to ids; a word that isn't known yet is run through the automaton."""

    def __init__(self, automaton: Automaton) -> None:
        super().__init__()
        self.automaton = automaton
        self.words = regex.compile(PATTERN).findall

    def __missing__(self, word: str) -> list[int]:
        if len(self) > CACHE:
            self.clear()
        ids = self[word] = self.automaton.encode(word.encode("utf-8", "replace"))
        return ids

    def ids(self, text: str | None) -> list[int]:
        return list(chain.from_iterable(map(self.__getitem__, self.words(text)))) if text else []

    def count(self, text: str | None) -> int:
        return sum(map(len, map(self.__getitem__, self.words(text)))) if text else 0


_ENCODERS: dict[str, Encoder] = {}


def task_encoder(name: str, tables: object) -> Encoder:
    """One encoder per Python worker, whichever task runs in it."""
    if name not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[name] = Encoder(tables.value)  # type: ignore[attr-defined]
    return _ENCODERS[name]


_COMPILED: dict[str, Automaton] = {}


def compiled(vocabulary: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> Automaton:
    path = str(Path(folder) / f"{vocabulary}.tiktoken")
    if path not in _COMPILED:
        _COMPILED[path] = Automaton(read_ranks(path))
    return _COMPILED[path]


def encode_corpus(docs: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """key, ids: the ids of each text."""
    tables = docs.sparkSession.sparkContext.broadcast(compiled(vocabulary, folder))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = task_encoder(vocabulary, tables)
        for batch in batches:
            lists = [encoder.ids(t) for t in batch.column(1).to_pylist()]
            ends = np.cumsum([0, *map(len, lists)], dtype=np.int32)
            flat = np.fromiter(chain.from_iterable(lists), dtype=np.int32, count=int(ends[-1]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], [key, "ids"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(run, f"{key} {kind}, ids array<int>")


def count_tokens(docs: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """key, n_tokens of each text."""
    tables = docs.sparkSession.sparkContext.broadcast(compiled(vocabulary, folder))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = task_encoder(vocabulary, tables)
        for batch in batches:
            counts = [encoder.count(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64())], [key, "n_tokens"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key), F.col(text)).mapInArrow(run, f"{key} {kind}, n_tokens long")
