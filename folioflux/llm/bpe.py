"""Problem 8: exact byte-pair encoding of a corpus under a public vocabulary, and decoding.

The encoder does not run merges. An Aho-Corasick automaton over the vocabulary gives the longest
token at every place of a pretoken; the encoder takes it, and goes back to the next shorter one
where the token cannot follow the one before it. Whether two tokens can stand side by side is
decided from the merges that made them: if some merge across their border would have come earlier,
they cannot. The result is the sequence that the merges give, in linear time.
"""

from __future__ import annotations

import base64
from itertools import chain
from pathlib import Path

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from ..functions.whitespace import SPACES
from .runtime import TOKENIZERS, shipped, spread

VOCABULARY = f"{TOKENIZERS}/byte_bpe_50k.tiktoken"
#: White space as the tokenizer sees it: Unicode's property, which lacks U+001C to U+001F.
_SPACE = "".join(chr(c) for c in SPACES if c not in range(0x1C, 0x20))
#: The vocabulary's published split pattern. Fixed value.
PRETOKENS = regex.compile(
    rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_SPACE}\p{{L}}\p{{N}}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"
)
_CACHE_LIMIT = 1 << 20


class Encoder(dict):
    """Ids by pretoken, worked out on first use; emptied when it holds a million pretokens."""

    def __init__(self, tokens: list[bytes]):
        super().__init__()
        self.tokens = tokens
        self.id_of = {t: i for i, t in enumerate(tokens)}
        if len(self.id_of) != len(tokens) or any(bytes([b]) not in self.id_of for b in range(256)):
            raise ValueError("the vocabulary repeats a token or lacks a byte")
        self.automaton = ahocorasick.Automaton()
        for i, t in enumerate(tokens):
            self.automaton.add_word(t.decode("latin-1"), i)
        self.automaton.make_automaton()
        self._learn_merges()
        self.table: dict[tuple[int, int], bool] = {}

    def _learn_merges(self) -> None:
        """shorter[i]: the longest token that is a proper prefix of token i; halves[i]: the two it was merged from."""
        id_of, n = self.id_of, len(self.tokens)
        self.shorter, self.halves, self.merge = [-1] * n, [(i, i) for i in range(n)], {}
        for i, t in enumerate(self.tokens):
            k = len(t) - 1
            while k > 0 and (j := id_of.get(t[:k])) is None:
                k -= 1
            if k > 0:
                self.shorter[i] = j
        for i, t in enumerate(self.tokens):
            left = self.shorter[i]
            while left >= 0:
                right = id_of.get(t[len(self.tokens[left]) :])
                if right is not None and left < i and right < i and self.fits(left, right):
                    self.halves[i] = (left, right)
                    self.merge[(left, right)] = i
                    break
                left = self.shorter[left]

    def fits(self, a: int, b: int) -> bool:
        """Whether the merges leave token b standing after token a."""
        merge, halves, bound = self.merge, self.halves, len(self.tokens)
        while True:
            m = merge.get((a, b))
            if m is not None and m < bound:
                return False
            undo_a = a > b
            for _ in range(2):  # undo the later of the two merges; if that one is a byte, the other
                if undo_a:
                    bound, inner = a, halves[a][1]
                    if inner != bound:
                        a = inner
                        break
                else:
                    bound, inner = b + 1, halves[b][0]
                    if inner != b:
                        b = inner
                        break
                undo_a = not undo_a
            else:
                return True

    def compatible(self, a: int, b: int) -> bool:
        """The pair-compatibility table, filled in where it is first looked at; emptied when it holds a million pairs."""
        known = self.table.get((a, b))
        if known is None:
            if len(self.table) >= _CACHE_LIMIT:
                self.table.clear()
            known = self.table[a, b] = self.fits(a, b)
        return known

    def ids(self, piece: bytes) -> tuple[int, ...]:
        whole = self.id_of.get(piece)
        if whole is not None and self.halves[whole] != (whole, whole):
            return (whole,)
        n, lengths = len(piece), self.tokens
        longest = [-1] * n
        for end, i in self.automaton.iter(piece.decode("latin-1")):
            start = end + 1 - len(lengths[i])
            if longest[start] < 0 or len(lengths[longest[start]]) < len(lengths[i]):
                longest[start] = i
        out: list[int] = []
        dead = bytearray(n + 1)
        at, nxt = 0, longest[0]
        while True:
            last = out[-1] if out else -1
            end = -1
            while nxt >= 0:
                end = at + len(lengths[nxt])
                if not dead[end] and (last < 0 or self.compatible(last, nxt)):
                    break
                nxt = self.shorter[nxt]
            if nxt >= 0:
                out.append(nxt)
                at = end
                if at == n:
                    return tuple(out)
                nxt = longest[at]
            else:
                dead[at] = 1
                nxt = out.pop()
                at -= len(lengths[nxt])
                nxt = self.shorter[nxt]

    def __missing__(self, pretoken: str) -> tuple[int, ...]:
        if len(self) >= _CACHE_LIMIT:
            self.clear()
        out = self[pretoken] = self.ids(pretoken.encode("utf-8", "replace"))
        return out

    def encode(self, text: str | None) -> list[int]:
        """Ids of a text; null and empty texts give none."""
        return list(chain.from_iterable(map(self.__getitem__, PRETOKENS.findall(text)))) if text else []


class Decoder:
    """Ids to bytes by an offset table over the joined tokens."""

    def __init__(self, tokens: list[bytes]):
        self.blob = np.frombuffer(b"".join(tokens), dtype=np.uint8)
        self.offsets = np.concatenate([[0], np.cumsum([len(t) for t in tokens])]).astype(np.int64)

    def decode(self, ids) -> str:
        ids = np.asarray(ids, dtype=np.int64)
        if not len(ids):
            return ""
        starts, sizes = self.offsets[ids], self.offsets[ids + 1] - self.offsets[ids]
        ends = np.cumsum(sizes)
        place = np.arange(ends[-1]) + np.repeat(starts - (ends - sizes), sizes)
        return self.blob[place].tobytes().decode("utf-8", "replace")


def read_ranks(file: str | bytes) -> list[bytes]:
    """Tokens by id of a file of base64 tokens and ranks, given by its path or its bytes."""
    data = file if isinstance(file, bytes) else Path(file).read_bytes()
    ranks = {int(rank): base64.b64decode(token) for token, rank in map(bytes.split, data.splitlines())}
    return [ranks[i] for i in range(len(ranks))]


_LOADED: dict[str, Encoder] = {}


def load(path: str, data: bytes | None = None) -> Encoder:
    """The encoder of a vocabulary; data: the file's bytes where the path isn't at hand."""
    if path not in _LOADED:
        _LOADED[path] = Encoder(read_ranks(data or path))
    return _LOADED[path]


def encoded(documents: DataFrame, vocabulary: str = VOCABULARY, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids) of every row. A null and an empty text give an empty list; names of special
    tokens in a text are ordinary text; repeated rows come out as often as they came in."""
    rows = spread(documents.select(key, text))
    schema = f"`{key}` {dict(rows.dtypes)[key]}, ids array<int>"
    file = shipped(documents.sparkSession, vocabulary)

    def encode(batches):
        encoder = load(vocabulary, file.value)
        look, find = encoder.__getitem__, PRETOKENS.findall
        for batch in batches:
            flat, sizes = [], [0]
            for t in batch.column(1).to_pylist():
                if t:
                    for ids in map(look, find(t)):
                        flat += ids
                sizes.append(len(flat))
            ids = pa.ListArray.from_arrays(pa.array(np.array(sizes, np.int32)), pa.array(np.array(flat, np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], names=[key, "ids"])

    return rows.mapInArrow(encode, schema)


def decoded(df: DataFrame, vocabulary: str = VOCABULARY, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(key, text) of lists of ids; a null list gives an empty text, an unknown id raises."""
    rows = df.select(key, ids)
    schema = f"`{key}` {dict(rows.dtypes)[key]}, text string"
    file = shipped(df.sparkSession, vocabulary)

    def decode(batches):
        decoder = Decoder(read_ranks(file.value))
        for batch in batches:
            texts = [decoder.decode(x or []) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[key, "text"])

    return rows.mapInArrow(decode, schema)
