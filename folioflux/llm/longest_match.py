"""Longest-match subword counting in linear time: a trie with failure links and emissions.

A longest-match vocabulary (WordPiece and its kin) cuts a word from the left into the longest
pieces it knows. The automaton walks the word once; where the walk leaves the trie, the failure
link names the state in which the matching goes on, and the number of pieces that are given out
on the way is precomputed with the link. Links are worked out on first use and kept.
"""

from __future__ import annotations

import json
from pathlib import Path

import regex

#: How a word is cut before matching: letters, single digits, runs of anything else. Fixed value.
WORD_PARTS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\p{L}\p{N}]+")
_CACHE_LIMIT = 1 << 20


def printable_bytes() -> dict[str, int]:
    """The public byte-to-character table of byte-level vocabularies, reversed."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(keep)]
    return {chr(b): b for b in keep} | {chr(256 + i): b for i, b in enumerate(rest)}


class LongestMatch:
    """Counts the pieces of a word under a longest-match vocabulary of byte strings.

    end: pieces that may only close a word carry this marker byte sequence at their end; the
    marker is matched as one more symbol (256) after the word's bytes.
    """

    END = 256

    def __init__(self, pieces):
        self.child: dict[tuple[int, int], int] = {}
        self.parent, self.symbol, self.final = [-1], [-1], [False]
        for piece in pieces:
            node = 0
            for s in piece:
                nxt = self.child.get((node, s))
                if nxt is None:
                    nxt = self.child[(node, s)] = len(self.parent)
                    self.parent.append(node)
                    self.symbol.append(s)
                    self.final.append(False)
                node = nxt
            self.final[node] = True
        self.link: dict[int, tuple[int, int]] = {}

    def failure(self, node: int) -> tuple[int, int]:
        """(state to go on in, or -1; number of pieces given out) for a node that has no next symbol."""
        todo = [node]
        while todo:
            v = todo[-1]
            if v in self.link:
                todo.pop()
            elif v == 0:
                self.link[0] = (-1, 0)
            elif self.final[v]:
                self.link[v] = (0, 1)
            elif self.parent[v] not in self.link:
                todo.append(self.parent[v])
            else:
                z, n = self.link[self.parent[v]]
                while z > 0 and (z, self.symbol[v]) not in self.child:
                    if z not in self.link:
                        todo.append(z)
                        break
                    n += self.link[z][1]
                    z = self.link[z][0]
                else:
                    to = self.child.get((z, self.symbol[v]), -1) if z >= 0 else -1
                    self.link[v] = (to, n) if to >= 0 else (-1, 0)
        return self.link[node]

    def count(self, symbols) -> int:
        """Pieces of one word; a word that no sequence of pieces covers counts as one unknown piece."""
        node = n = 0
        for s in symbols:
            nxt = self.child.get((node, s))
            while nxt is None:
                to, k = self.failure(node)
                if to < 0:
                    return 1
                n += k
                node = to
                nxt = self.child.get((node, s))
            node = nxt
        while node > 0:
            to, k = self.failure(node)
            if to < 0:
                return 1
            n += k
            node = to
        return n

    def naive(self, symbols) -> list[int]:
        """The same by trying every length at every place; for tests."""
        out, i = [], 0
        while i < len(symbols):
            node, best, j = 0, 0, i
            while j < len(symbols) and (node := self.child.get((node, symbols[j]), -1)) >= 0:
                j += 1
                if self.final[node]:
                    best = j
            if not best:
                return [len(symbols)]
            out.append(best - i)
            i = best
        return out


class TextCounter(dict):
    """Subword pieces of whitespace tokens, kept by token; emptied when it holds a million."""

    def __init__(self, matcher: LongestMatch):
        super().__init__()
        self.matcher = matcher

    def __missing__(self, token: str) -> int:
        if len(self) >= _CACHE_LIMIT:
            self.clear()
        n = sum(self.matcher.count((*part.encode(), LongestMatch.END)) for part in WORD_PARTS.findall(token.lower()))
        self[token] = n
        return n


_LOADED: dict[str, TextCounter] = {}


def load(path: str, ending: str = "</w>", data: bytes | None = None) -> TextCounter:
    """The counter of a vocabulary file (JSON of a byte-level vocabulary with word ends); data: its bytes where the path isn't at hand."""
    if path not in _LOADED:
        vocab = json.loads(data or Path(path).read_bytes())["model"]["vocab"]
        table = printable_bytes()
        pieces = []
        for piece in vocab:
            closes = piece.endswith(ending)
            body = piece[: -len(ending)] if closes else piece
            if all(c in table for c in body) and body:
                pieces.append((*(table[c] for c in body), *([LongestMatch.END] if closes else [])))
        _LOADED[path] = TextCounter(LongestMatch(pieces))
    return _LOADED[path]
