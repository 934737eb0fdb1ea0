"""Splitting a text into pre-tokens fast, shared by the two tokenizer operators.

A single space between two other characters always starts a new match of the
public pattern, and a single line feed between two others is a match of its
own.  So a text without two white-space characters in a row can be cut there
and the pieces looked up one by one; a text with such a pair is matched as a
whole.  Both ways give the matches of the pattern, in order.
"""

from __future__ import annotations

import re

import regex

TWO_SPACES = re.compile(r"\s\s")
LAST = frozenset(".,;:!?")       # characters that match on their own after a word


class Pieces:
    """Maps texts to cached values of their pieces.  ``encode(list of distinct
    pre-tokens)`` gives one value for each; ``join(values)`` the value of a
    run of them.  The cache of a worker holds at most ``bound`` pieces and
    those of one batch."""

    def __init__(self, pattern: str, encode, join, bound: int = 700_000):
        self.find = regex.compile(pattern).findall
        self.encode, self.join, self.bound = encode, join, bound
        self.cache: dict = {}

    def _cut(self, text: str) -> list[str]:
        if TWO_SPACES.search(text):
            return self.find(text)
        # A mark that no piece holds stands before every space and line feed.
        if "\x1f" in text:
            return self.find(text)
        pieces = text.replace(" ", "\x1f ").replace("\n", "\x1f\n\x1f").split("\x1f")
        return [p for p in pieces if p] if "" in pieces else pieces

    def _split(self, piece: str) -> list[str]:
        """The pre-tokens of one piece."""
        word = piece[1:] if piece[0] == " " else piece
        if word.isalpha():
            return [piece]
        if word[-1:] in LAST and word[:-1].isalpha():
            return [piece[:-1], piece[-1]]
        return self.find(piece)

    def __call__(self, texts: list[str]) -> list[list]:
        """For every text the values of its pieces."""
        cut = [self._cut(t) for t in texts]
        cache = self.cache
        if len(cache) > self.bound:
            cache.clear()
        new: set = set()
        for pieces in cut:
            new.update(pieces)
        new = new.difference(cache)
        if new:
            several, tokens = [], set()
            for p in new:
                ts = self._split(p)
                if len(ts) == 1:
                    tokens.add(p)
                else:
                    several.append((p, ts))
                    tokens.update(ts)
            tokens = list(tokens.difference(cache))
            cache.update(zip(tokens, self.encode(tokens)))
            for p, ts in several:
                cache[p] = self.join([cache[t] for t in ts])
        return [list(map(cache.__getitem__, pieces)) for pieces in cut]
