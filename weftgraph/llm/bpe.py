"""Byte-level BPE with a public vocabulary of ranks.

A word's parts lie between boundaries in one list, and the rank of joining each part with the next lies beside it in
another. The minimum is looked up, its boundary deleted and the two neighbouring ranks are refreshed, until no join has
a rank. Words too long for repeated scans take a heap of ranks over a linked list, which joins in the same order.
Words seen before come from a table of bounded size.
"""

from __future__ import annotations

import base64
import heapq
import re
from itertools import chain

import regex

#: Above this many bytes a word takes the heap.
LONG = 300
#: Words kept with their ids; beyond it the table starts anew.
KEPT = 400_000
_NONE = 1 << 60

# fixed value: the pattern of the vocabulary's words
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: White space as the reference libraries define it, unlike Python's own without the four separators below U+0020.
_SPACE = r"\t\n\x0b\x0c\r \x85\xa0  -     　"
_ANY = regex.compile(PATTERN.replace(r"[^\s\p{L}\p{N}]", rf"[^{_SPACE}\p{{L}}\p{{N}}]").replace(r"\s+(?!\S)", rf"[{_SPACE}]+(?![^{_SPACE}])").replace(r"|\s+", rf"|[{_SPACE}]+"))
_BLANK = r"\t\n\x0b\x0c\r "
_ASCII = re.compile(rf"'(?:[stmd]|re|ve|ll)| ?[A-Za-z]+| ?[0-9]+| ?[^{_BLANK}A-Za-z0-9]+|[{_BLANK}]+(?![^{_BLANK}])|[{_BLANK}]+")


def load_ranks(data: bytes) -> dict[bytes, int]:
    """The lines of a vocabulary file: a base64 token and its rank."""
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in data.splitlines() if line)}


def split_words(text: str) -> list[str]:
    return (_ASCII if text.isascii() else _ANY).findall(text)


def join_scan(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of a short word by the contiguous rank array."""
    get = ranks.get
    bounds = list(range(len(word) + 1))
    joins = [get(word[i : i + 2], _NONE) for i in range(len(word) - 1)]
    while joins:
        least = min(joins)
        if least == _NONE:
            break
        i = joins.index(least)
        del bounds[i + 1], joins[i]
        if i < len(joins):
            joins[i] = get(word[bounds[i] : bounds[i + 2]], _NONE)
        if i:
            joins[i - 1] = get(word[bounds[i - 1] : bounds[i + 1]], _NONE)
    return [ranks[word[a:b]] for a, b in zip(bounds, bounds[1:])]


def join_heap(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same for a long word: the least rank first, the leftmost among equal ones."""
    n = len(word)
    get = ranks.get
    after = list(range(1, n + 2))  # the start of the next part
    before = list(range(-1, n))
    alive = bytearray(b"\1" * n)
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, end = heapq.heappop(heap)
        j = after[i]
        if not alive[i] or j >= n or after[j] != end:
            continue
        alive[j] = 0
        after[i] = end
        if end < n:
            before[end] = i
            r = get(word[i : after[end]])
            if r is not None:
                heapq.heappush(heap, (r, i, after[end]))
        p = before[i]
        if p >= 0:
            r = get(word[p:end])
            if r is not None:
                heapq.heappush(heap, (r, p, end))
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i : after[i]]])
        i = after[i]
    return out


class Words(dict):
    """word -> ids"""

    def __init__(self, ranks: dict[bytes, int]):
        super().__init__()
        self.ranks = ranks

    def __missing__(self, word: str) -> tuple[int, ...]:
        raw = word.encode()
        one = self.ranks.get(raw)
        if one is not None:
            ids = (one,)
        else:
            ids = tuple(join_scan(raw, self.ranks) if len(raw) <= LONG else join_heap(raw, self.ranks))
        if len(raw) <= 64:
            if len(self) >= KEPT:
                self.clear()
            self[word] = ids
        return ids


class Encoder:
    def __init__(self, ranks: dict[bytes, int]):
        self.words = Words(ranks)

    def encode(self, text: str | None) -> list[int]:
        """Ids without special tokens; the empty list for an empty or a null text."""
        if not text:
            return []
        return list(chain.from_iterable(map(self.words.__getitem__, split_words(text))))

    def count(self, text: str | None) -> int:
        return sum(map(len, map(self.words.__getitem__, split_words(text)))) if text else 0
