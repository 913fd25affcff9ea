"""Vectorised pre-tokenisation: the two public split patterns as operations on code-point arrays.

A regular-expression engine visits every token in Python; here each character gets a class
(letter, number, white space, other) from a table probed from the tokenizer library itself, and token
boundaries are class changes corrected by the patterns' few rules.  Tests compare both.
"""

from __future__ import annotations

from functools import cache
from itertools import chain

import numpy as np

LETTER, NUMBER, SPACE, OTHER = 1, 2, 3, 0


def _tokenizers_finds(pattern: str, text: str) -> str:
    from tokenizers import Regex, pre_tokenizers

    split = pre_tokenizers.Split(Regex(pattern), "removed", invert=True)
    return "".join(part for part, _ in split.pre_tokenize_str(text))


def _tiktoken_finds(pattern: str, text: str) -> str:
    import tiktoken

    plain = tiktoken.Encoding("probe", pat_str=pattern, special_tokens={},
                              mergeable_ranks={bytes([i]): i for i in range(256)})
    return plain.decode(plain.encode_ordinary(text))


FINDERS = {"tokenizers": _tokenizers_finds, "tiktoken": _tiktoken_finds}


@cache
def classes(library: str) -> np.ndarray:
    """Class of every code point as the named library's own regular expressions see it
    (their Unicode versions differ)."""
    everything = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    out = np.zeros(0x110000, np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (SPACE, r"\s")):
        out[code_points(FINDERS[library](pattern, everything))] = kind
    return out


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


def byte_offsets(points: np.ndarray) -> np.ndarray:
    """UTF-8 offset of each code point, and the total length at the end."""
    out = np.zeros(len(points) + 1, np.int64)
    np.cumsum(1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF), out=out[1:])
    return out


def _contractions(points: np.ndarray, head: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Those of the apostrophes ``at`` that start 's 't 'm 'd 're 've 'll, and their lengths."""
    n = len(points)

    def char(k):
        """The character k after the apostrophe, 0 where its text has ended."""
        got = np.zeros(len(at), np.uint32)
        ok = at + k < n
        for j in range(1, k + 1):
            ok[ok] &= ~head[at[ok] + j]
        got[ok] = points[at[ok] + k]
        return got

    one, two = char(1), char(2)
    short = np.isin(one, [ord(c) for c in "stmd"])
    long = ((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) \
        | ((one == ord("l")) & (two == ord("l")))
    size = np.where(short, 2, np.where(long, 3, 0))
    return at[size > 0], size[size > 0]


def _cut_contractions(points, head, start, at):
    """Make each contraction one token: no start inside it, a start right after it."""
    at, size = _contractions(points, head, at)
    start[at] = True
    start[at + 1] = False
    long = at[size == 3]
    start[long + 2] = False
    after = at + size
    start[after[after < len(points)]] = True


def byte_level_starts(points: np.ndarray, head: np.ndarray, table: np.ndarray) -> np.ndarray:
    r"""Token starts (boolean per code point) of the byte-level pattern:
    contractions | " ?letters" | " ?numbers" | " ?others" | white space not before a word | white space.

    ``table``: from ``classes``. ``head``: True at the first code point of each text; tokens never cross texts.
    """
    n = len(points)
    if not n:
        return np.zeros(0, bool)
    kind = table[points]
    space = kind == SPACE
    change = np.empty(n, bool)
    change[0] = True
    change[1:] = kind[1:] != kind[:-1]
    change |= head
    joins = np.zeros(n, bool)  # a word character right after a blank of the same text
    joins[1:] = (points[:-1] == 32) & ~space[1:] & ~head[1:]
    start = change & ~joins
    last = np.zeros(n, bool)  # the last white space before a word stands alone or joins the word
    last[:-1] = space[:-1] & ~space[1:] & ~head[1:]
    start |= last
    _cut_contractions(points, head, start, np.flatnonzero((points == 39) & change & ~joins))
    return start


def word_starts(points: np.ndarray, head: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the word pattern (contractions | letters | one number | others), and which code
    points belong to no token (white space)."""
    n = len(points)
    if not n:
        return np.zeros(0, bool), np.zeros(0, bool)
    kind = table[points]
    change = np.empty(n, bool)
    change[0] = True
    change[1:] = kind[1:] != kind[:-1]
    change |= head
    start = change | (kind == NUMBER)
    _cut_contractions(points, head, start, np.flatnonzero((points == 39) & change))
    return start, kind == SPACE


def concatenated(ids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.fromiter(map(len, ids), np.int64, len(ids))
    return np.fromiter(chain.from_iterable(ids), np.int64, int(lengths.sum())), lengths


class TokenPool:
    """Ids of distinct pre-tokens, kept per worker up to ``limit`` entries; then it starts anew.

    ``encode(list of bytes) -> (ids of all, concatenated; ids of each)`` is only called for
    pre-tokens not yet seen.
    """

    def __init__(self, encode, limit: int = 400_000, dtype=np.uint32):
        self.encode, self.limit, self.dtype = encode, limit, dtype
        self._clear()

    def _clear(self):
        self.index: dict[bytes, int] = {}
        self.flat = np.zeros(0, self.dtype)
        self.offsets = np.zeros(1, np.int64)

    def lookup(self, tokens: list[bytes]) -> np.ndarray:
        """Pool rows of the given distinct pre-tokens."""
        if len(self.index) + len(tokens) > self.limit:
            self._clear()
        index = self.index
        missing = [t for t in tokens if t not in index]
        if missing:
            ids, lengths = self.encode(missing)
            self.flat = np.concatenate([self.flat, np.asarray(ids, self.dtype)])
            self.offsets = np.concatenate([self.offsets, self.offsets[-1] + np.cumsum(lengths)])
            base = len(index)
            index.update(zip(missing, range(base, base + len(missing))))
        return np.fromiter(map(index.__getitem__, tokens), np.int64, len(tokens))


def distinct_ranges(data: np.ndarray, starts: np.ndarray, ends: np.ndarray
                    ) -> tuple[list[bytes], np.ndarray]:
    """Distinct byte strings among the ranges, and for each range the index of its string."""
    from .arrays import RangeHash

    if not len(starts):
        return [], np.zeros(0, np.int64)
    _, first, inverse = np.unique(RangeHash(data)(starts, ends), return_index=True, return_inverse=True)
    raw = data.tobytes()
    return [raw[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist())], inverse.reshape(-1)


class Piece:
    """The pre-tokens of some rows: ``tokens`` (distinct byte strings), ``which`` (for each
    pre-token in text order, the index of its string) and ``row`` (its row).

    ``special`` strings are pre-tokens of their own, and the text on either side of one is
    split as texts of their own, as the tokenizer library does.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, table: np.ndarray, special: list[bytes] = ()):
        lead = (data & 0xC0) != 0x80
        at = np.flatnonzero(lead)  # byte offset of each code point
        points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        head = np.zeros(len(points), bool)
        head[np.searchsorted(at, offsets[:-1][offsets[:-1] < len(data)])] = True
        inner = _special_spans(data, offsets, special)
        for a, b in inner:
            head[np.searchsorted(at, a)] = True
            if b < len(data):
                head[np.searchsorted(at, b)] = True
        start = byte_level_starts(points, head, table)
        for a, b in inner:
            start[np.searchsorted(at, a) + 1:np.searchsorted(at, b)] = False
        starts = at[start]
        ends = np.append(starts[1:], len(data))
        self.tokens, self.which = distinct_ranges(data, starts, ends)
        self.row = np.searchsorted(offsets, starts, "right") - 1
        self.rows = len(offsets) - 1


def _special_spans(data: np.ndarray, offsets: np.ndarray, special: list[bytes]) -> list[tuple[int, int]]:
    """Occurrences of the special strings inside rows, left to right, without overlaps."""
    import re

    if not special:
        return []
    raw, out = data.tobytes(), []
    for m in re.finditer(b"|".join(map(re.escape, sorted(special, key=len, reverse=True))), raw):
        row_end = offsets[np.searchsorted(offsets, m.start(), "right")]
        if m.end() <= row_end:
            out.append(m.span())
    return out


def byte_characters() -> list[str]:
    """The character that byte-level vocabularies write for each byte: printable Latin-1
    characters stand for themselves, the others take the code points from 256 on, in order."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]
