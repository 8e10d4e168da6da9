"""Statistics of one text, each computed at most once and only when asked for."""

from __future__ import annotations

import re
from functools import cached_property

import numpy as np

SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\x0c\r"
_LETTERED = re.compile(rb"[A-Za-z\x80-\xff][^\x20\x09-\x0D]*")
#: Odd multipliers for hashing windows of words (fixed values, any odd numbers do).
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)


def repeated_words(words: list[bytes], width: int = 8) -> int:
    """Words inside a window of ``width`` words that occurs twice or more, first ones included."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    h = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    windows = np.zeros(n, np.uint64)
    for i in range(width):
        windows += h[i : i + n] * _MIX[i % len(_MIX)]
    order = np.argsort(windows, kind="stable")
    same = windows[order[1:]] == windows[order[:-1]]
    if not same.any():
        return 0
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edges = np.zeros(len(words) + 1, np.int64)
    np.add.at(edges, np.flatnonzero(twice), 1)
    np.add.at(edges, np.flatnonzero(twice) + width, -1)
    return int((np.cumsum(edges[:-1]) > 0).sum())


class Text:
    """A text (null: empty) and its statistics."""

    def __init__(self, text: str | None):
        self.text = text or ""

    @cached_property
    def data(self) -> bytes:
        return self.text.encode("utf-8", "surrogatepass")

    @cached_property
    def words(self) -> list[bytes]:
        return self.data.split()

    @cached_property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        return len(self.text) - sum(map(self.text.count, BLANKS))

    @cached_property
    def n_symbols(self) -> int:
        return sum(map(self.text.count, SYMBOLS))

    @cached_property
    def lines(self) -> list[str]:
        """Lines with a word."""
        return [x for x in self.text.split("\n") if x.strip(BLANKS)]

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def n_repeat_words(self) -> int:
        return repeated_words(self.words)

    @cached_property
    def n_stutters(self) -> int:
        """Words equal to the word before."""
        return sum(map(bytes.__eq__, self.words, self.words[1:]))

    @cached_property
    def n_distinct_words(self) -> int:
        return len(set(self.words))

    @cached_property
    def n_shouts(self) -> int:
        return self.text.count("!") + self.text.count("?")

    @cached_property
    def n_capitals(self) -> int:
        """Words of two bytes or more with a capital A-Z and without a small a-z."""
        return sum(w.isupper() and len(w) > 1 for w in self.words)

    @cached_property
    def n_lettered(self) -> int:
        """Words with a letter A-Z, a-z or a character beyond ASCII."""
        return len(_LETTERED.findall(self.data))

    @cached_property
    def n_digits(self) -> int:
        return sum(map(self.text.count, "0123456789"))

    @cached_property
    def n_stops(self) -> int:
        """Lines that end a sentence."""
        return sum(x.rstrip(BLANKS)[-1] in ".!?\"'”»" for x in self.lines)
