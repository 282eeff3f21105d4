"""Recompression of word sequences: the part that works on arrays, of many texts at once.

A level names runs of one symbol, or pairs of a left and a right symbol, by hashes of what they hold, so that a name is
the same in every task and needs no table. Which symbols pair depends on the two symbols alone, so that of equal
substrings all but the outermost symbols are equal on every level. What a window surely holds of a level, whatever
stands around it, is its interior: at a run level all but its first and last run, at a pair level all but a first right
and a last left symbol."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import xxhash

SEED = 42
#: Run levels; the rest are pair levels. Symbols of more words than LONG pair no more.
LEVELS, RUNS, LONG = 10, (0,), 8
_K = np.random.default_rng(SEED).integers(0, 2**64, 8, np.uint64) | np.uint64(1)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ x >> np.uint64(32)
    x *= _K[0]
    x ^= x >> np.uint64(29)
    return x


def _pair(a: np.ndarray, b: np.ndarray, kind: int) -> np.ndarray:
    return _mixed(_mixed(a * _K[1] + np.uint64(kind)) + b * _K[2])


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").split()  # splits at \x20 and \x09-\x0D


def word_names(words: list[bytes]) -> np.ndarray:
    """Two lanes of 64 bits for each word."""
    return np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, words)), np.uint64).reshape(-1, 2).T


def _starts(joined: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the symbol of the next level that each symbol goes into, the first symbol of each of those); joined: with the next."""
    first = np.ones(len(joined), bool)
    first[1:] = ~joined[:-1]
    return np.cumsum(first) - 1, np.flatnonzero(first)


def anchors(names: np.ndarray, text: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, at, symbol) of every window: an interior symbol of the highest level that has any, and the word where that
    begins. names: of the words of some texts; text: to which one a word belongs. Equal windows have equal symbols at
    equal places."""
    start = np.flatnonzero(text[: max(0, len(names) - window + 1)] == text[window - 1 :])
    low, high, left = start, start + window - 1, np.arange(len(start))
    at, symbol = start.copy(), names[start]
    s, size, begin = names, np.ones(len(names), np.int32), np.arange(len(names))
    for level in range(LEVELS):
        together = np.zeros(len(s), bool)
        together[:-1] = text[:-1] == text[1:]
        if level in RUNS:
            together[:-1] &= s[:-1] == s[1:]
            into, first = _starts(together)
            low, high = into[low] + 1, into[high] - 1
            k = np.diff(first, append=len(s))
            many = k > 1
            made = s[first]
            made[many] = _pair(made[many], k[many].astype(np.uint64), 1)
            size = size[first] * k
        else:
            is_left = (s * _K[3 + level % 5]) >> np.uint64(63 - level // 5 % 2) & np.uint64(1) == 0
            short = size <= LONG
            is_right, is_left = short & ~is_left, short & is_left
            together[:-1] &= is_left[:-1] & is_right[1:]
            into, first = _starts(together)
            low, high = low + is_right[low], high - is_left[high]
            keep = low <= high
            left, low, high = left[keep], into[low[keep]], into[high[keep]]
            pairs = together[first]
            made, size = s[first], size[first] + np.where(pairs, size[np.minimum(first + 1, len(s) - 1)], 0)
            made[pairs] = _pair(made[pairs], s[first[pairs] + 1], 2)
        keep = low <= high
        left, low, high = left[keep], low[keep], high[keep]
        if not len(left):
            break
        s, begin, text = made, begin[first], text[first]
        at[left], symbol[left] = begin[low], s[low]
    return start, at, symbol


def occurrences(at: np.ndarray, symbol: np.ndarray) -> np.ndarray:
    """For windows in order: where runs of windows with one anchor begin."""
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1]) | (symbol[1:] != symbol[:-1])
    return np.flatnonzero(new)


def window_names(lanes: np.ndarray, window: int) -> np.ndarray:
    """Two lanes of 64 bits for the window that starts at each word (those that don't fit are missing): a tree of pairs."""
    out, taken, part = None, 0, lanes
    for bit in range(window.bit_length()):
        if window >> bit & 1:
            out = part[:, : lanes.shape[1] - window + 1] if out is None else _pair(out, part[:, taken : taken + lanes.shape[1] - window + 1], 3)
            taken += 1 << bit
        if taken < window:
            part = _pair(part[:, : -(1 << bit)], part[:, 1 << bit :], 4)
    return out


def chunks(rows: list, words: int) -> Iterator[list]:
    """Rows (their words first) in turns of about so many words; a long text is a turn of its own."""
    turn, n = [], 0
    for row in rows:
        if turn and n + len(row[0]) > words:
            yield turn
            turn, n = [], 0
        turn.append(row)
        n += len(row[0])
    if turn:
        yield turn
