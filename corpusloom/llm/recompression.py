"""Recompression: a run-length grammar of word sequences, and exact extensions by it.

Block compression replaces every maximal run ``a..a`` by one symbol, pair compression
every ``ab`` with ``a`` on the left and ``b`` on the right side of a partition of the
symbols. Both look at neighbours only, so equal stretches are parsed equally but for one
symbol at either end. The longest common extension of two places is found by climbing
while both stand at the start of a symbol (stepping over at most one symbol or block per
level where not), and by descending from the level where the symbols differ. All
questions of a batch climb together, one level at a time.
"""

from __future__ import annotations

import numpy as np

_ODD = np.uint64(0x9E3779B97F4A7C15)


def _left_side(symbols: np.ndarray, level: int) -> np.ndarray:
    """A pseudo-random half of the symbols, another one on every level."""
    mixed = (symbols.view(np.uint64) + np.uint64(level + 1)) * _ODD
    return ((mixed ^ (mixed >> np.uint64(29))) * _ODD >> np.uint64(63)).astype(bool)


def _named(left: np.ndarray, right: np.ndarray, fresh: int) -> tuple[np.ndarray, int]:
    """New symbols from ``fresh`` on, one per distinct pair of values."""
    keys, names = np.unique(left * np.int64(fresh + len(left) + 1) + right, return_inverse=True)
    return names.reshape(-1) + fresh, fresh + len(keys)


class Level:
    """Symbols, and where each begins in the level below (with the end as last entry)."""

    def __init__(self, symbols: np.ndarray, first: np.ndarray | None, blocks: bool) -> None:
        self.symbols, self.first, self.blocks = symbols, first, blocks
        if first is not None:
            counts = np.diff(first)
            below = int(first[-1])
            self.up = np.full(below, -1, np.int64)
            self.up[first[:-1]] = np.arange(len(symbols))
            self.rest = np.repeat(first[1:], counts) - np.arange(below)
            self.counts = counts

    def mirrored(self) -> Level:
        if self.first is None:
            return Level(self.symbols[::-1], None, self.blocks)
        return Level(self.symbols[::-1], (self.first[-1] - self.first)[::-1], self.blocks)


class Grammar:
    """Of one sequence of numbers; negative ones are marks that never join others.

    The sequence begins and ends with a mark, and no mark occurs twice.
    """

    def __init__(self, levels: list[Level]) -> None:
        self.levels = levels

    @classmethod
    def of(cls, sequence: np.ndarray) -> Grammar:
        levels = [Level(sequence.astype(np.int64), None, False)]
        fresh = int(sequence.max(initial=0)) + 1
        while True:
            s = levels[-1].symbols
            first = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1])))
            sizes = np.diff(np.append(first, len(s)))
            if len(first) < len(s):
                names = s[first].copy()
                many = np.flatnonzero(sizes > 1)
                names[many], fresh = _named(names[many], sizes[many], max(fresh, len(s) + 1))
                levels.append(Level(names, np.append(first, len(s)), True))
                s = names
            free = s >= 0
            beside = free[:-1] & free[1:]
            if not beside.any():
                return cls(levels)
            side = _left_side(s, len(levels))
            pairs = [np.flatnonzero(beside & a & b) for a, b in ((side[:-1], ~side[1:]), (~side[:-1], side[1:]))]
            at = max(pairs, key=len)
            if not len(at):
                # The partition split no pair: part the symbols at one of the pairs' own.
                i = int(np.flatnonzero(beside)[0])
                at = np.flatnonzero(beside & (s[:-1] == s[i]) & (s[1:] != s[i]))
            names, keep = s.copy(), np.ones(len(s), bool)
            names[at], fresh = _named(s[at], s[at + 1], fresh)
            keep[at + 1] = False
            first = np.flatnonzero(keep)
            levels.append(Level(names[first], np.append(first, len(s)), False))

    def mirrored(self) -> Grammar:
        return Grammar([level.mirrored() for level in self.levels])

    def common(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """How many numbers from place x on equal those from place y on; x < y or x > y."""
        begin, x, y = x, x.copy(), y.copy()
        top = len(self.levels) - 1
        stopped = np.full(len(x), top)
        going = np.arange(len(x))
        for l in range(top):
            symbols, above = self.levels[l].symbols, self.levels[l + 1]
            px, py = x[going], y[going]
            off = (above.up[px] < 0) | (above.up[py] < 0)
            step = np.where(off, np.minimum(above.rest[px], above.rest[py]), 0)
            differ = off & (symbols[px] != symbols[py])
            step[differ] = 0
            # Blocks of different length: behind the shorter one the symbols differ.
            ends = differ | (off & (above.rest[px] != above.rest[py]))
            px, py = px + step, py + step
            x[going], y[going] = px, py
            stopped[going[ends]] = l
            going, px, py = going[~ends], px[~ends], py[~ends]
            x[going], y[going] = above.up[px], above.up[py]
        symbols = self.levels[top].symbols
        while len(going := going[symbols[x[going]] == symbols[y[going]]]):
            x[going] += 1
            y[going] += 1
        for l in range(top, 0, -1):
            level, below = self.levels[l], self.levels[l - 1].symbols
            at = np.flatnonzero(stopped >= l)
            px, py = x[at], y[at]
            step = np.minimum(level.counts[px], level.counts[py]) if level.blocks else 1
            px, py = level.first[px], level.first[py]
            step = np.where(below[px] == below[py], step, 0)
            x[at], y[at] = px + step, py + step
        return x - begin
