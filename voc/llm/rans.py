"""Static range asymmetric numeral system over token ids, in numpy.

One frequency table is shared by all blocks of a file. A block is coded on its own by ``LANES`` interleaved states: token i
belongs to lane i modulo ``LANES``, and one step moves all lanes at once. States are 64 bits wide and give off 32-bit words.
"""

from __future__ import annotations

import numpy as np

BITS = 20              # frequencies sum to 2^BITS
LOW = np.uint64(1 << 31)
LANES = 4_096
BLOCK = 1 << 19        # tokens of a block
_MASK = np.uint64((1 << BITS) - 1)
_SHIFT, _WORD, _LIMIT = np.uint64(BITS), np.uint64(32), np.uint64(63 - BITS)


class Table:
    """Symbols in ascending order with frequencies that sum to 2^BITS, each at least 1."""

    def __init__(self, symbols: np.ndarray, freq: np.ndarray):
        self.symbols, self.freq = symbols.astype("<u4"), freq.astype("<u8")
        self.start = np.concatenate([[0], np.cumsum(self.freq)[:-1]]).astype("<u8") if len(freq) else self.freq
        self._index = self._slots = None

    @classmethod
    def counted(cls, tokens: np.ndarray) -> "Table":
        counts = np.bincount(tokens) if len(tokens) else np.zeros(0, np.int64)
        symbols = np.flatnonzero(counts)
        if len(symbols) > 1 << BITS:
            raise ValueError("more symbols than slots")
        return cls(symbols, scaled(counts[symbols]))

    def index(self) -> np.ndarray:
        if self._index is None:
            self._index = np.zeros(int(self.symbols[-1]) + 1 if len(self.symbols) else 1, np.int64)
            self._index[self.symbols] = np.arange(len(self.symbols))
        return self._index

    def slots(self) -> np.ndarray:
        if self._slots is None:
            self._slots = np.repeat(np.arange(len(self.symbols), dtype=np.int32), self.freq.astype(np.int64))
        return self._slots


def scaled(counts: np.ndarray) -> np.ndarray:
    """Whole frequencies near the counts' shares, at least 1 each, with the sum 2^BITS."""
    if not len(counts):
        return counts
    freq = np.maximum(1, np.floor(counts * ((1 << BITS) / counts.sum()))).astype(np.int64)
    over = int(freq.sum()) - (1 << BITS)
    order = np.argsort(-counts, kind="stable")
    while over > 0:  # the ones that were raised to 1 are paid for by the largest
        give = np.minimum(freq[order] - 1, np.maximum(1, freq[order] * over // (1 << BITS)))
        give = np.minimum(give, np.maximum(0, over - np.cumsum(give) + give))
        freq[order] -= give
        over = int(freq.sum()) - (1 << BITS)
    freq[order[0]] -= over
    return freq


def encode(tokens: np.ndarray, table: Table) -> tuple[np.ndarray, np.ndarray]:
    """(final states, words) of one block."""
    at = table.index()[tokens]
    freq, start, words = table.freq[at], table.start[at], []
    state = np.full(min(LANES, len(tokens)), LOW, np.uint64)
    for low in range((len(tokens) - 1) // LANES * LANES if len(tokens) else -1, -1, -LANES):
        f, c = freq[low : low + LANES], start[low : low + LANES]
        x = state[: len(f)]
        full = x >= f << _LIMIT
        words.append(x[full].astype("<u4"))
        x = np.where(full, x >> _WORD, x)
        q = x // f
        state[: len(f)] = (q << _SHIFT) + (x - q * f) + c
    return state, np.concatenate(words[::-1]) if words else np.zeros(0, "<u4")


def decode(n: int, state: np.ndarray, words: np.ndarray, table: Table) -> np.ndarray:
    """The ``n`` tokens of one block."""
    slots, freq, start = table.slots(), table.freq, table.start
    state, words, at, out = state.astype(np.uint64), words.astype(np.uint64), 0, np.empty(n, np.int32)
    for low in range(0, n, LANES):
        x = state[: min(LANES, n - low)]
        slot = x & _MASK
        symbol = slots[slot]
        out[low : low + LANES] = symbol
        x = freq[symbol] * (x >> _SHIFT) + slot - start[symbol]
        empty = np.flatnonzero(x < LOW)
        x[empty] = (x[empty] << _WORD) | words[at : at + len(empty)]
        at += len(empty)
        state[: len(x)] = x
    if at != len(words) or (state != LOW).any():
        raise ValueError("damaged block")
    return table.symbols[out]
