"""A compressed FM-index over sequences of whole numbers: Burrows-Wheeler transform in a wavelet matrix, batched backward search."""

from __future__ import annotations

import numpy as np


def suffix_array(s: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes of s in order, by prefix doubling; ends early where all differ. Suffixes must differ within ``depth``."""
    n = len(s)
    _, rank = np.unique(s, return_inverse=True)
    rank = rank.astype(np.int64)
    order = np.argsort(rank, kind="stable")
    width = 1
    while True:
        key = np.zeros(n, np.int64)
        key[: n - width] = rank[width:] + 1
        key += rank * (n + 1)
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        new = np.cumsum(np.r_[False, ordered[1:] != ordered[:-1]])
        rank[order] = new
        width *= 2
        if new[-1] == n - 1 or width >= 2 * depth or width >= n:
            return order


class BitRank:
    """Bits with a count at every 64th: how many ones come before a place, for many places at once."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros(-(-(len(bits) + 1) // 64) * 64, np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view("<u8")
        ones = np.bitwise_count(self.words)
        self.before = (np.cumsum(ones, dtype=np.int64) - ones).astype(np.int32)

    def ones(self, place: np.ndarray) -> np.ndarray:
        word, bit = place >> 6, (place & 63).astype(np.uint64)
        return self.before[word] + np.bitwise_count(self.words[word] & ((np.uint64(1) << bit) - np.uint64(1)))


class FMIndex:
    """Counts how often a sequence occurs in a collection of sequences, extending it to the left symbol by symbol.

    Symbols are 1 and up; each sequence ends with a 0, which is never searched for. ``longest``: symbols of the longest.
    """

    def __init__(self, sequences: list[np.ndarray], longest: int):
        zero = np.zeros(1, np.int64)
        text = np.concatenate([p for s in sequences for p in (s, zero)]) if sequences else zero
        ends = text == 0
        # For sorting only, every end is a symbol of its own: suffixes then differ within longest + 1 symbols.
        distinct = np.where(ends, np.cumsum(ends) - 1, text + ends.sum())
        order = suffix_array(distinct, longest + 2)
        bwt = text[order - 1]
        self.n = len(text)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text))]).astype(np.int64)
        self.levels = max(1, int(text.max()).bit_length())
        self.bits: list[BitRank] = []
        self.zeros: list[int] = []
        at = bwt
        for level in range(self.levels - 1, -1, -1):
            bit = ((at >> level) & 1).astype(np.uint8)
            self.bits.append(BitRank(bit))
            self.zeros.append(int(len(bit) - bit.sum()))
            at = np.concatenate([at[bit == 0], at[bit == 1]])
        symbols = np.arange(len(self.first) - 1)
        self.start = self._walk(symbols, np.zeros(len(symbols), np.int64))

    def _walk(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        for k, level in enumerate(range(self.levels - 1, -1, -1)):
            ones = self.bits[k].ones(place)
            place = np.where((symbol >> level) & 1 == 1, self.zeros[k] + ones, place - ones)
        return place

    def rank(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        """How often each symbol occurs in the transform before each place."""
        return self._walk(symbol, place) - self.start[symbol]

    def extend(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows of (symbol + sequence) from those, low to high - 1, of each sequence."""
        both = self._walk(np.concatenate([symbol, symbol]), np.concatenate([low, high])) - np.tile(self.start[symbol], 2)
        base = self.first[symbol]
        return base + both[: len(low)], base + both[len(low) :]


def repeated_span(index: FMIndex, sequences: list[np.ndarray], window: int, least: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """For each sequence (of fewer than 2 * window symbols): from the first to the last window that occurs ``least`` times.

    Returns begin and end (of the last such window); both 0 where there is none. The windows' matching statistics are
    taken by backward search, all sequences abreast. The first window is sought from the left: where a window's suffix
    from q on is too rare, so is every window that contains it, and the next one tried starts at q + 1. The last one is
    sought from the right. As a sequence is short, all windows between overlap or touch both.
    """
    lanes = len(sequences)
    begin, end = np.zeros(lanes, np.int64), np.zeros(lanes, np.int64)
    if not lanes:
        return begin, end
    size = np.array([len(s) for s in sequences])
    base = np.cumsum(size) - size
    symbols = np.concatenate(sequences)
    lane = np.flatnonzero(size >= window)
    first = np.full(lanes, -1, np.int64)  # the first repeated window, once found
    start = np.zeros(lanes, np.int64)
    place = start + window - 1
    low, high = np.zeros(lanes, np.int64), np.full(lanes, index.n, np.int64)
    while len(lane):
        new_low, new_high = index.extend(symbols[base[lane] + place[lane]], low[lane], high[lane])
        fails = new_high - new_low < least
        hit = ~fails & (place[lane] == start[lane])
        go_on = lane[~fails & ~hit]
        low[go_on], high[go_on] = new_low[~fails & ~hit], new_high[~fails & ~hit]
        place[go_on] -= 1
        finding = first[lane] < 0
        # Still looking for the first window: go behind the symbol that made it too rare.
        moved = lane[fails & finding]
        start[moved] = place[moved] + 1
        done = [moved[start[moved] + window > size[moved]]]
        # Found the first: look for the last, from the right.
        found = lane[hit & finding]
        first[found] = begin[found] = start[found]
        end[found] = start[found] + window
        start[found] = size[found] - window
        done.append(found[start[found] <= first[found]])
        # Looking for the last: one to the left, or there it is.
        back = lane[fails & ~finding]
        start[back] -= 1
        done.append(back[start[back] <= first[back]])
        last = lane[hit & ~finding]
        end[last] = start[last] + window
        done.append(last)
        anew = np.concatenate([moved, found, back])
        place[anew] = start[anew] + window - 1
        low[anew], high[anew] = 0, index.n
        over = np.zeros(lanes, bool)
        over[np.concatenate(done)] = True
        lane = lane[~over[lane]]
    return begin, end
