"""Suffix arrays by mergesort with hash-compared suffixes.

Two suffixes are compared in logarithmic time: binary search over prefix polynomial hashes finds how
far they agree, and the next symbols decide. The sort merges runs of doubling size, all pairs of runs
of all groups at once, each element finding its place in the other run by binary search. Suffixes of
bytes are first merged by their first bytes, eight at a time as one number, a comparison that costs one step whatever
the size of a group; only those that agree in all of these and go on are compared by hashes. Agreements of
neighbours are verified on the symbols afterwards, so a collision of hashes can't make texts equal.
"""

from __future__ import annotations

import numpy as np

from ledgerloom.llm.anchors import Block, PrefixHashes

PASS_WINDOWS = 400_000
VERIFY = 1 << 22
WORD = 8                # bytes compared as one number
HEAD = 7 * WORD         # bytes of a suffix compared so


class Suffixes:
    """Suffixes of symbols, each cut at its limit."""

    def __init__(self, symbols: np.ndarray):
        self.symbols = symbols
        self.words = self._words(symbols) if symbols.itemsize == 1 else None
        self.hashes = PrefixHashes(symbols.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))

    @staticmethod
    def _words(symbols: np.ndarray) -> np.ndarray:
        """At each place the next bytes as a number, zeros after the end; a view of the symbols."""
        padded = np.concatenate([symbols, np.zeros(HEAD + WORD, np.uint8)])
        return np.ndarray(len(symbols) + HEAD, ">u8", padded, strides=(1,))

    def agree(self, a: np.ndarray, b: np.ndarray, limit: np.ndarray) -> np.ndarray:
        """How many symbols the suffixes at a and b have in common, at most limit."""
        low, high = np.zeros(len(a), np.int64), limit.copy()
        for _ in range(int(limit.max(initial=0)).bit_length()):
            middle = (low + high + 1) >> 1
            same = self.hashes.of(a, a + middle) == self.hashes.of(b, b + middle)
            low, high = np.where(same, middle, low), np.where(same, high, middle - 1)
        return low

    def less(self, a, a_size, b, b_size) -> np.ndarray:
        shorter = np.minimum(a_size, b_size)
        n = self.agree(a, b, shorter)
        inside = n < shorter
        at = np.minimum(n, np.maximum(shorter - 1, 0))
        return np.where(inside, self.symbols[a + at] < self.symbols[b + at], a_size < b_size)

    def verified(self, a: np.ndarray, b: np.ndarray, n: np.ndarray) -> np.ndarray:
        """n, or fewer where the symbols themselves differ."""
        out = n.copy()
        step = max(1, VERIFY // max(1, int(n.max(initial=1))))
        for at in range(0, len(a), step):
            part = slice(at, at + step)
            size = n[part]
            owner = np.repeat(np.arange(len(size)), size)
            place = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
            wrong = self.symbols[a[part][owner] + place] != self.symbols[b[part][owner] + place]
            np.minimum.at(out[part], owner[wrong], place[wrong])
        return out

    def sort(self, group: np.ndarray, place: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Order of suffixes within groups; group ascends."""
        if self.words is None:
            return self._merged(group, place, size)
        order, tied, rank = self._by_heads(group, place, size)
        if len(tied):
            rest = order[tied]
            order[tied] = rest[self._merged(rank, place[rest], size[rest])]
        return order

    def _by_heads(self, group: np.ndarray, place: np.ndarray, size: np.ndarray
                  ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Order by the first HEAD bytes, places in it that these don't decide, and their ranks."""
        order, rank = np.arange(len(group)), np.searchsorted(group, group)
        todo, head = order.copy(), np.minimum(size, HEAD)
        for at in [*range(0, int(head.max(initial=0)), WORD), HEAD]:
            one = order[todo]
            if at < HEAD:
                cut = (8 * (WORD - np.clip(head[one] - at, 0, WORD))).astype(np.uint64)
                word = self.words[place[one] + np.minimum(at, head[one])].astype(np.uint64)
                # 64 bits are cut in two steps, as a shift takes 63 at most
                half = cut >> np.uint64(1)
                word = ((word >> half >> (cut - half)) << half) << (cut - half)
            else:
                word = head[one]       # the bytes agree: what ends first, comes first
            by = np.lexsort((word, rank[todo]))
            order[todo], word, own = one[by], word[by], rank[todo][by]
            new = np.ones(len(todo), bool)
            new[1:] = (own[1:] != own[:-1]) | (word[1:] != word[:-1])
            first = np.flatnonzero(new)
            count = np.diff(np.append(first, len(todo)))
            rank[todo] = np.repeat(todo[first], count)
            todo = todo[np.repeat(count > 1, count)]
        todo = todo[head[order[todo]] == HEAD]
        return order, todo, rank[todo]

    def _merged(self, group: np.ndarray, place: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Order by merging runs of doubling size."""
        order = np.arange(len(group))
        begin = np.searchsorted(group, group)        # first of the own group
        end = np.searchsorted(group, group, side="right")
        inner = order - begin
        longest = int((end - begin).max(initial=1))
        width = 1
        while width < longest:
            run = inner // width
            left = (run & 1) == 0
            mine = begin + run * width
            other = np.where(left, np.minimum(mine + width, end), mine - width)
            low, high = other.copy(), np.minimum(other + width, end)
            high = np.where(left, high, mine)
            p, n = place[order], size[order]
            todo = np.flatnonzero(low < high)
            while len(todo):
                middle = (low[todo] + high[todo]) >> 1
                # of equal ones those of the left run come first
                l = left[todo]
                x, y = np.where(l, middle, todo), np.where(l, todo, middle)
                below = self.less(p[x], n[x], p[y], n[y])
                before = np.where(l, below, ~below)
                low[todo] = np.where(before, middle + 1, low[todo])
                high[todo] = np.where(before, high[todo], middle)
                todo = todo[low[todo] < high[todo]]
            target = np.minimum(mine, other) + (np.arange(len(order)) - mine) + (low - other)
            target = np.where(left, mine + (np.arange(len(order)) - mine) + (low - other), target)
            merged = np.empty_like(order)
            merged[target] = order
            order = merged
            width *= 2
        return order


def block_windows(block: Block, window: int):
    """Windows of a block in passes: segment, start in the segment, number in the block. Those that may
    be equal, of one group and distance to the anchor, stay together.

    A group too large for a pass is taken a few distances at a time, so that a passage in very many
    contexts needs no more memory than its segments do.
    """
    count = block.size - window + 1
    ends = np.cumsum(count)
    begin = ends - count
    at, n = 0, len(count)
    while at < n:
        stop = int(np.searchsorted(ends, begin[at] + PASS_WINDOWS, side="right"))
        if stop < n:
            stop = int(np.searchsorted(block.group, block.group[stop]))
        large = stop <= at
        if large:
            stop = int(np.searchsorted(block.group, block.group[at], side="right"))
        part = np.arange(at, stop)
        near = block.anchor[part] - (count[part] - 1)      # distance of the last window
        lowest, highest = int(near.min()), int(block.anchor[part].max())
        step = max(1, PASS_WINDOWS // len(part)) if large else highest - lowest + 1
        for low in range(lowest, highest + 1, step):
            first = np.maximum(block.anchor[part] - (low + step - 1), 0)
            size = np.maximum(np.minimum(block.anchor[part] - low, count[part] - 1) - first + 1, 0)
            segment = np.repeat(part, size)
            start = np.arange(len(segment)) + np.repeat(first - (np.cumsum(size) - size), size)
            if len(segment):
                yield segment, start, begin[segment] + start
        at = stop


def aligned_order(suffixes: Suffixes, block: Block, segment: np.ndarray, start: np.ndarray,
                  limit: int | None):
    """Windows sorted by group, distance to the anchor, and suffix; and how far neighbours agree.

    Windows that are equal have one distance to their anchor. Returns the order and, per place in it,
    the agreement with the one before (0 for the first of a group and distance).
    """
    distance = block.anchor[segment] - start
    by = np.lexsort((distance, block.group[segment]))
    key = block.group[segment[by]] * (1 << 20) + distance[by]
    place = (block.begin[segment] + start)[by]
    rest = (block.size[segment] - start)[by]
    size = np.minimum(rest, limit) if limit else rest
    order = suffixes.sort(key, place, size)
    a, b = place[order][:-1], place[order][1:]
    n = np.minimum(size[order][:-1], size[order][1:]) * (key[order][:-1] == key[order][1:])
    agree = np.zeros(len(order), np.int64)
    agree[1:] = suffixes.verified(a, b, suffixes.agree(a, b, n)) if len(order) > 1 else 0
    return by[order], agree
