"""A compressed full-text index over a shard of texts, and matching statistics against it.

The suffixes of all texts of a shard, each ended by a mark, are sorted to a depth above the longest match
that is asked for; the last-column text is kept as a Huffman-shaped wavelet tree, whose bit vectors take
about n H0 bits (the characters' entropy) and whose rank counts take 28 % more. Backward search prepends
a character to the match of a whole row of streamed texts at once. Where a match can't be prolonged, it is
shortened to its parent interval, found by range minima of the neighbours' common prefixes.
"""

from __future__ import annotations

import heapq

import numpy as np


class BitRank:
    """A bit vector with constant-time counts of the ones before a position: 32 bits for every 16 words, 16 for each."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros((len(bits) // 1024 + 1) * 1024, np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)])[:-1]
        self.major = before[::16].astype(np.uint32)
        self.minor = (before - np.repeat(before[::16], 16)).astype(np.uint16)

    def rank1(self, at: np.ndarray) -> np.ndarray:
        w = at >> 6
        low = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.major[w >> 4].astype(np.int64) + self.minor[w] + np.bitwise_count(self.words[w] & low)


def _code_words(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Length and bits of the Huffman code word of each symbol that occurs; at least one bit."""
    length = np.zeros(len(counts), np.int64)
    heap = [(int(c), i, [i]) for i, c in enumerate(counts) if c]
    if len(heap) == 1:
        length[heap[0][1]] = 1
    heapq.heapify(heap)
    while len(heap) > 1:
        (a, i, x), (b, _, y) = heapq.heappop(heap), heapq.heappop(heap)
        length[x] += 1
        length[y] += 1
        heapq.heappush(heap, (a + b, i, x + y))
    word, last, bits = np.zeros(len(counts), np.int64), 0, 0
    for i in sorted(np.flatnonzero(length).tolist(), key=lambda i: (length[i], i)):
        bits <<= int(length[i]) - last
        word[i], last = bits, int(length[i])
        bits += 1
    return length, word


class WaveletTree:
    """Counts of any symbol before any position, by one rank for each bit of its Huffman code word. Each level holds
    the symbols that have a bit there, zeros of the level above before its ones; so a node's symbols lie together."""

    def __init__(self, codes: np.ndarray, sigma: int):
        self.length, word = _code_words(np.bincount(codes, minlength=sigma))
        counts, self.rows = np.bincount(codes, minlength=sigma), []
        reverse = np.zeros(sigma, np.int64)  # the bits above this level, last one first: the order of the nodes
        for d in range(int(self.length.max(initial=0))):
            has = self.length > d
            bit = has & (word >> np.maximum(self.length - 1 - d, 0) & 1).astype(bool)
            nodes, of = np.unique(reverse[has], return_inverse=True)
            size = np.bincount(of, counts[has], len(nodes)).astype(np.int64)
            start = np.zeros(sigma, np.int64)
            start[has] = (np.cumsum(size) - size)[of]
            ones = bit[codes]
            row = BitRank(ones)
            self.rows.append((row, bit, start, np.where(has, row.rank1(start), 0)))
            more = self.length[codes] > d + 1
            codes = np.concatenate([codes[~ones & more], codes[ones & more]])
            reverse |= bit.astype(np.int64) << d

    def rank(self, code: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often ``code`` occurs before ``at``; 0 for a symbol that doesn't occur."""
        out = np.where(self.length[code] > 0, at, 0)
        lanes = np.flatnonzero(self.length[code] > 0)
        for d, (row, bit, start, base) in enumerate(self.rows):
            lanes = lanes[self.length[code[lanes]] > d] if d else lanes
            if not len(lanes):
                break
            c, a = code[lanes], out[lanes]
            ones = row.rank1(start[c] + a) - base[c]
            out[lanes] = np.where(bit[c], ones, a - ones)
        return out


def _dense_rank(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys)
    k = keys[order]
    rank = np.empty(len(keys), np.int64)
    rank[order] = np.concatenate([[0], np.cumsum(k[1:] != k[:-1])]) + 1
    return order, rank


class FMIndex:
    """Index of ``texts``; ``owners`` has the number of the document that each belongs to. ``cap`` is the
    length up to which matches are followed, and at which they are reported."""

    def __init__(self, texts: list[str], owners: np.ndarray, cap: int):
        if cap <= 0:
            raise ValueError("the cap must be above 0")
        self.cap, depth = cap, max(8, 1 << cap.bit_length())
        points = [np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32) for t in texts]
        ends = np.cumsum([len(p) + 1 for p in points])
        self.n = n = int(ends[-1]) if len(points) else 0
        flat = np.zeros(n, np.uint32)
        inside = np.ones(n, bool)
        inside[ends - 1] = False
        flat[inside] = np.concatenate(points) if points else flat[:0]
        used = np.zeros(0x110000, bool)
        used[flat[inside]] = True
        self.code_of = np.where(used, np.cumsum(used), 0).astype(np.int32)  # 0: a character that the shard lacks
        codes = np.zeros(n + depth + 4, np.int64)
        codes[:n][inside] = self.code_of[flat[inside]]
        sigma = int(used.sum()) + 1
        # Ranks of all substrings of 4, 8, ..., depth characters, each from two of half the length.
        key = codes[: n + depth]
        for shift in (1, 2, 3):
            key = key * sigma + codes[shift : n + depth + shift]
        order, rank = _dense_rank(key[:n])
        ranks, h = {}, 4
        while True:
            ranks[h] = np.concatenate([rank, np.zeros(depth, np.int64)]).astype(np.int32)
            if h >= depth:
                break
            order, rank = _dense_rank(rank * (n + 2) + ranks[h][h : h + n])
            h *= 2
        self.lcp = self._common(order, ranks, codes, depth)
        self.wavelet = WaveletTree(np.where(order > 0, codes[order - 1], 0), sigma)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(codes[:n], minlength=sigma))]).astype(np.int64)
        self.minima = [self.lcp]
        while (w := 1 << len(self.minima)) <= n:
            last = self.minima[-1]
            row = last.copy()
            row[: len(last) - w // 2] = np.minimum(last[: len(last) - w // 2], last[w // 2 :])
            self.minima.append(row)
        self._classes(order, np.repeat(np.asarray(owners, np.int64), [len(p) + 1 for p in points]))

    @staticmethod
    def _common(order: np.ndarray, ranks: dict[int, np.ndarray], codes: np.ndarray, depth: int) -> np.ndarray:
        """Common prefix of each suffix with the one before it, at most depth - 1; 0 before the first and after the last."""
        a, b = order[:-1], order[1:]
        length = np.zeros(len(a), np.int64)
        for h in sorted(ranks, reverse=True):
            if h < depth:
                length += h * (ranks[h][a + length] == ranks[h][b + length])
        for _ in range(3):
            length += codes[a + length] == codes[b + length]
        # A mismatch stays one, so each of the three steps adds at most what is really common.
        return np.concatenate([[0], np.minimum(length, depth - 1), [0]]).astype(np.uint8 if depth <= 256 else np.uint32)

    def _classes(self, order: np.ndarray, owner: np.ndarray) -> None:
        """Rows that agree in ``cap`` characters form a class; for each, its owners and a signature of that set."""
        self.class_of = np.cumsum(self.lcp[:-1] < self.cap, dtype=np.int32) - 1
        starts = np.flatnonzero(self.lcp[:-1] < self.cap)
        self.class_lo, self.class_hi = starts, np.append(starts[1:], self.n)
        docs, idx = np.unique(owner, return_inverse=True)
        pairs = np.unique(self.class_of.astype(np.int64) * len(docs) + idx[order]) if self.n else np.zeros(0, np.int64)
        cls = pairs // max(1, len(docs))
        self.owners = docs[pairs % max(1, len(docs))] if len(docs) else docs
        self.owner_lo = np.flatnonzero(np.concatenate([[True], cls[1:] != cls[:-1]])) if len(cls) else cls
        self.owner_hi = np.append(self.owner_lo[1:], len(cls)) if len(cls) else cls
        mixed = (self.owners.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
        mixed = (mixed ^ mixed >> np.uint64(29)) * np.uint64(0x94D049BB133111EB)
        self.signature = np.add.reduceat(mixed, self.owner_lo) if len(cls) else mixed

    def _extend(self, code: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        both = self.wavelet.rank(np.concatenate([code, code]), np.concatenate([lo, hi]))
        return both[: len(lo)] + self.first[code], both[len(lo) :] + self.first[code]

    def _parent(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The smallest interval that holds [lo, hi) and more, and the length that its rows have in common."""
        k = np.maximum(self.lcp[lo], self.lcp[hi])
        lo, hi = lo.copy(), hi.copy()
        for level in range(len(self.minima) - 1, -1, -1):
            w, row = 1 << level, self.minima[level]
            at = lo - w + 1
            go = (at > 0) & (row[np.maximum(at, 0)] >= k)
            lo[go] -= w
            go = (hi + w <= self.n) & (row[np.minimum(hi, self.n)] >= k)
            hi[go] += w
        lo[k == 0], hi[k == 0] = 0, self.n
        return lo, hi, k.astype(np.int64)

    def matches(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Every place where a streamed text agrees with the shard in ``cap`` characters: number of the
        text, position, and class of rows. The longest match at each position is followed from the right
        end of all texts at once; one that is longer than ``cap`` is cut to ``cap``."""
        points = [self.code_of[np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32)] for t in texts]
        lens = np.array([len(p) for p in points], np.int64)
        flat = np.concatenate(points) if points else np.zeros(0, np.int64)
        off = np.concatenate([[0], np.cumsum(lens)])
        lane = np.argsort(-lens, kind="stable")
        lane = lane[lens[lane] >= self.cap]
        at = lens[lane] - 1  # the character to prepend
        lo, hi, length = np.zeros(len(lane), np.int64), np.full(len(lane), self.n), np.zeros(len(lane), np.int64)
        found = []
        while len(lane):
            code = flat[off[lane] + at]
            a, b = self._extend(code, lo, hi)
            known = code > 0
            good = known & (a < b)
            skip = ~good & ((length == 0) | ~known)  # no match at all: go on to the left with the empty match
            lo, hi = np.where(good, a, lo), np.where(good, b, hi)
            length = length + good
            if skip.any():
                lo[skip], hi[skip], length[skip] = 0, self.n, 0
            full = np.flatnonzero(good & (length >= self.cap))
            if len(full):
                c = self.class_of[lo[full]]
                lo[full], hi[full], length[full] = self.class_lo[c], self.class_hi[c], self.cap
                found.append((lane[full], at[full], c))
            bad = np.flatnonzero(~good & ~skip)
            if len(bad):
                lo[bad], hi[bad], length[bad] = self._parent(lo[bad], hi[bad])
            at = at - (good | skip)
            # A match can still reach the cap only if enough characters are left.
            going = at + 1 + length >= self.cap
            going &= at >= 0
            if not going.all():
                lane, at, lo, hi, length = lane[going], at[going], lo[going], hi[going], length[going]
        if not found:
            none = np.zeros(0, np.int64)
            return none, none, none
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))
