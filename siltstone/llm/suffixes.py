"""Suffix arrays by external induced sorting: bucket queues on disk carry suffixes and their common-prefix values."""

from __future__ import annotations

import tempfile

import numpy as np


class BucketQueue:
    """A monotone priority queue: a first-in-first-out run for each first symbol, popped in symbol order.

    Suffixes are induced in their final order, so the order of insertion is the priority within a symbol. Pushed
    blocks of (position, common prefix with the suffix pushed before) stay in memory up to ``limit`` bytes; then all
    go to an unlinked temporary file, from which a symbol's blocks are read back when it is its turn.
    """

    def __init__(self, symbols: int, limit: int):
        self.blocks: list[list] = [[] for _ in range(symbols)]
        self.limit, self.held, self.file = limit, 0, None

    def push(self, symbol: int, pos: np.ndarray, lcp: np.ndarray) -> None:
        self.blocks[symbol].append((pos, lcp))
        self.held += pos.nbytes + lcp.nbytes
        if self.held > self.limit:
            self._spill()

    def _spill(self) -> None:
        if self.file is None:
            self.file = tempfile.TemporaryFile()
        self.file.seek(0, 2)
        for run in self.blocks:
            for i, block in enumerate(run):
                if isinstance(block[0], np.ndarray):
                    at = self.file.tell()
                    block[0].tofile(self.file)
                    block[1].tofile(self.file)
                    run[i] = (at, len(block[0]))
        self.held = 0

    def pop(self, symbol: int) -> tuple[np.ndarray, np.ndarray] | None:
        run, self.blocks[symbol] = self.blocks[symbol], []
        if not run:
            return None
        out = []
        for block in run:
            if isinstance(block[0], np.ndarray):
                self.held -= block[0].nbytes + block[1].nbytes
            else:
                self.file.seek(block[0])
                block = np.fromfile(self.file, np.int64, block[1]), np.fromfile(self.file, np.int16, block[1])
            out.append(block)
        return out[0] if len(out) == 1 else (np.concatenate([b[0] for b in out]), np.concatenate([b[1] for b in out]))


class Text:
    """Symbols 0 .. symbols - 1; a suffix that ends is smaller than one that goes on. Prefix hashes compare substrings."""

    def __init__(self, symbols: np.ndarray, alphabet: int, cap: int):
        self.t, self.alphabet, self.cap = symbols, alphabet, cap
        n = len(symbols)
        step = np.sign(np.append(symbols[1:].astype(np.int32), -1) - symbols.astype(np.int32))
        # The sign that decides is the next one that is not 0; the last is never 0.
        at = np.where(step != 0, np.arange(n), n)
        decides = np.minimum.accumulate(at[::-1])[::-1]
        self.small = step[decides] > 0  # S-type: smaller than the suffix behind it
        base = np.uint64(0x9E3779B97F4A7C15 | 1)
        steps = np.full(n + 1, base, np.uint64)
        steps[0] = 1
        self.power = np.multiply.accumulate(steps)
        value = (symbols.astype(np.uint64) + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
        value ^= value >> np.uint64(31)
        self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(value * self.power[:n])))

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Length of the common prefix of suffixes i and j, up to the cap, by halving the doubt."""
        n = len(self.t)
        got = np.zeros(len(i), np.int64)
        most = np.minimum(self.cap, n - np.maximum(i, j))
        low = np.minimum(i, j)
        high = np.maximum(i, j)
        bit = 1 << int(self.cap).bit_length()
        while bit:
            want = got + bit
            ok = want <= most
            a, b, e = low[ok], high[ok], want[ok]
            left = (self.sums[a + e] - self.sums[a]) * self.power[b - a]
            ok[ok] = left == self.sums[b + e] - self.sums[b]
            got[ok] += bit
            bit >>= 1
        return got.astype(np.int16)


def _order_stars(text: Text, stars: np.ndarray) -> np.ndarray:
    """The S*-suffixes in order, up to the cap: tuples of seven symbols name them, and only names that several share
    are refined by the next seven, again and again. Equal up to the cap stay in the order of position."""
    t = np.concatenate((text.t.astype(np.uint64) + np.uint64(1), np.zeros(text.cap + 16, np.uint64)))

    def tuples(p: np.ndarray) -> np.ndarray:
        key = np.zeros(len(p), np.uint64)
        for k in range(7):
            key = (key << np.uint64(9)) | t[p + k]
        return key

    key = tuples(stars)
    order = np.argsort(key, kind="stable")
    stars, key = stars[order], key[order]
    name = np.cumsum(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    for depth in range(7, text.cap + 7, 7):
        same = np.zeros(len(name), bool)
        tie = name[1:] == name[:-1]
        same[1:] |= tie
        same[:-1] |= tie
        at = np.flatnonzero(same)
        if not len(at):
            break
        key = tuples(np.minimum(stars[at] + depth, len(text.t)))
        order = np.lexsort((key, name[at]))
        stars[at] = stars[at][order]
        key = key[order]
        fresh = np.zeros(len(name), np.int64)
        fresh[0:1] = 1
        fresh[1:] = name[1:] != name[:-1]
        fresh[at[1:]] |= (key[1:] != key[:-1]) & (at[1:] - at[:-1] == 1)
        name = np.cumsum(fresh)
    return stars


class _Scan:
    """Feeds suffixes in scan order to the queue: each one's left neighbour of the wanted type goes to its symbol.

    Two left neighbours with the same symbol share one symbol more than the suffixes they come from, which share the
    least of all common-prefix values scanned between them.
    """

    def __init__(self, text: Text, queue: BucketQueue, wanted: np.ndarray):
        self.text, self.queue, self.wanted = text, queue, wanted
        self.since = np.zeros(text.alphabet, np.int16)  # least value scanned since the symbol's last push

    def feed(self, pos: np.ndarray, lcp: np.ndarray) -> None:
        if not len(pos):
            return
        t, cap = self.text.t, self.text.cap
        at = np.flatnonzero((pos > 0) & self.wanted[pos - 1])
        whole = lcp.min()
        if not len(at):
            np.minimum(self.since, whole, out=self.since)
            return
        before = pos[at] - 1
        symbol = t[before]
        order = np.argsort(symbol, kind="stable")
        at, before, symbol = at[order], before[order], symbol[order]
        first = np.append(True, symbol[1:] != symbol[:-1])
        start = np.where(first, 0, np.append(0, at[:-1] + 1))
        least = _range_min(lcp, start, at)
        heads = np.flatnonzero(first)
        which = symbol[heads]
        least[heads] = np.minimum(least[heads], self.since[which])
        value = np.minimum(least + 1, cap).astype(np.int16)
        np.minimum(self.since, whole, out=self.since)
        ends = np.append(heads[1:], len(at))
        last = at[ends - 1]
        tail = np.full(len(last), cap, np.int16)
        more = last + 1 < len(lcp)
        if more.any():
            back = np.minimum.accumulate(lcp[::-1])[::-1]
            tail[more] = back[last[more] + 1]
        self.since[which] = tail
        for s, a, b in zip(which.tolist(), heads.tolist(), ends.tolist()):
            self.queue.push(s, before[a:b], value[a:b])


def _range_min(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Minimum of values[low .. high], both ends included, for many ranges."""
    length = high - low + 1
    level = np.frexp(length)[1] - 1
    out = np.empty(len(low), np.int16)
    table = values
    for k in range(int(level.max()) + 1):
        some = np.flatnonzero(level == k)
        if len(some):
            out[some] = np.minimum(table[low[some]], table[high[some] - (1 << k) + 1])
        if k < level.max():
            table = np.minimum(table[: -(1 << k)], table[1 << k :])
    return out


def suffix_array(symbols: np.ndarray, alphabet: int = 257, cap: int = 128, limit: int = 64 << 20) -> tuple[np.ndarray, np.ndarray]:
    """(suffixes, lcp): sorted by their first ``cap`` symbols, and the common prefix with the one before, up to cap.

    Induced sorting: S*-suffixes are ordered first; scanning up the symbols, they induce the L-type suffixes, and
    scanning down, these induce the S-type ones. limit bounds the memory of each pass's queue.
    """
    n = len(symbols)
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int16)
    text = Text(symbols, alphabet, cap)
    small = text.small
    stars = _order_stars(text, np.flatnonzero(small[1:] & ~small[:-1]) + 1)
    star_lcp = np.zeros(len(stars), np.int16)
    if len(stars) > 1:
        star_lcp[1:] = text.common(stars[:-1], stars[1:])
    cuts = np.searchsorted(symbols[stars], np.arange(alphabet + 1))

    queue = BucketQueue(alphabet, limit)
    scan = _Scan(text, queue, ~small)
    # The empty suffix is the smallest of all and induces the last symbol's, which is always of L-type.
    queue.push(int(symbols[-1]), np.array([n - 1]), np.zeros(1, np.int16))
    larges = BucketQueue(alphabet, limit)
    for c in range(alphabet):
        last = -1
        while (block := queue.pop(c)) is not None:
            pos, lcp = block
            if last < 0:
                lcp[0] = 0
            larges.push(c, pos, lcp)
            scan.feed(pos, lcp)
            last = int(pos[-1])
        pos, lcp = stars[cuts[c] : cuts[c + 1]], star_lcp[cuts[c] : cuts[c + 1]].copy()
        if len(pos):
            lcp[0] = text.common(np.array([last]), pos[:1])[0] if last >= 0 else 0
            scan.feed(pos, lcp)

    scan = _Scan(text, queue, small)
    parts: list[tuple[np.ndarray, np.ndarray]] = []
    for c in range(alphabet - 1, -1, -1):
        runs, above = [], -1
        while (block := queue.pop(c)) is not None:  # from the greatest down; lcp with the one above
            pos, lcp = block
            if above < 0:
                lcp[0] = 0
            runs.append((pos, lcp))
            scan.feed(pos, lcp)
            above = int(pos[-1])
        got = larges.pop(c)
        seam = 0
        if got is not None:
            pos, lcp = got
            if above >= 0:
                seam = int(text.common(pos[-1:], np.array([above]))[0])
            scan.feed(pos[::-1], np.append(np.int16(seam), lcp[:0:-1]))
        if runs:
            pos, lcp = np.concatenate([r[0] for r in runs])[::-1], np.concatenate([r[1] for r in runs])
            parts.append((pos, np.append(np.int16(seam), lcp[:0:-1])))
        if got is not None:
            parts.append(got)
    parts.reverse()
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
