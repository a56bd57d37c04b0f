"""Word look-ups over whole batches of text: words of a byte buffer to token ids, found once and remembered."""

from __future__ import annotations

import numpy as np

#: Longest word (bytes) that is remembered.
LONGEST = 48
#: Words remembered by a worker before it starts anew.
ROOM = 1 << 18
_MIX = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def _powers(base: int) -> np.ndarray:
    return np.array([pow(base, k + 1, 1 << 64) for k in range(LONGEST)], np.uint64)


POWERS = (_powers(0x5851F42D4C957F2D), _powers(0x2545F4914F6CDD1D))


def spread(h: np.ndarray) -> np.ndarray:
    """Mixes the bits of 64-bit numbers."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(_MIX[0])
    h ^= h >> np.uint64(29)
    h = h * np.uint64(_MIX[1])
    return h ^ (h >> np.uint64(32))


def word_hashes(buf: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of each word of at most LONGEST bytes."""
    total = int(lens.sum())
    first = np.cumsum(lens) - lens
    off = np.arange(total) - np.repeat(first, lens)
    x = buf[off + np.repeat(starts, lens)].astype(np.uint64) + np.uint64(1)
    one, two = (np.add.reduceat(x * p[off], first) if total else np.zeros(0, np.uint64) for p in POWERS)
    n = lens.astype(np.uint64)
    one = spread(one + n)
    return np.where(one == 0, np.uint64(1), one), spread(two ^ (n << np.uint64(56)))


class Table:
    """Open addressing from word hashes to values, in arrays; 0 marks an empty place."""

    def __init__(self, room: int = ROOM):
        self.room, self.mask = room, np.uint64(2 * room - 1)
        self.keys, self.check, self.value = np.zeros(2 * room, np.uint64), np.zeros(2 * room, np.uint64), np.zeros(2 * room, np.int64)
        self.size = 0

    def find(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """Values, or -1."""
        out = np.full(len(one), -1, np.int64)
        todo, place = np.arange(len(one)), one & self.mask
        while len(todo):
            there = self.keys[place]
            hit = (there == one[todo]) & (self.check[place] == two[todo])
            out[todo[hit]] = self.value[place[hit]]
            go = ~hit & (there != 0)
            todo, place = todo[go], (place[go] + np.uint64(1)) & self.mask
        return out

    def add(self, one: np.ndarray, two: np.ndarray, value: np.ndarray) -> None:
        """New and distinct words only."""
        self.size += len(one)
        todo, place = np.arange(len(one)), one & self.mask
        while len(todo):
            free = self.keys[place] == 0
            at, who = place[free], todo[free]
            self.value[at] = who  # the last of several wins
            won = self.value[at] == who
            self.keys[at[won]], self.check[at[won]] = one[who[won]], two[who[won]]
            self.value[at[won]] = value[who[won]]
            lost = np.concatenate([who[~won], todo[~free]])
            place = np.concatenate([at[~won], (place[~free] + np.uint64(1)) & self.mask])
            todo = lost


class WordIds:
    """Token ids of words, by encode_all(list of bytes) -> (their ids in turn, how many each has) for those not seen before."""

    def __init__(self, encode_all, room: int = ROOM):
        self.encode_all, self.room = encode_all, room
        self.clear()

    def clear(self) -> None:
        self.table = Table(self.room)
        self.flat, self.used = np.zeros(1 << 16, np.uint32), 0
        self.off, self.cnt, self.n = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64), 0

    def _keep(self, words: list[bytes]) -> np.ndarray:
        new, cnt = self.encode_all(words)
        while self.used + len(new) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while self.n + len(cnt) > len(self.off):
            self.off, self.cnt = (np.concatenate([x, np.zeros_like(x)]) for x in (self.off, self.cnt))
        self.flat[self.used : self.used + len(new)] = new
        self.off[self.n : self.n + len(cnt)], self.cnt[self.n : self.n + len(cnt)] = self.used + np.cumsum(cnt) - cnt, cnt
        values = np.arange(self.n, self.n + len(cnt))
        self.used, self.n = self.used + len(new), self.n + len(cnt)
        return values

    def ids(self, data: bytes, starts: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words in turn, how many each word has)."""
        if self.table.size > self.room * 7 // 8:
            self.clear()
        buf = np.frombuffer(data, np.uint8)
        short = np.flatnonzero(lens <= LONGEST)
        value = np.full(len(starts), -1, np.int64)
        one, two = word_hashes(buf, starts[short], lens[short])
        value[short] = self.table.find(one, two)
        miss = np.flatnonzero(value[short] < 0)
        if len(miss):
            key, first, back = np.unique(one[miss], return_index=True, return_inverse=True)
            clash = two[miss][first][back] != two[miss]  # equal in one hash only: left to the rare way below
            at = short[miss[first]]
            new = self._keep([data[s : s + n] for s, n in zip(starts[at].tolist(), lens[at].tolist(), strict=True)])
            room = self.room - self.table.size
            self.table.add(key[:room], two[miss][first][:room], new[:room])
            value[short[miss[~clash]]] = new[back[~clash]]
        kept, used = self.n, self.used
        rest = np.flatnonzero(value < 0)
        if len(rest):
            value[rest] = self._keep([data[s : s + n] for s, n in zip(starts[rest].tolist(), lens[rest].tolist(), strict=True)])
        cnt = self.cnt[value]
        ends = np.cumsum(cnt)
        out = self.flat[np.repeat(self.off[value] - (ends - cnt), cnt) + np.arange(int(ends[-1]) if len(ends) else 0)]
        self.n, self.used = kept, used
        return out, cnt
