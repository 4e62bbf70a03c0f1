"""Run-length index of byte strings: a run-compressed Burrows-Wheeler transform with sampled run ends, and matching
statistics of other strings streamed through it, many strings in step."""

from __future__ import annotations

import numpy as np

#: Symbols in a first sort key: seven of nine bits.
_PACK = 7


def _lowest_bytes(x: np.ndarray) -> np.ndarray:
    """How many of the lowest bytes of each word are zero."""
    return np.bitwise_count((x & (~x + np.uint64(1))) - np.uint64(1)).astype(np.int64) >> 3


class RunLengthIndex:
    """Several strings, each with an end mark of its own.

    Kept are the runs of the transform (start, symbol, and the row to which its first row maps) and the text places
    of the suffixes at both ends of each run; a place elsewhere is known only by stepping from such an end.
    """

    def __init__(self, strings: list[bytes]) -> None:
        self.count = len(strings)
        sizes = np.fromiter(map(len, strings), np.int64, self.count)
        ends = np.cumsum(sizes + 1) - 1
        n = self.rows = int(ends[-1]) + 1 if self.count else 0
        raw = np.frombuffer(b"".join(b + b"\0" for b in strings) + bytes(16), np.uint8)
        symbol = raw[:n].astype(np.int64) + 1
        symbol[ends] = 0
        self.left = np.repeat(ends, sizes + 1) - np.arange(n)  # bytes up to the end mark
        self.words = np.lib.stride_tricks.sliding_window_view(raw, 8)[:n].copy().view("<u8").ravel()
        order = self._sorted(symbol, np.repeat(np.arange(self.count), sizes + 1), n)
        last = symbol[order - 1]
        self.run_start = np.flatnonzero(np.concatenate(([True], last[1:] != last[:-1]))) if n else np.zeros(0, np.int64)
        self.run_head = last[self.run_start]
        size = np.diff(np.append(self.run_start, n))
        self.first_place, self.last_place = order[self.run_start], order[self.run_start + size - 1]
        self.by_head = np.argsort(self.run_head, kind="stable")
        self.run_base = np.empty(len(size), np.int64)  # rows of suffixes are in the order of their first symbols
        self.run_base[self.by_head] = np.cumsum(size[self.by_head]) - size[self.by_head]
        self.head_key = self.run_head[self.by_head] * len(size) + self.by_head
        self.run_next = np.searchsorted(self.run_start, self.run_base, "right") - 1  # the run of that row
        self.run_stop = np.append(self.run_start[1:], n)

    def _sorted(self, symbol: np.ndarray, text: np.ndarray, n: int) -> np.ndarray:
        """Places in the order of their suffixes: prefix doubling over those that are still tied."""
        key, alive = np.zeros(n, np.int64), np.ones(n, bool)
        for j in range(_PACK):  # nothing past an end mark
            ahead = np.zeros(n, np.int64)
            ahead[: n - j] = symbol[j:]
            key = (key << 9) | np.where(alive, ahead, 0)
            alive &= ahead != 0
        order = np.argsort(key)
        rank, tied, depth = np.empty(n, np.int64), np.arange(n), _PACK
        key = key[order]
        while len(tied):
            first = np.concatenate(([True], key[1:] != key[:-1]))
            at = tied[np.maximum.accumulate(np.where(first, np.arange(len(tied)), 0))]
            rank[order[tied]] = at
            alone = first & np.append(first[1:], True)
            tied = tied[~alone]
            if not len(tied):
                break
            place = order[tied]
            ahead = np.where(self.left[place] >= depth, rank[np.minimum(place + depth, n - 1)] + self.count, text[place])
            key = rank[place] * (n + self.count + 1) + ahead  # equal ends are told apart by the string's number
            by = np.argsort(key)
            order[tied], key, depth = place[by], key[by], 2 * depth
        return order

    def step(self, rows: np.ndarray) -> np.ndarray:
        """Last-to-first: the rows of the suffixes that begin one symbol earlier."""
        run = np.searchsorted(self.run_start, rows, "right") - 1
        return self.run_base[run] + rows - self.run_start[run]

    def _runs_of(self, rows: np.ndarray, guess: np.ndarray) -> np.ndarray:
        """The runs of rows that are in the runs guessed or, mostly, just after."""
        run, late = guess, np.flatnonzero(rows >= self.run_stop[guess])
        for _ in range(2):
            run[late] += 1
            late = late[rows[late] >= self.run_stop[run[late]]]
        if len(late):
            run[late] = np.searchsorted(self.run_start, rows[late], "right") - 1
        return run

    def _common(self, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Length of what the suffixes at places ``a`` and ``b`` have in common, ``most`` at most."""
        most = np.minimum(most, np.minimum(self.left[a], self.left[b]))
        out, todo = np.zeros(len(a), np.int64), np.flatnonzero(most > 0)
        while len(todo):
            at = out[todo]
            apart = self.words[a[todo] + at] ^ self.words[b[todo] + at]
            out[todo] = at + np.where(apart == 0, 8, _lowest_bytes(apart))
            todo = todo[(apart == 0) & (out[todo] < most[todo])]
        return np.minimum(out, most)

    def matching(self, data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
        """Matching statistics: at each byte of ``data`` inside one of the strings (starts, stops), the length of the
        longest piece from there on, inside that string, that occurs in an indexed one.

        All strings go backwards in step. A string keeps the row and place of a suffix with the longest match; where
        that row's symbol is another, the nearest run ends with the right one, before and after, hold the longest
        match that goes on, and their sampled places tell how long it is.
        """
        out = np.zeros(len(data), np.int32)
        if not self.rows or not len(starts):
            return out
        by = np.argsort(starts - stops, kind="stable")
        starts, stops = starts[by], stops[by]
        sizes = stops - starts
        active = np.searchsorted(-sizes, -np.arange(1, int(sizes.max()) + 1), "right")  # strings with so many bytes
        k, runs = len(starts), len(self.run_start)
        row, place, length, run = (np.zeros(k, np.int64) for _ in range(4))
        place += self.first_place[0]
        for t, k in enumerate(active.tolist(), 1):
            at = stops[:k] - t
            row, place, length, run = row[:k], place[:k], length[:k], run[:k]
            c = data[at].astype(np.int64) + 1
            j = np.flatnonzero(self.run_head[run] != c)
            if len(j):
                cj, had, here = c[j], length[j], place[j]
                i = np.searchsorted(self.head_key, cj * runs + run[j])
                up, down = self.by_head[np.maximum(i - 1, 0)], self.by_head[np.minimum(i, runs - 1)]
                up_ok, down_ok = (i > 0) & (self.run_head[up] == cj), (i < runs) & (self.run_head[down] == cj)
                high = np.where(up_ok, self._common(here, self.last_place[up], np.where(up_ok, had, 0)), -1)
                low = np.where(down_ok, self._common(here, self.first_place[down], np.where(down_ok, had, 0)), -1)
                upward = high >= low
                best = np.where(upward, high, low)
                run[j] = np.where(upward, up, down)
                row[j] = np.where(upward, self.run_stop[run[j]] - 1, self.run_start[run[j]])
                place[j] = np.where(upward, self.last_place[up], self.first_place[down])
                length[j] = best
            row = self.run_base[run] + row - self.run_start[run]
            place, length = place - 1, length + 1
            lost = np.flatnonzero(length == 0)  # a byte that no indexed string has
            row[lost], place[lost] = 0, self.first_place[0]
            guess = self.run_next[run]
            guess[lost] = 0
            run = self._runs_of(row, guess)
            out[at] = length
        return out
