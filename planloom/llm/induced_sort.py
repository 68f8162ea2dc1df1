"""Suffix sorting by induction, with queues that move to disk.

The suffixes of a byte string are of type L (greater than the next one) or S.  An
S suffix after an L suffix is an LMS suffix.  Once the LMS suffixes are in order,
one ascending pass over the queue of suffixes induces the order of all L suffixes
and one descending pass that of all S suffixes.  The queue is a monotone priority
queue: a suffix taken with first character c only inserts suffixes with a first
character at or after c, in the order of their ranks, so it is kept as one
first-in, first-out lane per character, each lane a list of arrays that is
written to an anonymous temporary file once more than ``in_memory`` bytes are held.

The LMS suffixes are sorted recursively: a first pair of passes orders the LMS
substrings, equal substrings get equal names, and the string of names is
suffix-sorted.  Names have far larger alphabets than bytes; a string of at most
``LANES`` names is sorted by the same induction, a longer alphabet by doubling:
(rank, rank after it) tuples are sorted until all ranks differ.
"""

from __future__ import annotations

import tempfile

import numpy as np

LANES = 1024
IN_MEMORY = 256 << 20


class LaneQueue:
    """Lanes of positions, appended in order and taken once."""

    def __init__(self, lanes: int, in_memory: int = IN_MEMORY):
        self.lanes: list[list] = [[] for _ in range(lanes)]
        self.held, self.in_memory, self.file = 0, in_memory, None

    def put(self, keys: np.ndarray, positions: np.ndarray) -> None:
        if not len(keys):
            return
        order = np.argsort(keys.astype(np.uint16), kind="stable")  # a radix sort
        keys, positions = keys[order], positions[order]
        starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        for start, end in zip(starts, np.r_[starts[1:], len(keys)], strict=True):
            self.lanes[keys[start]].append(positions[start:end])
        self.held += positions.nbytes
        if self.held > self.in_memory:
            self._to_disk()

    def _to_disk(self) -> None:
        self.file = self.file or tempfile.TemporaryFile()
        self.file.seek(0, 2)
        for lane in self.lanes:
            for i, part in enumerate(lane):
                if isinstance(part, np.ndarray):
                    at = self.file.tell()
                    part.tofile(self.file)
                    lane[i] = (at, len(part))
        self.held = 0

    def take(self, lane: int) -> np.ndarray:
        parts = []
        for part in self.lanes[lane]:
            if isinstance(part, tuple):
                self.file.seek(part[0])
                part = np.fromfile(self.file, dtype=np.int64, count=part[1])
            parts.append(part)
        self.lanes[lane] = []
        return np.concatenate(parts) if parts else np.zeros(0, dtype=np.int64)


def _types(text: np.ndarray) -> np.ndarray:
    """True for S suffixes.  The end of the text is less than any character."""
    n = len(text)
    smaller = np.zeros(n, dtype=bool)
    if n:
        differ = np.flatnonzero(text[1:] != text[:-1])
        decides = np.full(n, -1, dtype=np.int64)
        where = np.searchsorted(differ, np.arange(n - 1))
        found = where < len(differ)
        decides[: n - 1][found] = differ[where[found]]
        known = decides >= 0
        smaller[known] = text[decides[known]] < text[decides[known] + 1]
    return smaller


def _induce(text: np.ndarray, is_s: np.ndarray, lms: np.ndarray, lanes: int, in_memory: int) -> np.ndarray:
    """All suffixes in order, given the LMS suffixes in order."""
    n = len(text)
    queue = LaneQueue(lanes, in_memory)
    seeds = LaneQueue(lanes, in_memory)
    seeds.put(text[lms], lms)
    queue.put(text[n - 1 : n], np.array([n - 1], dtype=np.int64))  # before the end of the text
    left: list[np.ndarray] = []

    def feed(at: np.ndarray, lane: int, want_s: bool) -> np.ndarray:
        """Queue the predecessors of the wanted type in other lanes; return those of the own lane."""
        before = at[at > 0] - 1
        before = before[is_s[before] == want_s]
        own = text[before] == lane
        queue.put(text[before[~own]], before[~own])
        return before[own]

    for lane in range(lanes):
        parts = []
        part = queue.take(lane)
        while len(part):
            parts.append(part)
            part = feed(part, lane, False)
        left.append(np.concatenate(parts) if parts else part)
        feed(seeds.take(lane), lane, False)
    queue = LaneQueue(lanes, in_memory)
    out: list[np.ndarray] = []
    for lane in range(lanes - 1, -1, -1):
        parts = []
        part = queue.take(lane)
        while len(part):
            parts.append(part)
            part = feed(part, lane, True)
        down = left[lane][::-1]
        feed(down, lane, True)
        out += [*parts, down]
        left[lane] = down[:0]
    return np.concatenate(out)[::-1] if out else np.zeros(0, dtype=np.int64)


def _doubled(names: np.ndarray) -> np.ndarray:
    """Order of the suffixes of a string of names, by sorting tuples of ranks."""
    rank, step, n = names.astype(np.int64), 1, len(names)
    while True:
        after = np.full(n, -1, dtype=np.int64)
        after[: max(n - step, 0)] = rank[step:]
        key = rank * (int(rank.max(initial=0)) + 2) + after + 1
        order = np.argsort(key)
        new = np.cumsum(np.r_[0, key[order[1:]] != key[order[:-1]]])
        rank = np.empty(n, dtype=np.int64)
        rank[order] = new
        if not n or new[-1] == n - 1:
            return order
        step *= 2


def suffix_order(text: np.ndarray, lanes: int = 256, in_memory: int = IN_MEMORY) -> np.ndarray:
    """Start positions of all suffixes of ``text`` (integers under ``lanes``) in order."""
    text = np.asarray(text).astype(np.uint16)
    n = len(text)
    if n < 2:
        return np.arange(n)
    is_s = _types(text)
    lms = np.flatnonzero(is_s[1:] & ~is_s[:-1]) + 1
    if len(lms) > 1:
        rough = _induce(text, is_s, lms, lanes, in_memory)
        is_lms = np.zeros(n, dtype=bool)
        is_lms[lms] = True
        ordered = rough[is_lms[rough]]
        length = np.zeros(n, dtype=np.int64)
        length[lms] = np.diff(np.r_[lms, n]) + 1  # through the next LMS position
        length[lms[-1]] = n - lms[-1]
        a, b = ordered[:-1], ordered[1:]
        same = (length[a] == length[b]) & (a != lms[-1]) & (b != lms[-1])
        open_ = np.flatnonzero(same)
        for j in range(int(length[ordered].max())):
            if not len(open_):
                break
            equal = text[a[open_] + j] == text[b[open_] + j]
            same[open_[~equal]] = False
            open_ = open_[equal & (length[a[open_]] > j + 1)]
        name = np.zeros(n, dtype=np.int64)
        name[ordered] = np.cumsum(np.r_[0, ~same])
        names = name[lms]
        count = int(names.max()) + 1
        if count < len(lms):
            order = suffix_order(names, count, in_memory) if count <= LANES else _doubled(names)
            lms = lms[order]
        else:
            lms = ordered
    return _induce(text, is_s, lms, lanes, in_memory)


def same_prefix_as_before(data: bytes, order: np.ndarray, length: int) -> np.ndarray:
    """For start positions in suffix order, each at least ``length`` before the end: whether
    the first ``length`` bytes (8 or more) equal those of the position before it."""
    words = np.ndarray((max(len(data) - 7, 0),), dtype="<u8", buffer=data, strides=(1,))
    same = np.zeros(len(order), dtype=bool)
    open_ = np.arange(1, len(order))
    for at in [*range(0, length - 8, 8), length - 8]:
        open_ = open_[words[order[open_ - 1] + at] == words[order[open_] + at]]
    same[open_] = True
    return same
