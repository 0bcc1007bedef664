"""External induced sorting of suffixes with common-prefix values.

The suffixes of a text are sorted by induction: suffixes that start at a left-most smaller character
(LMS) are sorted first, by the names of their LMS substrings and recursion on the reduced text; the
rest is induced from them in two scans over the characters. The scans run on disk-backed priority
queues, one FIFO for each character (priority within it is arrival, which is suffix order), that
hold (position, common prefix) tuples in blocks and spill the largest blocks to a scratch file over
`memory` bytes. The common prefix of neighbours in a queue is one more than the least one scanned
between the pushes of both.

Recursion ends by doubling ranks once the reduced text has at most `base` names.
"""

from __future__ import annotations

import tempfile
from collections import deque
from collections.abc import Iterator

import numpy as np

INF = np.int32(1 << 30)


class Queues:
    """FIFO queues of blocks of (position, common prefix), by character; the blocks live on disk beyond `memory` bytes."""

    def __init__(self, memory: int):
        self.q: dict[int, deque] = {}
        self.memory, self.held, self.file = memory, 0, None

    def push(self, c: int, pos: np.ndarray, lcp: np.ndarray) -> None:
        block = np.stack([pos.astype(np.int64), lcp.astype(np.int64)])
        self.held += block.nbytes
        if self.held > self.memory:
            self.held -= block.nbytes
            if self.file is None:
                self.file = tempfile.TemporaryFile()  # the task's own scratch, like a spill; gone with it
            self.file.seek(0, 2)
            at = self.file.tell()
            self.file.write(block.tobytes())
            block = (at, block.shape[1])
        self.q.setdefault(c, deque()).append(block)

    def _load(self, block) -> np.ndarray:
        if isinstance(block, tuple):
            self.file.seek(block[0])
            return np.frombuffer(self.file.read(16 * block[1]), np.int64).reshape(2, -1)
        self.held -= block.nbytes
        return block

    def pop(self, c: int, most: int = 1 << 20) -> np.ndarray | None:
        """The next blocks of c, joined up to about `most` tuples."""
        q, out, n = self.q.get(c), [], 0
        while q and n < most:
            out.append(self._load(q.popleft()))
            n += out[-1].shape[1]
        return np.concatenate(out, axis=1) if len(out) > 1 else out[0] if out else None

    def pop_back(self, c: int) -> np.ndarray | None:
        q = self.q.get(c)
        return self._load(q.pop())[:, ::-1] if q else None


class Scan:
    """Pushes predecessors of scanned suffixes with the common prefixes that follow from those scanned."""

    def __init__(self, text: np.ndarray, out: Queues, cap: int):
        self.text, self.out, self.cap = text, out, cap
        self.since: dict[int, int] = {}
        self.small = int(text.max()) < 1 << 16  # then stable sorts are radix sorts

    def __call__(self, pos: np.ndarray, lcp: np.ndarray, keep) -> None:
        pred = pos - 1
        ch = self.text[pred]  # position 0 wraps to the sentinel, which no scan keeps
        at = np.flatnonzero(keep(ch) & (pos > 0))
        chars = ch[at]
        order = np.argsort(chars.astype(np.uint16) if self.small else chars, kind="stable")
        at, chars = at[order], chars[order]
        cuts = np.concatenate([[0], np.flatnonzero(chars[1:] != chars[:-1]) + 1, [len(chars)]]) if len(chars) else np.zeros(1, np.int64)
        least = int(lcp.min())
        pushed = set()
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            c, j = int(chars[a]), at[a:b]
            mins = np.minimum.reduceat(lcp[: j[-1] + 1], np.concatenate([[0], j[:-1] + 1]))
            mins[0] = min(int(mins[0]), self.since[c]) if c in self.since else -1
            self.out.push(c, pred[j], np.minimum(mins + 1, self.cap))
            rest = lcp[j[-1] + 1 :]
            self.since[c] = int(rest.min()) if len(rest) else int(INF)
            pushed.add(c)
        for c in self.since:
            if c not in pushed and self.since[c] > least:
                self.since[c] = least


def common_prefix(text: np.ndarray, a: np.ndarray, b: np.ndarray, cap: int) -> np.ndarray:
    """Of the suffixes a[i] and b[i], cap at most. text has zeros behind its end."""
    out = np.full(len(a), cap, np.int64)
    live, step, at = np.arange(len(a)), 8, 0
    offs = np.arange(step)
    top = len(text) - 1
    while len(live) and at < cap:
        x, y = np.minimum(a[live, None] + (at + offs), top), np.minimum(b[live, None] + (at + offs), top)
        diff = text[x] != text[y]
        hit = diff.any(axis=1)
        out[live[hit]] = np.minimum(at + diff[hit].argmax(axis=1), cap)
        live = live[~hit]
        at += step
    return out


def _types(text: np.ndarray) -> np.ndarray:
    """True where the suffix is smaller than the next one (the sentinel's is)."""
    n = len(text)
    change = np.flatnonzero(text[:-1] != text[1:])
    s = np.ones(n, bool)
    s[: change[-1] + 1] = np.repeat(text[change] < text[change + 1], np.diff(np.concatenate([[-1], change])))
    return s


def induce(text: np.ndarray, chars: np.ndarray, lms: np.ndarray, lms_lcp: np.ndarray, cap: int, memory: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All suffixes from the largest to the least, in blocks, each with its common prefix with the one before. lms: in order within each character."""
    larger, done = Queues(memory), Queues(memory)
    scan = Scan(text, larger, cap)
    first = text[lms]
    bounds = {int(c): (int(a), int(b)) for c, a, b in zip(chars, np.searchsorted(first, chars, "left"), np.searchsorted(first, chars, "right"), strict=True)}
    scan(np.array([len(text) - 1]), np.array([0]), lambda ch: ch > 0)
    for c in chars.tolist():
        scan.since = {k: 0 for k in scan.since}  # suffixes with different characters have nothing in common
        last = None
        while (block := larger.pop(c)) is not None:
            pos, lcp = block[0], block[1].copy()
            if last is None:
                lcp[0] = 0
            done.push(c, pos, lcp)
            last = int(pos[-1])
            scan(pos, lcp, lambda ch, c=c: ch >= c)
        a, b = bounds[c]
        if a < b:
            pos, lcp = lms[a:b], lms_lcp[a:b].copy()
            lcp[0] = 0 if last is None else int(common_prefix(text, np.array([last]), pos[:1], cap)[0])
            scan(pos, lcp, lambda ch, c=c: ch > c)
    smaller = Queues(memory)
    scan = Scan(text, smaller, cap)
    for c in chars[::-1].tolist():
        scan.since = {k: 0 for k in scan.since}
        last = None
        while (block := smaller.pop(c)) is not None:
            pos, lcp = block[0], block[1].copy()
            if last is None:
                lcp[0] = 0
            last = int(pos[-1])
            scan(pos, lcp, lambda ch, c=c: ch <= c)
            yield pos, lcp
        seam = True
        after = 0
        while (block := done.pop_back(c)) is not None:
            pos, own = block[0], block[1]
            lcp = np.concatenate([[after], own[:-1]])  # a neighbour's value, seen from the other side
            if seam:
                lcp[0] = 0 if last is None else int(common_prefix(text, np.array([last]), pos[:1], cap)[0])
                seam = False
            after = int(own[-1])
            scan(pos, lcp, lambda ch, c=c: ch < c)
            yield pos, lcp
    yield np.array([len(text) - 1]), np.array([0])


def _double(names: np.ndarray) -> np.ndarray:
    """Suffix order of a short text of names by doubling."""
    rank, k, n = names.astype(np.int64), 1, len(names)
    while True:
        ahead = np.zeros(n, np.int64)
        ahead[: n - k] = rank[k:] + 1
        key = rank * (int(rank.max()) + 2) + ahead
        order = np.argsort(key, kind="stable")
        fresh = np.concatenate([[0], (key[order[1:]] != key[order[:-1]]).cumsum()])
        rank = np.empty(n, np.int64)
        rank[order] = fresh
        if fresh[-1] == n - 1 or k >= n:
            return order
        k *= 2


def sort_lms(text: np.ndarray, chars: np.ndarray, memory: int, base: int) -> np.ndarray:
    """The LMS suffixes in order."""
    s = _types(text)
    lms = np.flatnonzero(s[1:] & ~s[:-1]) + 1
    lms = lms[lms < len(text) - 1]
    if len(lms) < 2:
        return lms
    is_lms = np.zeros(len(text), bool)
    is_lms[lms] = True
    seeds = lms[np.argsort(text[lms], kind="stable")]
    order = np.concatenate([p[is_lms[p]] for p, _ in induce(text, chars, seeds, np.zeros(len(seeds), np.int64), 1, memory)])[::-1]
    ends = np.append(lms[1:], len(text) - 1)
    length = np.zeros(len(text), np.int64)
    length[lms] = ends - lms + 1
    a, b = order[:-1], order[1:]
    same = length[a] == length[b]
    idx = np.flatnonzero(same)
    for_len = length[a[idx]]
    if len(idx):
        same[idx] = common_prefix_upto(text, a[idx], b[idx], for_len)
    name = np.concatenate([[0], (~same).cumsum()])
    if name[-1] == len(lms) - 1:
        return order
    of = np.zeros(len(text), np.int64)
    of[order] = name
    names = of[lms]
    if len(names) <= base:
        return lms[_double(names)]
    reduced = np.concatenate([names + 1, [0]])
    inner = np.unique(reduced[:-1])
    found = [p for p, _ in induce(reduced, inner, *(lambda x: (x, np.zeros(len(x), np.int64)))(sort_lms(reduced, inner, memory, base)), 1, memory)]
    got = np.concatenate(found)[::-1]
    return lms[got[got < len(names)]]


def common_prefix_upto(text: np.ndarray, a: np.ndarray, b: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Whether the substrings of the given lengths at a[i] and b[i] are equal."""
    out = np.ones(len(a), bool)
    live, at, top = np.arange(len(a)), 0, len(text) - 1
    offs = np.arange(8)
    while len(live):
        x, y = np.minimum(a[live, None] + (at + offs), top), np.minimum(b[live, None] + (at + offs), top)
        bad = ((text[x] != text[y]) & (at + offs < length[live, None])).any(axis=1)
        out[live[bad]] = False
        at += 8
        live = live[~bad & (length[live] > at)]
    return out


def sorted_suffixes(text: np.ndarray, cap: int, memory: int = 256 << 20, base: int = 1 << 24) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks of (positions, common prefixes with the one before, cap at most), from the largest suffix to the least. text: integers over 0; a sentinel is added."""
    text = np.concatenate([text, [0]]).astype(np.int32)
    chars = np.unique(text[:-1])
    if len(text) == 1:
        return
    lms = sort_lms(text, chars, memory, base)
    lcp = np.zeros(len(lms), np.int64)
    if len(lms) > 1:
        lcp[1:] = common_prefix(text, lms[:-1], lms[1:], cap)
    for pos, l in induce(text, chars, lms, lcp, cap, memory):
        keep = pos < len(text) - 1
        if keep.all():
            yield pos, l
        elif keep.any():
            yield pos[keep], l[keep]
