"""Suffixes in order, with common prefixes, by external induced sorting.

A suffix is rising if it is smaller than its successor, else falling. The leftmost of each run of rising ones is a
sample. One induction over the samples in any order sorts the strings between neighbouring samples; their ranks, the
names, form a text of at most half the length, whose suffixes are sorted by the same means, or in memory once BASE names
or fewer are left. A second induction then carries the samples' order, and the common prefix of neighbours, to all
suffixes.

An induction is two passes over priority queues, one ascending and one descending. The entries are tuples of a position
and the common prefix with the entry before it in the same bucket; the priority is the first character, and entries of
one bucket leave in the order in which they came. A suffix that leaves hands its predecessor to the queue if that is of
the pass's kind; the new entry's prefix is one more than the least prefix that passed since the last entry of its
bucket. Queues keep HELD bytes in memory and the rest in a file; the text, kinds, samples, names and orders are mapped
files. So memory stays near HELD plus the base case, however long the text is.

All order and all prefixes hold up to ``depth`` characters; suffixes that agree so far stand in any order, with prefix
``depth``.
"""

from __future__ import annotations

import heapq
import os
import shutil
import tempfile
from collections import deque
from collections.abc import Callable, Iterator

import numpy as np

HELD = 2 << 20
#: Names that are sorted in memory.
BASE = 1 << 21
CHUNK = 1 << 17
RANGES = 1024
PREFIX = np.int16

Rows = tuple[np.ndarray, np.ndarray]


class Scratch:
    """Files of one task, which nothing else reads and which go when it ends. They lie in the executor's own spill folder,
    where Spark's sorts keep theirs."""

    def __init__(self) -> None:
        self.path = tempfile.mkdtemp(prefix="suffixes-", dir=os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0] or None)
        self.count = 0

    def name(self) -> str:
        self.count += 1
        return f"{self.path}/{self.count}"

    def array(self, kind, size: int) -> np.ndarray:
        return np.memmap(self.name(), kind, "w+", shape=(size,)) if size else np.zeros(0, kind)

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        shutil.rmtree(self.path, ignore_errors=True)


class Queue:
    """Tuples (position, prefix) by key from 0 to top; those of one key leave first in, first out, or from the other end.

    Keys beyond RANGES share buckets; one shared bucket at a time is parted by key in memory."""

    def __init__(self, top: int, key: Callable[[np.ndarray], np.ndarray], scratch: Scratch, held: int):
        self.width = 1 if top < RANGES else -(-(top + 1) // RANGES)
        self.rows: list[deque] = [deque() for _ in range(top // self.width + 1)]
        self.key, self.scratch, self.limit, self.held, self.file = key, scratch, held, 0, None
        self.open, self.inner, self.keys = -1, {}, []

    def put(self, key: np.ndarray, position: np.ndarray, prefix: np.ndarray) -> None:
        bucket = key if self.width == 1 else key // self.width
        order = np.argsort(bucket, kind="stable")
        bucket, position, prefix = bucket[order], position[order], prefix[order]
        cuts = np.flatnonzero(bucket[1:] != bucket[:-1]) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(bucket)]):
            if a < b:
                rows = position[a:b].copy(), prefix[a:b].copy()
                if self.width > 1 and int(bucket[a]) == self.open:
                    self._part(rows)
                else:
                    self.rows[int(bucket[a])].append(rows)
                    self.held += rows[0].nbytes + rows[1].nbytes
        if self.held > self.limit:
            self._spill()

    def _part(self, rows: Rows) -> None:
        key = self.key(rows[0])
        order = np.argsort(key, kind="stable")
        key = key[order]
        cuts = np.flatnonzero(key[1:] != key[:-1]) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(key)]):
            k = int(key[a])
            if not self.inner.get(k):
                self.inner[k] = deque()
                heapq.heappush(self.keys, k)
            self.inner[k].append((rows[0][order[a:b]], rows[1][order[a:b]]))

    def _spill(self) -> None:
        self.file = self.file or open(self.scratch.name(), "w+b")  # noqa: SIM115
        for row in self.rows:
            fresh = []
            while row and isinstance(row[-1][0], np.ndarray):
                fresh.append(row.pop())
            if fresh:
                self.file.seek(0, 2)
                at, position = self.file.tell(), np.concatenate([p for p, _ in reversed(fresh)])
                position.tofile(self.file)
                np.concatenate([x for _, x in reversed(fresh)]).tofile(self.file)
                row.append((at, position.dtype, 0, len(position), len(position)))
        self.held = 0

    def _read(self, part: tuple, a: int, b: int) -> Rows:
        at, kind, *_, size = part
        self.file.flush()
        self.file.seek(at + a * kind.itemsize)
        position = np.fromfile(self.file, kind, b - a)
        self.file.seek(at + size * kind.itemsize + a * np.dtype(PREFIX).itemsize)
        return position, np.fromfile(self.file, PREFIX, b - a)

    def drop(self) -> None:
        """Give the file's space back; nothing is left to be taken."""
        if self.file:
            self.file.close()
            os.unlink(self.file.name)

    def _close(self) -> None:
        """Put what is parted by key back into its bucket; rows of one key stay in order."""
        for row in self.inner.values():
            self.rows[self.open].extend(row)
            self.held += sum(p.nbytes + x.nbytes for p, x in row)
        self.open, self.inner, self.keys = -1, {}, []

    def _pop(self, row: deque, last: bool) -> Rows:
        """One stretch of at most CHUNK rows from an end of a bucket."""
        part = row.pop() if last else row.popleft()
        back = row.append if last else row.appendleft
        if isinstance(part[0], np.ndarray):
            n = len(part[0])
            cut = max(0, n - CHUNK) if last else min(n, CHUNK)
            near, rest = (slice(cut, n), slice(0, cut)) if last else (slice(0, cut), slice(cut, n))
            if n > CHUNK:
                back((part[0][rest], part[1][rest]))
            if self.width == 1 or row is self.rows[self.open]:
                self.held -= part[0][near].nbytes + part[1][near].nbytes
            return part[0][near], part[1][near]
        at, kind, a, b, size = part
        if b - a > CHUNK:
            back((at, kind, a, b - CHUNK, size) if last else (at, kind, a + CHUNK, b, size))
            a, b = (b - CHUNK, b) if last else (a, a + CHUNK)
        return self._read(part, a, b)

    def least(self, key: int) -> int | None:
        """The least key from ``key`` on that has rows."""
        for r in range(key // self.width, len(self.rows)):
            if self.width == 1:
                if self.rows[r]:
                    return r
                continue
            if self.rows[r]:
                if r != self.open:
                    self._close()
                    self.open = r
                while self.rows[r]:
                    self._part(self._pop(self.rows[r], False))
            while r == self.open and self.keys:
                if self.inner.get(self.keys[0]):
                    return self.keys[0]
                heapq.heappop(self.keys)
        return None

    def take(self, key: int, last: bool = False) -> Rows | None:
        """At most CHUNK rows of a key, in the order of their arrival, from the first on or up to the last."""
        row = self.rows[key] if self.width == 1 else self.inner.get(key) if key // self.width == self.open else None
        if not row:
            return None
        parts = [self._pop(row, last)]
        while row and sum(len(p) for p, _ in parts) < CHUNK // 2:
            parts.append(self._pop(row, last))
        if len(parts) == 1:
            return parts[0]
        parts = parts[::-1] if last else parts
        return np.concatenate([p for p, _ in parts]), np.concatenate([x for _, x in parts])


class Since:
    """The least prefix that has passed since the last entry of each bucket."""

    def __init__(self, top: int, depth: int, scratch: Scratch):
        self.last = scratch.array(np.int64, top + 1)  # two more than the time of the last entry, which may come before all times; 0: none
        self.depth, self.time = depth, 0
        # Times whose prefix is less than all later ones.
        self.times, self.values = np.zeros(0, np.int64), np.zeros(0, PREFIX)

    def step(self, prefix: np.ndarray, at: np.ndarray, bucket: np.ndarray) -> np.ndarray:
        """Let a stretch of prefixes pass; the prefixes of the new entries that its places ``at`` give to buckets."""
        out = np.zeros(len(at), PREFIX)
        if len(at):
            order = np.argsort(bucket, kind="stable")
            place, owner = at[order], bucket[order]
            head = np.concatenate([[True], owner[1:] != owner[:-1]])
            low = np.empty(len(at), PREFIX)
            rest = np.flatnonzero(~head)
            low[rest] = _range_least(prefix, place[rest - 1] + 1, place[rest])
            first = np.flatnonzero(head)
            known = self.last[owner[first]]
            later = np.searchsorted(self.times, known - 2, side="right")
            since = np.append(self.values, self.depth)[later]
            upto = np.minimum.accumulate(prefix)[place[first]]
            low[first] = np.where(known == 0, -1, np.minimum(since, upto))
            out[order] = np.minimum(low + 1, self.depth)
            end = np.append(first[1:], len(at)) - 1
            self.last[owner[first]] = self.time + place[end] + 2
        after = np.minimum.accumulate(prefix[::-1])[::-1]
        falls = np.flatnonzero(prefix < np.append(after[1:], self.depth + 1))
        keep = self.values < after[0]
        self.times = np.concatenate([self.times[keep], self.time + falls])
        self.values = np.concatenate([self.values[keep], prefix[falls]])
        self.time += len(prefix)
        return out


def _range_least(value: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The least of value[low..high], ends included."""
    out = np.empty(len(low), value.dtype)
    level = np.frexp((high - low + 1).astype(np.float64))[1] - 1
    table = value
    for k in range(int(level.max()) + 1 if len(level) else 0):
        if k:
            table = np.minimum(table[: -(1 << (k - 1))], table[1 << (k - 1) :])
        here = np.flatnonzero(level == k)
        out[here] = np.minimum(table[low[here]], table[high[here] - (1 << k) + 1])
    return out


def _kinds(text: np.ndarray, scratch: Scratch) -> np.ndarray:
    """Whether each suffix is rising; the last one is not."""
    n, step = len(text), 8 * CHUNK
    out = scratch.array(np.bool_, n)
    after, kind_after = None, False
    for b in range(n, 0, -step):
        part = np.asarray(text[max(0, b - step) : b])
        rising, sure = np.zeros(len(part), bool), np.ones(len(part), bool)
        rising[:-1], sure[:-1] = part[:-1] < part[1:], part[:-1] != part[1:]
        if after is not None:
            rising[-1] = part[-1] < after or part[-1] == after and kind_after
        place = np.where(sure, np.arange(len(part)), len(part))
        rising = rising[np.minimum.accumulate(place[::-1])[::-1]]
        out[max(0, b - step) : b] = rising
        after, kind_after = part[0], bool(rising[0])
    return out


def _samples(kinds: np.ndarray, scratch: Scratch) -> np.ndarray:
    """Positions of the rising suffixes that follow a falling one."""
    n, step = len(kinds), 8 * CHUNK
    found = lambda a: np.flatnonzero(kinds[a + 1 : a + 1 + step] & ~kinds[a : min(n - 1, a + step)]) + a + 1
    out = scratch.array(np.int32 if n < 2**31 else np.int64, sum(len(found(a)) for a in range(0, n - 1, step)))
    at = 0
    for a in range(0, n - 1, step):
        here = found(a)
        out[at : at + len(here)] = here
        at += len(here)
    return out


def _common(text: np.ndarray, a: np.ndarray, b: np.ndarray, limit: np.ndarray) -> np.ndarray:
    """How many characters from a and b on are equal, at most limit."""
    n, out = len(text), np.zeros(len(a), np.int64)
    a, b, live, at = a.astype(np.int64), b.astype(np.int64), np.arange(len(a)), 0
    while len(live):
        live = live[(at < limit[live]) & (np.maximum(a[live], b[live]) + at < n)]
        live = live[text[a[live] + at] == text[b[live] + at]]
        at += 1
        out[live] = at
    return out


def _induced(text: np.ndarray, kinds: np.ndarray, seeds: Iterator[Rows], top: int, depth: int, carry: bool, scratch: Scratch, held: int) -> Iterator[Rows]:
    """All suffixes in descending order, each with its prefix with the one before; seeds: the samples in ascending order
    with theirs. Without carry, prefixes are 0 and the seeds may stand in any order: then strings between samples are sorted."""
    n = len(text)
    position = np.int32 if n < 2**31 else np.int64
    up, down = (lambda p: text[p].astype(np.int64)), (lambda p: top - text[p].astype(np.int64))
    falling, starts, done, rising = (Queue(top, k, scratch, held // 4) for k in (up, up, down, down))
    for p, x in seeds:
        starts.put(up(p), p, x)
    end = np.array([n - 1], position)
    falling.put(up(end), end, np.zeros(1, PREFIX))

    def run(p: int) -> int:
        piece = text[p : p + depth]
        other = np.flatnonzero(piece != piece[0])
        return int(other[0]) if len(other) else len(piece)

    def seam(a: int | None, b: int) -> int:
        """The prefix of a falling and a rising suffix of one bucket: the shorter run of their first character."""
        return min(run(a), run(b)) if carry and a is not None else 0

    def hand_on(queue: Queue, key, since: Since, p: np.ndarray, x: np.ndarray, kind: bool) -> None:
        at = np.flatnonzero(p > 0)
        at = at[kinds[p[at] - 1] == kind]
        before = p[at] - 1
        new = since.step(x, at, text[before]) if carry else np.zeros(len(at), PREFIX)
        if len(at):
            queue.put(key(before), before, new)

    since, c = Since(top if carry else 0, depth, scratch), 0
    since.last[int(text[n - 1]) if carry else 0] = 1
    while (c := min((k for k in (falling.least(c), starts.least(c)) if k is not None), default=None)) is not None:
        last, first = None, True
        while (rows := falling.take(c)) is not None:
            done.put(np.full(len(rows[0]), top - c), *rows)
            hand_on(falling, up, since, *rows, False)
            last = int(rows[0][-1])
        while (rows := starts.take(c)) is not None:
            p, x = rows[0], rows[1].copy()
            if first:
                x[0], first = seam(last, int(p[0])), False
            hand_on(falling, up, since, p, x, False)
        c += 1
    falling.drop()
    starts.drop()
    since, c = Since(top if carry else 0, depth, scratch), 0
    while (c := min((k for k in (rising.least(c), done.least(c)) if k is not None), default=None)) is not None:
        last = None
        while (rows := rising.take(c)) is not None:
            yield rows
            hand_on(rising, down, since, *rows, True)
            last = int(rows[0][-1])
        further = None
        while (rows := done.take(c, last=True)) is not None:
            p, x = rows[0][::-1], np.empty(len(rows[0]), PREFIX)
            x[1:] = rows[1][:0:-1]
            x[0] = seam(last, int(p[0])) if further is None else further
            further = rows[1][0]
            yield p, x
            hand_on(rising, down, since, p, x, True)
        c += 1
    done.drop()
    rising.drop()


def _named(text: np.ndarray, kinds: np.ndarray, samples: np.ndarray, top: int, depth: int, scratch: Scratch, held: int) -> tuple[np.ndarray, int]:
    """The rank of the string from each sample to the next one, ends included, and how many ranks there are."""
    m, n = len(samples), len(text)
    names = scratch.array(np.int32 if m < 2**31 else np.int64, m)
    seeds = ((samples[a : a + CHUNK], np.zeros(len(samples[a : a + CHUNK]), PREFIX)) for a in range(0, m, CHUNK))
    name, last = -1, None
    for p, _ in _induced(text, kinds, seeds, top, depth, False, scratch, held):
        p = p[p > 0]
        p = p[kinds[p] & ~kinds[p - 1]]
        if not len(p):
            continue
        index = np.searchsorted(samples, p)
        whole = p if last is None else np.concatenate([last, p])
        size = np.minimum(_sizes(samples, np.searchsorted(samples, whole), n) + 1, depth + 1)
        same = size[1:] == size[:-1]
        pairs = np.flatnonzero(same)
        same[pairs] = _common(text, whole[pairs], whole[pairs + 1], size[pairs]) >= size[pairs]
        new = ~same if last is not None else np.concatenate([[True], ~same])
        found = name + np.cumsum(new)
        names[index] = found
        name, last = int(found[-1]), p[-1:]
    for a in range(0, m, CHUNK):
        names[a : a + CHUNK] = name - names[a : a + CHUNK]
    return names, name + 1


def _sizes(samples: np.ndarray, index: np.ndarray, n: int) -> np.ndarray:
    """How far each sample is from the next one, or from the end."""
    after = np.where(index + 1 < len(samples), samples[np.minimum(index + 1, len(samples) - 1)], n)
    return after.astype(np.int64) - samples[index]


def _doubled(names: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """In memory: positions in the order of their suffixes, and each one's prefix with the one before."""
    m, rank, span = len(names), names.astype(np.int64), 1
    levels = [names]
    while span < depth and int(rank.max()) < m - 1:
        key = rank * (m + 1)
        key[: m - span] += rank[span:] + 1
        order = np.argsort(key)
        key = key[order]
        rank[order] = np.cumsum(np.concatenate([[0], key[1:] != key[:-1]]))
        levels.append(rank.astype(names.dtype))
        span *= 2
    order = np.argsort(rank, kind="stable")
    a, b, shared = order[:-1], order[1:], np.zeros(m, np.int64)
    for k in range(len(levels) - 1, -1, -1):
        x, y = a + shared[1:], b + shared[1:]
        inside = np.flatnonzero(np.maximum(x, y) < m)
        shared[1 + inside] += (levels[k][x[inside]] == levels[k][y[inside]]).astype(np.int64) << k
    return order.astype(names.dtype), np.minimum(shared, depth)


def _ordered(text: np.ndarray, kinds: np.ndarray, samples: np.ndarray, top: int, depth: int, scratch: Scratch, held: int, base: int) -> Iterator[Rows]:
    """The samples in ascending order of their suffixes, each with its prefix with the one before."""
    m, n = len(samples), len(text)
    names, count = _named(text, kinds, samples, top, depth, scratch, held)
    deep = depth // 2 + 2  # names lie two characters apart at least
    if count == m:
        order, shared = scratch.array(names.dtype, m), None
        for a in range(0, m, CHUNK):
            order[names[a : a + CHUNK]] = np.arange(a, min(m, a + CHUNK))
    elif m <= base:
        order, shared = _doubled(np.asarray(names), deep)
    else:
        order, shared, at, further = scratch.array(names.dtype, m), scratch.array(PREFIX, m), m, 0
        for p, x in suffixes(names, count - 1, deep, scratch, held, base):
            order[at - len(p) : at] = p[::-1]
            if at < m:
                shared[at] = x[0]
            shared[at - len(p) + 1 : at] = x[:0:-1]
            at -= len(p)
    for a in range(0, m, CHUNK):
        index = np.asarray(order[max(0, a - 1) : a + CHUNK]).astype(np.int64)
        p = samples[index]
        left, right = index[:-1], p[1:].astype(np.int64)
        skip = np.zeros(len(left), np.int64)
        if shared is not None:
            reach = left + shared[max(0, a - 1) + 1 : a + CHUNK]
            skip = np.where(reach < m, samples[np.minimum(reach, m - 1)], n) - p[:-1].astype(np.int64)
        skip = np.minimum(skip, depth)
        prefix = np.minimum(skip + _common(text, p[:-1] + skip, right + skip, depth - skip), depth).astype(PREFIX)
        yield (p, np.concatenate([np.zeros(1, PREFIX), prefix])) if a == 0 else (p[1:], prefix)


def suffixes(text: np.ndarray, top: int, depth: int, scratch: Scratch, held: int = HELD, base: int = BASE) -> Iterator[Rows]:
    """Positions of all suffixes of a text of characters up to top, in descending order by their first depth characters at
    least, each with the length of its common prefix with the one before, up to depth."""
    if not len(text):
        return
    kinds = _kinds(text, scratch)
    samples = _samples(kinds, scratch)
    seeds = _ordered(text, kinds, samples, top, depth, scratch, held, base) if len(samples) else iter(())
    yield from _induced(text, kinds, seeds, top, depth, True, scratch, held)
