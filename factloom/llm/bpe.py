"""Byte-level BPE encoding and decoding.

Pre-tokenisation never runs a regular expression: every code point becomes a
symbol, every symbol a function on the eight states of a small automaton, and a
prefix scan composes these functions (composition is associative, and the
monoid they generate is small enough for a composition table). The states tell
where pieces begin. Pieces then go through a bounded cache of merged pairs.

Defined results: a null or empty text has no tokens; rows repeat as they are
given; a text of any length is one row, and merging uses a heap, so that a piece
of n bytes costs n log n. The file of ranks is read where the work is done: it
must lie at the same path on every executor, as an installed package does.
"""

from __future__ import annotations

import base64
import heapq
import unicodedata
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.arrow import map_texts

MAX_CACHED = 100_000
PIECE = 1 << 19  # bytes of text encoded at a time
SHORT = 48
NONE = 1 << 40

# Symbols. A letter that can stand in a contraction has a symbol of its own.
END, BLANK, SPACE, NUMBER, OTHER, QUOTE, LETTER, SINGLE, LETTER_E, FIRST, DOUBLE_L, LONE_L = range(12)
# States after a symbol.
IN_BLANK, IN_SPACE, IN_LETTERS, IN_NUMBERS, IN_OTHERS, AT_QUOTE, HALF, CLOSED = range(8)

# The code points of Unicode's White_Space property.
WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


def _steps() -> np.ndarray:
    """The state that follows each state, by symbol."""
    to = np.full((12, 8), IN_LETTERS, np.uint8)
    for symbol, state in ((END, IN_BLANK), (BLANK, IN_BLANK), (SPACE, IN_SPACE), (NUMBER, IN_NUMBERS), (OTHER, IN_OTHERS)):
        to[symbol] = state
    to[QUOTE] = AT_QUOTE
    to[QUOTE, [IN_SPACE, IN_OTHERS, AT_QUOTE]] = IN_OTHERS
    to[SINGLE, AT_QUOTE] = CLOSED
    to[[FIRST, DOUBLE_L], AT_QUOTE] = HALF
    to[[LETTER_E, DOUBLE_L, LONE_L], HALF] = CLOSED
    return to


def _begins() -> np.ndarray:
    """Whether a piece begins at a symbol, by the state before it; blanks are decided by what follows them."""
    new = np.ones((8, 12), bool)
    letters = [LETTER, SINGLE, LETTER_E, FIRST, DOUBLE_L, LONE_L]
    for state in (IN_LETTERS, IN_SPACE, HALF):
        new[state, letters] = False
    new[AT_QUOTE, [SINGLE, FIRST, DOUBLE_L]] = False
    new[[IN_NUMBERS, IN_SPACE], NUMBER] = False
    for state in (IN_OTHERS, IN_SPACE, AT_QUOTE):
        new[state, [OTHER, QUOTE]] = False
    return new


@cache
def _monoid() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids of the symbols' functions, the composition table (earlier, later), and each constant function's value (255: not constant)."""
    known: dict[bytes, int] = {}
    for row in _steps():
        known.setdefault(row.tobytes(), len(known))
    while True:
        rows = [np.frombuffer(k, np.uint8) for k in known]
        found = {later[earlier].tobytes() for earlier in rows for later in rows} - known.keys()
        if not found:
            break
        for k in sorted(found):
            known[k] = len(known)
    table = np.array([[known[later[earlier].tobytes()] for later in rows] for earlier in rows], np.uint8)
    value = np.array([r[0] if (r == r[0]).all() else 255 for r in rows], np.uint8)
    return np.array([known[r.tobytes()] for r in _steps()], np.uint8), table, value


@cache
def _symbols() -> np.ndarray:
    kinds = {"L": LETTER, "N": NUMBER}
    out = np.fromiter((kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)), np.uint8, 0x110000)
    out[WHITE_SPACE] = BLANK
    out[0x20], out[ord("'")] = SPACE, QUOTE
    for letters, symbol in (("stmd", SINGLE), ("e", LETTER_E), ("rv", FIRST), ("l", DOUBLE_L)):
        out[[ord(c) for c in letters]] = symbol
    return out


def piece_starts(points: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Mask of the positions at which a piece begins. ends: positions of the separators between texts (begin pieces too)."""
    n = len(points)
    if not n:
        return np.zeros(0, bool)
    symbol = _symbols()[points]
    after = np.append(points[1:], 0)
    symbol[(symbol == FIRST) & (after != ord("e"))] = LETTER
    symbol[(symbol == DOUBLE_L) & (after != ord("l"))] = LONE_L
    symbol[ends] = END
    first, compose, value = _monoid()
    function = first[symbol]
    open_, reach = np.flatnonzero(value[function] == 255), 1
    while len(open_):
        inside = open_[open_ >= reach]
        function[inside] = compose[function[inside - reach], function[inside]]
        open_, reach = inside[value[function[inside]] == 255], reach * 2
    state = value[function]
    early = np.flatnonzero(state == 255)  # no constant before them: the automaton's first state decides
    if len(early):
        known = _functions()
        state[early] = known[function[early], IN_BLANK]
    before = np.empty(n, np.uint8)
    before[0], before[1:] = IN_BLANK, state[:-1]
    begins = _begins()[before, symbol]
    blank = (symbol == BLANK) | (symbol == SPACE)
    solid_next = np.append(~(blank | (symbol == END))[1:], False)
    np.copyto(begins, solid_next, where=blank & (before <= IN_SPACE))
    begins[0] = True
    begins[ends] = True
    begins[ends[ends < n - 1] + 1] = True
    return begins


@cache
def _functions() -> np.ndarray:
    first, table, _ = _monoid()
    rows = np.zeros((len(table), 8), np.uint8)
    rows[first] = _steps()
    done = set(first.tolist())
    while len(done) < len(table):
        for a in list(done):
            for b in list(done):
                if table[a, b] not in done:
                    rows[table[a, b]] = rows[b][rows[a]]
                    done.add(int(table[a, b]))
    return rows


class Encoder(dict):
    """Maps a piece to the place of its merged tokens in the arrays at, size and flat; emptied beyond ``MAX_CACHED`` pieces."""

    def __init__(self, path: str):
        super().__init__()
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.token = [b""] * (max(self.ranks.values()) + 1)
        for b, i in self.ranks.items():
            self.token[i] = b
        self.width = np.array([len(b) for b in self.token], np.int64)
        self.start = np.cumsum(self.width) - self.width
        self.bytes = np.frombuffer(b"".join(self.token), np.uint8)
        self.single = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        get = self.ranks.get
        pairs = [(get(b[:k], -1) << 32 | get(b[k:], -1), r) for b, r in self.ranks.items() for k in range(1, len(b)) if b[:k] in self.ranks and b[k:] in self.ranks]
        pairs.sort()
        self.pairs, self.joined = (np.array(x, np.int64) for x in zip(*pairs))
        self.reset()

    def reset(self) -> None:
        self.clear()
        self.at, self.size, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def learn(self, pieces: list[str]) -> None:
        """Merge pieces that the cache lacks: short ones together, round by round, and long ones by a heap each."""
        raws = [p.encode() for p in pieces]
        whole = [self.ranks.get(r) for r in raws]
        done = [(i, np.array([r], np.int32)) for i, r in enumerate(whole) if r is not None]
        rest = [i for i, r in enumerate(whole) if r is None]
        done += [(i, np.array(self._merge_long(raws[i], len(raws[i])), np.int32)) for i in rest if len(raws[i]) > SHORT]
        short = [i for i in rest if len(raws[i]) <= SHORT]
        if short:
            ids, size = self._merge_short([raws[i] for i in short])
            upto = np.cumsum(size)
            done += [(i, ids[b - n : b]) for i, n, b in zip(short, size.tolist(), upto.tolist())]
        k = len(self)
        size = np.fromiter((len(x) for _, x in done), np.int64, len(done))
        self.flat = np.concatenate([self.flat, *(x for _, x in done)])
        self.at = np.concatenate([self.at, len(self.flat) - size.sum() + np.cumsum(size) - size])
        self.size = np.concatenate([self.size, size])
        self.update((pieces[i], k + j) for j, (i, _) in enumerate(done))

    def _ranks_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) << 32 | right
        found = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where(self.pairs[found] == key, self.joined[found], NONE)

    def _merge_short(self, raws: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """In each round every piece joins its pair of least rank, the leftmost of equals. Ids of all pieces in order, and how many each has."""
        size = np.fromiter(map(len, raws), np.int64, len(raws))
        part = self.single[np.frombuffer(b"".join(raws), np.uint8)]
        piece = np.repeat(np.arange(len(raws)), size)
        rank = np.full(len(part), NONE, np.int64)
        inner = np.flatnonzero(piece[1:] == piece[:-1])
        rank[inner] = self._ranks_of(part[inner], part[inner + 1])
        out = []
        while len(part):
            begins = np.flatnonzero(np.diff(piece, prepend=-1))
            count = np.diff(np.append(begins, len(part)))
            least = np.minimum.reduceat(rank, begins)
            over = np.repeat(least == NONE, count)
            if over.any():
                out.append((piece[over], part[over]))
                part, piece, rank = part[~over], piece[~over], rank[~over]
                least, count = least[least < NONE], count[least < NONE]
                if not len(part):
                    break
            at = np.flatnonzero(rank == np.repeat(least, count))
            at = at[np.flatnonzero(np.diff(piece[at], prepend=-1))]
            part[at] = rank[at]
            keep = np.ones(len(part), bool)
            keep[at + 1] = False
            at -= np.arange(len(at))  # as the row before each of these that is dropped shifts them
            rank[np.flatnonzero(~keep) - 1] = rank[~keep]  # NONE still marks the end of a piece
            part, piece, rank = part[keep], piece[keep], rank[keep]
            for left in (at, at[at > 0] - 1):
                left = left[left + 1 < len(part)]
                same = left[piece[left] == piece[left + 1]]
                rank[same] = self._ranks_of(part[same], part[same + 1])
            last = at[(at + 1 == len(part)) | (piece[np.minimum(at + 1, len(part) - 1)] != piece[at])]
            rank[last] = NONE
        owner = np.concatenate([x for x, _ in out])
        order = np.argsort(owner, kind="stable")
        return np.concatenate([x for _, x in out])[order], np.bincount(owner, minlength=len(raws))

    def _merge_long(self, raw: bytes, n: int) -> list[int]:
        ranks = self.ranks
        end = list(range(1, n + 1))  # of the part that begins here; 0: none does
        back = list(range(-1, n))
        heap = [(ranks[raw[i : i + 2]], i, i + 2) for i in range(n - 1) if raw[i : i + 2] in ranks]
        heapq.heapify(heap)
        while heap:
            _, a, stop = heapq.heappop(heap)
            b = end[a]
            if not b or b == n or end[b] != stop:
                continue
            end[a], end[b] = stop, 0
            if stop < n:
                back[stop] = a
                if (r := ranks.get(raw[a : end[stop]])) is not None:
                    heapq.heappush(heap, (r, a, end[stop]))
            if (p := back[a]) >= 0 and (r := ranks.get(raw[p:stop])) is not None:
                heapq.heappush(heap, (r, p, stop))
        out, i = [], 0
        while i < n:
            out.append(ranks[raw[i : end[i]]])
            i = end[i]
        return out

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts in order, and where each text's ids end."""
        if len(self) > MAX_CACHED:
            self.reset()
        whole = "\n".join(texts) + "\n"
        points = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        ends = np.cumsum(lengths + 1) - 1
        starts = np.flatnonzero(piece_starts(points, ends))
        stops = np.append(starts[1:], len(points))
        keep = ~np.isin(starts, ends, assume_unique=True)
        starts, stops = starts[keep], stops[keep]
        found = [whole[a:b] for a, b in zip(starts.tolist(), stops.tolist())]
        new = set(found) - self.keys()
        if new:
            self.learn(sorted(new))
        codes = np.fromiter(map(self.__getitem__, found), np.int64, len(starts))
        size = self.size[codes]
        upto = np.cumsum(size)
        total = int(upto[-1]) if len(upto) else 0
        ids = self.flat[np.repeat(self.at[codes] - (upto - size), size) + np.arange(total)]
        return ids, np.concatenate([[0], upto])[np.searchsorted(starts, ends)]

    def offsets(self, ids: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """The byte at which each token ends in its own text; bounds: where each text's ids begin, and the end of all."""
        upto = np.concatenate([[0], np.cumsum(self.width[ids])])
        return (upto[1:] - np.repeat(upto[bounds[:-1]], np.diff(bounds))).astype(np.int32)

    def decode(self, ids: np.ndarray, ends: np.ndarray) -> bytes:
        """The bytes of one text: every token is laid down where its offset says."""
        width = self.width[ids]
        begins = ends - width
        source = np.repeat(self.start[ids] - begins, width)
        out = np.empty(int(ends[-1]) if len(ends) else 0, np.uint8)
        place = np.arange(len(source)) + np.repeat(begins - (np.cumsum(width) - width), width)
        out[place] = self.bytes[source + place]
        return out.tobytes()


@cache
def encoder(path: str) -> Encoder:
    return Encoder(path)


def encode_documents(rows: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Columns: the id, ids (array of int), ends (array of int: the byte offset at which each token ends)."""

    def make():
        coder = encoder(path)

        def work(_, texts):
            ids, stops = coder.encode(texts)
            bounds = np.concatenate([[0], stops]).astype(np.int32)
            return [pa.ListArray.from_arrays(bounds, pa.array(x)) for x in (ids, coder.offsets(ids, bounds))]

        return work

    return map_texts(rows, id_col, text_col, make, "ids array<int>, ends array<int>", limit=PIECE)


def round_trip(rows: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encoding and decoding in one pass of one worker: the id, ids, ends (byte offsets), and decoded, the bytes that
    ids and offsets give."""

    def make():
        coder = encoder(path)

        def work(_, texts):
            ids, stops = coder.encode(texts)
            bounds = np.concatenate([[0], stops]).astype(np.int32)
            ends = coder.offsets(ids, bounds)
            decoded = [coder.decode(ids[a:b], ends[a:b]) for a, b in zip(bounds[:-1], bounds[1:])]
            return [*(pa.ListArray.from_arrays(bounds, pa.array(x)) for x in (ids, ends)), pa.array(decoded, pa.binary())]

        return work

    return map_texts(rows, id_col, text_col, make, "ids array<int>, ends array<int>, decoded binary", limit=PIECE)


def decode_documents(rows: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """The given rows' id and ids, and the bytes they stand for (column decoded); null ids decode to no bytes."""
    source = rows.select(F.col(id_col), F.coalesce(F.col(ids_col), F.array().cast("array<int>")).alias("ids"))
    kind = source.schema[0].dataType.simpleString()

    def run(batches):
        coder = encoder(path)
        for batch in batches:
            lists = batch.column(1)
            ids, at = lists.values.to_numpy()[: lists.offsets[-1].as_py()], lists.offsets.to_numpy()
            ends = coder.offsets(ids, np.concatenate([[0], at[1:]]))
            out = [coder.decode(ids[a:b], ends[a:b]) for a, b in zip(at[:-1], at[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0), lists, pa.array(out, pa.binary())], names=[id_col, "ids", "decoded"])

    return source.mapInArrow(run, f"`{id_col}` {kind}, ids array<int>, decoded binary")
