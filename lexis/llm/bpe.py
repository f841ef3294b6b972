"""Byte-level BPE encoding and decoding with vectorised pre-tokenisation.

Pieces are found without regular expressions.  Every code point gets a class
from a table; each class is a transition function on a small set of states
("what is open before this character"), and the functions form a finite
monoid whose composition is one table lookup.  A blocked scan composes them,
which gives the state before every character and with it the piece starts.
Texts of a batch share one scan: the first character of a text carries the
constant function "restart".

Pieces are merged by rank with a bounded cache; ids keep the byte offset of
each piece so that any slice of ids can be mapped back to the text.

Nulls are read as empty texts; an empty text has no ids.  Repeated rows are
encoded once each.  Other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import sys
import unicodedata
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lexis.llm.common import documents, row_chunks, utf8

MAX_CACHE = 400_000
"""Pieces kept with their ids in one Python worker; the cache is emptied when full."""

LONG_PIECE = 64
NO_PAIR = 1 << 40

# Code points with the Unicode property White_Space.
WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]

# Character classes.
LETTER, NUMBER, OTHER, QUOTE1, QUOTE2, SPACE_IN, BLANK_LAST, SPACE_LAST = range(8)
# States: nothing open, in letters / numbers / other signs, after a blank that
# joins the next piece, inside white space, one or two contraction letters due.
FREE, IN_LETTER, IN_NUMBER, IN_OTHER, JOINING, IN_SPACE, DUE_ONE, DUE_TWO = range(8)


def _step(state: int, kind: int) -> tuple[int, bool]:
    """Next state, and whether a piece starts at this character."""
    if kind == SPACE_IN:
        return IN_SPACE, state != IN_SPACE
    if kind == BLANK_LAST:
        return JOINING, True
    if kind == SPACE_LAST:
        return FREE, True
    if kind == LETTER and state == DUE_TWO:
        return DUE_ONE, False
    if kind == LETTER and state == DUE_ONE:
        return FREE, False
    if kind in (QUOTE1, QUOTE2) and state not in (IN_OTHER, JOINING):
        return (DUE_ONE if kind == QUOTE1 else DUE_TWO), True
    own = {LETTER: IN_LETTER, NUMBER: IN_NUMBER}.get(kind, IN_OTHER)
    return own, state not in (own, JOINING)


@lru_cache(None)
def _machine():
    """Monoid elements (as generated), their composition table, results and piece starts."""
    plain = [tuple(_step(s, k)[0] for s in range(8)) for k in range(8)]
    fresh = [tuple(f[FREE] for _ in range(8)) for f in plain]
    elements = list(dict.fromkeys([tuple(range(8)), *plain, *fresh]))
    generators = elements[1:]
    for f in elements:
        for g in generators:
            if (h := tuple(g[x] for x in f)) not in elements:
                elements.append(h)
    index = {f: i for i, f in enumerate(elements)}
    compose = np.array([[index[tuple(g[x] for x in f)] for g in elements] for f in elements], np.uint16)
    generator = np.array([[index[f] for f in plain], [index[f] for f in fresh]], np.uint16)
    from_free = np.array([f[FREE] for f in elements], np.uint8)
    starts = np.array([[_step(s, k)[1] for k in range(8)] for s in range(8)])
    return compose, generator, from_free, starts


@lru_cache(None)
def _classes() -> np.ndarray:
    table = np.full(sys.maxunicode + 1, OTHER, np.uint8)
    for point in range(sys.maxunicode + 1):
        kind = unicodedata.category(chr(point))[0]
        if kind == "L":
            table[point] = LETTER
        elif kind == "N":
            table[point] = NUMBER
    table[WHITE_SPACE] = SPACE_IN
    return table


def _scan(elements: np.ndarray, compose: np.ndarray) -> np.ndarray:
    """Composition of all elements up to and including each place (associative, blocked)."""
    n, width = len(elements), 128
    if n <= width:
        out = elements.copy()
        for i in range(1, n):
            out[i] = compose[out[i - 1], out[i]]
        return out
    rows = -(-n // width)
    grid = np.zeros(rows * width, np.uint16)  # element 0 is the identity
    grid[:n] = elements
    grid = np.ascontiguousarray(grid.reshape(rows, width).T)
    flat, size = compose.ravel(), np.int64(len(compose))
    for i in range(1, width):
        grid[i] = flat[grid[i - 1] * size + grid[i]]
    before = np.zeros(rows, np.uint16)
    before[1:] = _scan(grid[-1], compose)[:-1]
    grid = flat[before[None, :] * size + grid]
    return grid.T.ravel()[:n]


def piece_starts(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Byte offsets at which pieces start, for the concatenated texts ``raw``."""
    if not len(raw):
        return np.zeros(0, np.int64)
    points = np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), "<u4")
    lead = np.flatnonzero((raw & 0xC0) != 0x80)
    kinds = _classes()[points]
    opening = np.zeros(len(points) + 3, bool)
    opening[np.searchsorted(lead, offsets)] = True
    opening[len(points):] = True
    after = np.zeros(len(points) + 2, np.uint32)
    after[:len(points)] = points
    quotes = np.flatnonzero(points == ord("'"))
    if len(quotes):
        one = np.where(opening[quotes + 1], 0, after[quotes + 1])
        two = np.where(opening[quotes + 1] | opening[quotes + 2], 0, after[quotes + 2])
        kinds[quotes[np.isin(one, [ord(c) for c in "stmd"])]] = QUOTE1
        pair = (np.isin(one, [ord(c) for c in "rv"]) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
        kinds[quotes[pair]] = QUOTE2
    space = kinds == SPACE_IN
    following = np.zeros(len(points), bool)
    following[:-1] = ~space[1:]
    following &= ~opening[1:len(points) + 1]
    last = space & following
    kinds[last] = np.where(points[last] == 0x20, BLANK_LAST, SPACE_LAST)
    compose, generator, from_free, starts = _machine()
    first = opening[:len(points)]
    state = from_free[_scan(generator[first.astype(np.int64), kinds], compose)]
    before = np.zeros(len(points), np.uint8)
    before[1:] = state[:-1]
    before[first] = FREE
    return lead[starts[before, kinds]]


class Encoder:
    """Ranks of one tokenizer file with a bounded piece cache."""

    def __init__(self, path: str):
        with open(path, "rb") as file:
            pairs = [line.split() for line in file if line.strip()]
        self.ranks = {base64.b64decode(token): int(rank) for token, rank in pairs}
        self.tokens = {rank: token for token, rank in self.ranks.items()}
        self.cache: dict[bytes, tuple[int, ...]] = {}
        self.byte_ids = np.array([self.ranks[bytes([i])] for i in range(256)], np.int64)
        pairs = [(a << 32 | b, rank) for token, rank in self.ranks.items() for i in range(1, len(token))
                 if (a := self.ranks.get(token[:i])) is not None and (b := self.ranks.get(token[i:])) is not None]
        self.pair_keys, self.pair_ranks = np.array(sorted(pairs), np.int64).T.copy()

    def merge(self, pieces: list[bytes]) -> list[tuple[int, ...]]:
        """Ids of pieces: in each, the adjacent pair of lowest rank is merged, leftmost first, until none is left.

        One merge a round in every unfinished piece at once; pieces of over
        ``LONG_PIECE`` bytes use a heap of pairs instead.
        """
        out: list = [None] * len(pieces)
        short = []
        for i, piece in enumerate(pieces):
            if (whole := self.ranks.get(piece)) is not None:
                out[i] = (whole,)
            elif len(piece) > LONG_PIECE:
                out[i] = self._long([piece[j:j + 1] for j in range(len(piece))])
            else:
                short.append(i)
        if not short:
            return out
        sizes = np.fromiter((len(pieces[i]) for i in short), np.int64, len(short))
        ids = self.byte_ids[np.frombuffer(b"".join([pieces[i] for i in short]), np.uint8)]
        owner = np.repeat(np.arange(len(short)), sizes)
        ranks = self._pairs(ids, owner)
        while len(ids):
            first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            best = np.minimum.reduceat(ranks, first)
            size = np.diff(np.r_[first, len(ids)])
            over = best == NO_PAIR
            if over.any():
                done = np.repeat(over, size)
                flat, begin = ids[done].tolist(), 0
                for i, n in zip(owner[first[over]].tolist(), size[over].tolist()):
                    out[short[i]] = tuple(flat[begin:begin + n])
                    begin += n
                ids, owner, ranks = ids[~done], owner[~done], ranks[~done]
                best, size = best[~over], size[~over]
                if not len(ids):
                    break
            hits = np.flatnonzero(ranks == np.repeat(best, size))
            hits = hits[np.r_[True, owner[hits[1:]] != owner[hits[:-1]]]]
            ids[hits] = ranks[hits]
            keep = np.ones(len(ids), bool)
            keep[hits + 1] = False
            places = np.cumsum(keep)[hits] - 1
            ids, owner, ranks = ids[keep], owner[keep], ranks[keep]
            for at in (places, places[places > 0] - 1):
                ranks[at] = self._pairs(np.r_[ids, 0], np.r_[owner, -1], at)
        return out

    def _pairs(self, ids: np.ndarray, owner: np.ndarray, at: np.ndarray | None = None) -> np.ndarray:
        """Rank of the token that ids[i] and ids[i + 1] form within one piece, else NO_PAIR."""
        if at is None:
            ids, owner = np.r_[ids, 0], np.r_[owner, -1]
            at = np.arange(len(ids) - 1)
        keys = ids[at] << 32 | ids[at + 1]
        found = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        return np.where((self.pair_keys[found] == keys) & (owner[at] == owner[at + 1]), self.pair_ranks[found], NO_PAIR)

    def _long(self, parts: list[bytes]) -> tuple[int, ...]:
        """The same merges for long pieces with a heap of pairs over a linked list."""
        import heapq

        ranks, n = self.ranks, len(parts)
        left, right, alive = list(range(-1, n - 1)), list(range(1, n + 1)), [True] * n
        heap = [(r, i, a, b) for i, (a, b) in enumerate(zip(parts, parts[1:])) if (r := ranks.get(a + b)) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = right[i]
            if not alive[i] or j >= n or parts[i] != a or parts[j] != b:
                continue
            parts[i], alive[j], right[i] = a + b, False, right[j]
            if right[j] < n:
                left[right[j]] = i
            for x, y in ((left[i], i), (i, right[i])):
                if x >= 0 and y < n and (r := ranks.get(parts[x] + parts[y])) is not None:
                    heapq.heappush(heap, (r, x, parts[x], parts[y]))
        return tuple(ranks[parts[i]] for i in range(n) if alive[i])

    def rows(self, raw: np.ndarray, offsets: np.ndarray):
        """(ids, byte offsets of the pieces, ids of each piece) of every text in turn."""
        starts = piece_starts(raw, offsets)
        ends = np.append(starts[1:], len(raw))
        data, cache = raw.tobytes(), self.cache
        edge = np.searchsorted(starts, offsets).tolist()
        pieces = [data[a:b] for a, b in zip(starts.tolist(), ends.tolist())]
        if len(cache) > MAX_CACHE:
            cache.clear()
        missing = [piece for piece in set(pieces) if piece not in cache]
        cache.update(zip(missing, self.merge(missing)))
        found = list(map(cache.__getitem__, pieces))
        for row, (lo, hi) in enumerate(zip(edge, edge[1:])):
            yield list(chain.from_iterable(found[lo:hi])), starts[lo:hi] - offsets[row], found[lo:hi]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


@lru_cache(4)
def encoder(path: str) -> Encoder:
    return Encoder(path)


ENCODED = "doc_id long, n_tokens long, ids array<int>, piece_start array<int>, piece_tokens array<int>"
DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def _map(df: DataFrame, path: str, schema: str, fields: pa.Schema, make) -> DataFrame:
    def run(batches):
        enc = encoder(path)
        try:
            for batch in batches:
                raw, offsets = utf8(batch.column("text"))
                keys = batch.column("doc_id")
                for lo, hi in row_chunks(offsets):
                    part = raw[offsets[lo]:offsets[hi]]
                    rows = [make(enc, *row) for row in enc.rows(part, offsets[lo:hi + 1] - offsets[lo])]
                    columns = [keys.slice(lo, hi - lo), *map(list, zip(*rows))]
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) if isinstance(c, list) else c for c, f in zip(columns, fields)], schema=fields)
        finally:
            enc.cache.clear()  # an idle worker, kept for other stages, holds no pieces

    return documents(df).mapInArrow(run, schema)


def encode(df: DataFrame, path: str) -> DataFrame:
    """Ids of every text with the byte offset and id count of each piece.

    ``path`` names a rank file that every executor can open (a shared or
    installed file).
    """
    ints = pa.list_(pa.int32())
    fields = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", ints), ("piece_start", ints), ("piece_tokens", ints)])
    return _map(df, path, ENCODED, fields, lambda enc, ids, starts, pieces: (len(ids), np.array(ids, np.int32), starts.astype(np.int32), np.fromiter(map(len, pieces), np.int32)))


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """``doc_id`` and the bytes that the ids stand for (null ids: empty)."""
    def run(batches):
        enc = encoder(path)
        for batch in batches:
            data = [enc.decode(ids or []) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(data, pa.binary())], names=["doc_id", "bytes"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, bytes binary")


def round_trip_digests(df: DataFrame, path: str) -> DataFrame:
    """Encode and decode every text in one pass; only counts and digests leave the task."""
    def make(enc, ids, starts, pieces):
        packed = np.array(ids, "<u4").tobytes()
        return len(ids), hashlib.sha256(packed).hexdigest(), hashlib.sha256(enc.decode(ids)).hexdigest()

    fields = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])
    return _map(df, path, DIGESTS, fields, make)
