"""Byte-level BPE through a pair occurrence index, for tokenizer files with merges and added tokens.

Texts are cut at the added tokens, then into pieces: letters, numbers or other
signs with an optional blank before them, contractions, runs of white space.
Every piece start follows from its neighbouring characters, so that whole
batches are cut with array comparisons.

The distinct pieces of a step are laid side by side.  An index maps the rank
of each mergeable pair to all its positions; active ranks are taken in
ascending order, all positions of a rank are merged at once, and only the
lists of the pairs beside a merge are updated.  This equals merging each piece
on its own because no merge can make a pair of a lower rank than its own
(checked when the file is read).

Nulls are read as empty texts; an empty text has no ids.  Repeated rows are
encoded once each.  Other columns are ignored.  Texts longer than
``common.CHUNK_BYTES`` pass through in parts, cut before white space that
follows a visible ASCII sign, where a piece always starts; only a longer run
without such a place forms a larger step.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lexis.llm import common
from lexis.llm.common import documents, utf8

CACHE_BYTES = 16 << 20
"""Bytes of pieces kept with their ids in one Python worker; the cache starts anew beyond that."""

LETTER, NUMBER, SIGN, SPACE = range(4)
NONE = np.int64(1) << 40

_SAFE_CUT = re.compile(rb"[!-~](?=[\t-\r ])")


@lru_cache(4)
def character_classes(path: str) -> np.ndarray:
    """Class of every code point, as the file's own pre-tokenizer groups it.

    Unicode versions differ between libraries; a code point is a letter or a
    number here exactly if the tokenizer joins it with one.
    """
    from tokenizers import Tokenizer

    split = Tokenizer.from_file(path).pre_tokenizer.pre_tokenize_str
    probes = ((LETTER, "a"), (NUMBER, "1"), (SIGN, "!"))
    table = np.full(0x110000, SPACE, np.uint8)

    def alike(text: str) -> int | None:
        return next((kind for kind, beside in probes if len(split(beside + text)) == 1), None)

    for lo in range(0, 0x110000, 256):
        if 0xD800 <= lo < 0xE000:
            continue
        kind = alike("".join(map(chr, range(lo, lo + 256))))
        if kind is not None:
            table[lo:lo + 256] = kind
            continue
        for point in range(lo, lo + 256):
            kind = alike(chr(point))
            table[point] = SPACE if kind is None else kind
    return table


def _byte_letters() -> dict[str, int]:
    """The printable stand-in of each byte in tokenizer files: itself if visible in Latin-1, else the next from 256."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in visible]
    return {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Merges:
    """Vocabulary, merges and added tokens of one tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            content = json.load(file)
        model, letters = content["model"], _byte_letters()
        vocab = model["vocab"]
        self.added = {t["content"].encode(): t["id"] for t in content["added_tokens"]}
        size = max([*vocab.values(), *self.added.values()]) + 1
        tokens = [b""] * size
        for token, i in vocab.items():
            tokens[i] = bytes(letters[c] for c in token)
        for token, i in self.added.items():
            tokens[i] = token
        self.token_at = np.cumsum([0, *map(len, tokens)])
        self.token_bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self.byte_ids = np.zeros(256, np.int64)
        for letter, b in letters.items():
            self.byte_ids[b] = vocab[letter]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        left, right, made = (np.array([vocab[x] for x in side], np.int64) for side in (*zip(*merges), [a + b for a, b in merges]))
        born = np.full(size, -1)
        born[made[::-1]] = np.arange(len(merges))[::-1]
        if (np.maximum(born[left], born[right]) >= np.arange(len(merges))).any():
            raise ValueError("a merge stands before the merges that make its parts")
        order = np.argsort(left << 32 | right, kind="stable")
        self.pair_keys, self.pair_ranks, self.made = (left << 32 | right)[order], order, made
        self.classes = character_classes(path)
        self.cache: dict[bytes, int] = {}
        self._empty_cache()

    def _empty_cache(self):
        self.cache.clear()
        self.cached_bytes, self.table, self.table_at = 0, np.zeros(0, np.int64), np.zeros(1, np.int64)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left << 32 | right
        found = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[found] == keys, self.pair_ranks[found], NONE)

    def merge(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces one after the other, and the place where each piece's ids begin (pieces + 1 entries)."""
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        edge = np.r_[0, np.cumsum(sizes)]
        ids = self.byte_ids[np.frombuffer(b"".join(pieces), np.uint8)]
        n = len(ids)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        after[edge[1:][sizes > 0] - 1] = -1
        before[edge[:-1][sizes > 0]] = -1
        rank = np.full(n, NONE)
        linked = np.flatnonzero(after >= 0)
        rank[linked] = self.ranks(ids[linked], ids[after[linked]])
        alive = np.ones(n, bool)
        index: dict[int, list[np.ndarray]] = {}

        def note(places: np.ndarray):
            """Enter places under their pairs' ranks."""
            places = places[rank[places] != NONE]
            if not len(places):
                return
            order = places[np.argsort(rank[places], kind="stable")]
            values = rank[order]
            cuts = [0, *(np.flatnonzero(values[1:] != values[:-1]) + 1).tolist(), len(order)]
            for lo, hi in zip(cuts, cuts[1:]):
                r, part = int(values[lo]), order[lo:hi]
                if r not in index:
                    index[r] = []
                    heapq.heappush(active, r)
                index[r].append(part)

        active: list[int] = []
        note(linked)
        while active:
            r = heapq.heappop(active)
            at = index.pop(r)
            at = _sorted_set(np.concatenate(at) if len(at) > 1 else at[0])
            at = at[rank[at] == r]  # merged away or changed since it was entered
            if not len(at):
                continue
            if len(at) > 1 and ids[at[0]] == ids[after[at[0]]]:
                # a run of one token: every other pair, from the left
                fresh = np.r_[True, after[at[:-1]] != at[1:]]
                opens = np.flatnonzero(fresh)
                at = at[(np.arange(len(at)) - np.repeat(opens, np.diff(np.r_[opens, len(at)]))) % 2 == 0]
            gone = after[at]
            ids[at] = self.made[r]
            beyond = after[gone]
            after[at] = beyond
            inner = beyond >= 0
            before[beyond[inner]] = at[inner]
            alive[gone] = False
            rank[gone] = NONE
            prior = before[at]
            changed = _sorted_set(np.concatenate((at, prior[prior >= 0])))
            beside = after[changed]
            rank[changed] = np.where(beside >= 0, self.ranks(ids[changed], ids[beside]), NONE)
            note(changed)
        return ids[alive], np.r_[0, np.cumsum(alive)][edge]

    def piece_starts(self, raw: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Byte offsets at which pieces start; nothing is joined over the byte offsets ``bounds``."""
        if not len(raw):
            return np.zeros(0, np.int64)
        points = np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), "<u4")
        lead = np.flatnonzero((raw & 0xC0) != 0x80)
        n = len(points)
        kinds = self.classes[points]
        opens = np.zeros(n + 3, bool)
        opens[np.searchsorted(lead, bounds)] = True
        opens[n:] = True
        blank = points == 0x20
        space = kinds == SPACE
        before_kind = np.r_[np.uint8(SPACE), kinds[:-1]]
        before_blank = np.r_[False, blank[:-1]] & ~opens[:n]
        closes = opens[1:n + 1]  # the last character of its text
        next_space = np.r_[space[1:], False]
        run_goes_on = space & (np.r_[False, space[:-1]] & ~opens[:n])
        gives_back = space & ~closes & ~next_space  # the last of a run that a visible character follows
        start = np.where(space, ~run_goes_on | gives_back, (before_kind != kinds) & ~before_blank)
        start |= opens[:n]
        quotes = np.flatnonzero((points == 0x27) & (opens[:n] | ~(before_blank | (before_kind == SIGN))))
        if len(quotes):
            padded = np.r_[points, 0, 0]
            one = np.where(opens[quotes + 1], 0, padded[quotes + 1])
            two = np.where(opens[quotes + 1] | opens[quotes + 2], 0, padded[quotes + 2])
            short = np.isin(one, [ord(c) for c in "stmd"])
            long = (np.isin(one, [ord(c) for c in "rv"]) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
            for size, found in ((2, quotes[short]), (3, quotes[long])):
                start[found] = True
                for i in range(1, size):
                    start[found + i] = False
                start[(found + size)[found + size < n]] = True
        return lead[start]

    def encode(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts one after the other, and where each text's ids begin (texts + 1 entries)."""
        data = raw.tobytes()
        marks = sorted((m.start(), m.end(), i) for token, i in self.added.items() for m in re.finditer(re.escape(token), data))
        marks = [m for m in marks if np.searchsorted(offsets, m[0], "right") == np.searchsorted(offsets, m[1], "left")]
        bounds = np.unique(np.r_[offsets, [x for m in marks for x in m[:2]]].astype(np.int64))
        starts = self.piece_starts(raw, bounds)
        if marks:
            inside = np.searchsorted([m[0] for m in marks], starts, "right") - 1
            starts = starts[(inside < 0) | (starts >= np.array([m[1] for m in marks])[inside]) | (starts == np.array([m[0] for m in marks])[inside])]
        ends = np.append(starts[1:], len(raw))
        pieces = [data[a:b] for a, b in zip(starts.tolist(), ends.tolist())]
        missing = [piece for piece in dict.fromkeys(pieces) if piece not in self.cache]
        if self.cached_bytes > CACHE_BYTES and missing:
            self._empty_cache()
            missing = list(dict.fromkeys(pieces))
        if missing:
            made, at = self.merge(missing)
            self.cache.update(zip(missing, range(len(self.cache), len(self.cache) + len(missing))))
            self.table_at = np.r_[self.table_at, at[1:] + len(self.table)]
            self.table = np.r_[self.table, made]
            self.cached_bytes += sum(map(len, missing))
        entry = np.fromiter(map(self.cache.__getitem__, pieces), np.int64, len(pieces))
        begin, size = self.table_at[entry], self.table_at[entry + 1] - self.table_at[entry]
        special = np.searchsorted(starts, [m[0] for m in marks])
        size[special] = 1
        at = np.r_[0, np.cumsum(size)]
        ids = self.table[_gathered(begin, size, at) % max(len(self.table), 1)] if len(pieces) else np.zeros(0, np.int64)
        ids[at[special]] = [m[2] for m in marks]
        return ids, at[np.searchsorted(starts, offsets)]

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The bytes that ids stand for (ids that the file does not know stand for none)."""
        ids = np.asarray(ids, np.int64)
        ids = ids[(ids >= 0) & (ids < len(self.token_at) - 1)]
        begin, size = self.token_at[ids], self.token_at[ids + 1] - self.token_at[ids]
        return self.token_bytes[_gathered(begin, size, np.r_[0, np.cumsum(size)])]


def _sorted_set(places: np.ndarray) -> np.ndarray:
    if len(places) < 2:
        return places
    places = np.sort(places)
    new = np.empty(len(places), bool)
    new[0] = True
    np.not_equal(places[1:], places[:-1], out=new[1:])
    return places[new]


def _gathered(begin: np.ndarray, size: np.ndarray, at: np.ndarray) -> np.ndarray:
    """begin[i], begin[i] + 1, ... (size[i] of them) for every i; ``at`` holds the running sum of ``size``."""
    return np.arange(at[-1]) + np.repeat(begin - at[:-1], size)


@lru_cache(4)
def merges(path: str) -> Merges:
    return Merges(path)


def _steps(raw: np.ndarray, offsets: np.ndarray):
    """(first row, byte bounds) of each step: whole texts together, or a part of one long text."""
    limit = common.CHUNK_BYTES
    for lo, hi in common.row_chunks(offsets, limit):
        if hi - lo > 1 or offsets[hi] - offsets[lo] <= limit:
            yield lo, offsets[lo:hi + 1]
            continue
        begin, end, data = int(offsets[lo]), int(offsets[hi]), raw[offsets[lo]:offsets[hi]].tobytes()
        first = begin
        while end - begin > limit and (cut := _SAFE_CUT.search(data, begin - first + limit)):
            yield lo, np.array([begin, first + cut.end()])
            begin = first + cut.end()
        yield lo, np.array([begin, end])


def _encoded(batch, coder: Merges):
    """(first row, ids, place of each row's first id) of every step; a long text comes in several."""
    raw, offsets = utf8(batch.column("text"))
    for row, bounds in _steps(raw, offsets):
        yield row, *coder.encode(raw[bounds[0]:bounds[-1]], bounds - bounds[0])


def encode(df: DataFrame, path: str) -> DataFrame:
    """``doc_id, n_tokens, ids`` of every text; ``path`` names a tokenizer file that every executor can open."""
    def run(batches):
        coder = merges(path)
        for batch in batches:
            parts: list[list[np.ndarray]] = [[] for _ in range(batch.num_rows)]
            for row, ids, at in _encoded(batch, coder):
                for i in range(len(at) - 1):
                    parts[row + i].append(ids[at[i]:at[i + 1]].astype(np.int32))
            made = [np.concatenate(p) if p else np.zeros(0, np.int32) for p in parts]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(map(len, made), pa.int64()), pa.array(made, pa.list_(pa.int32()))], names=["doc_id", "n_tokens", "ids"])

    return documents(df).mapInArrow(run, "doc_id long, n_tokens long, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """``doc_id, text`` of every row of ids (null ids: empty); bytes that are no UTF-8 become replacement characters."""
    def run(batches):
        coder = merges(path)
        for batch in batches:
            texts = [coder.decode(np.array(ids or [], np.int64)).tobytes().decode("utf-8", "replace") for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trip_digests(df: DataFrame, path: str) -> DataFrame:
    """Encode and decode every text in one pass; only counts and digests leave the task."""
    def run(batches):
        coder = merges(path)
        for batch in batches:
            rows = batch.num_rows
            counts = [0] * rows
            of_ids, of_text = [hashlib.sha256() for _ in range(rows)], [hashlib.sha256() for _ in range(rows)]
            for row, ids, at in _encoded(batch, coder):
                packed, back = ids.astype("<u4"), coder.decode(ids)
                ends = np.r_[0, np.cumsum(coder.token_at[ids + 1] - coder.token_at[ids])][at]
                for i in range(len(at) - 1):
                    counts[row + i] += int(at[i + 1] - at[i])
                    of_ids[row + i].update(packed[at[i]:at[i + 1]].tobytes())
                    of_text[row + i].update(back[ends[i]:ends[i + 1]].tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array([h.hexdigest() for h in of_ids]), pa.array([h.hexdigest() for h in of_text])],
                                             names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return documents(df).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
