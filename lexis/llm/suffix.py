"""Exact removal of repeated byte passages by a hash-compared suffix sort.

A byte goes when some ``length``-byte string that covers it also starts
earlier (smaller key, or same text and earlier start).  Strings are judged on
the input and never cross texts.

1. Whole copies (equal bytes, larger key) repeat everything; one aggregation
   finds them and they take no further part.
2. Every window of ``length`` bytes has one *anchor*: the k-gram of smallest
   hash in it (leftmost on ties).  Equal windows have equal anchors at the same
   place, so only texts' anchors are shuffled, about one in forty bytes, and
   only anchors that occur more than once go on.
3. Around each such anchor the bytes of the windows that chose it are cut out.
   Equal cut-outs within a task are settled at once (all but the earliest
   repeat it), so a group of copies sends at most one cut-out a task.
4. Cut-outs are shuffled by anchor.  A task sorts the suffixes that start at
   their windows: first into buckets by anchor, place and outer bytes, then by
   a bottom-up mergesort whose comparisons find the common extension of two
   suffixes by binary search on prefix polynomial hashes.  Neighbours in order
   that agree over ``length`` bytes are compared byte by byte, and all but the
   earliest of each class repeat.  Steps are sized by windows; a larger anchor
   group is sorted bucket by bucket.
   An anchor with more than ``hot`` occurrences is not gathered: each of its
   windows is dealt by its own 128-bit hash instead, which spreads the group.
5. The repeated ranges of a text are joined back to it and cut out.

Defined cases: null text is empty; texts shorter than ``length`` keep
everything; rows with equal ``doc_id`` are taken as one position in the order
(equal rows give equal results); rows with null ``doc_id`` are left out.
Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexis.llm.common import documents, mix, powers, prefix_hash, range_hash, row_chunks, signed, utf8, words8

LENGTH = 100
GRAM = 24
HOT = 50_000
SORT_WINDOWS = 150_000
"""Windows sorted at once; an anchor group with more is dealt into buckets of the windows' outer bytes."""

_PLACE_BITS = 24


def anchors(raw: np.ndarray, offsets: np.ndarray, length: int, gram: int):
    """(anchor byte, first window start, last window start, k-gram hash) per chosen anchor."""
    n = len(raw)
    empty = np.zeros(0, np.int64)
    if n < length:
        return empty, empty, empty, np.zeros(0, np.uint64)
    prefix = prefix_hash(raw)
    _, down = powers(n + 1)
    hashes = mix((prefix[gram:] - prefix[:-gram]) * down[:n - gram + 1])
    size = np.diff(offsets)
    has = size >= length
    starts = np.concatenate([np.arange(a, b - length + 1) for a, b in zip(offsets[:-1][has], offsets[1:][has])]) if has.any() else empty
    if not len(starts):
        return empty, empty, empty, np.zeros(0, np.uint64)
    mask = np.uint64((1 << _PLACE_BITS) - 1)
    if n <= int(mask):
        key = (hashes & ~mask) | np.arange(len(hashes), dtype=np.uint64)
        width, low = length - gram + 1, key
        span = 1
        while span * 2 <= width:
            low = np.minimum(low[:-span], low[span:])
            span *= 2
        low = np.minimum(low[:len(key) - width + 1], low[width - span:width - span + len(key) - width + 1])
        chosen = (low[starts] & mask).astype(np.int64)
    else:  # a single text beyond 16 MB: the same minimum by overlapping slices
        parts, step = [], int(mask) - length
        for at in range(0, n - length + 1, step):
            piece = raw[at:at + step + length - 1]
            a, first, last, _ = anchors(piece, np.array([0, len(piece)]), length, gram)
            parts.append(np.repeat(a, last - first + 1) + at)
        chosen = np.concatenate(parts)[starts - offsets[0]]
    new = np.flatnonzero(np.r_[True, chosen[1:] != chosen[:-1]])
    ends = np.r_[new[1:], len(chosen)] - 1
    return chosen[new], starts[new], starts[ends], hashes[chosen[new]]


def _ranges(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """All integers of the ranges [first, first + size), concatenated."""
    total = np.cumsum(size)
    return np.arange(total[-1] if len(total) else 0) - np.repeat(total - size, size) + np.repeat(first, size)


def equal_ranges(eight: np.ndarray, raw: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether raw[a:a+size] == raw[b:b+size], byte by byte (size >= 8)."""
    same = np.ones(len(a), bool)
    for step in range(0, int(size.max(initial=0)), 8):
        at = np.minimum(step, size - 8)
        same &= eight[a + at] == eight[b + at]
    return same


def common_extension(prefix: np.ndarray, a: np.ndarray, b: np.ndarray, limit: int) -> np.ndarray:
    """Length, up to ``limit``, over which the strings at a and b agree: binary search on hashes."""
    done = np.zeros(len(a), np.int64)
    step = 1 << max(limit.bit_length() - 1, 0)
    while step:
        may = done + step <= limit
        x, y = a + done, b + done
        x1, y1 = np.where(may, x + step, x), np.where(may, y + step, y)
        done += np.where(may & (range_hash(prefix, x, x1) == range_hash(prefix, y, y1)), step, 0)
        step >>= 1
    return done


def suffix_order(prefix: np.ndarray, raw: np.ndarray, at: np.ndarray, run: np.ndarray, length: int) -> np.ndarray:
    """Stable order of the ``length``-byte suffixes at ``at`` within each run (runs are contiguous).

    Bottom-up mergesort: in each round every element finds its rank in the
    neighbouring block by binary search, all elements at once; a comparison is
    one common extension and one byte.
    """
    n = len(at)
    order = np.arange(n)
    first = np.flatnonzero(np.r_[True, run[1:] != run[:-1]])
    begin = np.repeat(first, np.diff(np.r_[first, n]))
    end = np.repeat(np.r_[first[1:], n], np.diff(np.r_[first, n]))
    place = np.arange(n) - begin
    width, widest = 1, int((end - begin).max(initial=0))
    while width < widest:
        block = place // width
        right = (block & 1).astype(bool)
        lo = begin + np.where(right, block - 1, block + 1) * width
        lo = np.minimum(lo, end)
        hi = np.minimum(lo + width, end)
        base = lo.copy()
        own = at[order]
        active = np.flatnonzero(lo < hi)
        while len(active):
            mid = (lo[active] + hi[active]) // 2
            a, b = own[active], at[order[mid]]
            ext = common_extension(prefix, a, b, length)
            tie = ext >= length
            inside = np.where(tie, 0, ext)
            less = raw[b + inside] < raw[a + inside]
            less = np.where(tie, right[active], less)  # ties: the left block first
            lo[active] = np.where(less, mid + 1, lo[active])
            hi[active] = np.where(less, hi[active], mid)
            active = active[lo[active] < hi[active]]
        target = begin + (block // 2) * 2 * width + (place - block * width) + (lo - base)
        moved = np.empty_like(order)
        moved[target] = order
        order = moved
        width *= 2
    return order


def repeated_windows(raw: np.ndarray, at: np.ndarray, key: np.ndarray, rank: np.ndarray, length: int) -> np.ndarray:
    """Which windows (start ``at``, bucket ``key``) equal one of smaller ``rank`` in the same bucket."""
    out = np.zeros(len(at), bool)
    if not len(at):
        return out
    eight = words8(raw)
    outer = mix(eight[at] * np.uint64(0x9E3779B97F4A7C15) ^ eight[at + length - 8] ^ mix(key))
    order = np.lexsort((rank, outer))
    same = np.r_[False, outer[order][1:] == outer[order][:-1]]
    keep = same | np.r_[same[1:], False]
    order = order[keep]
    if not len(order):
        return out
    run = np.cumsum(~same[keep])
    prefix = prefix_hash(raw)
    order = order[suffix_order(prefix, raw, at[order], run, length)]
    a, b = at[order[:-1]], at[order[1:]]
    near = (run[1:] == run[:-1]) & (key[order[1:]] == key[order[:-1]])
    equal = np.zeros(len(near), bool)
    near = np.flatnonzero(near)
    ext = common_extension(prefix, a[near], b[near], length) >= length
    near = near[ext]
    true = equal_ranges(eight, raw, a[near], b[near], np.full(len(near), length))
    equal[near[true]] = True
    if not true.all():  # a hash collision: these runs are settled by their bytes
        for r in np.unique(run[near[~true]]).tolist():
            seen: set[tuple[int, bytes]] = set()
            members = order[run == r]
            for i in members[np.argsort(rank[members], kind="stable")].tolist():
                item = (int(key[i]), raw[at[i]:at[i] + length].tobytes())
                out[i] = item in seen
                seen.add(item)
            equal[np.flatnonzero((run[1:] == r))] = False
    out[order[1:][equal]] = True  # ties stay in rank order: only the first of a class is not set
    return out


ANCHORS = "h long, doc_id long, place long"
CUTS = "h long, doc_id long, first long, windows int, lead int, cut binary, h2 long"


def _anchor_rows(texts: DataFrame, length: int, gram: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            raw, offsets = utf8(batch.column("text"))
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            for lo, hi in row_chunks(offsets):
                own = offsets[lo:hi + 1] - offsets[lo]
                place, _, _, h = anchors(raw[offsets[lo]:offsets[hi]], own, length, gram)
                row = np.searchsorted(own, place, "right") - 1
                yield pa.RecordBatch.from_arrays([pa.array(signed(h)), pa.array(ids[lo:hi][row]), pa.array(place - own[row])], names=["h", "doc_id", "place"])

    return texts.mapInArrow(run, ANCHORS)


def _cut_rows(texts: DataFrame, length: int, gram: int, hot: int) -> DataFrame:
    """Cut-outs around the anchors listed in ``places`` (struct of place and count).

    A row without ``cut`` and with ``lead`` -1 is a settled repeat: all its
    windows equal those of an earlier cut-out.  ``lead`` -2 marks a window of a
    hot anchor, dealt by its own hash.
    """
    names = [x.split()[0] for x in CUTS.split(", ")]

    def table(h, ids, first, windows, lead, cut, h2):
        n = len(first)
        return pa.RecordBatch.from_arrays([
            pa.array(h, pa.int64()), pa.array(ids, pa.int64()), pa.array(first, pa.int64()), pa.array(windows, pa.int32()),
            pa.array(np.broadcast_to(np.asarray(lead, np.int32), n), pa.int32()), pa.nulls(n, pa.binary()) if cut is None else cut,
            pa.array(h2 if h2 is not None else np.zeros(n, np.int64), pa.int64())], names=names)

    def run(batches):
        for batch in batches:
            raw_all, offsets = utf8(batch.column("text"))
            ids_all = batch.column("doc_id").to_numpy(zero_copy_only=False)
            lists = batch.column("places")
            for lo, hi in row_chunks(offsets):
                raw, own = raw_all[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo]
                part = lists.slice(lo, hi - lo)
                listed, flat = part.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), part.flatten()
                wanted = np.repeat(own[:-1], listed) + flat.field("place").to_numpy(zero_copy_only=False)
                count = flat.field("n").to_numpy(zero_copy_only=False)
                sort = np.argsort(wanted, kind="stable")
                wanted, count = wanted[sort], count[sort]
                place, first, last, h = anchors(raw, own, length, gram)
                if not len(place) or not len(wanted):
                    continue
                spot = np.minimum(np.searchsorted(wanted, place), len(wanted) - 1)
                keep = wanted[spot] == place
                place, first, last, h, many = place[keep], first[keep], last[keep], h[keep], count[spot[keep]] > hot
                row = np.searchsorted(own, place, "right") - 1
                ids, base = ids_all[lo:hi][row], own[row]
                windows, size, lead = last - first + 1, last - first + length, place - first
                prefix, eight = prefix_hash(raw), words8(raw)
                # equal cut-outs: settled here, all but the earliest
                content = mix(range_hash(prefix, first, first + size) ^ mix(h + lead.astype(np.uint64)) ^ size.astype(np.uint64))
                order = np.lexsort((first - base, ids, content))
                a, b = order[:-1], order[1:]
                alike = np.flatnonzero((content[a] == content[b]) & (size[a] == size[b]) & (lead[a] == lead[b]))
                true = equal_ranges(eight, raw, first[a[alike]], first[b[alike]], size[a[alike]])
                repeat = np.zeros(len(place), bool)
                repeat[b[alike[true]]] = True
                # the same row given twice is no earlier text
                twin = (ids[a] == ids[b]) & (first[a] - base[a] == first[b] - base[b]) & (row[a] != row[b])
                if twin.any():
                    repeat[b[twin]] = repeat[a[twin]]
                if repeat.any():
                    yield table(signed(mix(content[repeat] + np.flatnonzero(repeat).astype(np.uint64))), ids[repeat], (first - base)[repeat], windows[repeat], -1, None, None)
                plain = np.flatnonzero(~repeat & ~many)
                for at in range(0, len(plain), 20_000):
                    p = plain[at:at + 20_000]
                    body = raw[_ranges(first[p], size[p])]
                    ends = np.r_[0, np.cumsum(size[p])].astype(np.int32)
                    cut = pa.Array.from_buffers(pa.binary(), len(p), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(body))])
                    yield table(signed(h[p]), ids[p], (first - base)[p], windows[p], lead[p], cut, None)
                for p in np.array_split(np.flatnonzero(~repeat & many), max(1, int((~repeat & many).sum()) // 5000)):
                    if len(p):
                        starts, who = _ranges(first[p], windows[p]), np.repeat(p, windows[p])
                        one = mix(range_hash(prefix, starts, starts + length) + np.uint64(1))
                        two = mix(range_hash(prefix_hash(raw.astype(np.uint64) ** 2 + np.uint64(7)), starts, starts + length))
                        yield table(signed(one), ids[who], starts - base[who], np.ones(len(starts), np.int32), -2, None, signed(two))

    return texts.mapInArrow(run, CUTS)


def _merge_ranges(ids: np.ndarray, start: np.ndarray, length: int):
    """Windows starts (grouped by owner, ascending) as joined byte ranges."""
    new = np.flatnonzero(np.r_[True, (ids[1:] != ids[:-1]) | (start[1:] > start[:-1] + length)]) if len(ids) else np.zeros(0, np.int64)
    last = np.r_[new[1:], len(ids)] - 1 if len(ids) else new
    return ids[new], start[new], start[last] + length


def _buckets(total: int, raw: np.ndarray, length: int, place):
    """The windows 0..total-1, dealt so that equal ones share a bucket and a bucket holds about ``SORT_WINDOWS``.

    ``place`` gives byte offsets and keys of windows; the bucket comes from the
    key and the outer bytes, which equal windows share.
    """
    if total <= SORT_WINDOWS:
        yield np.arange(total)
        return
    eight, n = words8(raw), -(-total // SORT_WINDOWS)
    bucket = np.empty(total, np.uint16)
    n = min(n, 1 << 16)
    for lo in range(0, total, SORT_WINDOWS):
        at, key = place(np.arange(lo, min(lo + SORT_WINDOWS, total)))
        outer = mix(eight[at] * np.uint64(0x9E3779B97F4A7C15) ^ eight[at + length - 8] ^ mix(key))
        bucket[lo:lo + len(at)] = (outer >> np.uint64(20)) % np.uint64(n)
    for i in range(n):
        yield np.flatnonzero(bucket == i)


def _sort_rows(cuts: DataFrame, length: int) -> DataFrame:
    """``doc_id, first, stop``: byte ranges covered by repeated windows.  Input: sorted by ``h`` in each partition."""
    def settle(t: pa.Table):
        lead = t["lead"].to_numpy()
        ids, first, windows = t["doc_id"].to_numpy(), t["first"].to_numpy(), t["windows"].to_numpy().astype(np.int64)
        done = lead == -1
        out = [(ids[done], first[done], first[done] + windows[done] - 1 + length)]
        spread = np.flatnonzero(lead == -2)
        if len(spread):
            h, h2 = t["h"].to_numpy()[spread], t["h2"].to_numpy()[spread]
            order = np.lexsort((first[spread], ids[spread], h2, h))
            s = spread[order]
            again = np.r_[False, (h[order][1:] == h[order][:-1]) & (h2[order][1:] == h2[order][:-1])]
            same = np.r_[False, (ids[s][1:] == ids[s][:-1]) & (first[s][1:] == first[s][:-1])]
            for i in np.flatnonzero(same & again):
                again[i] = again[i - 1]
            out.append((ids[s[again]], first[s[again]], first[s[again]] + length))
        cut = np.flatnonzero(lead >= 0)
        if len(cut) > 1:
            t2 = t.take(pa.array(cut))
            raw, offsets = utf8(t2["cut"])
            h = t2["h"].to_numpy().view(np.uint64)
            # items in order of (doc, start): a window's rank is its item's place
            order = np.lexsort((first[cut], ids[cut]))
            rank = np.empty(len(cut), np.int64)
            rank[order] = np.arange(len(cut))
            same = np.zeros(len(cut), bool)
            same[1:] = (ids[cut][order][1:] == ids[cut][order][:-1]) & (first[cut][order][1:] == first[cut][order][:-1])
            if same.any():  # repeated rows: one item, settled alike
                lead_of = np.maximum.accumulate(np.where(same, 0, np.arange(len(cut))))
                only = np.sort(order[~same])
            else:
                only = np.arange(len(cut))
            w = windows[cut][only]
            ends = np.cumsum(w)

            def expanded(index: np.ndarray):
                """Item, place within it, byte offset and bucket key of windows given by number."""
                spot = np.searchsorted(ends, index, "right")
                who, inner = only[spot], index - (ends - w)[spot]
                place = lead[cut[who]].astype(np.int64) - inner
                return who, inner, offsets[:-1][who] + inner, mix(h[who] + place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))

            total = int(ends[-1])
            hit = np.zeros(total, bool)
            for index in _buckets(total, raw, length, lambda i: expanded(i)[2:]):
                who, inner, at, key = expanded(index)
                hit[index] = repeated_windows(raw, at, key, rank[who] * 4096 + inner, length)
            if same.any():
                twins = order[same]
                source = order[lead_of[same]]
                for a, b in zip(twins.tolist(), source.tolist()):
                    spot = int(np.searchsorted(only, b))
                    s = first[cut][b] + np.flatnonzero(hit[ends[spot] - w[spot]:ends[spot]])
                    out.append((np.full(len(s), ids[cut][a]), s, s + length))
            who, inner, _, _ = expanded(np.flatnonzero(hit))
            item, a, b = _merge_ranges(who, first[cut][who] + inner, length)
            out.append((ids[cut][item], a, b))
        parts = [np.concatenate(x) for x in zip(*out)]
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in parts], names=["doc_id", "first", "stop"])

    def run(batches):
        held: list[pa.RecordBatch] = []
        size = 0

        def weight(piece) -> int:
            """Windows to sort, and what other rows take beside them."""
            return int(np.where(piece["lead"].to_numpy() >= 0, piece["windows"].to_numpy(), 1).sum())

        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                piece = batch.slice(at, 1024)
                held.append(piece)
                size += weight(piece)
                if size < SORT_WINDOWS:
                    continue
                t = pa.Table.from_batches(held)
                h = t["h"].to_numpy()
                edge = int(np.searchsorted(h, h[-1]))  # the last group may go on
                if edge:
                    yield settle(t.slice(0, edge))
                    rest = t.slice(edge).combine_chunks()
                    held = rest.to_batches()
                    size = weight(rest)
        if held:
            yield settle(pa.Table.from_batches(held))

    return cuts.mapInArrow(run, "doc_id long, first long, stop long")


def repeats(df: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = HOT, id_col: str = "doc_id", text_col: str = "text",
            partitions: int | None = None) -> DataFrame:
    """``doc_id, text, whole, ranges``: every text with its repeated byte ranges.

    ``whole`` is true for a later copy of an earlier text (all bytes repeated);
    otherwise ``ranges`` holds (first, stop) structs, unsorted, possibly
    overlapping.
    """
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    docs = documents(df, id_col, text_col).filter("doc_id IS NOT NULL")
    # One exchange of the texts by key serves every later join with them.
    placed = docs.withColumn("text", F.coalesce("text", F.lit(""))).repartition(n, "doc_id")
    digest = docs.filter(F.octet_length("text") >= length).select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("d"))
    firsts = digest.groupBy("d").agg(F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id")).filter("first_id < last_id")
    copies = digest.join(firsts, "d").filter("doc_id > first_id").select("doc_id").distinct().withColumn("whole", F.lit(True))
    # a left join and a filter: an anti join would be moved below the exchange
    marked = placed.join(copies, "doc_id", "left").withColumn("whole", F.coalesce("whole", F.lit(False)))
    lone = marked.filter(~F.col("whole")).select("doc_id", "text")
    found = _anchor_rows(lone, length, gram)
    counted = found.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1")
    places = found.join(counted, "h").groupBy("doc_id").agg(F.collect_list(F.struct("place", "n")).alias("places"))
    cuts = _cut_rows(lone.join(places, "doc_id"), length, gram, hot)
    ranges = _sort_rows(cuts.repartition(n, "h").sortWithinPartitions("h"), length)
    per_text = ranges.groupBy("doc_id").agg(F.collect_list(F.struct("first", "stop")).alias("ranges"))
    return marked.join(per_text, "doc_id", "left").select("doc_id", "text", "whole", "ranges")


def joined_ranges(first: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of ranges as maximal runs (touching ranges are one run)."""
    if not len(first):
        return first, stop
    order = np.argsort(first, kind="stable")
    first, stop = first[order], np.maximum.accumulate(stop[order])
    new = np.flatnonzero(np.r_[True, first[1:] > stop[:-1]])
    return first[new], stop[np.r_[new[1:], len(first)] - 1]


def deduplicated(df: DataFrame, **options) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept``: every text without its repeated bytes."""
    def run(batches):
        for batch in batches:
            raw, offsets = utf8(batch.column("text"))
            whole = batch.column("whole").to_pylist()
            lists = batch.column("ranges")
            edge = np.r_[0, np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))].astype(np.int64)
            flat = lists.flatten()
            first, stop = (flat.field(x).to_numpy(zero_copy_only=False) for x in ("first", "stop"))
            sizes, removed, spans, kept = [], [], [], []
            for i in range(batch.num_rows):
                body = raw[offsets[i]:offsets[i + 1]].tobytes()
                a, b = joined_ranges(first[edge[i]:edge[i + 1]], stop[edge[i]:edge[i + 1]])
                if whole[i]:
                    a, b = np.array([0]), np.array([len(body)])
                cuts = zip([0, *b.tolist()], [*a.tolist(), len(body)])
                sizes.append(len(body))
                removed.append(int((b - a).sum()))
                spans.append(len(a))
                kept.append(b"".join(body[x:y] for x, y in cuts))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()),
                                              pa.array(spans, pa.int64()), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return repeats(df, **options).mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def digests(df: DataFrame, **options) -> DataFrame:
    """The counts and the SHA-256 of what is kept."""
    return deduplicated(df, **options).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
