"""N-gram Jaccard join: a blocked sparse product of the document by n-gram incidence matrix.

Rows are distinct n-gram sets (texts with equal sets share a row), columns are
n-grams.  Two rows link when 100 * |A and B| >= threshold * |A or B|.

1. *Column blocks.*  Linked sets differ in at most
   ``(100 - t) / (100 + t) * (|A| + |B|)`` n-grams.  Cut the columns into more
   blocks than that (by hash, per size class): linked rows agree in some
   whole blocks, more of them than a row usually has blocks with under two
   n-grams.  A row sends one hash per block with more, and for rows with
   unusually many such weak blocks a prefix of these, so every linked pair of
   rows meets at some hash, whatever n-grams are frequent, and rows that share
   no more than single n-grams do not.
2. *Row blocks.*  Rows that meet are joined into candidate groups.  Chance
   meetings chain ever more rows of a growing table into one group, so the rows
   of a group beyond ``BLOCK_ROWS`` rows or ``BLOCK_GRAMS`` n-grams are paired
   hash by hash, and a pair stays only if enough column blocks agree, by one
   byte each, for it to link; groups are formed anew from these pairs.  (The rows
   of a hash met by over ``PAIRED_ROWS`` of them are compared in blocks of
   ``PAIRED_BLOCK``.)  A group that is still beyond the limits is cut into blocks by size class and hash, and
   only block pairs whose sizes can link are formed.
3. *Product.*  Each block (pair) accumulates overlap counts column by column
   in numpy: pair expansion for columns with few rows, dense products for the
   others.  Pairs whose sizes cannot reach the bound are discarded before,
   those whose counts do not reach it after.  Only links that join two still
   separate rows of the block are returned, at most one fewer than its rows.
4. Components of the links, then the smallest key of each.

Within a map task, rows that meet are tied to one of them before anything is
shuffled, and that one stands for all of them at every hash, so a hash met by a
third of all rows sends one row a task and a group adds about one link a row.

Defined cases: null and wordless texts have an empty set and link with
nothing; a text of fewer words than ``n`` is one n-gram; rows with equal
``doc_id`` stay separate rows of the result; null ``doc_id`` rows are left
out.  N-grams and sets are compared by 64-bit hash.  Other columns are ignored.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexis.llm.common import documents, drop_shuffles, lower_ascii, mix, prefix_hash, range_hash, row_chunks, signed, utf8, word_bounds, written
from lexis.llm.graph import components

BLOCK_ROWS = 1500
BLOCK_GRAMS = 1_500_000
FLUSH_ROWS = 4000
PAIRED_ROWS = 48
PAIRED_BLOCK = 1024
COMPARED_BYTES = 1 << 20
FILLED = 2
SPREAD = -1.0
"""Spare blocks beside the usual number of weak ones, in its standard deviations; any value is exact."""
"""N-grams that a column block must hold to be sent as a matter of course."""
_ODD = np.uint64(0x9E3779B97F4A7C15)


def gram_sets(raw: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct n-gram hashes of every text, and where each text's begin."""
    raw = lower_ascii(raw)
    starts, ends, edge = word_bounds(raw, offsets)
    words = mix(range_hash(prefix_hash(raw), starts, ends) + (ends - starts).astype(np.uint64))
    count = np.diff(edge)
    total = np.maximum(np.minimum(count, 1), count - n + 1)
    begin = np.r_[0, np.cumsum(total)]
    row = np.repeat(np.arange(len(count)), total)
    first = np.repeat(edge[:-1], total) + np.arange(begin[-1]) - np.repeat(begin[:-1], total)
    size = np.minimum(count, n)[row]
    grams = size.astype(np.uint64)
    for i in range(n):
        grams = mix(grams * _ODD + np.where(i < size, words[np.minimum(first + i, max(len(words) - 1, 0))], 0)) if len(words) else grams
    for a, b in zip(begin[:-1].tolist(), begin[1:].tolist()):
        grams[a:b].sort()
    new = np.ones(len(grams), bool)
    new[1:] = (grams[1:] != grams[:-1]) | (row[1:] != row[:-1])
    return grams[new], np.r_[0, np.cumsum(np.bincount(row[new], minlength=len(count)))].astype(np.int64)


def set_nodes(grams: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """One id per set: hash of its members and its size."""
    sums = np.r_[np.zeros(1, np.uint64), np.cumsum(mix(grams))]
    return signed(mix((sums[begin[1:]] - sums[begin[:-1]]) * _ODD + np.diff(begin).astype(np.uint64)))


class Blocks:
    """Size classes and column blocks for one threshold (percent)."""

    def __init__(self, threshold: int):
        self.threshold = threshold
        self.ratio = 1.02 / (threshold / 100)

    def size_class(self, n: np.ndarray) -> np.ndarray:
        return np.floor(np.log(np.maximum(n, 1)) / np.log(self.ratio) + 1e-9).astype(np.int64)

    @lru_cache(None)  # noqa: B019
    def layout(self, level: int) -> tuple[int, int]:
        """(column blocks, spare blocks) for pairs whose smaller set is of class ``level`` (0: only equal sets link).

        Linked sets agree in all blocks but the differing n-grams', so in more
        than ``spare`` of them.  A block with fewer than ``FILLED`` n-grams is
        weak; ``spare`` is about the usual number of weak blocks, so that few of
        them need to be sent.
        """
        top = self.ratio ** (level + 1) + 1e-6
        differ = int((100 - self.threshold) * (top + top * 100 / self.threshold) / (100 + self.threshold) + 1e-6)
        spare = 1
        for _ in range(30):
            mean = self.ratio ** level / (differ + 1 + spare)
            weak = (differ + 1 + spare) * np.exp(-mean) * (1 + mean)
            spare = min(int(weak + SPREAD * np.sqrt(weak)) + 1, 2 + differ)
        return (differ + 1 + spare, spare) if differ else (0, 0)

    def differing(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """N-grams of only one of two linked sets of ``a`` and ``b`` n-grams, at most."""
        return np.floor((100 - self.threshold) * (a + b) / (100 + self.threshold) + 1e-6).astype(np.int64)

    def contents(self, grams: np.ndarray, begin: np.ndarray):
        """For each size class that links sets: (class, spare, rows, n-grams held and hash of every column block of each row)."""
        size = np.diff(begin)
        own = self.size_class(size)
        sums = np.r_[np.zeros(1, np.uint64), np.cumsum(mix(grams + np.uint64(1)))]
        high = grams >> np.uint64(32)
        for level in np.unique(np.r_[own, own - 1]).tolist():
            blocks, spare = self.layout(level) if level >= 0 else (0, 0)
            member = np.flatnonzero(((own == level) | (own == level + 1)) & (size > 0))
            if not blocks or not len(member):
                continue
            count = size[member]
            which = np.repeat(np.arange(len(member)), count)
            place = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + begin[member][which]
            cell = which * blocks + ((high[place] * np.uint64(blocks)) >> np.uint64(32)).astype(np.int64)
            held = np.bincount(cell, minlength=len(member) * blocks)
            ends = np.cumsum(held).reshape(len(member), blocks)
            ends = ends - ends[:, :1] + held.reshape(len(member), blocks)[:, :1] + begin[member][:, None]
            held = held.reshape(len(member), blocks)
            content = sums[ends] - sums[ends - held]
            salt = mix(np.arange(blocks).astype(np.uint64) + np.uint64(level * 1_000_003 + 17 << 20))
            yield level, spare, member, held, mix(content * _ODD + salt[None, :])

    def sketches(self, grams: np.ndarray, begin: np.ndarray) -> list[bytes]:
        """A byte for every column block of each set, by the layout of its own size class and then by that of the class below."""
        own = self.size_class(np.diff(begin))
        out = [[b"", b""] for _ in own]
        for level, _, member, _, sig in self.contents(grams, begin):
            for row, part in zip(member.tolist(), (sig >> np.uint64(56)).astype(np.uint8)):
                out[row][own[row] - level] = part.tobytes()
        return [a + b for a, b in out]

    def agreeing(self, a: tuple[np.ndarray, np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
        """Which pairs of different sets may link, by sizes and sketches; each side: n-grams, sketch bytes, where each sketch begins."""
        sizes = [side[0] for side in (a, b)]
        small, large = np.minimum(*sizes), np.maximum(*sizes)
        level = self.size_class(small)
        fit = np.flatnonzero((small * 100 >= self.threshold * large) & (self.size_class(large) <= level + 1))
        most = self.differing(*sizes)
        out = np.zeros(len(small), bool)
        for one in np.unique(level[fit]).tolist():
            blocks = self.layout(one)[0]
            mine = fit[level[fit] == one]
            step = max(1, COMPARED_BYTES // max(1, blocks))
            for at in (mine[lo:lo + step] for lo in range(0, len(mine) if blocks else 0, step)):
                parts = [raw[(begin[at] + np.where(self.size_class(n[at]) > one, self.layout(one + 1)[0], 0))[:, None] + np.arange(blocks)] for n, raw, begin in (a, b)]
                out[at] = (parts[0] == parts[1]).sum(axis=1) >= blocks - most[at]
        return out

    def signatures(self, grams: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(signature, row) of every block that is not weak; of weak ones, in order, as many as exceed the spare.

        Two sets whose agreeing blocks are all weak share more than ``spare``
        weak blocks, so one of the first ``weak - spare`` of each (the prefix
        of a set of that overlap) is common to both.
        """
        out, rows = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for _, spare, member, held, sig in self.contents(grams, begin):
            weak = held < FILLED
            # weak blocks in order: fuller ones first, then by place (1 for the first)
            order = np.argsort(np.where(weak, -held, 1), axis=1, kind="stable")
            rank = np.empty_like(order)
            np.put_along_axis(rank, order, np.arange(1, held.shape[1] + 1)[None, :].repeat(len(member), 0), 1)
            sent = ~weak | (rank <= (weak.sum(1) - spare)[:, None])
            r, _ = np.nonzero(sent)
            out.append(sig[sent])
            rows.append(member[r])
        return np.concatenate(out), np.concatenate(rows)


def members(df: DataFrame, n: int) -> DataFrame:
    """``doc_id, n_grams, node`` for every text (null node for an empty set)."""
    def run(batches):
        for batch in batches:
            raw, offsets = utf8(batch.column("text"))
            for lo, hi in row_chunks(offsets):
                grams, begin = gram_sets(raw[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo], n)
                size = np.diff(begin)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), pa.array(size, pa.int64()),
                                                  pa.array(set_nodes(grams, begin), mask=size == 0)], names=["doc_id", "n_grams", "node"])

    return df.mapInArrow(run, "doc_id long, n_grams long, node long")


def _joined(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index of the component of each of ``n`` nodes under the links (a, b)."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def meetings(df: DataFrame, n: int, threshold: int) -> DataFrame:
    """``sig, node, other``: block hashes of the sets; with ``other``, two sets that met within the task."""
    def run(batches):
        blocks = Blocks(threshold)
        for batch in batches:
            raw, offsets = utf8(batch.column("text"))
            sigs, nodes = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
            for lo, hi in row_chunks(offsets):
                grams, begin = gram_sets(raw[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo], n)
                node = set_nodes(grams, begin)
                sig, row = blocks.signatures(grams, begin)
                sigs.append(sig)
                nodes.append(node[row])
            sig = np.concatenate(sigs)
            names, node = np.unique(np.concatenate(nodes), return_inverse=True)
            order = np.lexsort((node, sig))
            first = np.r_[True, sig[order][1:] != sig[order][:-1]][:len(sig)]
            pivot = node[order][np.maximum.accumulate(np.where(first, np.arange(len(sig)), 0))] if len(sig) else node
            label = _joined(len(names), node[order], pivot)
            rep = label[node]  # one set stands for all that met in this task
            order = np.lexsort((rep, sig))
            once = np.r_[True, (sig[order][1:] != sig[order][:-1]) | (rep[order][1:] != rep[order][:-1])][:len(sig)]
            back = np.sort(order[once])  # in text order: neighbours compress well
            yield pa.RecordBatch.from_arrays([pa.array(signed(sig[back])), pa.array(names[rep[back]]), pa.nulls(len(back), pa.int64())], names=["sig", "node", "other"])
            met = np.flatnonzero(label != np.arange(len(names)))
            if len(met):
                yield pa.RecordBatch.from_arrays([pa.array(signed(mix(names[met].astype(np.uint64)))), pa.array(names[met]), pa.array(names[label[met]])], names=["sig", "node", "other"])

    return df.mapInArrow(run, "sig long, node long, other long")


def _sets(df: DataFrame, n: int) -> DataFrame:
    """``node, grams``: n-gram hashes as packed integers, of the rows whose text has the set ``node``."""
    def run(batches):
        for batch in batches:
            raw, offsets = utf8(batch.column("text"))
            for lo, hi in row_chunks(offsets):
                grams, begin = gram_sets(raw[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo], n)
                packed = pa.Array.from_buffers(pa.binary(), hi - lo, [None, pa.py_buffer((begin * 8).astype(np.int32)), pa.py_buffer(grams)])
                wanted = batch.column("node").slice(lo, hi - lo)
                found = pa.RecordBatch.from_arrays([wanted, packed], names=["node", "grams"])
                yield found.filter(pa.array(wanted.to_numpy(zero_copy_only=False) == set_nodes(grams, begin)))

    return df.mapInArrow(run, "node long, grams binary")


def _marks(texts: DataFrame, n: int, threshold: int) -> DataFrame:
    """``sig, node, n_grams, sketch`` of the rows whose text has the set ``node``: one row with the sketch (null ``sig``), one for each block hash."""
    def run(batches):
        blocks = Blocks(threshold)
        for batch in batches:
            raw, offsets = utf8(batch.column("text"))
            for lo, hi in row_chunks(offsets):
                grams, begin = gram_sets(raw[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo], n)
                node = set_nodes(grams, begin)
                own = node == batch.column("node").slice(lo, hi - lo).to_numpy(zero_copy_only=False)
                at = np.flatnonzero(own)
                sketch = blocks.sketches(grams, begin)
                yield pa.RecordBatch.from_arrays([pa.nulls(len(at), pa.int64()), pa.array(node[at]), pa.array(np.diff(begin)[at]), pa.array([sketch[i] for i in at.tolist()], pa.binary())], names=["sig", "node", "n_grams", "sketch"])
                sig, row = blocks.signatures(grams, begin)
                sig, row = sig[own[row]], row[own[row]]
                yield pa.RecordBatch.from_arrays([pa.array(signed(sig)), pa.array(node[row]), pa.nulls(len(row), pa.int64()), pa.nulls(len(row), pa.binary())], names=["sig", "node", "n_grams", "sketch"])

    return texts.mapInArrow(run, "sig long, node long, n_grams long, sketch binary")


def _every_two(groups: DataFrame) -> DataFrame:
    """``a, b``: every two nodes of a group with different ``labels``; both lists as long, the groups small."""
    def run(batches):
        for batch in batches:
            nodes, labels = (batch.column(c) for c in ("nodes", "labels"))
            count = nodes.value_lengths().to_numpy()
            begin = np.cumsum(count) - count
            nodes, labels = (x.flatten().to_numpy() for x in (nodes, labels))
            for k in np.unique(count).tolist():
                at = begin[count == k][:, None] + np.arange(k)
                x, y = np.triu_indices(k, 1)
                for lo in range(0, len(at), max(1, COMPARED_BYTES // max(1, len(x)))):
                    part = at[lo:lo + max(1, COMPARED_BYTES // max(1, len(x)))]
                    first, second = part[:, x].ravel(), part[:, y].ravel()
                    apart = labels[first] != labels[second]
                    one, two = nodes[first[apart]], nodes[second[apart]]
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(one, two)), pa.array(np.maximum(one, two))], names=["a", "b"])

    return groups.mapInArrow(run, "a long, b long")


def _likely(pairs: DataFrame, sketches: DataFrame, threshold: int) -> DataFrame:
    """The distinct pairs ``a, b`` whose sketches agree in as many blocks as a link needs."""
    def run(batches):
        blocks = Blocks(threshold)
        for batch in batches:
            sides = []
            for side in "ab":
                raw, offsets = utf8(batch.column(f"sketch_{side}"))
                sides.append((batch.column(f"n_{side}").to_numpy(), raw, offsets[:-1]))
            keep = pa.array(blocks.agreeing(*sides))
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(keep) for c in "ab"], names=["a", "b"])

    sketch = lambda side: sketches.select(F.col("node").alias(side), F.col("n_grams").alias(f"n_{side}"), F.col("sketch").alias(f"sketch_{side}"))
    return pairs.distinct().join(sketch("a"), "a").join(sketch("b"), "b").mapInArrow(run, "a long, b long")


def _likely_in(cells: DataFrame, threshold: int) -> DataFrame:
    """Spanning pairs ``a, b`` of the likely ones of each cell, between its two sides (``side`` 0: every row of the cell is on one side)."""
    def solve(key, table):
        blocks = Blocks(threshold)
        order = np.argsort(table.column("n_grams").to_numpy(), kind="stable")
        table = table.take(pa.array(order))
        node, label, side, size = (table.column(c).to_numpy() for c in ("node", "label", "side", "n_grams"))
        raw, offsets = utf8(table.column("sketch"))
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        reach = np.searchsorted(size * threshold, size * 100, "right")
        for i in range(len(node)):
            j = np.arange(i + 1, reach[i])
            j = j[(label[j] != label[i]) & ((side[j] != side[i]) | (side[j] == 0))]
            if len(j):
                first = np.full(len(j), i)
                j = j[blocks.agreeing((size[first], raw, offsets[first]), (size[j], raw, offsets[j]))]
                a.append(np.full(len(j), i))
                b.append(j)
        low = _joined(len(node), np.concatenate(a), np.concatenate(b))
        at = np.flatnonzero(low != np.arange(len(node)))
        return pa.table({"a": node[low[at]], "b": node[at]})

    return cells.groupBy("cell").applyInArrow(solve, "a long, b long")


def _split_groups(crowd: DataFrame, texts: DataFrame, n: int, threshold: int) -> DataFrame:
    """``crowd`` (the rows of large candidate groups) in groups of pairs that may link; rows without such a pair go.

    The rows that meet at a hash are compared with one of them first; of these
    links' groups, every two rows that met and are in different ones are compared.
    """
    marks = _marks(texts.join(crowd.select("node"), "node", "left_semi"), n, threshold)
    sketches = written(marks.filter("sig IS NULL").select("node", "n_grams", "sketch"), "sketches")
    met = written(marks.filter("sig IS NOT NULL").groupBy("sig").agg(F.collect_set("node").alias("nodes")).filter("size(nodes) > 1"), "met")
    each = met.select("sig", F.array_min("nodes").alias("a"), F.explode("nodes").alias("b"))
    star = written(_likely(each.select("a", "b").filter("a <> b"), sketches, threshold), "likely")
    label = components(star).select(F.col("node").alias("b"), F.col("component").alias("label"))
    named = each.join(label, "b", "left").groupBy("sig").agg(F.collect_list(F.struct(F.coalesce("label", "b").alias("label"), F.col("b").alias("node"))).alias("rows"))
    apart = written(named.select("sig", F.col("rows.node").alias("nodes"), F.col("rows.label").alias("labels")).filter("size(array_distinct(labels)) > 1"), "apart")
    few = _likely(_every_two(apart.filter(f"size(nodes) <= {PAIRED_ROWS}").select("nodes", "labels")), sketches, threshold)
    many = apart.filter(f"size(nodes) > {PAIRED_ROWS}").select("sig", F.ceil(F.size("nodes") / PAIRED_BLOCK).cast("int").alias("m"), F.posexplode(F.arrays_zip("nodes", "labels")).alias("at", "row"))
    own, other = F.pmod("at", "m"), F.col("other")
    spread = many.select("sig", own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("m") - 1)).alias("other"), F.col("row.nodes").alias("node"), F.col("row.labels").alias("label"))
    side = F.when(F.col("own") == other, 0).when(F.col("own") < other, 1).otherwise(2)
    cells = spread.select(F.xxhash64("sig", F.least("own", other), F.greatest("own", other)).alias("cell"), side.alias("side"), "node", "label")
    pairs = star.union(few).union(_likely_in(cells.join(sketches, "node"), threshold))
    return crowd.drop("component").join(components(written(pairs, "likely")), "node")


class _Forest:
    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        self.up[a] = b
        return a != b


def block_product(sizes: np.ndarray, grams: np.ndarray, row: np.ndarray, group: np.ndarray, threshold: int) -> list[tuple[int, int]]:
    """Spanning links between rows of the same group.  ``grams``/``row``: the incidence; rows of a group are contiguous."""
    total = len(sizes)
    key = mix(grams + mix(group[row].astype(np.uint64) + np.uint64(5)))
    order = np.argsort(key, kind="stable")
    row = row[order]
    head = np.flatnonzero(np.r_[True, key[order][1:] != key[order][:-1]]) if len(key) else np.zeros(0, np.int64)
    df = np.diff(np.r_[head, len(row)])
    pair_sums: list[np.ndarray] = []
    counts: list[np.ndarray] = []
    few = 24

    def compact():
        key, inverse = np.unique(np.concatenate(pair_sums), return_inverse=True)
        pair_sums[:], counts[:] = [key], [np.bincount(inverse, np.concatenate(counts)).astype(np.int64)]

    waiting = 0
    for d in np.unique(df[(df > 1) & (df <= few)]).tolist():
        at = head[df == d]
        for i in range(d):
            for j in range(i + 1, d):
                a, b = row[at + i], row[at + j]
                small, large = np.minimum(sizes[a], sizes[b]), np.maximum(sizes[a], sizes[b])
                fit = small * 100 >= threshold * large
                pair_sums.append(np.minimum(a, b)[fit] * total + np.maximum(a, b)[fit])
                counts.append(np.ones(int(fit.sum()), np.int64))
                waiting += len(counts[-1])
                if waiting > 4_000_000:
                    compact()
                    waiting = 0
    wide = np.flatnonzero(df > few)
    if len(wide):
        owner = group[row[head[wide]]]
        bounds = np.searchsorted(group, np.arange(group[-1] + 2))
        for g in np.unique(owner).tolist():
            lo, hi = int(bounds[g]), int(bounds[g + 1])
            dense = np.zeros((hi - lo, hi - lo), np.float32)
            mine = wide[owner == g]
            for c in range(0, len(mine), 2048):
                cols = mine[c:c + 2048]
                part = np.zeros((hi - lo, len(cols)), np.float32)
                where = np.repeat(np.arange(len(cols)), df[cols])
                place = np.repeat(head[cols], df[cols]) + np.arange(len(where)) - np.repeat(np.cumsum(df[cols]) - df[cols], df[cols])
                part[row[place] - lo, where] = 1
                dense += part @ part.T
            a, b = np.nonzero(np.triu(dense, 1))
            small, large = np.minimum(sizes[a + lo], sizes[b + lo]), np.maximum(sizes[a + lo], sizes[b + lo])
            fit = small * 100 >= threshold * large
            pair_sums.append((a[fit] + lo) * total + b[fit] + lo)
            counts.append(dense[a[fit], b[fit]].astype(np.int64))
    if not pair_sums:
        return []
    compact()
    pair, both = pair_sums[0], counts[0]
    a, b = pair // total, pair % total
    linked = 100 * both >= threshold * (sizes[a] + sizes[b] - both)
    forest = _Forest(total)
    return [(x, y) for x, y in zip(a[linked].tolist(), b[linked].tolist()) if forest.join(x, y)]


def _links(blocks: DataFrame, threshold: int) -> DataFrame:
    """``a, b`` links of every block.  Input: ``block, node, grams``, sorted by block in each partition."""
    def solve(table: pa.Table):
        nodes = table["node"].to_numpy()
        packed, offsets = utf8(table["grams"])
        begin = offsets // 8
        block = table["block"].to_numpy()
        group = np.cumsum(np.r_[False, block[1:] != block[:-1]])
        found = block_product(np.diff(begin), np.frombuffer(packed.tobytes(), np.uint64), np.repeat(np.arange(len(nodes)), np.diff(begin)), group, threshold)
        a, b = (np.array([x[i] for x in found], np.int64) for i in (0, 1))
        return pa.RecordBatch.from_arrays([pa.array(nodes[a]), pa.array(nodes[b])], names=["a", "b"])

    def run(batches):
        held: list[pa.RecordBatch] = []
        rows = size = 0
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                held.append(batch.slice(at, 512))
                rows += held[-1].num_rows
                size += held[-1].column("grams").nbytes
                if rows < FLUSH_ROWS and size < 8 * BLOCK_GRAMS:
                    continue
                table = pa.Table.from_batches(held)
                block = table["block"].to_numpy()
                edge = int(np.searchsorted(block, block[-1]))  # the last block may go on
                if edge:
                    yield solve(table.slice(0, edge))
                    held = table.slice(edge).combine_chunks().to_batches()
                    rows, size = sum(b.num_rows for b in held), sum(b.column("grams").nbytes for b in held)
        if held:
            yield solve(pa.Table.from_batches(held))

    return blocks.mapInArrow(run, "a long, b long")


def _sized(groups: DataFrame, rows: int, grams: int) -> DataFrame:
    """``groups`` with ``large``: whether the row's component goes beyond one block."""
    blocks = F.greatest(F.ceil(F.col("rows") / rows), F.ceil(F.col("grams") / grams))
    whole = groups.groupBy("component").agg(F.count("*").alias("rows"), F.sum("n_grams").alias("grams")).select("component", (blocks > 1).alias("large"))
    return groups.join(whole, "component")


def _block_keys(groups: DataFrame, threshold: int, rows: int, grams: int) -> DataFrame:
    """``block, node``: the blocks and block pairs that every node of a candidate group belongs to."""
    size_class = F.floor(F.log(F.col("n_grams").cast("double")) / F.lit(float(np.log(Blocks(threshold).ratio))) + F.lit(1e-9)).cast("int")
    blocks = F.greatest(F.ceil(F.col("rows") / rows), F.ceil(F.col("grams") / grams)).cast("int")
    nodes = _sized(groups.withColumn("k", size_class), rows, grams)
    small = nodes.filter("NOT large").select(F.xxhash64("component").alias("block"), "node")
    large = nodes.filter("large")
    parts = large.groupBy("component", "k").agg(F.count("*").alias("rows"), F.sum("n_grams").alias("grams")).select("component", "k", blocks.alias("m"))
    near = (parts.join(parts.select("component", F.col("k").alias("k1"), F.col("m").alias("m1")).withColumn("k", F.col("k1") - 1).drop("k1"), ["component", "k"], "left")
            .join(parts.select("component", F.col("k").alias("k0"), F.col("m").alias("m0")).withColumn("k", F.col("k0") + 1).drop("k0"), ["component", "k"], "left"))
    own = F.pmod(F.xxhash64("node"), F.col("m")).cast("int")
    cells = large.join(near, ["component", "k"]).withColumn("i", own)
    pair = lambda k0, i0, k1, i1: F.struct(F.lit(k0).alias("k0") if isinstance(k0, int) else k0.alias("k0"), i0.alias("i0"), k1.alias("k1"), i1.alias("i1"))
    k, i = F.col("k"), F.col("i")
    sequence = lambda m: F.sequence(F.lit(0), F.coalesce(F.col(m), F.lit(1)) - 1)
    inside = F.transform(sequence("m"), lambda j: pair(k, F.least(i, j), k, F.greatest(i, j)))
    above = F.when(F.col("m1").isNotNull(), F.transform(sequence("m1"), lambda j: pair(k, i, k + 1, j)))
    below = F.when(F.col("m0").isNotNull(), F.transform(sequence("m0"), lambda j: pair(k - 1, j, k, i)))
    empty = F.array().cast("array<struct<k0:int,i0:int,k1:int,i1:int>>")
    typed = lambda c: F.coalesce(c.cast("array<struct<k0:int,i0:int,k1:int,i1:int>>"), empty)
    spread = cells.select("component", "node", F.explode(F.array_distinct(F.concat(typed(inside), typed(above), typed(below)))).alias("p"))
    return small.unionByName(spread.select(F.xxhash64("component", "p.k0", "p.i0", "p.k1", "p.i1").alias("block"), "node"))


def join_groups(df: DataFrame, n: int = 3, threshold: int = 90, id_col: str = "doc_id", text_col: str = "text",
                block_rows: int = BLOCK_ROWS, block_grams: int = BLOCK_GRAMS) -> DataFrame:
    """``doc_id, n_grams, component_id``: the smallest key reachable by links, for every text."""
    spark = df.sparkSession
    docs = documents(df, id_col, text_col).filter("doc_id IS NOT NULL")
    member = written(members(docs, n), "members")
    node_docs = member.filter("node IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("first_id"), F.first("n_grams").alias("n_grams"))
    met = meetings(docs, n, threshold)
    pivot = F.min("node").over(Window.partitionBy("sig"))
    pairs = met.select("node", F.coalesce("other", pivot).alias("other")).filter("node <> other").distinct()
    groups = components(pairs, "node", "other")
    wanted = written(groups.join(node_docs, "node"), "candidates")
    drop_shuffles(spark)
    # shuffled by key whatever the number of candidates: one plan at every size
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    texts = docs.repartition(parts, "doc_id").join(wanted.select(F.col("first_id").alias("doc_id"), "node"), "doc_id").select("node", "text")
    sized = _sized(wanted, block_rows, block_grams)
    if sized.filter("large").limit(1).count():
        texts = written(texts, "candidate-texts")
        sized = written(sized, "sized")
        crowd = sized.filter("large").drop("large")
        wanted = written(sized.filter("NOT large").drop("large").unionByName(_split_groups(crowd, texts, n, threshold)), "candidates")
    keys = _block_keys(wanted, threshold, block_rows, block_grams)
    blocks = keys.join(_sets(texts, n), "node").select("block", "node", "grams").repartition(parts, "block").sortWithinPartitions("block")
    linked = components(written(_links(blocks, threshold), "links"))
    named = node_docs.join(linked, "node", "left").withColumn("component", F.coalesce("component", "node"))
    smallest = named.groupBy("component").agg(F.min("first_id").alias("component_id"))
    ids = named.select("node", "component").join(smallest, "component").select("node", "component_id")
    return member.join(ids, "node", "left").select("doc_id", "n_grams", F.coalesce("component_id", "doc_id").alias("component_id"))
