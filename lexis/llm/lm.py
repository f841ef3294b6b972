"""Cross-entropy difference scoring with matched bigram models.

A target and a background model share one vocabulary, one order and one
smoothing; the background counts are scaled to the target's token total, so
both are smoothed by the same mass.  A text's score is the mean over its
tokens of target loss minus background loss, in bits: the lower, the closer to
the target.

Tokens are runs of ASCII digits, ASCII letters (lower-cased) and characters
beyond ASCII.  The vocabulary is every word of all texts, so it and the models
grow with the corpus; a start mark precedes each text.  All counts cover all
texts.

The models are never in one place.  Texts are read once, into blocks of some
megabytes with the block's own word list; a block sends one entry for each of
its distinct words and word pairs, dealt by hash into buckets of bounded size,
a bucket adds up its entries and answers each block, and a block scores its
texts with the answers.  An entry is a pre-aggregated count, so a word that
makes up a third of all tokens is one entry a block.  Texts are never shuffled.

Words and pairs are told apart by 64-bit hashes; two that share one share their
counts.

Defined cases: null, empty and wordless texts have no tokens and null losses;
without target texts the target model is the smoothed uniform one; keys of the
target table that name no text, or repeat, do not matter; texts with equal keys
are in the target together, those with a null key never.  Other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexis.llm.common import class_table, documents, lower_ascii, mix, prefix_hash, range_hash, row_chunks, signed, utf8, word_bounds, written

SMOOTHING = 50.0
BLOCK_BYTES = 4 << 20
"""Text bytes of a block; a longer single text is its own block."""
BUCKET_ENTRIES = 1 << 20
"""Words and pairs that a bucket holds on average."""
BETWEEN = class_table(*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80))
_START = np.uint64(2)  # word hashes are odd
_STATS = -1  # block number of the rows that carry a bucket's totals


def word_hashes(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word, and the first word of each text."""
    raw = lower_ascii(raw)
    starts, ends, edge = word_bounds(raw, offsets, BETWEEN)
    return mix(range_hash(prefix_hash(raw), starts, ends) + (ends - starts).astype(np.uint64)) | np.uint64(1), edge


def packed(*arrays: np.ndarray) -> bytes:
    """Long arrays as one value, each compressed alone and byte plane by byte plane: small numbers take little room in a shuffle."""
    planes = [np.ascontiguousarray(np.ascontiguousarray(a, "<i8").view(np.uint8).reshape(-1, 8).T) for a in arrays]
    parts = [zstandard.ZstdCompressor(level=3).compress(p.tobytes()) for p in planes]
    return np.array([len(parts), *map(len, parts)], "<i8").tobytes() + b"".join(parts)


def unpacked(content: bytes) -> list[np.ndarray]:
    """The arrays of ``packed``."""
    n = int(np.frombuffer(content, "<i8", 1)[0])
    ends = 8 * (n + 1) + np.cumsum(np.frombuffer(content, "<i8", n, 8))
    planes = [np.frombuffer(zstandard.ZstdDecompressor().decompress(content[a:b]), np.uint8) for a, b in zip([8 * (n + 1), *ends[:-1]], ends)]
    return [np.ascontiguousarray(p.reshape(8, -1).T).view("<i8").ravel() for p in planes]


def gaps(keys: np.ndarray) -> np.ndarray:
    """Differences of rising hashes: two bytes shorter than the hashes in blocks of some megabytes."""
    return signed(np.diff(np.r_[np.zeros(1, np.uint64), keys]))


def from_gaps(steps: np.ndarray) -> np.ndarray:
    return np.cumsum(steps.view(np.uint64), dtype=np.uint64)


def _numbers(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Values of a number column, or of a column of number lists one after another."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return (column.flatten() if pa.types.is_list(column.type) else column).to_numpy(zero_copy_only=False)


def blocks(docs: DataFrame) -> DataFrame:
    """``block, doc_ids, lengths, size, content``: texts as places in their block's sorted word list.

    ``content`` packs the word list and the places of all tokens, ``size`` counts both.

    Block numbers come from the writing task, so the result must be written once and read from there.
    """
    def run(batches):
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            raw, offsets = utf8(batch.column("text"))
            for a, b in row_chunks(offsets, BLOCK_BYTES):
                hashes, lengths = [np.zeros(0, np.uint64)], []
                for c, d in row_chunks(offsets[a:b + 1]):
                    found, edge = word_hashes(raw[offsets[a + c]:offsets[a + d]], offsets[a + c:a + d + 1] - offsets[a + c])
                    hashes.append(found)
                    lengths.append(np.diff(edge))
                words, tokens = np.unique(np.concatenate(hashes), return_inverse=True)
                edges = pa.array([0, b - a], pa.int32())
                ids, sizes = (pa.ListArray.from_arrays(edges, x) for x in (batch.column("doc_id").slice(a, b - a), pa.array(np.concatenate(lengths), pa.int64())))
                content = pa.array([packed(gaps(words), tokens)], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array([number]), ids, sizes, pa.array([len(words) + len(tokens)]), content], names=["block", "doc_ids", "lengths", "size", "content"])
                number += 1

    return docs.mapInArrow(run, "block long, doc_ids array<long>, lengths array<long>, size long, content binary")


class Block:
    """Words and word pairs of one block, each in the order of their hashes, which is that of the buckets."""

    def __init__(self, words: np.ndarray, tokens: np.ndarray, lengths: np.ndarray, buckets: int):
        keys = mix(np.r_[words, _START])
        self.width = len(keys)
        self.current = tokens.astype(np.int64)
        self.previous = np.r_[self.width - 1, self.current[:-1]][:len(tokens)]
        self.row = np.repeat(np.arange(len(lengths)), lengths)
        self.previous[np.flatnonzero(np.r_[True, self.row[1:] != self.row[:-1]][:len(self.row)])] = self.width - 1
        self.codes, self.pair = np.unique(self.previous * self.width + self.current, return_inverse=True)
        pairs = mix(mix(keys[self.codes // self.width]) + keys[self.codes % self.width])
        self.word_order, self.word_keys, self.word_bucket = self._dealt(keys, buckets)
        self.pair_order, self.pair_keys, self.pair_bucket = self._dealt(pairs, buckets)

    @staticmethod
    def _dealt(keys: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        return order, keys, (((keys >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.int64)

    def counts(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Counts of words (as a word and as a context, each in all texts and in the chosen ones) and of pairs (all, chosen)."""
        weight = chosen[self.row].astype(float)

        def both(at: np.ndarray, size: int) -> list[np.ndarray]:
            return [np.bincount(at, minlength=size), np.bincount(at, weight, minlength=size)]

        words = np.array(both(self.current, self.width) + both(self.previous, self.width), np.int64)
        return words[:, self.word_order], np.array(both(self.pair, len(self.codes)), np.int64)[:, self.pair_order]


def _entries(marked: DataFrame, buckets: int) -> DataFrame:
    """``bucket, block, content``: what each block knows of each bucket's keys (words, their counts, pairs, their counts)."""
    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for i in range(batch.num_rows):
                words, tokens = unpacked(batch.column("content")[i].as_py())
                if not len(tokens):
                    continue
                lengths = _numbers(batch.column("lengths").slice(i, 1))
                block = Block(from_gaps(words), tokens, lengths, buckets)
                chosen = np.zeros(len(lengths), bool)
                chosen[_numbers(batch.column("chosen").slice(i, 1)).astype(np.int64)] = True
                word_counts, pair_counts = block.counts(chosen)
                hit = np.union1d(block.word_bucket, block.pair_bucket)
                w = np.searchsorted(block.word_bucket, np.r_[hit, buckets])
                p = np.searchsorted(block.pair_bucket, np.r_[hit, buckets])
                content = [packed(gaps(block.word_keys[a:b]), word_counts[:, a:b].ravel(), gaps(block.pair_keys[c:d]), pair_counts[:, c:d].ravel())
                           for a, b, c, d in zip(w[:-1], w[1:], p[:-1], p[1:])]
                number = np.full(len(hit), batch.column("block")[i].as_py())
                yield pa.RecordBatch.from_arrays([pa.array(hit), pa.array(number), pa.array(content, pa.binary())], names=["bucket", "block", "content"])

    return marked.mapInArrow(run, "bucket long, block long, content binary")


def _totals(keys: list[np.ndarray], counts: list[np.ndarray], kinds: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Per block the summed counts (kind by kind) of its keys, and the sums of every distinct key."""
    distinct, at = np.unique(np.concatenate([from_gaps(k) for k in keys]), return_inverse=True)
    places = np.split(at, np.cumsum([len(k) for k in keys])[:-1])
    sums = np.zeros((kinds, len(distinct)), np.int64)
    for place, given in zip(places, counts):
        for kind, row in enumerate(given.reshape(kinds, -1)):
            np.add.at(sums[kind], place, row)  # pairs of one block may share a hash
    return [sums[:, place].ravel() for place in places], sums


def _answers(entries: DataFrame) -> DataFrame:
    """``block, bucket, content, totals``: corpus counts of every block's keys, and a row of totals a bucket."""
    def add(table: pa.Table) -> pa.Table:
        words, word_counts, pairs, pair_counts = zip(*[unpacked(c.as_py()) for c in table.column("content")])
        words, sums = _totals(words, word_counts, 4)
        pairs, _ = _totals(pairs, pair_counts, 2)
        totals = [int((sums[0] > 0).sum()), int(sums[0].sum()), int(sums[1].sum())]
        bucket = _numbers(table.column("bucket"))
        return pa.table({"block": pa.array(np.r_[_numbers(table.column("block")), _STATS]), "bucket": pa.array(np.r_[bucket, bucket[:1]]),
                         "content": pa.array([*[packed(w, p) for w, p in zip(words, pairs)], None], pa.binary()),
                         "totals": pa.array([*[None] * len(bucket), totals], pa.list_(pa.int64()))})

    return entries.groupBy("bucket").applyInArrow(add, "block long, bucket long, content binary, totals array<long>")


def _mean_losses(block: Block, lengths: np.ndarray, answers: pa.Table, totals: tuple[int, int, int], smoothing: float) -> tuple[np.ndarray, np.ndarray]:
    """Mean bits a token of every text under the target and under the background model."""
    order = np.argsort(_numbers(answers.column("bucket")), kind="stable")
    words, pairs = zip(*[unpacked(answers.column("content")[int(i)].as_py()) for i in order])

    def gathered(parts: list[np.ndarray], kinds: int, places: np.ndarray) -> np.ndarray:
        out = np.empty((kinds, len(places)))
        out[:, places] = np.concatenate([part.reshape(kinds, -1) for part in parts], axis=1)
        return out

    word, context = np.split(gathered(words, 4, block.word_order), 2)
    pair = gathered(pairs, 2, block.pair_order)
    size, every, target = totals
    scale = max(target, 1) / every
    before, after = block.codes // block.width, block.codes % block.width
    means = []
    for kind, factor, mass in ((1, 1.0, target), (0, scale, every * scale)):
        single = (word[kind] * factor + 1) / (mass + size + 2)
        loss = -np.log2((pair[kind] * factor + smoothing * single[after]) / (context[kind][before] * factor + smoothing))
        means.append(np.bincount(block.row, loss[block.pair], minlength=len(lengths)) / np.maximum(lengths, 1))
    return means[0], means[1]


def cross_entropy_difference(df: DataFrame, target: DataFrame, smoothing: float = SMOOTHING, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_tokens, loss_target, loss_background, score`` (mean bits a token); ``target``'s first column holds text keys."""
    cut = written(blocks(documents(df, id_col, text_col)), "lm-blocks")
    size = cut.agg(F.sum("size").alias("n")).first()["n"] or 0
    buckets = -(-size // BUCKET_ENTRIES) or 1

    keys = target.select(F.col(target.columns[0]).cast("long").alias("doc_id")).distinct()
    places = cut.select("block", F.posexplode("doc_ids").alias("place", "doc_id")).join(keys, "doc_id", "left_semi")
    chosen = places.groupBy("block").agg(F.collect_list("place").alias("chosen"))  # at most the texts of a block
    marked = cut.join(chosen, "block", "left").select("block", "lengths", "content", F.coalesce("chosen", F.array().cast("array<int>")).alias("chosen"))
    answers = written(_answers(_entries(marked, buckets)), "lm-answers")
    sums = answers.filter(F.col("block") == _STATS).agg(*[F.sum(F.col("totals")[i]) for i in range(3)]).first()
    totals = tuple(int(x or 0) for x in sums)

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, lengths = left.column("doc_ids").combine_chunks().flatten(), _numbers(left.column("lengths"))
        words, tokens = unpacked(left.column("content")[0].as_py())
        means = [np.zeros(len(lengths))] * 2
        if len(tokens):
            means = _mean_losses(Block(from_gaps(words), tokens, lengths, buckets), lengths, right, totals, smoothing)
        columns = [pa.array(x, mask=lengths == 0) for x in (*means, means[0] - means[1])]
        return pa.table([ids, pa.array(lengths), *columns], names=["doc_id", "n_tokens", "loss_target", "loss_background", "score"])

    parts = answers.filter(F.col("block") != _STATS).drop("totals").groupBy("block")
    return cut.groupBy("block").cogroup(parts).applyInArrow(score, "doc_id long, n_tokens long, loss_target double, loss_background double, score double")
