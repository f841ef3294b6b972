"""Line dedup by a deletion-neighbourhood join over words.

A line is a maximal run without ``\\n``; its words are the runs without ASCII
white space, and two lines are as far apart as the fewest words to insert,
remove or replace.  A line of at least ``min_words`` words goes when an equal
line came earlier (smaller key, or same text and earlier line); a line of at
least ``near_words`` words also goes when a line of that length within one
word came earlier.  Lines are judged on the input, not on what is left.

1. Equal lines: one aggregation by line hash keeps the earliest place.
2. Lines with a possible partner: of two lines one word apart, the first or
   the last half (of the shorter length) is the same, so lines that share no
   half with a different line have an empty neighbourhood and stop here.  A
   task sends one line for each half, and tells at once which lines met there.
3. The others send the hash of every variant with one word deleted, with its
   place, and of the whole line.  Equal variants at the same place are one
   replaced word; a variant equal to a whole line is one inserted word.
   Aggregations keep the earliest line of each variant, so no pairs of a
   group are formed, whatever its size.
4. Each line's earliest partner is checked on the words themselves.

Defined cases: null text has no lines; lines without words and lines below
``min_words`` always stay; rows with equal ``doc_id`` are taken as one position
in the order (equal rows keep equal lines); null ``doc_id`` rows are left out.
Other columns are ignored by the operator.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexis.llm.common import CHUNK_BYTES, documents, mix, powers, prefix_hash, range_hash, row_chunks, signed, utf8, word_bounds, written

TEXT_BYTES = CHUNK_BYTES // 4
"""Text bytes of one step here: a worker keeps hashes, places and power tables of many times that size."""

MIN_WORDS = 5
NEAR_WORDS = 10
_ODD = np.uint64(0x9E3779B97F4A7C15)


class Lines:
    """Word and line structure of concatenated texts."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray):
        starts, ends, edge = word_bounds(raw, offsets)
        breaks = np.flatnonzero(raw == 10)
        row = np.searchsorted(edge, np.arange(len(starts)), "right") - 1
        line = np.searchsorted(breaks, starts) - np.searchsorted(breaks, offsets[:-1])[row]
        head = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (line[1:] != line[:-1])]) if len(starts) else np.zeros(0, np.int64)
        self.first, self.last = head, np.r_[head[1:], len(starts)] if len(head) else head
        self.row, self.line = row[head], line[head]
        words = mix(range_hash(prefix_hash(raw), starts, ends) + (ends - starts).astype(np.uint64))
        self.prefix = prefix_hash(words)
        self.starts, self.ends = starts, ends

    def key(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Hash of the word sequences [first, last) and their length."""
        return mix(range_hash(self.prefix, first, last) + (last - first).astype(np.uint64) * _ODD)

    def halves(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(hash, index into ``at``) of the first and the last half of each line.

        A half is ``n // 2`` words.  Lines of an even length also send halves of
        one word less, which is what a line one word shorter sends.
        """
        a, b = self.first[at], self.last[at]
        n = b - a
        even = np.flatnonzero(n % 2 == 0)
        who = np.r_[np.arange(len(at)), even]
        half = np.r_[n // 2, n[even] // 2 - 1]
        a, b = a[who], b[who]
        return np.r_[mix(self.key(a, a + half) + np.uint64(1)), mix(self.key(b - half, b) + np.uint64(2))], np.r_[who, who]

    def deletions(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(variant hash, place of the deleted word, index into ``at``) of every one-word deletion."""
        a, b = self.first[at], self.last[at]
        n = b - a
        who = np.repeat(np.arange(len(at)), n)
        place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        up, _ = powers(int(n.max(initial=0)) + 1)
        i = a[who] + place
        left = range_hash(self.prefix, a[who], i)
        right = range_hash(self.prefix, i + 1, b[who]) * up[place]
        return mix(left + right + (n[who] - 1).astype(np.uint64) * _ODD), place, who


def _line_rows(docs: DataFrame, min_words: int) -> DataFrame:
    """``doc_id, line, id`` of every judged line."""
    def run(batches):
        for batch in batches:
            raw, offsets = utf8(batch.column("text"))
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            for lo, hi in row_chunks(offsets, TEXT_BYTES):
                lines = Lines(raw[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo])
                at = np.flatnonzero(lines.last - lines.first >= min_words)
                yield pa.RecordBatch.from_arrays([pa.array(ids[lo:hi][lines.row[at]]), pa.array(lines.line[at]),
                                                  pa.array(signed(lines.key(lines.first[at], lines.last[at])))], names=["doc_id", "line", "id"])

    return docs.mapInArrow(run, "doc_id long, line long, id long")


def _half_rows(docs: DataFrame, near_words: int) -> DataFrame:
    """``k, id, met``: one line for each half met in the task, and (``met``) every line that met a different one there."""
    def run(batches):
        for batch in batches:
            raw, offsets = utf8(batch.column("text"))
            halves, owners = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
            for lo, hi in row_chunks(offsets, TEXT_BYTES):
                lines = Lines(raw[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo])
                at = np.flatnonzero(lines.last - lines.first >= near_words)
                half, who = lines.halves(at)
                halves.append(half)
                owners.append(signed(lines.key(lines.first[at], lines.last[at]))[who])
            half, owner = np.concatenate(halves), np.concatenate(owners)
            order = np.lexsort((owner, half))
            half, owner = half[order], owner[order]
            first = np.r_[True, half[1:] != half[:-1]][:len(half)]
            pivot = owner[np.maximum.accumulate(np.where(first, np.arange(len(half)), 0))] if len(half) else owner
            met = np.unique(np.r_[owner[owner != pivot], pivot[owner != pivot]])
            k = np.r_[signed(half[first]), signed(mix(met.astype(np.uint64)))]
            yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(np.r_[owner[first], met]),
                                              pa.array(np.r_[np.zeros(first.sum(), bool), np.ones(len(met), bool)])], names=["k", "id", "met"])

    return docs.mapInArrow(run, "k long, id long, met boolean")


def _line_words(texts: DataFrame) -> DataFrame:
    """``doc_id, line, words`` of the lines in the ``lines`` list (words joined by single blanks)."""
    def run(batches):
        for batch in batches:
            raw, offsets = utf8(batch.column("text"))
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            for lo, hi in row_chunks(offsets, TEXT_BYTES):
                body = raw[offsets[lo]:offsets[hi]]
                lines = Lines(body, offsets[lo:hi + 1] - offsets[lo])
                part = batch.column("lines").slice(lo, hi - lo)
                rows = np.repeat(np.arange(hi - lo), part.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
                wanted = rows * (1 << 40) + part.flatten().to_numpy(zero_copy_only=False)
                at = np.flatnonzero(np.isin(lines.row * (1 << 40) + lines.line, wanted))
                data = body.tobytes()
                words = [b" ".join(data[lines.starts[a]:lines.ends[b - 1]].split()).decode() for a, b in zip(lines.first[at].tolist(), lines.last[at].tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(ids[lo:hi][lines.row[at]]), pa.array(lines.line[at]), pa.array(words, pa.string())], names=["doc_id", "line", "words"])

    return texts.mapInArrow(run, "doc_id long, line long, words string")


def _variant_rows(words: DataFrame) -> DataFrame:
    """``key, place, doc_id, line``: one-word deletions of the lines; place -1 is the whole line."""
    names = ["key", "place", "doc_id", "line"]

    def run(batches):
        for batch in batches:
            raw, offsets = utf8(batch.column("words"))
            ids, line = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("doc_id", "line"))
            for lo, hi in row_chunks(offsets, TEXT_BYTES):
                lines = Lines(raw[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo])
                at = np.arange(len(lines.first))
                key, place, who = lines.deletions(at)
                row = lo + lines.row[np.r_[who, at]]
                key = np.r_[key, lines.key(lines.first, lines.last)]
                yield pa.RecordBatch.from_arrays([pa.array(signed(key)), pa.array(np.r_[place, np.full(len(at), -1)]), pa.array(ids[row]), pa.array(line[row])], names=names)

    return words.mapInArrow(run, ", ".join(f"{x} long" for x in names))


def within_one_word(a: str, b: str) -> bool:
    """Whether at most one word is inserted, removed or replaced between two lines."""
    x, y = a.split(" "), b.split(" ")
    if abs(len(x) - len(y)) > 1:
        return False
    same = 0
    while same < min(len(x), len(y)) and x[same] == y[same]:
        same += 1
    rest = x[same:], y[same:]
    return rest[0][1:] == rest[1][1:] or rest[0] == rest[1][1:] or rest[0][1:] == rest[1]


def _verified(pairs: DataFrame) -> DataFrame:
    def run(batches):
        for batch in batches:
            good = [within_one_word(a, b) for a, b in zip(batch.column("words").to_pylist(), batch.column("other_words").to_pylist())]
            yield batch.filter(pa.array(good, pa.bool_())).select(["doc_id", "line"])

    return pairs.mapInArrow(run, "doc_id long, line long")


def repeated_lines(df: DataFrame, min_words: int = MIN_WORDS, near_words: int = NEAR_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, text, judged, exact, near``: every text, how many lines were judged, and the line numbers that go."""
    if near_words < max(min_words, 4):
        raise ValueError("near_words must be at least min_words and 4")
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    docs = documents(df, id_col, text_col).filter("doc_id IS NOT NULL")
    placed = docs.repartition(n, "doc_id")  # one exchange of the texts serves every later join
    lines = written(_line_rows(docs, min_words), "lines").withColumn("at", F.struct("doc_id", "line"))
    firsts = lines.groupBy("id").agg(F.min("at").alias("first"))

    whole = Window.partitionBy("k")
    halves = _half_rows(docs, near_words).select("id", "met", (F.min("id").over(whole) < F.max("id").over(whole)).alias("shared"))
    maybe = halves.filter("met OR shared").select("id").distinct()
    chosen = written(maybe.join(firsts, "id").select("id", "first.doc_id", "first.line"), "maybe")
    lists = chosen.groupBy("doc_id").agg(F.collect_list("line").alias("lines"))
    # the words of the chosen lines, dealt once for the variants and the check
    words = _line_words(placed.join(lists, "doc_id")).repartition(n, "doc_id", "line")
    variants = _variant_rows(words).select("key", "place", F.struct("doc_id", "line").alias("at"))
    earliest = variants.groupBy("key", "place").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    kinds = earliest.groupBy("key").agg(F.min(F.when(F.col("place") < 0, F.col("first"))).alias("whole"), F.min(F.when(F.col("place") >= 0, F.col("first"))).alias("cut"),
                                        F.sum("n").alias("lines")).filter("lines > 1")
    other = F.when(F.col("place") < 0, F.col("cut")).otherwise(F.col("whole"))
    partner = earliest.join(kinds, "key").filter((F.col("place") >= 0) & (F.col("n") > 1) | other.isNotNull()).select(
        "key", "place", F.least(F.when(F.col("place") >= 0, F.col("first")), other).alias("partner"))
    pairs = variants.join(partner, ["key", "place"]).filter("partner < at").groupBy("at").agg(F.min("partner").alias("partner")).select(
        "at.doc_id", "at.line", F.col("partner.doc_id").alias("other_id"), F.col("partner.line").alias("other_line"))

    others = words.select(F.col("doc_id").alias("other_id"), F.col("line").alias("other_line"), F.col("words").alias("other_words"))
    near = _verified(pairs.join(words, ["doc_id", "line"]).join(others, ["other_id", "other_line"])).distinct()
    near_ids = chosen.join(near, ["doc_id", "line"]).select("id", F.lit(True).alias("near"))

    gone = lines.join(firsts, "id").join(near_ids, "id", "left").select("doc_id", "line", (F.col("at") > F.col("first")).alias("exact"), F.coalesce("near", F.lit(False)).alias("near"))
    per_text = gone.groupBy("doc_id").agg(F.countDistinct("line").alias("judged"), F.collect_set(F.when(F.col("exact"), F.col("line"))).alias("exact"),
                                          F.collect_set(F.when(F.col("near") & ~F.col("exact"), F.col("line"))).alias("near"))
    return placed.join(per_text, "doc_id", "left").select("doc_id", "text", F.coalesce("judged", F.lit(0)).alias("judged"), "exact", "near")


def deduplicated(df: DataFrame, **options) -> DataFrame:
    """``doc_id, text, n_lines, n_judged, n_exact, n_near, only_copies``.

    ``text`` is what is left; ``only_copies`` marks texts all of whose judged
    lines go (at least one).  ``n_lines`` counts lines with a word.
    """
    blank = " \t\n\v\f\r"

    def run(batches):
        for batch in batches:
            out = []
            for text, judged, exact, near in zip(*(batch.column(c).to_pylist() for c in ("text", "judged", "exact", "near"))):
                lines = [] if text is None else text.split("\n")
                gone = {*(exact or ()), *(near or ())}
                if gone:
                    text = "\n".join([line for i, line in enumerate(lines) if i not in gone])
                out.append((text, sum(1 for line in lines if line.strip(blank)), judged, len(exact or ()), len(near or ()), judged > 0 and len(gone) == judged))
            columns = list(zip(*out)) or [()] * 6
            types = [pa.string(), *[pa.int64()] * 4, pa.bool_()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(c, t) for c, t in zip(columns, types)]],
                                             names=["doc_id", "text", "n_lines", "n_judged", "n_exact", "n_near", "only_copies"])

    return repeated_lines(df, **options).mapInArrow(run, "doc_id long, text string, n_lines long, n_judged long, n_exact long, n_near long, only_copies boolean")
