"""Fill-in-the-middle rearrangement of texts as a pyarrow.compute pipeline.

A text of n code points is cut at two hashed places into prefix, middle and
suffix and written in prefix-suffix-middle (``psm``) or suffix-prefix-middle
(``spm``) order with markers, or left as it is (``plain``).  Where a text is
cut, and in which form, depends on its ``doc_id`` and length alone.

Per Arrow batch: texts are split into list arrays of code points, flattened
with their parent indices, numbered by ordinals, filtered by role, rebuilt as
lists and joined.  A text longer than ``SEGMENT_BYTES`` passes through as
several lists with running ordinals, so the arrays of a step stay bounded.

Null texts are read as empty; empty texts, and texts that hold a marker
already, are ``plain``.  A null ``doc_id`` is hashed as an empty number and
comes back as null.  Repeated rows are arranged once each, alike when key and
length are.  Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexis.llm.common import documents, row_chunks, utf8

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
ARRANGED_PERCENT = 90
SPM_PERCENT = 20
SALT = "1:"

SEGMENT_BYTES = 256 << 10
"""Text bytes whose code points are held as list arrays at once."""

ARRANGED = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


def _hash_group(digest: Column, i: int) -> Column:
    """The i-th group of eight hex digits as an unsigned integer."""
    return F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long")


def planned(df: DataFrame, arranged_percent: int = ARRANGED_PERCENT, spm_percent: int = SPM_PERCENT, salt: str = SALT) -> DataFrame:
    """``doc_id, text, n, form, prefix_chars, middle_chars`` of every row (the last two null for plain texts)."""
    digest = F.sha2(F.concat(F.lit(salt), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256)
    rows = documents(df).select("doc_id", F.coalesce("text", F.lit("")).alias("text"), digest.alias("digest"))
    rows = rows.select("doc_id", "text", F.length("text").cast("long").alias("n"), *[_hash_group(F.col("digest"), i).alias(f"h{i + 1}") for i in range(4)])
    a, b = (F.col(h) % (F.col("n") + 1) for h in ("h1", "h2"))
    marked = F.col("text").contains(PREFIX) | F.col("text").contains(SUFFIX) | F.col("text").contains(MIDDLE)
    plain = (F.col("n") == 0) | marked | (F.col("h3") % 100 >= arranged_percent)
    form = F.when(plain, "plain").when(F.col("h4") % 100 < spm_percent, "spm").otherwise("psm")
    rows = rows.select("doc_id", "text", "n", form.alias("form"), F.least(a, b).alias("first"), F.greatest(a, b).alias("second"))
    cut = F.col("form") != "plain"
    return rows.select("doc_id", "text", "n", "form", F.when(cut, F.col("first")).alias("prefix_chars"),
                       F.when(cut, F.col("second") - F.col("first")).alias("middle_chars"))


def _segments(raw: np.ndarray, offsets: np.ndarray):
    """(row, byte start, byte end) of every list: whole texts, long ones in several, cut between code points."""
    for row, (lo, hi) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
        while hi - lo > SEGMENT_BYTES:
            cut = lo + SEGMENT_BYTES
            while raw[cut] & 0xC0 == 0x80:
                cut -= 1
            yield row, lo, cut
            lo = cut
        yield row, lo, hi


def _steps(segments):
    """Runs of segments of about ``SEGMENT_BYTES`` together."""
    step, size = [], 0
    for segment in segments:
        if step and size + segment[2] - segment[1] > SEGMENT_BYTES:
            yield step
            step, size = [], 0
        step.append(segment)
        size += segment[2] - segment[1]
    if step:
        yield step


def split_by_role(texts: pa.Array, first: np.ndarray, second: np.ndarray) -> list[pa.Array]:
    """Prefix, middle and suffix of every text, cut before its code points number ``first`` and ``second``."""
    raw, offsets = utf8(texts)
    done = np.zeros(len(texts), np.int64)  # code points of a text seen in earlier steps
    pieces: list[list[pa.Array]] = [[], [], []]
    rows_of = []
    for step in _steps(_segments(raw, offsets)):
        rows = np.array([s[0] for s in step], np.int64)
        begin, end = step[0][1], step[-1][2]
        part = raw[begin:end]
        lead = np.flatnonzero((part & 0xC0) != 0x80)
        places = np.append(lead, len(part)).astype(np.int32)
        units = pa.StringArray.from_buffers(len(lead), pa.py_buffer(places), pa.py_buffer(np.ascontiguousarray(part)))
        edge = np.searchsorted(lead, np.array([s[1] - begin for s in step] + [end - begin]))
        lists = pa.ListArray.from_arrays(pa.array(edge, pa.int32()), units)
        sizes = np.diff(edge)
        # segments of one text lie side by side: those before a segment count towards its first ordinal
        before = np.cumsum(sizes) - sizes
        opens = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
        base = done[rows] + before - np.repeat(before[opens], np.diff(np.r_[opens, len(rows)]))
        np.add.at(done, rows, sizes)
        flat, parent = pc.list_flatten(lists), pc.list_parent_indices(lists)
        ordinal = pc.add(pc.subtract(pa.array(np.arange(len(flat))), pa.array(edge[:-1]).take(parent)), pa.array(base).take(parent))
        in_prefix = pc.less(ordinal, pa.array(first[rows]).take(parent))
        in_suffix = pc.greater_equal(ordinal, pa.array(second[rows]).take(parent))
        for out, role in zip(pieces, (in_prefix, pc.invert(pc.or_(in_prefix, in_suffix)), in_suffix)):
            out.append(_joined(pc.filter(flat, role), pc.filter(parent, role), len(step)))
        rows_of.append(rows)
    owner = pa.array(np.concatenate(rows_of) if rows_of else np.zeros(0, np.int64))
    return [_joined(pa.chunked_array(p, pa.string()).combine_chunks(), owner, len(texts)) for p in pieces]


def _joined(units: pa.Array, parent: pa.Array, n: int) -> pa.Array:
    """Lists rebuilt from sorted parent indices, each joined into one string."""
    edge = np.searchsorted(parent.to_numpy(zero_copy_only=False), np.arange(n + 1))
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(edge, pa.int32()), units), "")


def arrange(texts: pa.Array, form: pa.Array, prefix_chars: pa.Array, middle_chars: pa.Array) -> pa.Array:
    """The output of every text in its form."""
    cut = pc.not_equal(form, "plain")
    first = pc.filter(prefix_chars, cut).to_numpy(zero_copy_only=False).astype(np.int64)
    second = first + pc.filter(middle_chars, cut).to_numpy(zero_copy_only=False).astype(np.int64)
    prefix, middle, suffix = split_by_role(pc.filter(texts, cut), first, second)
    psm = pc.binary_join_element_wise(PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle, "")
    spm = pc.binary_join_element_wise(SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle, "")
    ordered = pc.if_else(pc.equal(pc.filter(form, cut), "psm"), psm, spm)
    return pc.replace_with_mask(texts.cast(pa.string()), cut, ordered.cast(pa.string()))


def _pair(texts: pa.Array, marker: str) -> tuple[pa.Array, pa.Array]:
    """What stands before and after the first marker."""
    halves = pc.split_pattern(texts, marker, max_splits=1)
    return pc.list_element(halves, 0), pc.list_element(halves, 1)


def undo(output: pa.Array, form: pa.Array) -> pa.Array:
    """The texts, from outputs and forms alone.

    A marker holds its first and last sign nowhere else, so its first
    occurrence is the written one: cut texts hold no marker.
    """
    output = output.cast(pa.string())
    back = output
    for kind, opening, second in (("psm", PREFIX, SUFFIX), ("spm", SUFFIX, PREFIX)):
        mine = pc.equal(form, kind)
        one, rest = _pair(pc.utf8_slice_codeunits(pc.filter(output, mine), len(opening)), second)
        two, middle = _pair(rest, MIDDLE)
        prefix, suffix = (one, two) if kind == "psm" else (two, one)
        back = pc.replace_with_mask(back, mine, pc.binary_join_element_wise(prefix, middle, suffix, ""))
    return back


def fill_in_middle(df: DataFrame, arranged_percent: int = ARRANGED_PERCENT, spm_percent: int = SPM_PERCENT, salt: str = SALT) -> DataFrame:
    """``doc_id, n, form, prefix_chars, middle_chars, output`` of every text."""
    def run(batches):
        for batch in batches:
            _, offsets = utf8(batch.column("text"))
            for lo, hi in row_chunks(offsets):
                part = batch.slice(lo, hi - lo)
                made = arrange(*[part.column(c) for c in ("text", "form", "prefix_chars", "middle_chars")])
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in ("doc_id", "n", "form", "prefix_chars", "middle_chars")], made],
                                                 names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    return planned(df, arranged_percent, spm_percent, salt).mapInArrow(run, ARRANGED)


def restored(arranged: DataFrame) -> DataFrame:
    """``arranged`` with ``restored``, the text rebuilt from ``output`` and ``form`` (a null output stays null)."""
    def run(batches):
        for batch in batches:
            yield batch.append_column("restored", undo(batch.column("output"), batch.column("form")))

    return arranged.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output").mapInArrow(run, ARRANGED + ", restored string")
