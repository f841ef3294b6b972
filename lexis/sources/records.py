"""Multi-line CSV records read by many tasks per file.

A quoted field may hold line ends, so a byte range of a file cannot tell on its
own whether it starts inside quotes.  Two passes over the physical lines settle
it: the first sums the quote signs of each byte range; the running parity of
the ranges before it says how a range opens.  In the second, each task puts the
lines of its range together into records; only the pieces of a record that
crosses ranges (at most two a range) meet in an exchange.
"""

from __future__ import annotations

import csv
import io

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

WHOLE, TAIL, MIDDLE, HEAD = range(4)
_PIECE = "file string, block long, kind int, first boolean, record string"
_FIELDS = pa.schema([("file", pa.string()), ("block", pa.int64()), ("kind", pa.int32()), ("first", pa.bool_()), ("record", pa.string())])


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """``file, block, line, quotes`` of every physical line; a task sees the lines of a byte range in order."""
    raw = spark.read.option("lineSep", "\n").text(path)
    line = F.regexp_replace("value", "\r$", "")
    return raw.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), line.alias("line"),
                      (F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))).cast("long").alias("quotes"))


def opening_parities(lines: DataFrame) -> dict[tuple[str, int], int]:
    """1 for each byte range that starts inside quotes, else 0: one number per range, as many as the scan has splits."""
    sums = lines.groupBy("file", "block").agg(F.sum("quotes").alias("quotes"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    rows = sums.select("file", "block", (F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2).cast("int").alias("open")).collect()
    return {(r["file"], r["block"]): r["open"] for r in rows}


def _pieces(lines: pa.Array, quotes: np.ndarray, inside: bool) -> tuple[pa.Array, np.ndarray, bool]:
    """Records of consecutive lines, joined by line ends; the line after which each one ends, and whether the last is open."""
    parity = (np.cumsum(quotes) + inside) % 2
    ends = np.flatnonzero(parity == 0)
    still_open = bool(len(parity)) and parity[-1] == 1
    edge = np.r_[0, ends + 1, [len(parity)] if still_open else []].astype(np.int32)
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(edge, pa.int32()), lines), "\n"), ends, still_open


def _assemble(opening: dict[tuple[str, int], int]):
    """Lines of a task -> whole records and the open pieces at the edges of its byte ranges."""
    def run(batches):
        at, started, inside, held = None, False, False, []

        def close():
            """The piece that is still open where a range ends."""
            if held:
                yield pa.RecordBatch.from_pylist([{"file": at[0], "block": at[1], "kind": HEAD if started else MIDDLE, "first": False, "record": "\n".join(held)}], _FIELDS)

        for batch in batches:
            files, blocks = batch.column("file"), batch.column("block").to_numpy()
            names = files.dictionary_encode()
            codes = names.indices.to_numpy()
            cuts = np.flatnonzero((blocks[1:] != blocks[:-1]) | (codes[1:] != codes[:-1])) + 1 if len(blocks) else []
            edges = [0, *cuts, len(blocks)]
            for lo, hi in zip(edges, edges[1:]):
                if lo == hi:
                    continue
                here = (names.dictionary[codes[lo]].as_py(), int(blocks[lo]))
                fresh = here != at
                if fresh:
                    yield from close()
                    at, held, inside = here, [], bool(opening[here])
                    started = not inside  # False: the range opens within a record of an earlier range
                    first = here[1] == 0
                records, ends, still_open = _pieces(batch.column("line").slice(lo, hi - lo), batch.column("quotes").to_numpy()[lo:hi], inside)
                done = records.slice(0, len(ends))
                kinds, firsts = np.full(len(done), WHOLE, np.int32), np.zeros(len(done), bool)
                if len(done):
                    if held:
                        done = pa.concat_arrays([pa.array(["\n".join([*held, done[0].as_py()])], pa.string()), done.slice(1)])
                        held = []
                    if not started:
                        kinds[0], started = TAIL, True
                    firsts[0], first = first, False
                    yield pa.RecordBatch.from_arrays([pa.array([here[0]] * len(done), pa.string()), pa.array(np.full(len(done), here[1])), pa.array(kinds), pa.array(firsts), done], schema=_FIELDS)
                if still_open:
                    held.append(records[len(records) - 1].as_py())
                inside = still_open
        yield from close()

    return run


def csv_records(spark: SparkSession, path: str) -> DataFrame:
    """``file, first, record``: every CSV record of the files, as text; ``first`` marks the first record of a file."""
    lines = _lines(spark, path)
    pieces = lines.mapInArrow(_assemble(opening_parities(lines)), _PIECE)
    whole = pieces.filter(F.col("kind") == WHOLE).select("file", "first", "record")
    edge = pieces.filter(F.col("kind") != WHOLE)
    # a record across ranges: its head, the ranges it fills, and the tail; a file that ends inside quotes has no tail
    order = Window.partitionBy("file").orderBy("block", "kind")
    numbered = edge.withColumn("crossing", F.sum(F.when(F.col("kind") == HEAD, 1).otherwise(0)).over(order))
    joined = numbered.groupBy("file", "crossing").agg(F.array_sort(F.collect_list(F.struct("block", "kind", "record"))).alias("parts"), F.min("block").alias("block"))
    text = F.array_join(F.transform("parts", lambda p: p["record"]), "\n")
    return whole.unionByName(joined.select("file", F.lit(False).alias("first"), text.alias("record")))


def header_of(records: DataFrame) -> list[str]:
    """Column names from the first record of the first file."""
    row = records.filter("first").orderBy("file").select("record").limit(1).collect()
    return next(csv.reader(io.StringIO(row[0]["record"])), []) if row else []


def read_csv_table(spark: SparkSession, path: str) -> DataFrame:
    """``file`` and one text column per header name; blank records are skipped, missing fields are null."""
    records = csv_records(spark, path)
    header = [c.lstrip("\ufeff") for c in header_of(records)]
    schema = ", ".join(f"c{i} STRING" for i in range(max(len(header), 1)))
    body = records.filter(~F.col("first") & (F.trim("record") != "")).select(
        F.element_at(F.split("file", "/"), -1).alias("file"), F.from_csv("record", F.lit(schema), {"escape": '"', "quote": '"', "mode": "PERMISSIVE", "maxCharsPerColumn": "-1"}).alias("r"))
    return body.select("file", *[F.col(f"r.c{i}").alias(name) for i, name in enumerate(header)])
