"""Helpers shared by the operators: Arrow text buffers, polynomial hashes, written tables."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexis.session import drop_shuffles, ensure_checkpoint_dir  # noqa: F401 (drop_shuffles: for the operators)

CHUNK_BYTES = 2 << 20
"""Text bytes that one vectorised step works on; longer single texts form their own step."""

_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1


def documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the key and the text, under fixed names; other columns never reach an operator."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once into the shared checkpoint folder and read it back.

    Cuts the lineage and keeps later readers from computing ``df`` again; the
    files outlive any executor.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/lexis-llm/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets (starting at 0) of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "").cast(pa.large_binary())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0]:at[-1]] if len(at) else raw[:0], at - at[0] if len(at) else np.zeros(1, np.int64)


def row_chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES):
    """Row ranges (lo, hi) of about ``limit`` bytes; every row belongs to exactly one."""
    lo, rows = 0, len(offsets) - 1
    while lo < rows:
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1
        hi = min(max(hi, lo + 1), rows)
        yield lo, hi
        lo = hi


_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """B^i and B^-i modulo 2^64 for i < n (kept between calls, grown by doubling)."""
    if len(_powers.get("up", ())) < n:
        size = 1 << max(16, (n - 1).bit_length())
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            table = np.ones(size, np.uint64)
            done = 1
            while done < size:
                table[done:2 * done] = table[:done] * np.uint64(pow(base, done, 1 << 64))
                done *= 2
            _powers[name] = table
    return _powers["up"], _powers["down"]


def prefix_hash(values: np.ndarray) -> np.ndarray:
    """G[i] = sum of values[j] * B^j for j < i, modulo 2^64."""
    up, _ = powers(len(values) + 1)
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values.astype(np.uint64) * up[:len(values)], out=out[1:])
    return out


def range_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Position-free polynomial hash of values[start:end] from the prefix hashes."""
    _, down = powers(len(prefix))
    return (prefix[end] - prefix[start]) * down[start]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads the polynomial hash over all 64 bits."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def words8(buffer: np.ndarray) -> np.ndarray:
    """The eight bytes from every offset of ``buffer`` as one integer (a strided view)."""
    return np.ndarray((max(len(buffer) - 7, 0),), "<u8", np.ascontiguousarray(buffer).data, strides=(1,))


def class_table(*points: int) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(points)] = True
    return table


BLANK = class_table(0x20, *range(0x09, 0x0E))
"""Bytes that end a word of ``[^\\x20\\x09-\\x0D]+``."""


def word_bounds(raw: np.ndarray, offsets: np.ndarray, stops: np.ndarray = BLANK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte start and end of every word, and the first word of each row (rows + 1 entries)."""
    inside = ~stops[raw]
    first = np.zeros(len(raw) + 1, bool)
    first[offsets[:-1]] = True
    first = first[:len(raw)]
    opens = inside.copy()
    opens[1:] &= ~inside[:-1] | first[1:]
    starts = np.flatnonzero(opens)
    closes = inside.copy()
    closes[:-1] &= ~inside[1:] | first[1:]
    ends = np.flatnonzero(closes) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def lower_ascii(raw: np.ndarray) -> np.ndarray:
    return np.where((raw >= 65) & (raw <= 90), raw + np.uint8(32), raw)
