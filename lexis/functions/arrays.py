"""Array, label and hashing column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def one_hot(code, k: int) -> Column:
    """``k``-long 0/1 array with a 1 at ``code``."""
    code = _col(code)
    return F.transform(F.sequence(F.lit(0), F.lit(k - 1)),
                       lambda i: F.when(i == code, 1).otherwise(0))


def argmax(values) -> Column:
    """0-based index of the first maximum of an array."""
    values = _col(values)
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def l2_normalize(vec) -> Column:
    """Divide by the Euclidean norm; an all-zero vector stays zero."""
    vec = _col(vec)
    sq = F.aggregate(vec, F.lit(0.0).cast("double"),
                     lambda acc, x: acc + x.cast("double") * x.cast("double"))
    norm = F.sqrt(sq)
    return F.transform(vec, lambda x: F.when(norm > 0, x.cast("double") / norm)
                       .otherwise(F.lit(0.0)))


def seeded_key(seed, *cols) -> Column:
    """Deterministic pseudo-random sort key: ``md5('<seed>-<c1>-<c2>...')`` (hex).

    The same expression in DuckDB gives the same string, so orderings by
    this key are reproducible in both engines and at any scale.
    """
    head = seed if isinstance(seed, Column) else F.lit(str(seed))
    parts = [head] + [_col(c).cast("string") for c in cols]
    return F.md5(F.concat_ws("-", *parts))


def unit_interval(key) -> Column:
    """Map a hex md5 key to a double in [0, 1) using its first 8 hex digits."""
    return F.conv(F.substring(_col(key), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def hex_int(key, start: int, width: int) -> Column:
    """Integer value of ``width`` hex digits of ``key`` starting at 1-based ``start``."""
    return F.conv(F.substring(_col(key), start, width), 16, 10).cast("long")
