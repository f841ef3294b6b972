"""Join helpers: broadcast only behind a checked size bound."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexis.session import written

# A side is broadcast only if it provably has at most this many rows.
DEFAULT_BROADCAST_ROWS = 200_000


def bounded_broadcast(df: DataFrame, max_rows: int = DEFAULT_BROADCAST_ROWS) -> DataFrame:
    """Return ``broadcast(df)`` when ``df`` has at most ``max_rows`` rows, else ``df``.

    The count is a small job over an already small side (label maps,
    capped vocabularies, class weights).  Beyond the bound the join is left
    to the planner: sort-merge, with AQE free to switch to a broadcast at
    run time if the real size turns out small, and to split skewed keys.
    """
    n = df.limit(max_rows + 1).count()
    return F.broadcast(df) if n <= max_rows else df


# A side is broadcast only if rows * estimated row size stays under this many bytes.
DEFAULT_BROADCAST_BYTES = 256 << 20


def bounded_broadcast_bytes(df: DataFrame, row_bytes: int,
                            max_bytes: int = DEFAULT_BROADCAST_BYTES) -> tuple[DataFrame, bool]:
    """Broadcast ``df`` when its rows take at most ``max_bytes``: ``row_bytes`` each, and the bytes of its strings.

    ``df`` is written once; the size is measured on what was written, and the
    join reads the same table.  Returns ``(table_or_broadcast, broadcast?)``.
    Used for word-vector tables joined to every token: broadcasting them
    removes the token shuffle and with it the hot-word skew.  Beyond the budget
    the join is a sort-merge join whose skewed word partitions AQE splits at run
    time.
    """
    side = written(df, "join-side")
    strings = [F.coalesce(F.sum(F.octet_length(F.col(f"`{f.name}`"))), F.lit(0)) for f in df.schema.fields if f.dataType.simpleString() == "string"]
    size = side.agg(sum(strings, F.count(F.lit(1)) * row_bytes).alias("b")).collect()[0]["b"]
    return (F.broadcast(side), True) if size <= max_bytes else (side, False)


def hot_keys(df: DataFrame, key: str, top: int = 256, sample_frac: float = 0.01,
             seed_col: str | None = None) -> list:
    """The ``top`` most frequent values of ``key`` in a seeded sample (bounded list).

    The sample only decides *which* keys get salted; it never changes a result.
    """
    from lexis.functions.arrays import seeded_key, unit_interval
    basis = F.col(seed_col) if seed_col else F.col(key)
    sampled = df.filter(unit_interval(seeded_key("hot", basis)) < F.lit(sample_frac))
    rows = (sampled.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
            .orderBy(F.desc("n")).limit(top).collect())
    return [r[key] for r in rows]


def salted_join(left: DataFrame, right: DataFrame, key: str, hot: list, salts: int,
                spread_col: str, how: str = "left") -> DataFrame:
    """Equi-join on ``key`` with the ``hot`` keys spread over ``salts`` partitions.

    Left rows of a hot key get salt ``pmod(hash(spread_col), salts)``
    (deterministic, so a retried task reproduces its partitioning); right
    rows of a hot key are replicated once per salt; every other key keeps
    salt 0.  The join result is the same as the plain join; a key holding a
    third of all rows is processed by ``salts`` tasks instead of one.
    """
    if not hot or salts <= 1:
        return left.join(right, key, how)
    l_salt = F.when(F.col(key).isin(hot),
                    F.pmod(F.xxhash64(F.col(spread_col)), F.lit(salts))).otherwise(F.lit(0))
    r_salts = F.when(F.col(key).isin(hot),
                     F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))
                     ).otherwise(F.array(F.lit(0).cast("long")))
    l2 = left.withColumn("_salt", l_salt.cast("long"))
    r2 = right.withColumn("_salt", F.explode(r_salts))
    return l2.join(r2, [key, "_salt"], how).drop("_salt")
