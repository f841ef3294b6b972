"""Benchmark decontamination by a prefix-filtered set join, in DataFrame functions only.

Words are runs of ASCII digits, ASCII letters (lower-cased) and characters
beyond ASCII.  An item's windows are its runs of ``window`` words (one shorter
window for a shorter item).  Windows and texts are sets of positioned
shingles of three words.  A window is contained only if all its shingles are,
so its *rarest* shingle over the corpus is a sufficient prefix: texts join on
that shingle alone, its place in the window gives the only possible start,
starts outside the text are dropped by length, and the words are compared.

Defined cases: null texts and items have no words; items without words are
never found; rows with equal ``doc_id`` share one result, repeated for each of
them; rows with null ``doc_id`` are returned unjudged (no hits).  Other columns
are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexis.llm.common import written

WINDOW = 10
SHINGLE = 3
BROADCAST_ROWS = 200_000
"""Benchmark shingles or windows (a few short words each) up to this number are broadcast; more are shuffled."""

BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _words(text: str) -> Column:
    """Words after lower-casing A-Z (``lower`` does just that on ASCII-only text, and faster)."""
    c = F.coalesce(F.col(text).cast("string"), F.lit(""))
    low = F.when(F.length(c) == F.octet_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))
    return F.filter(F.split(low, BETWEEN), lambda w: w != "")


def _triples(words: str) -> Column:
    """One struct of three words per place; missing words are empty strings."""
    w = F.col(words)
    return F.arrays_zip(w.alias("a"), F.slice(w, 2, F.greatest(F.size(w), F.lit(1))).alias("b"), F.slice(w, 3, F.greatest(F.size(w), F.lit(1))).alias("c"))


def windows(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """``item_id, words``: the distinct windows of every item."""
    items = benchmark.select(F.col(item_col).alias("item_id"), _words(text_col).alias("w")).filter(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - window + 1, F.lit(1)))
    return items.select("item_id", F.explode(starts).alias("at"), "w").select("item_id", F.slice("w", F.col("at"), window).alias("words")).distinct()


def _shingles(of: DataFrame, keep: list[str]) -> DataFrame:
    """Places and shingles of the window words (a window of under three words is one shingle)."""
    size = F.size("words")
    places = F.sequence(F.lit(0), F.greatest(size - SHINGLE, F.lit(0)))
    word = lambda i: F.coalesce(F.get("words", F.col("place") + i), F.lit(""))
    return of.select(*keep, "words", F.explode(places).alias("place")).select(*keep, "place", "words", word(0).alias("a"), word(1).alias("b"), word(2).alias("c"))


def _small(df: DataFrame) -> DataFrame:
    """Broadcast hint when the number of rows is within bounds."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def hits(docs: DataFrame, wins: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, place, a, b, c``: every place of a text that starts a shingle of the benchmark.

    Benchmark shingles shorter than three words (items of one or two words)
    are matched on their own length.
    """
    texts = docs.select(F.col(id_col).alias("doc_id"), _words(text_col).alias("w"))
    placed = texts.select("doc_id", F.posexplode_outer(_triples("w")).alias("place", "t")).select(
        "doc_id", "place", F.col("t.a").alias("a"), F.coalesce("t.b", F.lit("")).alias("b"), F.coalesce("t.c", F.lit("")).alias("c")).filter("a IS NOT NULL")
    wanted = _shingles(wins, []).select("a", "b", "c").distinct()
    lengths = {r["n"] for r in wanted.select(F.when(F.col("b") == "", 1).when(F.col("c") == "", 2).otherwise(3).alias("n")).distinct().collect()}
    found = None
    for n in sorted(lengths):
        blank = [F.lit("").alias(x) if i >= n else F.col(x) for i, x in enumerate("abc")]
        some = wanted.filter((F.col("a") != "") & (F.col("b") != "" if n > 1 else F.col("b") == "") & (F.col("c") != "" if n > 2 else F.col("c") == ""))
        part = placed.select("doc_id", "place", *blank).join(_small(some), ["a", "b", "c"], "left_semi")
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = placed.filter(F.lit(False))
    return found.select("doc_id", "place", "a", "b", "c")


def candidates(found: DataFrame, wins: DataFrame) -> DataFrame:
    """``doc_id, start, item_id, words``: windows whose rarest shingle lies at the right place of a text."""
    rarity = found.groupBy("a", "b", "c").agg(F.count("*").alias("n"))
    ranked = _shingles(wins, ["item_id"]).join(rarity, ["a", "b", "c"], "left").groupBy("item_id", "words").agg(
        F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "place", "a", "b", "c")).alias("p"))
    prefix = ranked.filter("p.n > 0").select("item_id", "words", F.col("p.place").alias("offset"), "p.a", "p.b", "p.c")
    return found.join(_small(prefix), ["a", "b", "c"]).select(
        "doc_id", (F.col("place") - F.col("offset")).alias("start"), "item_id", "words").filter("start >= 0")


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``doc_id, n_words, hit_spans, items`` for every row of ``docs``.

    ``hit_spans`` are the (start, length) word ranges of the occurring
    windows, ``items`` the sorted ids (as strings) of the items they belong to.
    """
    wins = written(windows(benchmark, item_col, item_text_col, window), "windows")
    found = written(hits(docs, wins, id_col, text_col), "hits")
    per_text = (candidates(found, wins).groupBy("doc_id", "start", "words").agg(F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("ids"))
                .groupBy("doc_id").agg(F.collect_list(F.struct("start", "words", "ids")).alias("maybe")))
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(per_text, "doc_id", "left")
    judged = texts.select("doc_id", _words("text").alias("w"), "maybe").select(
        "doc_id", F.size("w").cast("long").alias("n_words"),
        F.filter(F.coalesce("maybe", F.expr("array()").cast(per_text.schema["maybe"].dataType)),
                 lambda m: F.slice("w", m["start"] + 1, F.size(m["words"])) == m["words"]).alias("hit"))
    return judged.select("doc_id", "n_words",
                         F.array_sort(F.array_distinct(F.transform("hit", lambda m: F.struct(m["start"].alias("start"), F.size(m["words"]).alias("length"))))).alias("hit_spans"),
                         F.array_sort(F.array_distinct(F.flatten(F.transform("hit", lambda m: m["ids"])))).alias("items"))


def hit_words(spans: str = "hit_spans") -> Column:
    """Number of words covered by the spans (sorted by start)."""
    def add(state: Column, s: Column) -> Column:
        end = s["start"] + s["length"]
        fresh = F.greatest(end - F.greatest(s["start"], state["end"]), F.lit(0))
        return F.struct((state["n"] + fresh).alias("n"), F.greatest(state["end"], end).alias("end"))

    return F.aggregate(spans, F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")), add, lambda s: s["n"]).cast("long")
