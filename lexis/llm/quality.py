"""Quality rules by distribution divergence, in DataFrame functions only.

A text is described by two histograms: character classes (lower-case, upper-
case, digits, sentence punctuation, symbols, white space, everything else) and
common words (a fixed list per language, plus "any other word").  References
are the histograms summed over all documents of a label.  A text is kept when
for at least one label both Jensen-Shannon distances (base 2, the square root
of the divergence) are within bounds; a text with fewer words than
``min_words`` is too short to be compared and fails.

Defined cases: null text has no words and is not kept; rows with null label
feed no reference but are scored; without any reference nothing is kept;
repeated rows are scored alike.  Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexis.llm.common import written

BLANK = r"[\x20\x09-\x0D]+"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
CLASS_BOUND = (0.16, 0.9)
WORD_BOUND = (0.17, 0.7)
"""A distance may reach base + slack / sqrt(words): short texts stray further from any reference."""
MAX_LABELS = 50
"""References are kept for this many labels, those with the most texts (first label on ties): they are planned as literals."""

# Frequent function words of four languages.
COMMON_WORDS = [
    "the", "of", "and", "to", "in", "a", "is", "that", "for", "it",
    "der", "die", "und", "das", "den", "von", "zu", "mit", "ist", "ein",
    "de", "la", "le", "les", "des", "et", "un", "une", "que", "est",
    "el", "en", "y", "los", "se", "las", "por", "con", "no", "su",
]

# Patterns of the counted character classes.
CHAR_CLASSES = {
    "upper": "[A-Z]",
    "digit": "[0-9]",
    "stop": "[.,;:!?'\"()-]",
    "symbol": "[#*$%&|<>]",
    "blank": "[\\x20\\x09-\\x0D]",
    "beyond": "[^\\x00-\\x7F]",
}




def _matching(column: str, pattern: str) -> Column:
    """Characters that match ``pattern`` (a one-character class)."""
    return F.length(column) - F.length(F.regexp_replace(column, pattern + "+", ""))


def _covered(places: Column, width: int) -> Column:
    """Size of the union of ``[p, p + width)`` over sorted distinct places."""
    steps = F.zip_with(places, F.slice(places, 2, F.size(places)), lambda a, b: F.least(F.lit(width), F.coalesce(b - a, F.lit(width))))
    return F.aggregate(steps, F.lit(0), lambda total, x: total + x)


def histograms(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang") -> DataFrame:
    """``doc_id, label``, the base counts and the two histograms of every text.

    Three-word windows are compared by 64-bit hash inside one text; they are
    sorted with their places, so equal ones are neighbours and the cost of a
    text is n log n.
    """
    rows = df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), F.col(label_col).alias("label"))
    # lower-case letters are most of a text: the other classes are counted in what is left of it
    rows = rows.select("doc_id", "label", F.length("text").cast("long").alias("n_chars"), F.regexp_replace("text", "[a-z]+", "").alias("rest"),
                       F.filter(F.split("text", BLANK), lambda w: w != "").alias("words"),
                       F.filter(F.split("text", "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]")).alias("lines"))
    word = lambda i: F.get("words", i)
    hashes = F.when(F.size("words") >= 3, F.transform(F.sequence(F.lit(0), F.size("words") - 3), lambda i: F.xxhash64(word(i), word(i + 1), word(i + 2))))
    rows = rows.select("*", F.size("words").cast("long").alias("n_words"), hashes.alias("hashes"),
                       F.filter(F.transform("words", F.lower), lambda w: w.isin(COMMON_WORDS)).alias("hits"),
                       *[_matching("rest", p).cast("long").alias(f"n_{name}") for name, p in CHAR_CLASSES.items()])
    # only a text with an equal pair of windows is sorted
    placed = F.when(F.size(F.array_distinct("hashes")) < F.size("hashes"), F.sort_array(F.transform("hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    rows = rows.select("*", placed.alias("sorted"))
    near = lambda x, j: (x["h"] == F.get("sorted", j - 1)["h"]) | (x["h"] == F.get("sorted", j + 1)["h"])
    twice = F.filter("sorted", lambda x, j: F.coalesce(near(x, j), F.when(j == 0, x["h"] == F.get("sorted", j + 1)["h"]), F.when(j > 0, x["h"] == F.get("sorted", j - 1)["h"]), F.lit(False)))
    rows = rows.select("*", F.array_sort(F.transform(twice, lambda x: x["i"])).alias("places"))
    named = [F.col(f"n_{name}") for name in CHAR_CLASSES]
    counts = [F.size("hits") - F.size(F.array_remove("hits", w)) for w in COMMON_WORDS]
    return rows.select(
        "doc_id", "label", "n_chars", "n_words", (F.col("n_chars") - F.col("n_blank")).alias("word_chars"), F.col("n_symbol").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.size("places") > 0, _covered(F.col("places"), 3)).otherwise(0).cast("long").alias("n_repeat_words"),
        F.array(F.col("n_chars") - sum(named[1:], named[0]), *named).cast("array<double>").alias("classes"),
        F.array(F.col("n_words") - F.size("hits"), *counts).cast("array<double>").alias("common"))


def references(hist: DataFrame, max_labels: int = MAX_LABELS) -> list[tuple[str, list[float], list[float]]]:
    """(label, class counts, common-word counts) summed over all texts of each of the ``max_labels`` most frequent labels."""
    sums = [F.sum(F.get(name, F.lit(i))).alias(f"{name}{i}") for name, n in (("classes", len(CHAR_CLASSES) + 1), ("common", len(COMMON_WORDS) + 1)) for i in range(n)]
    rows = hist.filter("label IS NOT NULL").groupBy("label").agg(F.count(F.lit(1)).alias("n_texts"), *sums).orderBy(F.desc("n_texts"), "label").limit(max_labels).collect()
    return [(r["label"], [r[f"classes{i}"] for i in range(len(CHAR_CLASSES) + 1)], [r[f"common{i}"] for i in range(len(COMMON_WORDS) + 1)])
            for r in sorted(rows, key=lambda r: r["label"])]


def js_distance(shares: Column, reference: list[float]) -> Column:
    """Jensen-Shannon distance of a column of shares to a count list (1 when either is empty)."""
    whole = sum(reference)
    if not whole:
        return F.lit(1.0)

    def part(p: Column, q: Column) -> Column:
        return F.when(p > 0, p * F.log2(2 * p / (p + q))).otherwise(0.0) + F.when(q > 0, q * F.log2(2 * q / (p + q))).otherwise(0.0)

    parts = F.zip_with(shares, F.array(*[F.lit(x / whole) for x in reference]), part)
    return F.coalesce(F.sqrt(F.greatest(F.aggregate(parts, F.lit(0.0), lambda a, x: a + x) / 2, F.lit(0.0))), F.lit(1.0))


def judge(hist: DataFrame, refs: list[tuple[str, list[float], list[float]]], min_words: int = MIN_WORDS,
          class_bound: tuple[float, float] = CLASS_BOUND, word_bound: tuple[float, float] = WORD_BOUND) -> DataFrame:
    """The histograms with ``base_failed``, the best label's distances and ``kept``.

    The best label is the one of smallest distance sum (first label on ties).
    """
    base_failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    # Totals are plain columns and each step is used as one, so no sum or
    # distance is worked out again inside a lambda or for a second use.
    share = lambda name, total: F.when(F.col(total) > 0, F.transform(name, lambda x: x / F.col(total)))
    rows = hist.select("*", base_failed.alias("base_failed"), share("classes", "n_chars").alias("p_class"), share("common", "n_words").alias("p_word"))
    pairs = [F.struct(js_distance(F.col("p_class"), c).alias("class_distance"), js_distance(F.col("p_word"), w).alias("word_distance")) for _, c, w in refs]
    kind = "array<struct<class_distance:double,word_distance:double>>"
    rows = rows.select("*", (F.array(*pairs) if pairs else F.array()).cast(kind).alias("distances"))
    ranked = F.transform("distances", lambda d, i: F.struct((d["class_distance"] + d["word_distance"]).alias("total"), i.alias("i"), d["class_distance"].alias("class_distance"), d["word_distance"].alias("word_distance")))
    rows = rows.select("*", F.array_min(ranked).alias("best"))
    bound = lambda b: F.lit(b[0]) + F.lit(b[1]) / F.sqrt("n_words")
    fits = (F.col("best.class_distance") <= bound(class_bound)) & (F.col("best.word_distance") <= bound(word_bound))
    return rows.select("*", F.col("best.class_distance"), F.col("best.word_distance"),
                       (~F.col("base_failed") & F.coalesce(fits, F.lit(False))).alias("kept"))


def quality(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang") -> DataFrame:
    """Histograms of all texts (computed and written once), references over all of them, verdicts."""
    hist = written(histograms(df, id_col, text_col, label_col), "quality")
    return judge(hist, references(hist)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "class_distance", "word_distance")
