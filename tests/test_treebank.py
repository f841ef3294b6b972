"""The contraction-aware tokenizer against Python's regular expressions and known cases."""

import random
import re

from pyspark.sql import functions as F

from lexis.functions.text import BLANKS, TREEBANK_RULES, treebank_tokens

KNOWN = {
    "I can't do that, won't I?": ["I", "ca", "n't", "do", "that", ",", "wo", "n't", "I", "?"],
    "It's John's; they'll say \"no\".": ["It", "'s", "John", "'s", ";", "they", "'ll", "say", "``", "no", "''", "."],
    "We cannot pay $3,000.50 (ever)...": ["We", "can", "not", "pay", "$", "3,000.50", "(", "ever", ")", "..."],
    "Mr. Smith arrived. He left.": ["Mr.", "Smith", "arrived.", "He", "left", "."],
    "'Tis gonna be -- fine": ["'T", "is", "gon", "na", "be", "--", "fine"],
    "": [], " \n\t": [],
}


def plain(text):
    out = f" {text} "
    for pattern, replacement in TREEBANK_RULES:
        parts = re.split(r"\$(\d)", replacement)
        build = lambda m, parts=parts: "".join(p if i % 2 == 0 else m.group(int(p)) for i, p in enumerate(parts))
        out = re.sub(pattern.replace(r"\z", r"\Z"), build, out)
    return [t for t in re.split(BLANKS, out) if t]


def test_known_and_random(spark):
    rnd = random.Random(3)
    bits = ["can", "n't", "N'T", "'s", "'", '"', "cannot", " ", " ", "gimme", "it", "'ll", "...", ".", ",", ":", "3", "(", "]", "--", "?", "é", "\n", "'Tis", "&", "more'n"]
    texts = list(KNOWN) + ["".join(rnd.choice(bits) for _ in range(rnd.randrange(20))) for _ in range(800)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(-1, None)], "i int, t string")
    got = {r["i"]: r["x"] for r in df.select("i", treebank_tokens(F.col("t")).alias("x")).collect()}
    assert got[-1] is None
    for i, t in enumerate(texts):
        assert got[i] == plain(t), t
    for i, t in enumerate(KNOWN):
        assert got[i] == KNOWN[t], t
