"""Property test: the JVM tokenizer equals Python's ``re`` semantics on random text.

Python's ``re`` (Unicode ``\\w``) defines the expected tokens; the Spark
column expression must produce exactly the same lists.  The alphabet mixes
ASCII, Latin-1 letters, apostrophes, digits, superscripts, fractions,
combining marks, CJK and whitespace, plus runs of ``x`` to exercise the
redaction removal (which fuses neighbours).
"""

import re

from hypothesis import given, settings
from hypothesis import strategies as st

from lexis.functions.text import space_word_count, word_tokens

ALPHABET = list("abcxyzXAB019_' -.,;:\t\n") + ["x", "xx", "é", "ß", "Ж", "漢", "²", "½", "́", "’", "٣"]


def expected_tokens(text: str) -> list[str]:
    stripped = re.sub(r"(x{2,})", "", text)
    return [t for t in re.findall(r"['\w]+", stripped) if len(t) > 2]


texts = st.lists(st.sampled_from(ALPHABET), min_size=0, max_size=40).map("".join)


@settings(max_examples=5, deadline=None)
@given(st.lists(texts, min_size=200, max_size=200))
def test_tokenizer_matches_python_re(spark, batch):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(batch)], "i int, text string")
    rows = df.select("i", word_tokens("text").alias("tok"), space_word_count("text").alias("n")).collect()
    for r in rows:
        text = batch[r["i"]]
        assert list(r["tok"]) == expected_tokens(text), repr(text)
        assert r["n"] == len(text.split(" ")), repr(text)
