"""Text column functions (tokenizer, word counts, id sequences).

All functions return JVM-side ``Column`` expressions, so they stay inside
whole-stage code generation; no Python runs per row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values that must equal the reference's behaviour.
# - redaction runs: two or more lowercase x, removed even inside words
# - word tokens: runs of Unicode letters, digits, underscore and apostrophe
# - tokens of length 2 or less are dropped
REDACTION_PATTERN = "x{2,}"
TOKEN_PATTERN = "['\\p{L}\\p{N}_]+"
MIN_TOKEN_LENGTH = 3
# word-or-punctuation tokenizer used for the exploratory vocabulary
# (whitespace spelled out so Java and RE2 agree: space, tab, LF, VT, FF, CR)
WORD_PUNCT_PATTERN = "[\\p{L}\\p{N}_]+|[^ \\t\\n\\x0B\\f\\r\\p{L}\\p{N}_]"

# The rules of the Penn Treebank's tokenizer script, in order, over a text padded with blanks
# ($n: group n, $0: the match).  Patterns are written so that Java, RE2 and Python read them alike.
TREEBANK_RULES = [
    (r'^ "', " `` "),
    (r'([ (\[{<])"', "$1 `` "),
    (r"\.\.\.", " ... "),
    (r"([:,])([^0-9])", " $1 $2"),
    (r"[;@#$%&]", " $0 "),
    (r"""([^.])(\.)([\])}>"']*)[ \t\n\r]*\z""", "$1 $2$3 "),
    (r"[?!]", " $0 "),
    (r"[\]\[(){}<>]", " $0 "),
    (r"--", " -- "),
    (r'"', " '' "),
    (r"([^'])' ", "$1 ' "),
    (r"'([sSmMdD]) ", " '$1 "),
    (r"'(ll|LL|re|RE|ve|VE) ", " '$1 "),
    (r"(n't|N'T) ", " $1 "),
    (r" ([Cc])annot ", " $1an not "),
    (r" ([Dd])'ye ", " $1' ye "),
    (r" ([Gg])imme ", " $1im me "),
    (r" ([Gg])onna ", " $1on na "),
    (r" ([Gg])otta ", " $1ot ta "),
    (r" ([Ll])emme ", " $1em me "),
    (r" ([Mm])ore'n ", " $1ore 'n "),
    (r" '([Tt])is ", " '$1 is "),
    (r" '([Tt])was ", " '$1 was "),
    (r" ([Ww])anna ", " $1an na "),
]
BLANKS = "[ \\t\\n\\x0B\\f\\r]+"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip_redactions(text) -> Column:
    """Remove runs of two or more lowercase ``x``; neighbours fuse."""
    return F.regexp_replace(_col(text), REDACTION_PATTERN, "")


def word_tokens(text, min_length: int = MIN_TOKEN_LENGTH) -> Column:
    """Redaction removal, regexp tokens, drop tokens shorter than ``min_length``."""
    toks = F.regexp_extract_all(strip_redactions(text), F.lit(TOKEN_PATTERN), 0)
    if min_length <= 1:
        return toks
    return F.filter(toks, lambda t: F.length(t) >= F.lit(min_length))


def join_tokens(tokens) -> Column:
    """T4: tokens joined by single spaces."""
    return F.array_join(_col(tokens), " ")


def space_word_count(text) -> Column:
    """T5: pieces after splitting on one space; empty pieces count."""
    return F.size(F.split(_col(text), " ", -1))


def word_punct_tokens(text) -> Column:
    """Word runs and single punctuation characters."""
    return F.regexp_extract_all(_col(text), F.lit(WORD_PUNCT_PATTERN), 0)


def treebank_tokens(text) -> Column:
    """Contraction-aware tokens: the Treebank rules as one cascade of replacements, then pieces between blanks.

    Contractions are cut (``do n't``, ``it 's``, ``can not``), double quotes
    become opening and closing ones, brackets and punctuation stand alone, and a
    period only at the end of the text.
    """
    out = F.concat(F.lit(" "), _col(text), F.lit(" "))
    for pattern, replacement in TREEBANK_RULES:
        out = F.regexp_replace(out, pattern, replacement)
    return F.filter(F.split(out, BLANKS), lambda t: t != "")


def pad_front(ids, maxlen: int, pad: int = 0) -> Column:
    """Keep the last ``maxlen`` ids and left-pad with ``pad`` to ``maxlen``."""
    ids = _col(ids)
    n = F.size(ids)
    kept = F.when(n > maxlen, F.slice(ids, n - F.lit(maxlen - 1), maxlen)).otherwise(ids)
    return F.concat(F.array_repeat(F.lit(pad), F.lit(maxlen) - F.size(kept)), kept)


def encode_fixed(ids, length: int, start_id: int, end_id: int, pad: int = 0) -> Column:
    """``[start] + ids[:length-2] + [end]`` padded at the end, plus an attention mask.

    Returns ``struct<ids: array<int>, mask: array<int>>``.
    """
    ids = _col(ids)
    body = F.slice(ids, 1, max(length - 2, 0))
    framed = F.concat(F.array(F.lit(start_id)), body, F.array(F.lit(end_id)))
    used = F.size(framed)
    padded = F.concat(framed, F.array_repeat(F.lit(pad), F.lit(length) - used))
    mask = F.transform(F.sequence(F.lit(1), F.lit(length)),
                       lambda i: F.when(i <= used, 1).otherwise(0))
    return F.struct(padded.alias("ids"), mask.alias("mask"))
