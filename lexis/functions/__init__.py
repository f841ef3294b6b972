from lexis.functions.arrays import argmax, hex_int, l2_normalize, one_hot, seeded_key, unit_interval
from lexis.functions.names import run_name, split_model_name
from lexis.functions.text import (
    MIN_TOKEN_LENGTH,
    REDACTION_PATTERN,
    TOKEN_PATTERN,
    WORD_PUNCT_PATTERN,
    encode_fixed,
    join_tokens,
    pad_front,
    space_word_count,
    strip_redactions,
    treebank_tokens,
    word_punct_tokens,
    word_tokens,
)

__all__ = [
    "argmax", "hex_int", "l2_normalize", "one_hot", "seeded_key", "unit_interval",
    "run_name", "split_model_name",
    "MIN_TOKEN_LENGTH", "REDACTION_PATTERN", "TOKEN_PATTERN", "WORD_PUNCT_PATTERN",
    "encode_fixed", "join_tokens", "pad_front", "space_word_count", "strip_redactions", "treebank_tokens",
    "word_punct_tokens", "word_tokens",
]
