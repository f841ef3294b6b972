"""The pair occurrence index against the public tokenizer library."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from lexis.llm import common, pair_index
from lexis.llm.queries import merge_file


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(merge_file())


@pytest.fixture(scope="module")
def coder():
    return pair_index.merges(merge_file())


def texts(seed, n, longest):
    rnd = random.Random(seed)
    signs = list("abcdest'''lrvem  \t\n\xa0　1234²½!?.,é日\U0001F600ᲉꟋ") + ["<|endoftext|>", "'s", "'ll", "'re", " the", "ing", "<|end", "oftext|>", "\r\n"]
    return ["".join(rnd.choice(signs) for _ in range(rnd.randrange(longest))) for _ in range(n)]


AWKWARD = ["", "<|endoftext|>", "<|endoftext|><|endoftext|>", "a <|endoftext|>  b", "a" * 5000, "ab" * 3000, " " * 500, "\n" * 33, "'" * 40, "it's 'tis we'll'd",
           "\x00\x01", "   x", "x   ", "\u0085x", "Ünï 12½"]


def encode(coder, rows):
    raw = np.frombuffer("".join(rows).encode(), np.uint8)
    ids, at = coder.encode(raw, np.r_[0, np.cumsum([len(t.encode()) for t in rows], dtype=np.int64)].astype(np.int64))
    return [ids[a:b].tolist() for a, b in zip(at, at[1:])]


def test_ids_equal_the_library(coder, library):
    rows = texts(1, 3000, 60) + AWKWARD
    assert encode(coder, rows) == [e.ids for e in library.encode_batch(rows, add_special_tokens=False)]
    halves = ["x<|endof", "text|>y"]  # a token split over two texts is none
    assert encode(coder, halves) == [e.ids for e in library.encode_batch(halves, add_special_tokens=False)]


def test_every_code_point(coder, library):
    points = [chr(p) for p in range(0x110000) if not 0xD800 <= p < 0xE000]
    for kind, beside in ((pair_index.LETTER, "a"), (pair_index.NUMBER, "1")):
        sample = points[::97] + points[:0x3000]
        joined = [len(library.pre_tokenizer.pre_tokenize_str(beside + c)) == 1 for c in sample]
        assert [coder.classes[ord(c)] == kind for c in sample] == joined


def test_merges_piece_by_piece(coder):
    """Each piece alone, its lowest pair first, gives the ids of the common index."""
    rnd = random.Random(9)
    pieces = ["".join(rnd.choice("aabnieth s") for _ in range(rnd.randrange(1, 40))).encode() for _ in range(400)]
    rank = {(int(k) >> 32, int(k) & 0xFFFFFFFF): (int(r), int(coder.made[r])) for k, r in zip(coder.pair_keys, coder.pair_ranks)}

    def plain(piece):
        ids = [int(coder.byte_ids[b]) for b in piece]
        while True:
            found = [(rank[p][0], i) for i, p in enumerate(zip(ids, ids[1:])) if p in rank]
            if not found:
                return ids
            _, i = min(found)
            ids[i:i + 2] = [rank[ids[i], ids[i + 1]][1]]

    ids, at = coder.merge(pieces)
    assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == [plain(p) for p in pieces]


def test_decode(coder, library):
    rnd = random.Random(4)
    for _ in range(300):
        ids = [rnd.randrange(50300) for _ in range(rnd.randrange(12))]
        assert coder.decode(np.array(ids, np.int64)).tobytes().decode("utf-8", "replace") == library.decode(ids, skip_special_tokens=False)


def test_long_texts_in_parts_and_cache(coder, monkeypatch):
    rows = [t * 9 for t in texts(5, 60, 80)] + AWKWARD + [None]
    batch = pa.RecordBatch.from_arrays([pa.array(rows)], names=["text"])

    def run():
        out = [[] for _ in rows]
        for row, ids, at in pair_index._encoded(batch, coder):
            for i in range(len(at) - 1):
                out[row + i] += ids[at[i]:at[i + 1]].tolist()
        return out

    whole = run()
    monkeypatch.setattr(common, "CHUNK_BYTES", 50)
    assert run() == whole
    monkeypatch.setattr(pair_index, "CACHE_BYTES", 10)
    assert run() == whole


def test_queries_over_a_table(spark, library):
    rows = [(i, t) for i, t in enumerate(texts(7, 200, 80) + AWKWARD)] + [(None, "no key"), (1, "clash"), (1, "clash"), (77, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("text", "'x' AS ids", "doc_id", "1 AS n_tokens")

    def digest(i, t):
        ids = library.encode(t or "", add_special_tokens=False).ids
        back = library.decode(ids, skip_special_tokens=False)
        return i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()

    got = pair_index.round_trip_digests(df, merge_file()).collect()
    assert sorted(map(tuple, got), key=str) == sorted((digest(*r) for r in rows), key=str)
    back = pair_index.decode(pair_index.encode(df, merge_file()), merge_file()).collect()
    assert sorted(map(tuple, back), key=str) == sorted(((i, t or "") for i, t in rows), key=str)
    assert pair_index.round_trip_digests(df.limit(0), merge_file()).collect() == []
