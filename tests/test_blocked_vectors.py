"""Wide document vectors by blocks against plain means; id lists without a shuffle."""

import numpy as np

from lexis.operators import sequences as S
from lexis.operators import vectors as E


def test_blocks_equal_plain_means(spark):
    rng = np.random.default_rng(0)
    vec = {f"w{i}": rng.normal(size=90) for i in range(40)}
    docs = [(i, [f"w{j}" for j in rng.integers(0, 60, rng.integers(0, 50))]) for i in range(60)] + [(900, ["none"]), (901, None), (902, []), (None, ["w1", "w1"])]
    tokens = spark.createDataFrame(docs, "doc_id long, tokens array<string>")
    vectors = spark.createDataFrame([(w, v.tolist()) for w, v in vec.items()], "word string, vec array<double>")
    for block_words, share_rows in ((7, 100), (1000, 10 ** 6)):
        got = {r["doc_id"]: r for r in E.doc_vectors_blocked(tokens, vectors, block_words=block_words, share_rows=share_rows).collect()}
        assert len(got) == len(docs)
        for i, words in docs:
            known = [vec[w] for w in words or [] if w in vec]
            assert got[i]["n_known"] == len(known)
            assert (got[i]["vec"] is None) if not known else np.allclose(got[i]["vec"], np.mean(known, axis=0))
    assert E.doc_vectors_blocked(tokens.limit(0), vectors, 90).collect() == []
    none = E.doc_vectors_blocked(tokens, vectors.limit(0), 90, empty="zeros").collect()
    assert len(none) == len(docs) and all(r["vec"] == [0.0] * 90 for r in none)


def test_ids_in_one_map_stage(spark):
    vocab = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (9, "far")], "idx int, word string")
    docs = [(1, "x", ["a", "z", "b", None, "a"]), (2, "y", []), (3, "y", None), (4, None, ["z"]), (None, "x", ["c", "far"])]
    tokens = spark.createDataFrame(docs, "doc_id long, code string, tokens array<string>")
    out = S.token_ids(tokens, vocab, keep=["code"], max_words=9)
    assert sorted((tuple(r) for r in out.collect()), key=str) == sorted([(1, "x", [1, 2, 1]), (2, "y", []), (3, "y", []), (4, None, []), (None, "x", [3])], key=str)
    known = S.token_ids(tokens, vocab, offset=3, unknown_id=3, max_words=9)
    assert {r["doc_id"]: r["ids"] for r in known.collect()} == {1: [4, 3, 5, 4], 2: [], 3: [], 4: [3], None: [6, 3]}
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()


def test_gather_and_shares_are_bounded(spark, monkeypatch):
    """A step gathers the words of some documents up to a limit, whatever the number of documents."""
    assert list(E.product_steps(np.array([0, 9, 16, 60, 62, 70]), 16)) == [(0, 2), (2, 3), (3, 5)]
    assert list(E.product_steps(np.array([0]), 16)) == []
    monkeypatch.setattr(E, "GATHER_ROWS", 16)
    tokens = spark.createDataFrame([(i, [f"w{j}" for j in range(i % 25)]) for i in range(80)], "doc_id long, tokens array<string>")
    vectors = spark.createDataFrame([(f"w{j}", [float(j), 1.0]) for j in range(25)], "word string, vec array<double>")
    got = {r["doc_id"]: r for r in E.doc_vectors_blocked(tokens, vectors, share_docs=10).collect()}
    assert len(got) == 80
    for i in range(80):
        n = i % 25
        assert got[i]["n_known"] == n and (got[i]["vec"] == [(n - 1) / 2, 1.0] if n else got[i]["vec"] is None)


def test_one_sum_a_document_crosses(spark):
    """Neither partial sums nor a copy of all vectors for each share: a share's task sends whole sums, whatever the blocks."""
    tokens = spark.createDataFrame([(i, [f"w{j}" for j in range(i % 25)]) for i in range(80)], "doc_id long, tokens array<string>")
    vectors = spark.createDataFrame([(f"w{j}", [j / 3, 1.0]) for j in range(25)], "word string, vec array<float>")
    out = E.doc_vectors_blocked(tokens, vectors, share_docs=9, block_words=4)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "CoGroup" not in plan and "ObjectHashAggregate" not in plan
    for r in out.collect():
        n = r["doc_id"] % 25
        want = [float(np.arange(n).astype(np.float64).dot(np.ones(n)) / 3 / n), 1.0] if n else None
        assert r["n_known"] == n and (r["vec"] is None if want is None else np.allclose(r["vec"], want, rtol=1e-6))
