"""Every operator against brute force on small tables with the awkward cases in them."""

import base64
import random

import pytest
from pyspark.sql import functions as F

from lexis.llm import bpe, decontam, langid, licenses, lines, lm, ngram_join, pii, quality, suffix
from tests.llm import brute

SCHEMA = "doc_id long, text string"


def frame(spark, rows):
    """A documents table with a null, empty and blank texts, one long text and clashing extra columns."""
    return spark.createDataFrame(rows, SCHEMA).selectExpr("text", "doc_id", "'x' AS words", "1 AS place", "2 AS node", "'y' AS at", "'z' AS h")


AWKWARD = [(9000, None), (9001, ""), (9002, " \n\t\n"), (9003, "é"), (9004, "É"), (9005, "one two"), (9006, "One  TWO"),
           (9007, "a" * 3000), (9008, "ab " * 2500), (9009, "\U0001F600 ́x'll")]


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(5)
    words = [f"w{i}" for i in range(60)] + ["the", "of", "Ärger", "l'eau", "3.14"]
    base = [[rnd.choice(words) for _ in range(rnd.choice([3, 9, 10, 11, 14, 30, 60]))] for _ in range(25)]
    out = []
    for _ in range(130):
        text = []
        for _ in range(rnd.randrange(1, 5)):
            line = list(rnd.choice(base))
            for _ in range(rnd.choice([0, 0, 0, 1, 2])):
                i, kind = rnd.randrange(len(line)), rnd.randrange(3)
                if kind == 0:
                    line[i] = rnd.choice(words)
                elif kind == 1 and len(line) > 1:
                    del line[i]
                else:
                    line.insert(i, rnd.choice(words))
            text.append(rnd.choice([" ", " ", "  ", "\t"]).join(line))
        out.append((len(out) * 37 % 1009 - 100, "\n".join(text)))
    return out + AWKWARD


def test_line_dedup(spark, rows):
    got = {r[0]: tuple(r)[1:] for r in lines.deduplicated(frame(spark, rows)).collect()}
    assert got == brute.line_dedup(rows)


def test_line_dedup_long_text_with_many_repeats(spark):
    text = "\n".join(f"line number {i % 50} of a very long text" for i in range(3000))
    got = lines.deduplicated(frame(spark, [(1, text), (2, text)])).orderBy("doc_id").collect()
    assert [(r["n_judged"], r["n_exact"]) for r in got] == [(3000, 2950), (3000, 3000)]
    assert got[1]["only_copies"] and not got[0]["only_copies"]


def test_jaccard_join(spark, rows):
    want = brute.jaccard_groups(rows)
    got = {r[0]: tuple(r)[1:] for r in ngram_join.join_groups(frame(spark, rows)).collect()}
    assert got == want
    small = {r[0]: tuple(r)[1:] for r in ngram_join.join_groups(frame(spark, rows), block_rows=4).collect()}
    assert small == want
    other = {r[0]: tuple(r)[1:] for r in ngram_join.join_groups(frame(spark, rows), n=5, threshold=80).collect()}
    assert other == brute.jaccard_groups(rows, 5, 80)


def test_jaccard_chance_meetings_do_not_chain(spark, monkeypatch):
    """Windows over one long text meet from neighbour to neighbour but do not link: no large group is left to be cut into block pairs."""
    words = [f"t{i}" for i in range(900)]
    rows = [(i, " ".join(words[i * 5:i * 5 + 60])) for i in range(160)]
    rows += [(1000 + i, " ".join([*words[i * 5:i * 5 + 59], "changed"])) for i in range(0, 160, 9)]
    want = brute.jaccard_groups(rows)
    groups, real = [], ngram_join._block_keys
    monkeypatch.setattr(ngram_join, "_block_keys", lambda wanted, *a: groups.append(wanted) or real(wanted, *a))
    for paired, block in ((48, 1024), (2, 3)):
        monkeypatch.setattr(ngram_join, "PAIRED_ROWS", paired)
        monkeypatch.setattr(ngram_join, "PAIRED_BLOCK", block)
        got = {r[0]: tuple(r)[1:] for r in ngram_join.join_groups(frame(spark, rows), block_rows=40).collect()}
        assert got == want and len({c for _, c in got.values()}) == 160
        assert groups[-1].groupBy("component").count().agg(F.max("count")).first()[0] <= 40


def test_jaccard_sketches_of_linked_pairs_agree():
    import numpy as np
    rnd = np.random.default_rng(4)
    for threshold in (80, 90):
        blocks = ngram_join.Blocks(threshold)
        for size in (9, 19, 40, 150, 600):
            grams = rnd.integers(0, 2**64 - 1, size + size // 2, dtype=np.uint64)
            room = int(size * (100 - threshold) / threshold)
            sets = [np.sort(grams[:size]), np.sort(np.r_[grams[:size], grams[size:size + room]]), np.sort(grams[room:size]), np.sort(grams[size // 2:])]
            begin = np.cumsum([0, *map(len, sets)])
            sketch = blocks.sketches(np.concatenate(sets), begin)
            side = lambda k: (np.array([len(sets[k])]), np.frombuffer(sketch[k], np.uint8), np.zeros(1, np.int64))
            for k in (1, 2, 3):
                both = len(np.intersect1d(sets[0], sets[k]))
                linked = 100 * both >= threshold * (size + len(sets[k]) - both)
                assert blocks.agreeing(side(0), side(k))[0] or not linked or len(sets[k]) == size
            assert size < 100 or not blocks.agreeing(side(0), side(3))[0]


def test_jaccard_signatures_meet_for_every_linked_pair():
    import numpy as np
    rnd = np.random.default_rng(3)
    for threshold in (80, 90):
        blocks = ngram_join.Blocks(threshold)
        for size in (5, 9, 10, 19, 20, 37, 100, 400):
            for _ in range(30):
                both = rnd.integers(0, 2**63, size, dtype=np.uint64)
                extra = rnd.integers(0, 2**63, size, dtype=np.uint64)
                room = int(size * (100 - threshold) / threshold)
                split = rnd.integers(0, room + 1)
                a = np.sort(np.r_[both, extra[:split]])
                b = np.sort(np.r_[both, extra[split:room]])
                if len(a) == len(b) == size:
                    continue  # equal sets share a row of the matrix
                sigs, row = blocks.signatures(np.r_[a, b], np.array([0, len(a), len(a) + len(b)]))
                assert set(sigs[row == 0].tolist()) & set(sigs[row == 1].tolist())


def test_suffix_dedup(spark, rows):
    for options in ({}, {"hot": 2}, {"length": 40, "gram": 8}):
        got = {r[0]: tuple(r)[1:] for r in suffix.digests(frame(spark, rows), **options).collect()}
        assert got == brute.repeated_bytes(rows, options.get("length", 100))


def test_suffix_order_and_collision_fallback(monkeypatch):
    import numpy as np
    rnd = random.Random(2)
    raw = np.frombuffer("".join(rnd.choice("ab") for _ in range(600)).encode(), np.uint8)
    at = np.arange(0, 500)
    order = suffix.suffix_order(suffix.prefix_hash(raw), raw, at, np.zeros(500, np.int64), 60)
    assert order.tolist() == sorted(range(500), key=lambda i: (raw[i:i + 60].tobytes(), i))
    want = suffix.repeated_windows(raw, at, np.zeros(500, np.uint64), at, 12)
    # a hash that tells nothing apart: the byte check must still give the same windows
    monkeypatch.setattr(suffix, "range_hash", lambda prefix, a, b: np.zeros(len(a), np.uint64))
    assert (suffix.repeated_windows(raw, at, np.zeros(500, np.uint64), at, 12) == want).all()


def test_decontamination(spark, rows):
    items = [(1, rows[0][1]), (2, "one two"), (3, "É"), (4, None), (5, ""), (6, rows[3][1].upper()), (7, rows[0][1]), (10, "one")]
    found = decontam.contamination(frame(spark, rows), spark.createDataFrame(items, "item_id long, text string").withColumn("words", F.lit(1)))
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], len(r["items"]), brute.sha(",".join(r["items"])), bool(r["hit_spans"]))
           for r in found.withColumn("n_hit", decontam.hit_words()).collect()}
    assert got == brute.contamination(rows, items)


def test_decontamination_stays_in_dataframe_functions(spark, rows):
    found = decontam.contamination(frame(spark, rows[:20]), spark.createDataFrame([(1, rows[0][1])], "item_id long, text string"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow", "Cartesian", "NestedLoop"))


def test_quality_base_counts_and_plan(spark, rows):
    df = frame(spark, rows).withColumn("lang", F.when(F.col("doc_id") % 3 == 0, "a").when(F.col("doc_id") % 3 == 1, "b"))
    got = quality.quality(df)
    assert "Python" not in got._jdf.queryExecution().executedPlan().toString()
    for r in got.collect():
        want = brute.base_counts(dict(rows)[r["doc_id"]])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r["base_failed"] and r["kept"])


def test_quality_tells_junk_from_prose(spark):
    rnd = random.Random(4)
    common = quality.COMMON_WORDS[:10]
    prose = [" ".join(rnd.choice(common) if rnd.random() < 0.4 else f"word{chr(97 + rnd.randrange(26))}" for _ in range(200)) for _ in range(40)]
    junk = " ".join(f"x{i}###" for i in range(200))
    df = spark.createDataFrame([(i, t, "en") for i, t in enumerate([*prose, junk])], "doc_id long, text string, lang string")
    kept = {r["doc_id"]: r["kept"] for r in quality.quality(df).collect()}
    assert all(kept[i] for i in range(40)) and not kept[40]
    distance = spark.range(1).select(quality.js_distance(F.array(F.lit(0.5), F.lit(0.5)), [1.0, 1.0]).alias("a"),
                                     quality.js_distance(F.array(F.lit(1.0), F.lit(0.0)), [0.0, 3.0]).alias("b")).first()
    assert distance["a"] == 0 and distance["b"] == pytest.approx(1.0)


def test_quality_with_more_labels_than_references(spark):
    """The most frequent labels serve as references (first label on ties); texts of the others are judged all the same."""
    rows = [(i, f"the words of text {i} are of a kind and it is so", f"l{i % 60:02d}") for i in range(63)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    refs = quality.references(quality.histograms(df))
    assert [label for label, _, _ in refs] == [f"l{i:02d}" for i in range(quality.MAX_LABELS)]
    assert [label for label, _, _ in quality.references(quality.histograms(df), 2)] == ["l00", "l01"]
    assert [r["class_distance"] is None for r in quality.quality(df).collect()] == [False] * 63


def test_bpe_equals_the_public_library(spark, rows):
    tiktoken = pytest.importorskip("tiktoken")
    tokenizers = pytest.importorskip("public_tokenizers")
    path = tokenizers.path("byte_bpe_50k.tiktoken")
    with open(path, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    library = tiktoken.Encoding("own", pat_str=tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rnd = random.Random(1)
    signs = [*"astdmrevl' ' \n\t12.!éÉ中́²", " ", "　", "\U0001F600", "'ll", "'re", "  "]
    rows = rows + [(10_000 + i, "".join(rnd.choice(signs) for _ in range(rnd.randrange(40)))) for i in range(3000)]
    rows += [(20_000, "x" * 20_000), (20_001, "".join(rnd.choice("abcdefgh") for _ in range(5000)))]
    encoded = bpe.encode(frame(spark, rows), path)
    texts = dict(rows)
    for r in encoded.collect():
        text = texts[r["doc_id"]] or ""
        assert r["ids"] == library.encode_ordinary(text)
        assert sum(r["piece_tokens"]) == r["n_tokens"]
        assert r["piece_start"] == sorted(set(r["piece_start"])) and (not text or r["piece_start"][0] == 0)
    decoded = {r["doc_id"]: bytes(r["bytes"]) for r in bpe.decode(encoded, path).collect()}
    assert decoded == {doc: (text or "").encode() for doc, text in rows}
    import struct
    for r in bpe.round_trip_digests(frame(spark, rows[:40] + AWKWARD), path).collect():
        ids = library.encode_ordinary(texts[r["doc_id"]] or "")
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == brute.sha(struct.pack(f"<{len(ids)}I", *ids))
        assert r["decoded_sha256"] == brute.sha(texts[r["doc_id"]] or "")


def test_language_id(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    learned = langid.learn(docs.filter(~langid.held_out()))
    assert set(learned.labels) == {r["lang"] for r in docs.select("lang").distinct().collect()}
    judged = langid.identify(docs, learned).join(docs.select("doc_id", "lang"), "doc_id").filter(langid.held_out())
    right, n, rejected = judged.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*"), F.sum(F.col("rejected").cast("int"))).first()
    assert right > 0.95 and rejected < 0.03 * n
    odd = langid.identify(frame(spark, AWKWARD + [(1, "123 456 !!")]), learned).collect()
    assert {r["doc_id"] for r in odd if r["lang_pred"] == "und"} == {9000, 9001, 9002, 1}
    assert all(0 <= r["score"] <= 1 and (r["lang_pred"] != "und" or r["rejected"] and r["score"] == 0) for r in odd)
    nothing = langid.learn(spark.createDataFrame([(1, "text", None)], "doc_id long, text string, lang string"))
    assert [r["lang_pred"] for r in langid.identify(frame(spark, [(1, "text")]), nothing).collect()] == ["und"]


def test_language_id_margin_does_not_shrink_with_the_length(spark):
    rnd = random.Random(3)
    vocabularies = [["".join(rnd.choices(letters, k=rnd.randrange(3, 9))) for _ in range(2000)] for letters in ("abcdefghij", "fghijklmno")]
    contents = [" ".join(rnd.choices(words, k=40_000)).encode()[:200_000] for words in vocabularies]
    learned = langid.Dictionaries(("a", "b"), tuple(contents))
    long = " ".join(rnd.choices(vocabularies[0], k=2_000_000))[:12_000_000]
    got = {r["doc_id"]: r for r in langid.identify(frame(spark, [(1, long[:4096]), (2, long[:100_000]), (3, long)]), learned).collect()}
    assert all(r["lang_pred"] == "a" and not r["rejected"] for r in got.values())
    assert got[3]["score"] > 0.5 * got[1]["score"] and got[2]["score"] > 0.5 * got[1]["score"]


def test_language_id_blocks_cover_the_text():
    for size in (0, 1, langid.BLOCK_BYTES, langid.BLOCK_BYTES + 1, 100_001):
        raw = bytes(i % 251 for i in range(size))
        assert b"".join(langid.blocks(raw)) == raw and all(len(x) <= langid.BLOCK_BYTES for x in langid.blocks(raw))


def test_language_id_learns_past_a_common_banner(spark):
    rnd = random.Random(6)
    vocabularies = {name: ["".join(rnd.choices(letters, k=rnd.randrange(3, 9))) for _ in range(300)] for name, letters in (("a", "abcdefghij"), ("b", "fghijklmno"))}
    banner = "the same banner opens every text of this source " * 7
    docs = [(i, banner + " ".join(rnd.choices(vocabularies["ab"[i % 2]], k=300)), "ab"[i % 2]) for i in range(120)]
    copies = [(1000 + i, "one short text that is given again and again", "a") for i in range(50)]
    learned = langid.learn(spark.createDataFrame(docs + copies, "doc_id long, text string, lang string"))
    for label, content in zip(learned.labels, learned.contents):
        assert sum(w in content.decode().split() for w in vocabularies[label]) > 200
    assert dict(zip(learned.labels, learned.contents))["a"].count(b"one short text") == 1


def test_cross_entropy_difference(spark, rows):
    target = {doc for doc, _ in rows if doc % 2}
    table = spark.createDataFrame([(doc,) for doc in [*target, *target, 77777]], "doc_id long")
    want = brute.cross_entropy(rows, target)
    for r in lm.cross_entropy_difference(frame(spark, rows), table).collect():
        n, own, general = want[r["doc_id"]]
        assert r["n_tokens"] == n
        assert (r["loss_target"], r["loss_background"]) == (pytest.approx(own), pytest.approx(general))
        assert r["score"] == (None if own is None else pytest.approx(own - general))


def test_cross_entropy_difference_in_many_blocks_and_buckets(spark, rows, monkeypatch):
    """Blocks of a few texts and buckets of a few words, with null and repeated keys, give the same losses."""
    monkeypatch.setattr(lm, "BLOCK_BYTES", 600)
    monkeypatch.setattr(lm, "BUCKET_ENTRIES", 300)
    target = {doc for doc, _ in rows if doc % 2}
    extra = [(None, "w1 w2 w3 never"), (rows[0][0], rows[0][1]), (rows[0][0], None)]
    keyed = [(("n", i), text) for i, (_, text) in enumerate(rows + extra)]
    ids = [doc for doc, _ in rows + extra]
    want = brute.cross_entropy(keyed, {k for k, doc in zip((k for k, _ in keyed), ids) if doc in target})
    got = lm.cross_entropy_difference(frame(spark, rows + extra), spark.createDataFrame([(doc,) for doc in target], "doc_id long")).collect()

    def order(items):
        return sorted(((-10**9 if d is None else d), n, -1 if a is None else round(a, 6), -1 if b is None else round(b, 6)) for d, n, a, b in items)

    assert order((r["doc_id"], r["n_tokens"], r["loss_target"], r["loss_background"]) for r in got) == order((d, *want[k]) for d, (k, _) in zip(ids, keyed))


def test_cross_entropy_difference_knows_rare_words(spark):
    """Words of two texts only are in the models: those texts stand apart, however large the rest."""
    rnd = random.Random(9)
    plain = [(i, " ".join(rnd.choice(["alpha", "beta", "gamma", "delta", "eps"]) for _ in range(60))) for i in range(400)]
    rare = [(1000 + i, " ".join(f"rare{j}" for j in range(20))) for i in range(2)]
    target = spark.createDataFrame([(i,) for i in range(0, 400, 2)], "doc_id long")
    score = {r["doc_id"]: r["score"] for r in lm.cross_entropy_difference(frame(spark, plain + rare), target).collect()}
    assert min(score[1000], score[1001]) > 1 + max(score[i] for i, _ in plain)


def test_personal_data(spark):
    texts = ["mail é a.b+c@mail1.example.com, ring +1 (632) 555-4827.", "ip 10.1.2.3 and 999.1.1.1 and 1.2.3.4.5", "card 4111 1111 1111 1111 not 4111111111111112",
             "call 555-867-5309 or (212) 555-0199, room 101", "version 2.0 of 2021-03-14, 300 people", None, "", "plain words only\nand more of them " * 500]
    got = {r["doc_id"]: r for r in pii.personal_data(frame(spark, list(enumerate(texts)))).collect()}
    counts = {i: tuple(r[f"n_{k}"] for k in pii.KINDS) for i, r in got.items()}
    assert counts == {0: (1, 0, 0, 1), 1: (0, 2, 0, 0), 2: (0, 0, 1, 0), 3: (0,) * 4, 4: (0,) * 4, 5: (0,) * 4, 6: (0,) * 4, 7: (0,) * 4}
    assert got[0]["spans"] == "email:7:30,phone:37:54" and got[0]["base_sha256"] == brute.sha(got[0]["spans"])
    added = [x.split(":") for x in got[3]["spans"].split(",")]
    assert [(k, texts[3][int(a):int(b)]) for k, a, b in added] == [("phone", "555-867-5309"), ("phone", "(212) 555-0199")]
    assert all(got[i]["spans"] == "" for i in (4, 5, 6, 7))


def test_random_field_learns_its_table_and_viterbi_is_exact():
    import itertools

    import numpy as np
    weights, moves = pii.trained()
    assert pii.plain_is_outside(weights, moves)
    for features, labels in pii._examples():
        assert (pii.viterbi(features @ weights, np.array([0]), np.array([len(labels)]), moves) == labels).all()
    rnd = np.random.default_rng(1)
    score, step = rnd.normal(size=(9, 3)), rnd.normal(size=(3, 3))
    begin, end = np.array([0, 4, 4, 8]), np.array([4, 4, 8, 9])
    got = pii.viterbi(score, begin, end, step)
    for a, b in zip(begin, end):
        paths = itertools.product(range(3), repeat=int(b - a))
        best = max(paths, key=lambda p: sum(score[a + i, x] for i, x in enumerate(p)) + sum(step[x, y] for x, y in zip(p, p[1:])), default=())
        assert tuple(got[a:b]) == best


def test_license_scan(spark):
    notice = "Licensed under the Apache License, Version 2.0."
    texts = [f"some words here\n{notice}\nmore", "Released under the MIT License.", "Licensed under the Frobnicate Public License, version 9.",
             "the weather was fine and nobody took a license plate", None, "", "word " * 5000]
    corpus = ["the weather was fine today and we went out", "a map of the town and the river"] * 200
    model = licenses.train(corpus)
    got = {r["doc_id"]: [(p["line"], p["family"]) for p in r["paragraphs"]] for r in licenses.scan(frame(spark, list(enumerate(texts))), model).collect()}
    assert got == {0: [(1, "apache-2.0")], 1: [(0, "mit")], 2: [(0, "unknown")], 3: [], 4: [], 5: [], 6: []}
    for family, notices in licenses.TEMPLATES.items():
        assert {p["family"] for r in licenses.scan(frame(spark, list(enumerate(notices))), model).collect() for p in r["paragraphs"]} == {family}
    assert licenses.license_scan(frame(spark, [])).count() == 0


def test_empty_tables(spark):
    none = frame(spark, [])
    bench = spark.createDataFrame([], "item_id long, text string")
    assert lines.deduplicated(none).count() == 0
    assert ngram_join.join_groups(none).count() == 0
    assert suffix.digests(none).count() == 0
    assert decontam.contamination(none, bench).count() == 0
    assert decontam.contamination(frame(spark, [(1, "some words")]), bench).first()["items"] == []
    assert quality.quality(none.withColumn("lang", F.lit("en"))).count() == 0
    assert lm.cross_entropy_difference(none, bench.select("item_id")).count() == 0
    assert pii.personal_data(none).count() == 0
    assert langid.identify(none, langid.learn(none.withColumn("lang", F.lit("en")))).count() == 0


def test_repeated_rows_and_null_keys(spark):
    text = "this very line of words is given more than once to see what happens when rows repeat in the table"
    rows = [(1, text), (1, text), (2, text + " now"), (None, text)]
    assert sorted(r["n_exact"] + r["n_near"] for r in lines.deduplicated(frame(spark, rows)).collect()) == [0, 0, 1]
    assert sorted(r["component_id"] for r in ngram_join.join_groups(frame(spark, rows), threshold=80).collect()) == [1, 1, 1]
    got = sorted((r["doc_id"], r["n_removed"]) for r in suffix.digests(frame(spark, rows), length=40, gram=8).collect())
    assert got == [(1, 0), (1, 0), (2, len(text))]
    bench = spark.createDataFrame([(1, text)], "item_id long, text string")
    found = decontam.contamination(frame(spark, rows), bench).collect()
    assert len(found) == 4 and sorted(len(r["items"]) for r in found) == [0, 1, 1, 1]


def test_suffix_dedup_in_buckets(spark, rows, monkeypatch):
    """An anchor group of more windows than a step, dealt over buckets: the same ranges as one sort."""
    import numpy as np
    import pyarrow as pa

    rnd = random.Random(8)
    passage = "".join(rnd.choice("abcdefgh ") for _ in range(300))
    texts = [passage[rnd.randrange(60):] + "".join(rnd.choice("xyz ") for _ in range(rnd.randrange(90))) for _ in range(60)]
    want = None
    for step in (10 ** 9, 500, 40):
        monkeypatch.setattr(suffix, "SORT_WINDOWS", step)
        raw = np.frombuffer("".join(texts).encode(), np.uint8)
        offsets = np.r_[0, np.cumsum([len(t) for t in texts])]
        at = np.concatenate([np.arange(a, b - 99) for a, b in zip(offsets, offsets[1:])])
        hit = np.zeros(len(at), bool)
        buckets = list(suffix._buckets(len(at), raw, 100, lambda i: (at[i], np.zeros(len(i), np.uint64))))
        for index in buckets:
            hit[index] = suffix.repeated_windows(raw, at[index], np.zeros(len(index), np.uint64), index, 100)
        assert np.array_equal(np.sort(np.concatenate(buckets)), np.arange(len(at)))
        want = hit if want is None else want
        assert np.array_equal(hit, want) and hit.any()


def plain_pattern_spans(text):
    """The four patterns by the definition: leftmost matches of each kind, failing ones dropped."""
    import re

    out = []
    for index, kind in enumerate(pii.KINDS):
        for m in re.finditer(pii.PATTERNS[kind], text):
            digits = [int(c) for c in m.group() if c.isdigit()]
            luhn = sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(reversed(digits)))
            if {"email": True, "ip": all(int(x) <= 255 for x in m.group().split(".")) if kind == "ip" else True,
                    "card": 14 <= len(digits) <= 19 and luhn % 10 == 0, "phone": 10 <= len(digits) <= 15}[kind]:
                out.append((m.start(), index, m.end()))
    return out


def test_personal_data_patterns_equal_the_definition():
    rnd = random.Random(6)
    bits = ["a", "b.c", "@", "x@y.z", "_", ".", "..", "1", "12", "255", "256", "007", "0000", "4111 1111 1111 1111", "-", " ", "+", "+49 ", "(0)", "é", "\n", "%", "30.4", "@@", ".com"]
    for _ in range(4000):
        text = "".join(rnd.choice(bits) for _ in range(rnd.randrange(14)))
        assert pii.pattern_spans(text) == plain_pattern_spans(text)


def test_personal_data_long_runs():
    import time

    before = time.time()
    assert pii.pattern_spans("1.2.3." + "0" * 5000 + "7") == [(0, 1, 5007)]
    assert pii.pattern_spans("9" * 200_000) == [] and pii.pattern_spans("a" * 200_000 + " x@y") == []
    assert pii.pattern_spans("0" * 100_000 + ".1.1.1 " + "@" * 100_000) == [(0, 1, 100_006)]
    assert time.time() - before < 20
