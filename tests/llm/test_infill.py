"""Fill-in-the-middle against plain string slicing."""

import hashlib
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lexis.llm import infill, oracles
from tests.oracle import compare

FORMS = ("plain", "psm", "spm")


def plan(doc_id, text):
    """Form and cuts by the definition, on Python strings."""
    text = text or ""
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i:8 * i + 8], 16) for i in range(4)]
    n = len(text)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not n or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    pre, mid, suf = text[:a], text[a:b], text[b:]
    if h[3] % 100 < 20:
        return n, "spm", a, b - a, f"<S>{suf}<P>{pre}<M>{mid}"
    return n, "psm", a, b - a, f"<P>{pre}<S>{suf}<M>{mid}"


ROWS = [(None, "no key"), (1, None), (2, ""), (3, "a"), (4, "é́\U0001F600"), (5, "has <S> in it"), (6, "<P" * 40), (7, ">S<" * 50), (3, "a"), (3, "another text"),
        (2 ** 63 - 1, "edge"), (-5, "\x00\r\n\t"), (8, "long é\U0001F600 " * 60_000)]


@pytest.fixture(scope="module")
def docs(spark):
    rnd = random.Random(2)
    more = [(100 + i, "".join(rnd.choice("ab<PSM>é日\U0001F600 \n") for _ in range(rnd.randrange(50)))) for i in range(400)]
    rows = ROWS + more
    return rows, spark.createDataFrame(rows, "doc_id long, text string").selectExpr("'x' AS form", "text", "1 AS n", "'y' AS output", "doc_id", "3 AS h1", "'z' AS first")


def test_equals_slicing(docs):
    rows, df = docs
    got = infill.restored(infill.fill_in_middle(df)).collect()
    assert sorted((tuple(r)[:6] for r in got), key=str) == sorted(((i, *plan(i, t)) for i, t in rows), key=str)
    assert sorted(((r["doc_id"], r["restored"]) for r in got), key=str) == sorted(((i, t or "") for i, t in rows), key=str)
    assert {r["form"] for r in got} == set(FORMS)


def test_rates(docs):
    _, df = docs
    assert {r["form"] for r in infill.fill_in_middle(df, arranged_percent=0).select("form").distinct().collect()} == {"plain"}
    assert {r["form"] for r in infill.fill_in_middle(df, arranged_percent=100, spm_percent=100).filter("n > 0 AND NOT output LIKE '%<S>%<S>%'").select("form").distinct().collect()} <= {"spm", "plain"}


def test_long_texts_in_several_lists(monkeypatch):
    rnd = random.Random(1)
    texts = ["".join(rnd.choice("aé\U0001F600SP\n ") for _ in range(rnd.randrange(40))) for _ in range(200)]
    second = [rnd.randrange(len(t) + 1) for t in texts]
    first = [rnd.randrange(b + 1) for b in second]
    form = [rnd.choice(FORMS) if t else "plain" for t in texts]
    columns = [pa.array([None if f == "plain" else x for f, x in zip(form, xs)], pa.int64()) for xs in (first, [b - a for a, b in zip(first, second)])]
    whole = infill.arrange(pa.array(texts), pa.array(form), *columns)
    for size in (4, 7, 33):
        monkeypatch.setattr(infill, "SEGMENT_BYTES", size)
        assert infill.arrange(pa.array(texts), pa.array(form), *columns).equals(whole)
    assert infill.undo(whole, pa.array(form)).to_pylist() == texts


def test_empty_table(spark):
    none = infill.restored(infill.fill_in_middle(spark.createDataFrame([], "doc_id long, text string")))
    assert none.collect() == [] and none.columns[-1] == "restored"


def test_sql_on_awkward_rows(spark, docs, tmp_path):
    import duckdb

    rows, df = docs
    keep = [r for r in rows if "\x00" not in (r[1] or "") and r[0] != 2 ** 63 - 1]  # pandas holds null and long together as doubles
    con = duckdb.connect()
    con.register("documents", pa.table({"doc_id": [r[0] for r in keep], "text": [r[1] for r in keep]}))
    back = infill.restored(infill.fill_in_middle(df.filter(~F.coalesce(F.col("text"), F.lit("")).contains("\x00") & (F.coalesce("doc_id", F.lit(0)) < 2 ** 62))))
    digest = lambda c: F.sha2(F.col(c).cast("binary"), 256)
    got = back.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest("output").alias("output_sha256"), digest("restored").alias("restored_sha256"))
    ok, msg = compare(got, con, oracles.FILL_IN_MIDDLE)
    assert ok, msg
