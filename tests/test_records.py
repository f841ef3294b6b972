"""Multi-line CSV read in byte ranges: equal to Python's reader, whatever the ranges."""

import csv
import random
import tempfile

import pytest

from lexis.sources.records import _lines, read_csv_table


def written_file(rows, seed, line_end="\n"):
    path = f"{tempfile.mkdtemp(prefix='lexis-records-', dir='/tmp')}/a.csv"
    with open(path, "w", encoding="utf8", newline="") as f:
        out = csv.writer(f, lineterminator=line_end, quoting=csv.QUOTE_ALL if seed % 2 else csv.QUOTE_MINIMAL)
        out.writerow(["product", "na\nme", "text"])
        out.writerows(rows)
    return path


def awkward_rows(seed, n):
    rnd = random.Random(seed)
    bits = ['"', '""', ",", "\n", "word", " ", "é😀", '"\n"', "\n\n", "x" * 40, ",\n", '",']
    cell = lambda: "p" + "".join(rnd.choice(bits) for _ in range(rnd.randrange(8))) + "s"
    return [(f"k{i}", cell(), cell()) for i in range(n)]


@pytest.mark.parametrize("seed, size, line_end", [(1, "64b", "\n"), (2, "64b", "\r\n"), (3, "1k", "\n"), (4, "1m", "\n")])
def test_ranges_do_not_matter(spark, seed, size, line_end):
    rows = awkward_rows(seed, 60) + [("long", '"' + "many lines\n" * 40 + ',"', "end")] + awkward_rows(seed + 50, 20)
    path = written_file(rows, seed, line_end)
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        table = read_csv_table(spark, path)
        assert table.columns == ["file", "product", "na\nme", "text"]
        assert sorted(tuple(r)[1:] for r in table.collect()) == sorted(rows)
        assert (_lines(spark, path).rdd.getNumPartitions() > 3) == (size != "1m")
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_several_files_blank_lines_and_short_rows(spark):
    folder = tempfile.mkdtemp(prefix="lexis-records-", dir="/tmp")
    for name, text in (("a.csv", 'x,y\n1,"a\n\nb"\n\n2\n'), ("b.csv", "x,y\n3,c\n"), ("c.csv", "x,y\n")):
        with open(f"{folder}/{name}", "w") as f:
            f.write(text)
    got = read_csv_table(spark, folder).collect()
    assert sorted(map(tuple, got), key=str) == [("a.csv", "1", "a\n\nb"), ("a.csv", "2", None), ("b.csv", "3", "c")]
