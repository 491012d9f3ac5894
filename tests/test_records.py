"""CSV records over split borders against one task that reads a file whole."""

import csv
import io
import random

import pytest

from nitrogrid.sources.manifest import read_manifest_texts, with_row_number
from nitrogrid.sources.records import read_split_texts, split_records


@pytest.fixture
def small_splits(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "97")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")


def made(rng, records, line="\n", last="x,`y"):
    out = io.StringIO()
    writer = csv.writer(out, lineterminator=line)
    writer.writerow(["id", "a b", last])
    rows = []
    for i in range(records):
        cell = lambda: "".join(rng.choice(["a", "é", '"', ",", "\n", "\n\n", " ", "word"]) for _ in range(rng.randint(0, 40)))
        rows.append([str(i), cell(), cell()])
        writer.writerow(rows[-1])
        if rng.random() < 0.1:
            out.write(line)  # a blank line is no record
    return out.getvalue(), rows


@pytest.mark.parametrize("line", ["\n", "\r\n"])
def test_records_over_split_borders(spark, small_splits, tmp_path, line):
    rng = random.Random(7)
    want = []
    for k in range(3):
        text, rows = made(rng, 60, line)
        (tmp_path / f"f{k}.csv").write_bytes(text.encode())
        want += [(n + 2, *(c or None for c in r)) for n, r in enumerate(rows)]
    got = read_split_texts(spark, str(tmp_path))
    assert got.columns == ["id", "a b", "x,`y", "row_number"]
    assert sorted(((r[3], *r[:3]) for r in got.collect()), key=repr) == sorted(want, key=repr)
    assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 3


def test_same_as_a_read_in_one_task(spark, small_splits, tmp_path):
    text, _ = made(random.Random(9), 80, last="x,y")
    (tmp_path / "f.csv").write_text(text, encoding="utf-8")
    mine = read_split_texts(spark, str(tmp_path))
    other = with_row_number(read_manifest_texts(spark, str(tmp_path)))
    assert sorted(map(tuple, mine.collect()), key=repr) == sorted(map(tuple, other.collect()), key=repr)


def test_odd_files(spark, small_splits, tmp_path):
    (tmp_path / "a.csv").write_text("")
    assert split_records(spark, str(tmp_path)).count() == 0 and read_split_texts(spark, str(tmp_path)).count() == 0
    (tmp_path / "b.csv").write_text("x,y\n")
    assert read_split_texts(spark, str(tmp_path)).collect() == []
    (tmp_path / "b.csv").write_text("\n\nx,y\n1\n2,3,4\n" + '"never closed\n' + "a,b\n" * 60)
    rows = sorted(map(tuple, read_split_texts(spark, str(tmp_path)).collect()), key=lambda r: r[2])
    assert rows[:2] == [("1", None, 2), ("2", "3", 3)] and len(rows) == 3
