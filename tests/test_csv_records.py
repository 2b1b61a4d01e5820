"""CSV records over line ends, read in many splits, against Python's csv module."""

import csv
import io
import random

import pytest

from tabsmith.sources import csv_records as R
from tabsmith.sources.csv import read_csv, write_csv


@pytest.fixture()
def small_splits(spark):
    keys = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = [spark.conf.get(k) for k in keys]
    for k, v in zip(keys, ("150", "0")):
        spark.conf.set(k, v)
    yield
    for k, v in zip(keys, before):
        spark.conf.set(k, v)


def made(n, seed, end="\n"):
    rnd = random.Random(seed)
    parts = ["plain", "two\nlines", 'a "quoted" word', "x,y", "", "\n\n\n", "ü日", "long " * 60 + "\n" + "tail " * 40, '"', "\r\n", " spaced "]
    rows = [(k, rnd.choice(parts) + rnd.choice(parts), rnd.choice([1.5, 2.25, -3.0])) for k in range(n)]
    out = io.StringIO()
    writer = csv.writer(out, lineterminator=end)
    writer.writerow(["id", "text", "y"])
    writer.writerows(rows)
    return rows, out.getvalue()


@pytest.mark.parametrize("end", ["\n", "\r\n"])
@pytest.mark.parametrize("seed", range(2))
def test_records_equal_the_csv_module(spark, tmp_path, small_splits, seed, end):
    rows, text = made(60, seed, end)
    (tmp_path / "a.csv").write_bytes(text.encode())
    lines = R.physical_lines(spark, str(tmp_path))
    blocks = lines.select("block").distinct().count()
    assert blocks > 10  # one file, many splits
    assert R.has_open_lines(lines) and R.splits_inside_quotes(lines).count() > 3
    df = read_csv(spark, str(tmp_path / "a.csv"))
    assert dict(df.dtypes) == {"id": "int", "text": "string", "y": "double"}
    want = {k: (t if t else None, y) for k, t, y in rows}
    got = {r.id: (r.text, r.y) for r in df.collect()}
    assert got == want
    with_schema = read_csv(spark, str(tmp_path / "a.csv"), schema="id long, text string, y double", na_tokens=[])
    assert {r.id for r in with_schema.collect()} == set(want)


def test_several_files_and_a_record_over_many_splits(spark, tmp_path, small_splits):
    want = {}
    for f in range(3):
        rows = [(10 * f + k, "\n".join(str(x) for x in range(400)) if k == 1 else f"t{k}") for k in range(4)]
        want |= dict(rows)
        with open(tmp_path / f"{f}.csv", "w", newline="") as out:
            writer = csv.writer(out, lineterminator="\n")
            writer.writerows([("id", "text"), *rows])
    got = {r.id: r.text for r in read_csv(spark, str(tmp_path)).collect()}
    assert got == want


def test_open_quote_at_the_end_and_blank_lines(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,text\n\n1,"a\nb"\n\n2,"never closed\n3,x')
    got = {r.id: r.text for r in read_csv(spark, str(tmp_path / "a.csv")).collect()}
    assert got[1] == "a\nb" and set(got) == {1, 2}


def test_plain_files_keep_the_plain_reader(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,d,b,t\n1,2020-01-02,true,NA\n2,2020-01-03,false,x\n")
    df = read_csv(spark, str(tmp_path / "a.csv"))
    assert "MapInPandas" not in df._jdf.queryExecution().toString()
    quoted = tmp_path / "b.csv"
    quoted.write_text('id,d,b,t\n1,2020-01-02,true,NA\n2,2020-01-03,false,"x\ny"\n')
    both = read_csv(spark, str(quoted))
    assert dict(both.dtypes) == dict(df.dtypes)
    assert [tuple(r) for r in both.orderBy("id").collect()][0] == [tuple(r) for r in df.orderBy("id").collect()][0]


def test_the_sink_round_trips(spark, tmp_path):
    rows, _ = made(60, 9)
    df = spark.createDataFrame([(k, t or None, y) for k, t, y in rows], "id int, text string, y double")
    back = read_csv(spark, write_csv(df, str(tmp_path / "out")))
    assert {tuple(r) for r in back.collect()} == {tuple(r) for r in df.collect()}
