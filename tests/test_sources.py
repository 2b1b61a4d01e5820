"""CSV, bundle discovery, file catalog and archives."""

import base64
import io
import tarfile
import tempfile

import pytest
from pyspark.sql import functions as F

from tabsmith.sources import archives as ar
from tabsmith.sources import csv as cs
from tabsmith.sources import files as fl


def test_csv_na_tokens_and_roundtrip(spark):
    d = tempfile.mkdtemp(prefix="tabsmith-test-")
    with open(f"{d}/t.csv", "w") as fh:
        fh.write('id,x,s\n1,1.5,"a,b"\n2,NaN,NA\n3,,n/a\n')
    df = cs.read_csv(spark, f"{d}/t.csv")
    rows = {r["id"]: r for r in df.collect()}
    assert rows[1]["s"] == "a,b" and rows[2]["x"] is None and rows[2]["s"] is None and rows[3]["s"] is None
    cs.write_csv(df, f"{d}/out", single_file=True, order_by=["id"])
    back = cs.read_csv(spark, f"{d}/out")
    assert back.count() == 3


def test_csv_numbers_with_na_spellings_and_splits(spark):
    d = tempfile.mkdtemp(prefix="tabsmith-test-")
    with open(f"{d}/n.csv", "w") as fh:
        fh.write("id,x,y,z,w\n1,1.5,NA,NA,2024-01-01\n2,N/A,7,b,NA\n3,-2e3,n/a,1,2024-01-02\n")
    df = cs.read_csv(spark, f"{d}/n.csv")
    assert dict(df.dtypes)["x"] == dict(df.dtypes)["y"] == "double" and dict(df.dtypes)["z"] == "string" and dict(df.dtypes)["w"] != "double"
    assert [(r["x"], r["y"]) for r in df.orderBy("id").collect()] == [(1.5, None), (None, 7.0), (-2000.0, None)]
    with open(f"{d}/m.csv", "w") as fh:
        fh.write('id,s\n1,"a\nb"\n')
    assert cs.read_csv(spark, f"{d}/m.csv", multi_line=True).first()["s"] == "a\nb"
    with open(f"{d}/long.csv", "w") as fh:
        fh.write("id,s\n" + "".join(f"{i},{'x' * 50}\n" for i in range(20_000)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200000")
    try:
        assert cs.read_csv(spark, f"{d}/long.csv", schema="id long, s string").rdd.getNumPartitions() > 3
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_written_summary_reads_a_prefix(spark):
    d = tempfile.mkdtemp(prefix="tabsmith-test-")
    spark.range(5000).coalesce(1).write.mode("overwrite").option("header", True).csv(f"{d}/out")
    got = fl.written_summary(spark, f"{d}/out").first()
    text = "id\n" + "".join(f"{i}\n" for i in range(5000))
    assert got["exists"] and got["files"] == 1 and got["size_bytes"] == len(text) and got["preview"] == text[:400]


def test_bundle_discovery_and_catalog(spark):
    root = tempfile.mkdtemp(prefix="tabsmith-test-")
    df = spark.createDataFrame([(1, 0)], "id int, target int")
    for name in ("train.csv", "test.csv", "sample_submission.csv", "sample_submission_v2.csv"):
        cs.write_csv(df, f"{root}/home/data/{name}")
    cs.write_csv(df, f"{root}/Notes.csv")
    ddir = fl.data_dir(spark, root)
    assert ddir.endswith("home/data")
    assert fl.find_first(spark, ddir, "sample_submission*.csv").first()["name"] == "sample_submission.csv"
    cat = [r["entry"] for r in fl.file_catalog(spark, root).collect()]
    assert cat == ["home/", "Notes.csv/"]  # directories first, case-insensitive
    with pytest.raises(ValueError):
        fl.resolve_inside(root, "../etc/passwd")
    assert fl.resolve_inside(root, "home/./data").endswith("home/data")


def test_archive_skips_unsafe_members(spark):
    buf = io.BytesIO()
    with tarfile.open(fileobj=buf, mode="w:gz") as tar:
        for name, data in (("home/data/train.csv", b"a,b\n1,2\n"), ("/abs.txt", b"x"), ("../up.txt", b"y")):
            info = tarfile.TarInfo(name)
            info.size = len(data)
            tar.addfile(info, io.BytesIO(data))
        link = tarfile.TarInfo("ln")
        link.type = tarfile.SYMTYPE
        link.linkname = "/etc/passwd"
        tar.addfile(link)
    payload = base64.b64encode(buf.getvalue()).decode()
    df = spark.createDataFrame([(1, payload)], "aid long, b64 string")
    got = [(r["member"], r["size"]) for r in ar.archive_members(df, "aid", "b64").collect()]
    assert got == [("home/data/train.csv", 8)]


def test_damaged_archives_have_a_status_row(spark):
    def pack(*names):
        buf = io.BytesIO()
        with tarfile.open(fileobj=buf, mode="w:gz") as tar:
            for name in names:
                info = tarfile.TarInfo(name)
                info.size = 3
                tar.addfile(info, io.BytesIO(b"abc"))
        return base64.b64encode(buf.getvalue()).decode()

    whole = pack("a", "b")
    rows = [(1, whole), (2, None), (3, ""), (4, "%%%"), (5, whole[:40]), (6, base64.b64encode(b"no gzip").decode()), (None, whole), (1, whole)]
    got = ar.archive_report(spark.createDataFrame(rows, "id long, p string"), "id", "p").collect()
    by_id = {}
    for r in got:
        by_id.setdefault(r["archive_id"], []).append((r["member"], r["size"], r["status"]))
    both = [("a", 3, "ok"), ("b", 3, "ok")]
    assert sorted(by_id.pop(1)) == sorted(both * 2) and by_id.pop(None) == both
    assert by_id == {2: [(None, None, "empty")], **{i: [(None, None, "broken")] for i in (3, 4, 5, 6)}}
    assert ar.archive_members(spark.createDataFrame(rows, "id long, p string"), "id", "p").count() == 6


def test_members_leave_a_task_in_batches_of_bounded_size(spark):
    import pyarrow as pa

    rows = [(i, f"docs/{i}.txt", "x" * (i * 300)) for i in range(400)]
    packed = ar.pack_texts(spark.createDataFrame(rows, "id long, name string, text string").coalesce(1), "id", "name", "text").collect()
    payloads = pa.RecordBatch.from_arrays([pa.array([r[0] for r in packed]), pa.array([r[1] for r in packed])], ["archive_id", "payload_b64"])
    out = list(ar._members(iter([payloads])))
    assert [(m, n) for b in out for m, n in zip(b.column("member").to_pylist(), b.column("size").to_pylist())] == [(n, len(t)) for _, n, t in rows]
    assert all(sum(b.column("size").to_pylist()) < ar.OUT_BYTES + 400 * 300 for b in out)
    assert len(out) < 40  # one batch per member made the queries slow
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 1_000  # whole payloads in batches of 10,000 rows filled the workers
