"""The content store and files read by ranges."""

import hashlib

from pyspark.sql import functions as F

from pagetrail.sources import contents, tables
from tests.test_operators import chained


def test_chained_hash_of_long_files(spark, tmp_path):
    made = {"a b": b"", "one": b"x", "exact": b"y" * 64, "long": bytes(range(256)) * 50 + b"end", "d/odd%20": b"z" * 65}
    (tmp_path / "d").mkdir()
    for name, data in made.items():
        (tmp_path / name).write_bytes(data)
    for chunk in (8, 64, 4 << 20):
        got = {r.path.split(f"{tmp_path}/")[1]: (r.length, r.chained) for r in contents.chained_files(spark, f"file://{tmp_path}", chunk=chunk).collect()}
        assert got == {name: (len(data), chained(data, chunk)) for name, data in made.items()}
    (tmp_path / "_hidden").mkdir()
    (tmp_path / "_hidden" / "x").write_bytes(b"x")
    read = tables.read_contents(spark, f"file://{tmp_path}").select("path", "length", "content", F.year("modificationTime").alias("y")).collect()
    assert {r.path.split(f"{tmp_path}/")[1]: bytes(r.content) for r in read} == made and all(r.y >= 2024 for r in read)
    assert sorted(r.path.split("/")[-1] for r in contents.list_files(spark, f"file://{tmp_path}", "o*").collect()) == ["odd%20", "one"]
    plan = contents.chained_files(spark, f"file://{tmp_path}", chunk=8)._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan.replace("file://", "")


def test_no_files(spark, tmp_path):
    assert contents.chained_files(spark, f"file://{tmp_path}").collect() == []


def test_contents_stay_in_the_task_that_reads_them(spark, tmp_path):
    data = [b"x", b"x", b"", None, bytes(range(256)), b"x" * 100_000]
    df = spark.createDataFrame([(k, None if c is None else bytearray(c)) for k, c in enumerate(data * 5)], "id long, content binary").repartition(6)
    root = f"file://{tmp_path}/store"
    put = contents.put_contents(df, root)
    want = {hashlib.sha256(c).hexdigest(): c for c in data if c is not None}
    assert {r.hash: r.size for r in put.collect()} == {h: len(c) for h, c in want.items()}
    files = sorted(p for p in (tmp_path / "store").rglob("*") if p.is_file() and p.suffix != ".crc")
    assert {p.name: p.read_bytes() for p in files} == want and len(files) == len(want)
    before = {p: p.stat().st_mtime_ns for p in files}
    assert put.count() == len(want) and {p: p.stat().st_mtime_ns for p in files} == before  # a retry writes nothing
    assert not list((tmp_path / "store").rglob(".*-*"))
    read = contents.put_contents(spark.createDataFrame(df.collect(), df.schema), f"{root}-2")
    plan = spark._jvm.PythonSQLUtils.explainString(read._jdf.queryExecution(), "formatted")
    moved = plan.split("Exchange\nInput")[1:]
    assert moved and all("content#" not in part.split("\n")[0] for part in moved)
    assert contents.put_contents(df.filter("false"), root).count() == 0
    assert df.select(F.count("content")).first()[0] == 25


def test_whole_files_are_listed_and_read_by_tasks(spark, tmp_path, monkeypatch):
    """No plan names the files, so the driver does not hold them; batches are bounded by bytes."""
    made = {f"{k % 7}/f{k}": bytes([k]) * (k * 997 % 5000) for k in range(60)}
    for name, data in made.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(data)
    monkeypatch.setattr(contents, "HELD", 2000, raising=False)
    monkeypatch.setattr(contents, "READ", 9000, raising=False)
    read = tables.read_contents(spark, f"file://{tmp_path}", "f*")
    assert {r.path.split(f"{tmp_path}/")[1]: bytes(r.content) for r in read.collect()} == made
    assert read.schema.simpleString() == "struct<path:string,modificationTime:timestamp,length:bigint,content:binary>"
    assert not any(f"{tmp_path}/" in f for f in read.inputFiles())
    assert tables.read_contents(spark, f"file://{tmp_path}", "none*").collect() == []
