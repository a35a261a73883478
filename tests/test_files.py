"""One file per key: round trips, repeats, failures, packing and pruning."""

import json
import os

import pytest
from pyspark.sql import functions as F

from tallyloom.sources import files

ODD = [("plain", "text\nmore"), ("a/b c%?é", "é中\0"), (None, "no key"), ("empty", ""), ("null", None), ("long", "x" * 300_000)]


def test_texts_come_back(spark, tmp_path):
    path = str(tmp_path / "out")
    df = spark.createDataFrame([*ODD, ("twice", "a"), ("twice", "b"), ("twice", "b")], "k string, t string").repartition(3)
    files.write_files(df, path, F.col("k"), F.col("t"), ".txt")
    got = {r.key: (r.text, r.bytes, r.problem) for r in files.read_files(spark, f"file:{path}", ".txt").collect()}
    want = {k: t or "" for k, t in [*ODD, ("twice", "b")]}
    assert got == {k: (t, len(t.encode()), None) for k, t in want.items()}
    state = json.loads((tmp_path / "out" / "_current").read_text())
    assert state["files"] == len(want) and state["bytes"] == sum(len(t.encode()) for t in want.values())
    assert not [n for _, _, names in os.walk(path) for n in names if n.startswith(".") and not n.endswith(".crc")]


def test_overwrite_append_and_empty(spark, tmp_path):
    path = str(tmp_path / "out")
    df = spark.createDataFrame([("a", "1"), ("b", "2")], "k string, t string")
    files.write_files(df, path, F.col("k"), F.col("t"))
    files.write_files(df.filter("k = 'a'"), path, F.lit("c"), F.col("t"), append=True)
    assert {r.key for r in files.read_files(spark, path).collect()} == {"a", "b", "c"}
    files.write_files(df.filter("k = 'b'"), path, F.col("k"), F.col("t"))
    assert {r.key for r in files.read_files(spark, path).collect()} == {"b"}
    assert len([x for x in os.listdir(path) if x.startswith("run-")]) == 1
    files.write_files(df.limit(0), path, F.col("k"), F.col("t"))
    assert files.read_files(spark, path).count() == 0


def test_a_failed_write_changes_nothing(spark, tmp_path):
    path = str(tmp_path / "out")
    df = spark.createDataFrame([(f"k{i}", "t") for i in range(40)], "k string, t string")
    files.write_files(df, path, F.col("k"), F.col("t"))
    for bad in ("", "k" * 500):
        with pytest.raises(Exception, match="no file name"):
            files.write_files(df.unionAll(spark.createDataFrame([(bad, "x")], df.schema)), path, F.col("k"), F.lit("new"))
    assert {r.text for r in files.read_files(spark, path).collect()} == {"t"}
    assert len([x for x in os.listdir(path) if x.startswith("run-")]) == 1


def test_a_repeated_task_writes_the_same_files(spark, tmp_path):
    writer = files.KeyedWriter({"path": str(tmp_path), "suffix": ".x"}, overwrite=True)
    batch = spark.createDataFrame(ODD, "key string, text string").toArrow().to_batches()
    first, second = writer.write(iter(batch)), writer.write(iter(batch))
    assert first == second and first.files == len(ODD)
    writer.commit([first, None])
    assert files.read_files(spark, str(tmp_path), ".x").count() == len(ODD)
    other = files.KeyedWriter({"path": str(tmp_path)}, overwrite=True)
    other.write(iter(batch))
    other.abort([None])
    assert not os.path.exists(tmp_path / other.run) and files.read_files(spark, str(tmp_path), ".x").count() == len(ODD)


def test_packing_and_pruning_of_a_plain_folder(spark, tmp_path):
    for i in range(50):
        (tmp_path / f"p{i:02}.py").write_text("x" * i)
    (tmp_path / "p01_test.py").write_text("skip")
    (tmp_path / ".hidden.py").write_text("skip")
    (tmp_path / "deep").mkdir()
    (tmp_path / "deep" / "q.py").write_bytes(b"\xff ok")
    rows = files.read_files(spark, str(tmp_path), ".py", "_test.py", partitionFiles=7)
    assert rows.rdd.getNumPartitions() == 8
    got = {r.key: r.text for r in rows.collect()}
    assert got == {f"p{i:02}": "x" * i for i in range(50)} | {"q": "� ok"}
    reader = files.KeyedReader({"path": str(tmp_path), "suffix": ".py", "prefix": "p1", "partitionBytes": "40"})
    names = [[os.path.basename(n) for n in p.names] for p in reader.partitions()]
    assert sorted(sum(names, [])) == sorted([f"p{i}.py" for i in range(10, 20)]) and all(len(n) <= 3 for n in names)


def test_records(spark, tmp_path):
    path = str(tmp_path / "out")
    df = spark.createDataFrame([(1, "a", None, 0.5), (2, 'q"\n', [1, 2], None)], "id int, s string, l array<int>, d double")
    files.write_records(df, path, F.col("id"))
    back = files.read_records(spark, path, df.schema)
    assert sorted(tuple(r.record) for r in back.collect()) == sorted(map(tuple, df.collect())) and not back.filter("bad").count()
    texts = spark.createDataFrame([("3", "{ not json"), ("4", "[1]"), ("5", ""), ("6", '{"id": 6}'), ("7", '{"id": "x"}'), ("8", "null")], "k string, t string")
    files.write_files(texts, path, F.col("k"), F.col("t"), ".json", append=True)
    back = {r.key: (r.bad, r.record) for r in files.read_records(spark, path, df.schema).collect()}
    assert len(back) == 8 and {k for k, (bad, _) in back.items() if bad} == {"3", "4", "5", "7", "8"}
    assert tuple(back["6"][1]) == (6, None, None, None) and back["3"][1] is None
    unreadable = files.KeyedReader({"path": path})
    (row,) = [b.to_pylist()[0] for b in unreadable.read(files.Files([f"{path}/gone.json"]))]
    assert row["problem"] == "FileNotFoundError" and row["text"] is None
