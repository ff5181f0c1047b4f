"""A folder of text files: a file per text, the rows that Spark's writer gives."""

import os

from pyspark.sql import functions as F

from sievetext.sources import files
from sievetext.sources.files import read_text_folder, write_text_folder

DATA = [(1, "a"), (2, "two\nlines\n"), (3, ""), (-4, "minus"), (5, None), (None, "no id"), (7, "\u00fc \U0001f600"),
        (8, "x" * 100_000), (9, "once"), (9, "again"), (9, "third")] + [(i, f"text {i}") for i in range(100, 200)]


def _rows(spark, path):
    return sorted(((r.id, r.text) for r in read_text_folder(spark, path).collect()), key=str)


def _files(path):
    return [os.path.join(d, f) for d, _, fs in os.walk(path) for f in fs if f.endswith(".txt") and not f.startswith(".")]


def test_rows_equal_those_of_sparks_writer(spark, tmp_path, monkeypatch):
    df = spark.createDataFrame(DATA, "id long, text string").repartition(3, "id")
    monkeypatch.setattr(files, "FOLDER_TEXTS", 7)  # several folders a task
    new, old = str(tmp_path / "new"), str(tmp_path / "old")
    os.makedirs(f"{new}/id=77")  # written over
    open(f"{new}/id=77/a.txt", "w").close()
    write_text_folder(df, new)
    df.write.partitionBy("id").text(old)
    assert _rows(spark, new) == _rows(spark, old) and len(_rows(spark, new)) == len(DATA) - 2
    assert sorted(open(f, "rb").read() for f in _files(new)) == sorted(open(f, "rb").read() for f in _files(old))
    assert os.listdir(tmp_path) and not [f for f in os.listdir(tmp_path) if f.startswith(".")]


def test_no_folder_for_each_text(spark, tmp_path):
    path = write_text_folder(spark.range(300).select("id", F.lit("t").alias("text")).coalesce(2), f"file:{tmp_path}/many")
    assert len(_files(tmp_path / "many")) == 300
    assert sum(len(ds) for _, ds, _ in os.walk(tmp_path / "many")) <= 4
    assert _rows(spark, path) == sorted(((i, "t") for i in range(300)), key=str)


def test_small_files_share_read_tasks(spark, tmp_path):
    path = write_text_folder(spark.range(300).select("id", F.lit("t").alias("text")), str(tmp_path / "many"))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1m")  # a partition for each file
    try:
        got = read_text_folder(spark, path)
        assert spark.read.text(path, wholetext=True, recursiveFileLookup=True).rdd.getNumPartitions() == 300
        assert got.rdd.getNumPartitions() == min(300, 4 * spark.sparkContext.defaultParallelism)
        assert got.count() == 300
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_failed_write_leaves_what_was_there(spark, tmp_path):
    path = write_text_folder(spark.createDataFrame([(1, "kept")], "id long, text string"), str(tmp_path / "t"))
    bad = spark.range(50).select("id", F.when(F.col("id") == 40, F.raise_error(F.lit("bad"))).otherwise("t").cast("string").alias("text"))
    try:
        write_text_folder(bad, path)
    except Exception as e:  # noqa: BLE001
        assert "bad" in str(e)
    else:
        raise AssertionError("the error was swallowed")
    assert _rows(spark, path) == [(1, "kept")] and os.listdir(tmp_path) == ["t"]


def test_string_ids_are_escaped(spark, tmp_path):
    df = spark.createDataFrame([("a/b", "1"), ("", "2"), ("c=d%", "3"), ("e.gz", "4")], "name string, text string")
    write_text_folder(df, str(tmp_path / "s"), id_col="name")
    names = sorted(os.path.basename(f) for f in _files(tmp_path / "s"))
    assert names == sorted(["name=a%2Fb.txt", "name=__HIVE_DEFAULT_PARTITION__.txt", "name=c%3Dd%25.txt", "name=e.gz.txt"])
    assert sorted(r.text for r in read_text_folder(spark, str(tmp_path / "s"), "name").collect()) == ["1", "2", "3", "4"]


def _by_spark(spark, path):
    raw = spark.read.text(path, wholetext=True, recursiveFileLookup=True)
    return sorted((r.p, r.v) for r in raw.select(F.col("_metadata.file_path").alias("p"), F.hex("value").alias("v")).collect())


def _by_tasks(spark, path):
    return sorted((r.path, r.v) for r in files._read_by_tasks(spark, path).select("path", F.hex("value").alias("v")).collect())


def _odd_folder(top):
    punctuation = "".join(c for c in map(chr, range(33, 127)) if c not in "/:" and not c.isalnum())
    names = [punctuation, "é ü😀", "%41", "a%20b", "x._COPYING_", "_common_metadata1", "_y", "_y=2", ".z", "tab\tx", "nl\nx", "a\u3000b"]
    for folder in ("a b", "_x=1", "_h", ".h", "_metadata_d", "deep/er", "empty"):
        os.makedirs(top / folder)
    for i, name in enumerate(names):
        (top / "a b" / name).write_bytes(b"\xff\xe2\n" + b"x" * i)
    for folder in ("_x=1", "_h", ".h", "_metadata_d", "deep/er"):
        (top / folder / "f").write_text("q\n\n")
    (top / "nothing").touch()
    os.symlink(top / "nowhere", top / "broken")
    os.symlink(top / "a b" / "%41", top / "link")
    os.symlink(top / "deep", top / "linked")


def test_tasks_read_the_rows_of_sparks_reader(spark, tmp_path, monkeypatch):
    _odd_folder(tmp_path)
    want = _by_spark(spark, str(tmp_path))
    assert len(want) > 10 and _by_tasks(spark, str(tmp_path)) == want
    monkeypatch.setattr(files, "_MOST_FOLDERS", 2)  # the tasks walk all
    assert _by_tasks(spark, f"file://{tmp_path}/../{tmp_path.name}/") == want


def test_folders_are_split_or_left_whole(tmp_path, monkeypatch):
    for i in range(6):
        os.makedirs(tmp_path / f"{i}/x")
    top = str(tmp_path)
    assert files._folders(top, 1) == [(top, True)]
    assert sorted(files._folders(top, 3)) == [(top, False)] + [(f"{top}/{i}", True) for i in range(6)]
    assert len(files._folders(top, 100)) == 13 and not any(deep for _, deep in files._folders(top, 100))
    monkeypatch.setattr(files, "_MOST_FOLDERS", 5)
    assert files._folders(top, 100) == [(top, True)]


def test_no_list_of_files_in_the_driver(spark, tmp_path):
    """Spark's file index, which holds every file, is not asked."""
    path = write_text_folder(spark.range(500).select("id", F.lit("t").alias("text")), str(tmp_path / "many"))
    got = read_text_folder(spark, path)
    assert not [f for f in got.inputFiles() if "/many/" in f]
    assert _rows(spark, path) == sorted(((i, "t") for i in range(500)), key=str)


def test_what_spark_reads(spark, tmp_path):
    import gzip

    import pytest

    (tmp_path / "id=1.txt").write_text("one\n")
    (tmp_path / "id=2.txt.gz").write_bytes(gzip.compress(b"two\n"))
    assert _rows(spark, str(tmp_path)) == [(1, "one"), (2, "two")]
    assert _rows(spark, f"{tmp_path}/*.txt") == _rows(spark, f"{tmp_path}/id=1.txt") == [(1, "one")]
    os.makedirs(tmp_path / "none/below")
    assert _rows(spark, str(tmp_path / "none")) == []
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        read_text_folder(spark, str(tmp_path / "missing"))
