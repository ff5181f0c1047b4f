"""Files whose records span lines, cut into many splits."""

import json
import random

import pytest
from sievetext.sources.files import LABELED_CSV_SCHEMA, _CSV_OPTS, _NO_NULL_TOKEN, read_csv, write_csv
from sievetext.sources.files import read_text_records, write_text_records
from sievetext.sources.splits import read_csv_split, read_json_array, write_json_array
from pyspark.sql import types as T

OPTS = {**_CSV_OPTS, "nullValue": _NO_NULL_TOKEN}
PIECES = ["a", "b c", "\n", "\n\n", '"', '""', ",", "é", "日本", "", "x" * 40, "{", "}", "[", "]", "\\", '\\"', "\t"]


@pytest.fixture
def tiny_splits(spark):
    keys = {"spark.sql.files.maxPartitionBytes": "120", "spark.sql.files.openCostInBytes": "0"}
    before = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def texts(seed, n):
    rng = random.Random(seed)
    return [(rng.choice(["en", "fr", "", None]), "".join(rng.choice(PIECES) for _ in range(rng.randint(0, 30)))) for _ in range(n)]


@pytest.mark.parametrize("seed", range(2))
def test_csv_equals_the_whole_file_reader(spark, tmp_path, tiny_splits, seed):
    rows = texts(seed, 40)
    path = write_csv(spark.createDataFrame(rows, LABELED_CSV_SCHEMA).coalesce(2), str(tmp_path / "c"))
    got = read_csv_split(spark, path, LABELED_CSV_SCHEMA, OPTS)
    whole = sorted(map(tuple, read_csv(spark, path).collect()), key=str)
    assert sorted(map(tuple, got.collect()), key=str) == whole
    assert spark.read.text(path).rdd.getNumPartitions() > 10


@pytest.mark.parametrize("seed", range(2))
@pytest.mark.parametrize("indent", [None, 2])
def test_json_array_equals_json_loads(spark, tmp_path, tiny_splits, seed, indent):
    rng = random.Random(seed)
    want = [{"id": i, "text": t, "more": {"a": [i, {"b": t}], "c": rng.choice([None, "}", "]"])}}
            for i, (_, t) in enumerate(texts(seed, 30))]
    (tmp_path / "j").mkdir()
    for k in range(3):
        (tmp_path / "j" / f"f{k}.json").write_text(json.dumps(want[k::3], indent=indent, ensure_ascii=bool(seed % 2)))
    schema = T.StructType.fromDDL("id long, text string, more struct<a: array<string>, c: string>")
    got = read_json_array(spark, str(tmp_path / "j"), schema).collect()
    assert sorted((r.id, r.text, r.more.c) for r in got) == [(w["id"], w["text"], w["more"]["c"]) for w in want] or \
        sorted(((r.id, r.text, str(r.more.c)) for r in got)) == sorted((w["id"], w["text"], str(w["more"]["c"])) for w in want)
    assert [json.loads(r.more.a[1])["b"] for r in sorted(got, key=lambda r: r.id)] == [w["text"] for w in want]


def test_array_round_trip_and_empty_files(spark, tmp_path, tiny_splits):
    rows = [(i, t) for i, (_, t) in enumerate(texts(9, 40))]
    df = spark.createDataFrame(rows, "id long, text string").repartition(3)
    path = write_json_array(df, str(tmp_path / "a"))
    for f in (tmp_path / "a").glob("part-*"):
        json.loads(f.read_text())  # every file is one array
    schema = T.StructType.fromDDL("id long, text string")
    assert sorted(map(tuple, read_json_array(spark, path, schema).collect())) == rows
    (tmp_path / "e").mkdir()
    (tmp_path / "e" / "none.json").write_text("[]")
    (tmp_path / "e" / "blank.json").write_text(" \n[ ]\n")
    assert read_json_array(spark, str(tmp_path / "e"), schema).collect() == []


def test_one_record_over_many_splits(spark, tmp_path, tiny_splits):
    (tmp_path / "c").mkdir()
    long = "line\n" * 200
    (tmp_path / "c" / "f.csv").write_text(f'en,"{long}"\nfr,short\n"","x""y\n"\n')
    got = read_csv_split(spark, str(tmp_path / "c"), LABELED_CSV_SCHEMA, OPTS)
    assert sorted(map(tuple, got.collect())) == sorted([("en", long), ("fr", "short"), ("", 'x"y\n')])


def test_text_records_keep_every_text(spark, tmp_path):
    rows = [(1, "two\nlines"), (2, ""), (3, None), (4, '"quoted",   and \\ back'), (None, "no id"), (4, "again"), (4, "again")]
    df = spark.createDataFrame(rows, "doc long, body string")
    path = write_text_records(df, str(tmp_path / "records"), 2, "doc", "body")
    assert len(list((tmp_path / "records").glob("part-*"))) <= 2
    got = [tuple(r) for r in read_text_records(spark, path).collect()]
    assert sorted(got, key=repr) == sorted(rows, key=repr)


def test_no_text_records(spark, tmp_path):
    df = spark.createDataFrame([], "id long, text string")
    assert read_text_records(spark, write_text_records(df, str(tmp_path / "none"), 3)).count() == 0
