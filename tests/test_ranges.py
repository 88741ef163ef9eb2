"""Large quoted files are read by many tasks, with the rows of a reader that sees the whole file."""

import csv
import io
import json
import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.sources import ranges, tapes


@pytest.fixture
def small_ranges(spark):
    names = {"spark.sql.files.maxPartitionBytes": "300", "spark.sql.files.openCostInBytes": "0", "spark.sql.files.minPartitionNum": "1"}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield
    for k in names:
        spark.conf.unset(k)


def text(rng):
    return "".join(rng.choice(["a", "é", ",", '"', "\n", "\r\n", "}", "{", "]", "\\", " word ", "x" * rng.randrange(200)]) for _ in range(rng.randrange(1, 12)))


@pytest.mark.parametrize("seed", range(4))
def test_csv_of_many_ranges(spark, tmp_path, small_ranges, seed):
    rng = random.Random(seed)
    rows = [(str(i), text(rng) if rng.random() < 0.5 else f"plain {i}", rng.choice(["", "z"])) for i in range(120)]
    if seed == 3:
        rows[40] = ("40", "\n".join(f"{k},}}" for k in range(2000)), "one cell over many ranges")
    for part in range(2):
        out = io.StringIO()
        writer = csv.writer(out, lineterminator="\n" if seed % 2 else "\r\n")
        writer.writerow(["a", "b", "c"])
        writer.writerows(rows[part::2])
        (tmp_path / f"{part}.csv").write_bytes(out.getvalue().encode())
    df = tapes.read_csv(spark, str(tmp_path), ["a", "b", "c"])
    assert ranges.starts(spark, str(tmp_path), "\n", False).count() > 6
    got = sorted(tuple(r) for r in df.collect())
    assert got == sorted((a, b, c or None) for a, b, c in rows) or [(a, b) for a, b, _ in got] == sorted((a, b) for a, b, _ in rows)
    assert sum(r[2] is None for r in got) == sum(r[2] == "" for r in rows)


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("indent", [None, 1])
def test_one_array_of_many_ranges(spark, tmp_path, small_ranges, seed, indent):
    rng = random.Random(seed)
    rows = [{"a": str(i), "b": rng.choice([text(rng), None, ""]), "n": rng.choice([1, True, -5, None])} for i in range(90)]
    (tmp_path / "a.json").write_text(json.dumps(rows[:89], indent=indent, ensure_ascii=seed == 1) + "\n")
    (tmp_path / "b.json").write_text("  " + json.dumps(rows[89:]))
    (tmp_path / "c.json").write_text("[ ]")
    df = tapes.read_json_array(spark, str(tmp_path), ["a", "b", "n"])
    as_text = lambda v: v if v is None or isinstance(v, str) else json.dumps(v)
    assert sorted((tuple(r) for r in df.collect()), key=str) == sorted(((r["a"], r["b"], as_text(r["n"])) for r in rows), key=str)
    assert ranges.starts(spark, str(tmp_path), "}", True, "]").count() > 10
    assert df.select(F.spark_partition_id()).distinct().count() > 5


@pytest.mark.parametrize(
    "bad",
    ['a,b\n1,"2', "a,b\n1", "a,b\n1,2,3", 'a,b\n1,x"2"', 'a,b\n"1"x,2', "b,a\n1,2", "a,b\n1,2\n\n3,4", "a,b\n1,2\r3"],
)
def test_csv_refusals(spark, tmp_path, bad):
    (tmp_path / "x.csv").write_text(bad, newline="")
    with pytest.raises(Exception):
        tapes.read_csv(spark, str(tmp_path), ["a", "b"]).collect()


def test_lone_carriage_returns_and_a_mark_at_the_start(spark, tmp_path):
    (tmp_path / "x.csv").write_text('﻿a,b\r1,"x\ry"\r\n"3",4\r', newline="")
    assert sorted(tuple(r) for r in tapes.read_csv(spark, str(tmp_path), ["a", "b"]).collect()) == [("1", "x\ry"), ("3", "4")]


@pytest.mark.parametrize("bad", ['[{"a":"1"}', '[{"a":"1"}{"a":"2"}]', '{"a":"1"}', '[{"a":"1}]', '[{"a":{"b":"1"}}]', '[{"a":1.5}]', '[1]', '[{"a":"1"}]]'])
def test_json_refusals(spark, tmp_path, bad):
    (tmp_path / "x.json").write_text(bad)
    with pytest.raises(Exception):
        tapes.read_json_array(spark, str(tmp_path), ["a"]).collect()
