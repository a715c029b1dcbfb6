"""JSON array files cut into many ranges equal the whole file parsed at once."""

from __future__ import annotations

import json
import random

import numpy as np
import pytest

from reviewops.sources import arrays
from reviewops.sources.raw import read_json_dataset


def odd_value(rng, depth=0):
    kind = rng.randrange(9 if depth < 3 else 6)
    if kind < 3:
        return "".join(rng.choice(['"', "\\", "{", "}", "[", "]", ",", "a", "é", "文", "\n", " ", "}}", '\\"', "\\\\"]) for _ in range(rng.randrange(30)))
    if kind == 3:
        return rng.choice([None, True, 1.5, -7])
    if kind == 4:
        return {}
    if kind == 5:
        return []
    if kind == 6:
        return [odd_value(rng, depth + 1) for _ in range(rng.randrange(4))]
    return {f"k{i}{rng.choice(['', '}', '{'])}": odd_value(rng, depth + 1) for i in range(rng.randrange(4))}


def write(path, text):
    path.write_text(text, encoding="utf-8")


@pytest.fixture
def small_ranges(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.execution.arrow.maxRecordsPerBatch")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "400b")
    spark.conf.set("spark.sql.files.openCostInBytes", "1b")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("limit", [arrays.BROADCAST, 0])
def test_elements_equal_a_parse_of_the_whole_file(spark, tmp_path, monkeypatch, small_ranges, limit):
    monkeypatch.setattr(arrays, "BROADCAST", limit)
    rng, want = random.Random(3), []
    for name in ("a", "b", "c"):
        items = [odd_value(rng) for _ in range(60)] + [{"long": "x}" * 900}, {"id": name}]
        rng.shuffle(items)
        write(tmp_path / f"{name}.json", rng.choice(["", " \n"]) + json.dumps(items, ensure_ascii=name == "a", indent=None if name == "b" else 1) + rng.choice(["", "\n"]))
        want += [(name, i) for i in items if isinstance(i, dict)]
    write(tmp_path / "d.json", '{"not": [{"an": "array"}]}')
    write(tmp_path / "e.json", "")
    write(tmp_path / "f.json", '[{"a": 1}, {"b": "breaks o')
    got = arrays.read_elements(spark, str(tmp_path)).orderBy("file", "pos").collect()
    names = [r["file"].rsplit("/", 1)[1][0] for r in got]
    assert [(n, json.loads(r["text"])) for n, r in zip(names, got, strict=True)] == [*want, ("f", {"a": 1})]
    for r, n in zip(got, names, strict=True):
        assert (tmp_path / f"{n}.json").read_bytes()[r["pos"]:].startswith(r["text"].encode())


def test_one_file_is_read_by_several_tasks(spark, tmp_path, small_ranges):
    write(tmp_path / "a.json", json.dumps([{"id": str(i), "n": [{"i": i}]} for i in range(300)]))
    assert spark.read.option("lineSep", "}").text(str(tmp_path)).rdd.getNumPartitions() > 10
    rows = read_json_dataset(spark, str(tmp_path), spark.createDataFrame([], "id string, n array<struct<i:int>>").schema)
    assert sorted((int(r["id"]), r["n"][0]["i"]) for r in rows.collect()) == [(i, i) for i in range(300)]


def test_structure_counts_escapes():
    text = b'{"a\\\\":"\\"}{",":":[1]}'
    step, inside = arrays.structure(np.frombuffer(text, np.uint8), False)
    assert not inside and [(i, int(s)) for i, s in enumerate(step) if s] == [(0, 1), (18, 1), (20, -1), (21, -1)]
    assert arrays.structure(np.frombuffer(b'x"{', np.uint8), True)[0].tolist() == [0, 0, 1]


def test_array_files_grow_in_number_with_the_rows(spark):
    from collections import Counter

    from reviewops.plans.queries_sources import array_files
    schema = "seq long, raw_json string"
    ev = spark.createDataFrame([(i // 2, json.dumps({"id": i})) for i in range(3000)], schema).repartition(3)
    for rows_a_file, least in ((100, 25), (1 << 19, 4)):
        path = array_files({"ev": ev}, rows_a_file)
        found = arrays.read_elements(spark, path).select("file", "text").collect()
        assert Counter(json.loads(r["text"])["id"] for r in found) == Counter(range(3000))
        sizes = Counter(r["file"] for r in found)
        assert len(sizes) >= least and (rows_a_file > 100 or max(sizes.values()) < 250)
    assert arrays.read_elements(spark, array_files({"ev": ev.limit(0)})).count() == 0
