"""Large JSON arrays read element by element, against Python's JSON reader."""

import json
import random

import pytest

from colloquy.sources.arrays import read_array_elements
from colloquy.sources.documents import parse_export
from colloquy.sources.lines import read_documents
from tests.test_sources import EXPORT

PIECES = ['"', "\\", "{", "}", "[", "]", ",", ":", "\n", "é", "\\u007b", "a", " ", '\\"', "😀"]


def value(rng, depth=0):
    kind = rng.randrange(7)
    if kind < 2 and depth < 4:
        return {text(rng): value(rng, depth + 1) for _ in range(rng.randrange(4))}
    if kind == 2 and depth < 4:
        return [value(rng, depth + 1) for _ in range(rng.randrange(4))]
    return [None, True, 1.5, text(rng), text(rng)][rng.randrange(5)]


def text(rng):
    return "".join(rng.choice(PIECES) for _ in range(rng.randrange(12)))


def read(spark, path, split):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
    try:
        df = read_array_elements(spark, str(path))
        splits = df.sparkSession.read.option("lineSep", "{").text(str(path)).rdd.getNumPartitions()
        return splits, [(r.path.rsplit("/", 1)[1], r.element, r.value) for r in df.orderBy("path", "element").collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


@pytest.mark.parametrize("split", [97, 1_000, 1 << 27])
def test_elements_of_random_arrays(spark, tmp_path, split):
    rng = random.Random(7)
    want = []
    for name, indent in (("a.json", None), ("b.json", 2)):
        elements = [{"k": value(rng), text(rng): value(rng)} for _ in range(60)]
        (tmp_path / name).write_text(json.dumps(elements, indent=indent, ensure_ascii=name == "a.json"), encoding="utf-8")
        want += [(name, i, e) for i, e in enumerate(elements)]
    splits, got = read(spark, tmp_path, split)
    assert [(n, i, json.loads(v)) for n, i, v in got] == want
    assert splits > 40 or split > 97


def test_awkward_files(spark, tmp_path):
    files = {
        "empty.json": "", "blank.json": " \n", "none.json": "[]", "object.json": ' {"a": {"b": "}{"}, "c": [{}, {}]}\n', "scalars.json": '[1, "{", null]',
        "cut.json": '[{"a": 1}, {"b": ', "open.json": '[{"a": "x}]', "mixed.json": '[1, {"a": 2}, "}", null, {"a": {}} , [3]]', "bare.json": "[{},{}]",
    }
    for name, body in files.items():
        (tmp_path / name).write_text(body)
    for split in (5, 1 << 20):
        _, got = read(spark, tmp_path, split)
        assert [(n, i, json.JSONDecoder().raw_decode(v)[0]) for n, i, v in got] == [
            ("bare.json", 0, {}), ("bare.json", 1, {}), ("mixed.json", 0, {"a": 2}), ("mixed.json", 1, {"a": {}}),
            ("object.json", 0, {"a": {"b": "}{"}, "c": [{}, {}]}),
        ]


def test_export_by_elements_equals_whole_files(spark, tmp_path):
    second = json.loads(json.dumps(EXPORT[0]).replace("Trip", "Tour \\\" {").replace("e1", "e2"))
    (tmp_path / "conversations.json").write_text(json.dumps([*EXPORT, None, {"title": "no nodes"}, second]))
    (tmp_path / "single.json").write_text(json.dumps(EXPORT[0] | {"id": "e3"}))
    for tree in (False, True):
        whole, parts = (
            sorted(map(str, parse_export(r(spark, str(tmp_path)), tree_order=tree, as_of="2025-01-01 00:00:00").collect()))
            for r in (read_documents, read_array_elements)
        )
        assert whole and whole == parts
