"""JSON documents in byte ranges against Spark's reader of whole files."""

import json
import random

import pytest
from test_csv_ranges import rows_of, small_splits  # noqa: F401

from mendframe.sources import json_ranges, load


def record(rng, depth=0):
    texts = ["plain", 'q"uote', "br}ace{", "[list]", "back\\slash", "tab\t", "line\nbreak", "é", "\\", '\\"', "}", ""]
    out = {"id": rng.randrange(100), "t": rng.choice(texts), "n": rng.choice([None, 1.5, 2])}
    if depth < 2 and rng.random() < 0.4:
        out["o"] = {"t": rng.choice(texts), "e": {}}
    if rng.random() < 0.3:
        out["l"] = [rng.choice(texts) for _ in range(rng.randrange(3))]
    if rng.random() < 0.03:
        out["t"] = rng.choice(texts) * 300
    return out


def written(path, rng, wrap, n=120):
    records = [record(rng) for _ in range(n)]
    content = records if wrap is None else {wrap: records}
    path.write_text(json.dumps(content, indent=rng.choice([None, None, 1]), ensure_ascii=rng.random() < 0.5), encoding="utf-8")
    return str(path)


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("wrap", [None, "records", "items"])
def test_ranges_give_what_the_whole_file_gives(spark, tmp_path, small_splits, seed, wrap):  # noqa: F811
    rng = random.Random(seed)
    path = written(tmp_path / "t.json", rng, wrap)
    want = load.read_json_whole(spark, path)
    expected = rows_of(want)
    small_splits(rng.choice([70, 300, 1500]))
    got = load.read_json(spark, path)
    assert got.schema == want.schema and rows_of(got) == expected
    assert "/json-lines-" in got.inputFiles()[0]
    assert json_ranges.splits_of(spark, path, 1 if wrap is None else 2).count() > 3


@pytest.mark.parametrize(
    "text",
    [
        '[{"a": 1}, {"a": 2}]',
        '  [\n{"a": {"b": "}]"}}\n,\n{"a": null}\n]\n',
        '{"data": [{"a": 1}, {"a": 2}], "more": 3}',
        '{"more": 3, "data": [{"a": 1}]}',
        '{"a": 1, "b": [1, 2]}',
        '{"a": 1}\n{"a": 2}\n',
        '{"rows": [{"a": "x\\\\"}, {"a": "\\\\\\""}]}',
    ],
)
def test_odd_documents(spark, tmp_path, text):
    path = tmp_path / "odd.json"
    path.write_text(text)
    want, got = load.read_json_whole(spark, str(path)), load.read_json(spark, str(path))
    assert got.schema == want.schema and rows_of(got) == rows_of(want)


def test_lists_that_hold_more_than_records(spark, tmp_path):
    path = tmp_path / "mixed.json"
    path.write_text('[{"a": 1}, 5, {"a": 2}]')
    for read in (load.read_json_whole, load.read_json):
        with pytest.raises(load.LoadError):
            read(spark, str(path))


def test_a_folder_of_documents(spark, tmp_path, small_splits):  # noqa: F811
    rng = random.Random(7)
    for i in range(3):
        written(tmp_path / f"{i}.json", rng, "data", 30)
    want = load.read_json_whole(spark, str(tmp_path))
    expected = sorted(map(str, rows_of(want)))
    small_splits(200)
    assert sorted(map(str, rows_of(load.read_json(spark, str(tmp_path))))) == expected
