"""CSV in byte ranges against Spark's reader of whole files."""

import random
import re

import pytest

from mendframe.sources import csv_ranges, load


def written(path, rng, break_, rows):
    """A file of three columns in which quoted fields hold delimiters, quotes and line breaks."""

    def field():
        kind = rng.random()
        body = "".join(rng.choice(["a", "b", " ", "1", "x,", "\n", '""', "é", "\r\n", "\n\n"]) for _ in range(rng.randrange(9)))
        if kind < 0.35:
            return f'"{body}"'
        if kind < 0.42:
            return f'"{body}"tail'
        if kind < 0.5:
            return 'mid"quote'
        return re.sub('[,\n\r"]', "", body)

    lines = [",".join(field() for _ in range(rng.choice([3, 3, 3, 2, 4]))) for _ in range(rows)]
    lines.insert(rows // 2, f'9,"{"long" * 20}{break_ * 200}",z')
    if break_ == "\r\n":
        lines = [x.replace("\r\n", "\n").replace("\n", rng.choice(["\r\n", "\n"])) for x in lines]
    text = break_.join(["a,b c,d`e", *lines]) + rng.choice([break_, ""])
    path.write_text(text, encoding="utf-8", newline="")
    return str(path)


@pytest.fixture
def small_splits(spark):
    def size(n):
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(n))

    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield size
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def rows_of(df):
    return [tuple(r) for r in df.collect()]


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("break_", ["\n", "\r\n"])
def test_ranges_give_what_the_whole_file_gives(spark, tmp_path, small_splits, seed, break_):
    rng = random.Random(seed)
    path = written(tmp_path / "t.csv", rng, break_, 150)
    want = load.read_csv_whole(spark, path)
    small_splits(rng.choice([90, 300, 900]))
    got = load.read_csv(spark, path)
    assert got.columns == want.columns
    assert rows_of(got) == rows_of(want)
    assert csv_ranges.splits_of(spark, path).count() > 3


def test_a_folder_of_files(spark, tmp_path, small_splits):
    rng = random.Random(5)
    for i in range(3):
        written(tmp_path / f"{i}.csv", rng, "\n", 40)
    want = rows_of(load.read_csv_whole(spark, str(tmp_path)))
    small_splits(200)
    assert sorted(map(str, rows_of(load.read_csv(spark, str(tmp_path))))) == sorted(map(str, want))


def test_files_without_breaks_in_fields_are_scanned_by_lines(spark, tmp_path, small_splits):
    path = tmp_path / "plain.csv"
    path.write_text("a,b\n" + "".join(f'{i},"x, ""{i}"""\n' for i in range(200)))
    small_splits(300)
    got = load.read_csv(spark, str(path))
    assert got.inputFiles() and all(f.endswith("plain.csv") for f in got.inputFiles())
    assert got.rdd.getNumPartitions() > 3
    assert rows_of(got) == rows_of(load.read_csv_whole(spark, str(path)))


@pytest.mark.parametrize(
    "text",
    [
        "a,b\r1,2\r3,4\r",
        'a,b\n1,"x\ry"\n2,z\n',
        'a,b\n\n\n1,"x\n\ny"\n\n',
        '"a\nb",c\n1,2\n',
        "a,b\n",
        'a,b\n1,"x"\r\n2,y\n',
        "﻿a,b\n1,\"x\ny\"\n",
    ],
)
def test_odd_files(spark, tmp_path, text):
    path = tmp_path / "odd.csv"
    path.write_text(text, encoding="utf-8", newline="")
    want, got = load.read_csv_whole(spark, str(path)), load.read_csv(spark, str(path))
    assert got.columns == want.columns and rows_of(got) == rows_of(want)


def test_a_field_that_never_closes_ends_with_the_file(spark, tmp_path):
    path = tmp_path / "open.csv"
    path.write_text('a,b\n1,x\n2,"never closed\n3,z\n')
    assert rows_of(load.read_csv(spark, str(path))) == [("1", "x"), ("2", "never closed\n3,z")]


def test_line_functions(spark):
    """Both states of every short line against a plain automaton."""

    def plain(line, inside):
        state = "quoted" if inside else "start"
        for c in line:
            if state == "start":
                state = "quoted" if c == '"' else "start" if c == "," else "bare"
            elif state == "bare":
                state = "start" if c == "," else "bare"
            elif state == "quoted":
                state = "quote" if c == '"' else "quoted"
            else:  # a quote inside quotes
                state = "quoted" if c == '"' else "start" if c == "," else "bare"
        return state == "quoted"

    lines = [""]
    for _ in range(6):
        lines += [x + c for x in lines if len(x) == len(lines[-1]) for c in '",a']
    lines = sorted(set(lines)) + ['"' * 9, '"a' * 2000, "x," * 20_000 + '"', '""' * 30_000]
    df = csv_ranges._with_function(spark.createDataFrame([(x,) for x in lines], "line string"))
    for r in df.collect():
        assert r["from_outside"] == plain(r["line"], False), r["line"][:40]
        assert r["from_inside"] == plain(r["line"], True), r["line"][:40]


def test_numbers_follow_the_file(spark, tmp_path, small_splits):
    path = tmp_path / "t.csv"
    path.write_text("name,v\n" + "".join(f'n{i},"a\n{i}"\n' for i in range(100)))
    small_splits(120)
    df, meta = load.load_table(spark, str(path))
    assert [(r["id"], r["name"]) for r in df.orderBy("id").collect()] == [(i + 1, f"n{i}") for i in range(100)]
