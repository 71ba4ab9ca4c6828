import json
import math
import os

import pytest
from samples import CSV_TEXT
from pyspark.sql import functions as F

from mendframe.session import materialize, shared_folder
from mendframe.sources import LoadError, coerce_types, ensure_id, export_table, load_table, load_tables
from mendframe.sources import export, load


def write(path, text, encoding="utf-8"):
    path.write_text(text, encoding=encoding)
    return str(path)


def test_csv_text(spark):
    df, meta = load_table(spark, CSV_TEXT)
    assert meta.name == "dataset" and meta.format == "csv"
    assert dict(df.dtypes) == {"id": "bigint", "name": "string", "age": "string", "fare": "double", "survived": "bigint"}
    assert df.count() == 10 and spark.table("dataset").count() == 10


def test_csv_text_may_hold_line_breaks(spark):
    df, _ = load_table(spark, "k,v\n" + "".join(f'{i},"x\ny, {i}"\n' for i in range(6)))
    assert [r["v"] for r in df.orderBy("k").collect()] == [f"x\ny, {i}" for i in range(6)]


def test_csv_file(spark, tmp_path):
    text = 'PassengerId,note,n\n' + "".join(f'{i},"a, ""q""\nline {i}",{i}.0\n' for i in range(1, 7)) + "7,short\n8,x,,extra\n"
    path = write(tmp_path / "1 My-File.csv", text, "utf-8-sig")
    df, meta = load_table(spark, path)
    assert meta.name == "t_1_my_file" and df.columns == ["id", "note", "n"]
    assert df.count() == 8 and df.where("id = 3").first()["note"] == 'a, "q"\nline 3'
    assert dict(df.dtypes)["n"] == "bigint" and df.where("n is null").count() == 2
    lines = write(tmp_path / "plain.csv", "a,b\n" + "".join(f"{i},x\n" for i in range(6)))
    assert load_table(spark, lines, multiline=False)[0].count() == 6


def test_json_shapes(spark, tmp_path):
    records = [{"k": i, "v": f"r{i}"} for i in range(6)]
    plain = write(tmp_path / "a.json", json.dumps(records, indent=1))
    assert load_table(spark, plain)[0].count() == 6
    for key in load.WRAPPER_KEYS:
        wrapped = write(tmp_path / f"{key}.json", json.dumps({"meta": 1, key: records}))
        assert sorted(r["v"] for r in load_table(spark, wrapped)[0].collect()) == [f"r{i}" for i in range(6)]
    lines = write(tmp_path / "b.jsonl", "\n\n".join(json.dumps(r) for r in records))
    df, meta = load_table(spark, lines)
    assert df.count() == 6 and meta.format == "jsonl"


def test_parquet_nan_is_null(spark, tmp_path):
    path = str(tmp_path / "p.parquet")
    rows = [(i, math.nan if i == 3 else i / 2) for i in range(6)]
    spark.createDataFrame(rows, "Index long, x double").write.parquet(path)
    df, _ = load_table(spark, path)
    assert df.columns == ["id", "x"] and df.where("x is null").count() == 1


def test_ids_follow_file_order(spark, tmp_path):
    path = str(tmp_path / "many.parquet")
    spark.range(0, 1000, 1, 7).select(F.col("id").alias("n")).write.option("maxRecordsPerFile", 60).parquet(path)
    df = ensure_id(spark.read.parquet(path), scanned=True)
    rows = sorted((r["id"], r["n"]) for r in df.collect())
    assert [i for i, _ in rows] == list(range(1, 1001)) and [n for _, n in rows] == list(range(1000))
    derived = ensure_id(spark.read.parquet(path).where("n % 2 = 0").repartition(3))
    assert sorted(r["id"] for r in derived.collect()) == list(range(1, 501))


def test_bad_ids_become_positions(spark):
    df = spark.createDataFrame([("7", "a"), ("x", "b"), (None, "c")], "ID string, t string").coalesce(1)
    assert sorted((r["t"], r["id"]) for r in ensure_id(df).collect()) == [("a", 7), ("b", 2), ("c", 3)]


def test_positions_never_meet_ids(spark):
    df = spark.createDataFrame([("7", "a"), (None, "b"), ("2", "c")], "id string, t string").coalesce(1)
    assert sorted((r["t"], r["id"]) for r in ensure_id(df).collect()) == [("a", 7), ("b", 9), ("c", 2)]


def test_first_rows(spark, tmp_path):
    path = str(tmp_path / "rows.parquet")
    spark.range(0, 100, 1, 4).select(F.col("id").alias("n")).write.parquet(path)
    df, _ = load_table(spark, path, max_rows=10)
    assert sorted(r["n"] for r in df.collect()) == list(range(10))


def test_coercion(spark):
    rows = [(" 1", "1.5", "x", "9007199254740993", "", "1"), ("2.0 ", "2", "3", "5", " ", None)]
    df = coerce_types(spark.createDataFrame(rows, "a string, b string, c string, d string, e string, f string"))
    assert [t for _, t in df.dtypes] == ["bigint", "double", "string", "bigint", "string", "bigint"]
    first, second = df.collect()
    assert (first["a"], second["a"], first["d"], first["e"], second["f"]) == (1, 2, 9007199254740993, "", None)
    whole = coerce_types(spark.createDataFrame([(1.0,), (None,)], "x double"))
    assert whole.dtypes == [("x", "bigint")]


def test_refused_sources(spark, tmp_path):
    small = write(tmp_path / "small.csv", "a,b\n1,2\n")
    for source in ("", "   ", "not a source", str(tmp_path / "missing.csv"), small):
        with pytest.raises(LoadError):
            load_table(spark, source)
    with pytest.raises(LoadError):
        load_table(spark, small, fmt="xlsx")


def test_several_tables_leave_out_small_ones(spark, tmp_path):
    good = write(tmp_path / "g.csv", "a,b\n" + "".join(f"{i},{i}\n" for i in range(6)))
    small = write(tmp_path / "s.csv", "a,b\n1,2\n")
    assert list(load_tables(spark, {"Sheet 1": good, "tiny": small})) == ["sheet_1"]
    with pytest.raises(LoadError):
        load_tables(spark, {"tiny": small})


@pytest.mark.parametrize("fmt", ["csv", "json", "jsonl", "parquet", "nonsense"])
def test_export(spark, tmp_path, dirty, fmt):
    tagged = dirty.withColumn("_source_format", F.lit("csv"))
    done = export_table(tagged, str(tmp_path), "/data/My Set.csv", "csv", fmt)
    assert done.row_count == 10 and done.format == ("csv" if fmt == "nonsense" else fmt)
    assert os.path.basename(done.path).startswith("my_set_cleaned.")
    back, _ = load_table(spark, done.path)
    # JSON columns come back in alphabetical order
    assert sorted(back.columns) == sorted(dirty.columns) and back.count() == 10
    assert back.where("id = 5").first()["fare"] == 512.33


def test_export_rules(spark, dirty, tmp_path):
    with pytest.raises(ValueError):
        export_table(dirty.limit(0), str(tmp_path), "x")
    assert export.export_format("hf_dataset") == "csv" and export.export_format("json", "parquet") == "parquet"
    assert export.export_name("a" * 90) == "a" * 90 + "_cleaned" and export.export_name("") == "dataset_cleaned"


def test_shared_folder_and_materialize(spark, dirty):
    folder = shared_folder(spark)
    assert shared_folder(spark) == folder
    stored = materialize(dirty, "unit")
    assert stored.schema == dirty.schema and stored.count() == 10
    assert any(name.startswith("unit-") for name in os.listdir(folder.removeprefix("file:")))


@pytest.mark.parametrize("cell_rows", [3, 1000])
def test_repeated_ids_are_numbered_on(spark, cell_rows):
    rows = [(i if i % 3 else 7, i, f"v{i}") for i in range(1, 61)]
    df = spark.createDataFrame(rows, "id long, _position long, v string").repartition(5)
    found = {r["v"]: r["id"] for r in load.spread_repeats(df, cell_rows).collect()}
    seen, want, top = set(), {}, 59
    for i, position, v in rows:
        top = top + 1 if i in seen else top
        want[v] = top if i in seen else i
        seen.add(i)
    assert found == want and len(set(found.values())) == 60


def test_repeated_ids_of_a_file(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text("id,v\n" + "".join(f"{i},{n}\n" for n, i in enumerate([5, 5, "", "x", 2, 5, 2, 9])))
    df, _ = load.load_table(spark, str(path))
    assert [(r["v"], r["id"]) for r in df.orderBy("v").collect()] == [(0, 5), (1, 14), (2, 12), (3, 13), (4, 2), (5, 15), (6, 16), (7, 9)]
    assert df.columns == ["id", "v"]
