import hashlib

import pytest
from pyspark.sql import functions as F

from panelweave import sources


@pytest.fixture(scope="module")
def sample(spark):
    return spark.range(1, 101).select(
        "id", (F.col("id") * 1.5).alias("value"), F.element_at(F.array(*map(F.lit, "ABC")), (F.col("id") % 3 + 1).cast("int")).alias("category")
    )


@pytest.mark.parametrize("ext", ["parquet", "csv", "json"])
def test_round_trip(spark, sample, tmp_path, ext):
    path = f"{tmp_path}/deep/er/out.{ext}"
    assert sources.save_data(sample, path) == path
    back = sources.load_data(spark, path)
    assert sorted(map(tuple, back.select("id", "value", "category").collect())) == sorted(map(tuple, sample.collect()))
    sources.save_data(sample.limit(7), path)
    assert sources.count_rows(spark, path) == 7


def test_errors(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        sources.load_data(spark, f"{tmp_path}/none.parquet")
    odd = tmp_path / "x.xyz"
    odd.touch()
    with pytest.raises(ValueError, match="no reader"):
        sources.load_data(spark, str(odd))
    assert sources.count_rows(spark, f"{tmp_path}/none.csv") == 0


def test_quoted_line_breaks_count_once(spark, tmp_path):
    path = tmp_path / "q.csv"
    path.write_text('a,b\n1,"x\ny"\n2,z\n')
    assert sources.count_rows(spark, str(path), multiLine="true") == 2


def test_typed_text_columns(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text("a,b\n1,x\nNaN,NA\n,y\n-999,\n")
    rows = sources.read_text_columns(spark, str(path), {"a": "double"}).collect()
    assert [r["a"] for r in rows] == [1.0, None, None, -999.0]
    assert [r["b"] for r in rows] == ["x", None, "y", None]


def test_nan_becomes_null(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),)], "a double")
    assert sources.normalise_missing(df).filter("a is null").count() == 1


def test_many_sources(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,x\n1,2\n")
    (tmp_path / "b.csv").write_text("id,y\n3,4\n")
    (tmp_path / "c.txt").write_text("no")
    files = sources.find_input_files(spark, str(tmp_path), ["*.csv", "*.txt"])
    assert [f.rsplit("/", 1)[1] for f in files] == ["a.csv", "b.csv", "c.txt"]
    stacked, errors = sources.load_all_sources(spark, files)
    assert sorted(stacked.columns) == ["id", "x", "y"] and len(errors) == 1
    assert {(r["id"], r["x"], r["y"]) for r in stacked.collect()} == {(1, 2, None), (3, None, 4)}
    separate, _ = sources.load_all_sources(spark, files, concat=False)
    assert [p.rsplit("/", 1)[1] for p in separate] == ["a.csv", "b.csv"]


def test_diagnostics(spark, sample, tmp_path):
    sources.save_diagnostic(sample, str(tmp_path), "stats", "sub")
    assert sources.load_diagnostic(spark, str(tmp_path), "stats", "sub").count() == 100
    with pytest.raises(FileNotFoundError):
        sources.load_diagnostic(spark, str(tmp_path), "none")


def test_inventory(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.qmd").write_text("hello")
    (tmp_path / "sub" / "b.qmd").write_text("x" * 100)
    (tmp_path / "skip.bib").write_text("no")
    rows = sources.collect_files(spark, str(tmp_path), "manuscript", [".qmd"], ["none"]).collect()
    by_name = {r["path"].rsplit("/", 1)[1]: r for r in rows}
    assert set(by_name) == {"a.qmd", "b.qmd"}
    assert by_name["a.qmd"]["sha256"] == hashlib.sha256(b"hello").hexdigest()
    assert by_name["b.qmd"]["sha256"] == hashlib.sha256(b"x" * 100).hexdigest() and by_name["b.qmd"]["size_bytes"] == 100
    cut = sources.collect_files(spark, str(tmp_path), include_exts=[".qmd"], max_hash_bytes=50).where("size_bytes = 100").first()
    assert cut["sha256"] is None
    assert by_name["a.qmd"]["category"] == "manuscript"
