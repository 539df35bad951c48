import pytest
from pyspark.sql import functions as F

from panelweave import sources
from panelweave.operators import audit, manifest, rules, tables

SCHEMA = {"id": {"dtype": "int64", "required": True, "unique": True}, "value": {"dtype": "float64", "min": 0, "max": 10}, "category": {"dtype": "object", "values": ["A", "B"]}}


@pytest.fixture(scope="module")
def sample(spark):
    letters = F.array(*map(F.lit, "ABC"))
    return spark.range(1, 101).select(
        "id",
        (F.col("id") / 10).alias("value"),
        F.element_at(letters, (F.col("id") % 3 + 1).cast("int")).alias("category"),
        F.date_add(F.lit("2020-01-01").cast("date"), F.col("id").cast("int")).alias("date"),
    )


@pytest.fixture(scope="module")
def repeated(spark):
    rows = zip([1, 2, 2, 3, 4, 4, 4, 5], [10, 20, 20, 30, 40, 40, 40, 50])
    return spark.createDataFrame(list(rows), "id bigint, value bigint")


def check(df, *given):
    return rules.DataValidator().add_rules(given).validate(df)


def test_rules_pass_and_fail(sample, repeated, spark):
    holes = sample.withColumn("value", F.when(~F.col("id").between(10, 15), F.col("value")))
    assert not check(sample, rules.no_missing_values(["id", "value", "absent"])).has_errors
    report = check(holes, rules.no_missing_values(["value"]))
    assert report.has_errors and "value=6" in report.results[0].message
    assert not check(sample, rules.unique_values("id")).has_errors
    assert "3 repeats in 8 rows" in check(repeated, rules.unique_values("id")).results[0].message
    assert check(holes, rules.unique_values("value")).has_errors
    assert check(sample, rules.value_range("value", 0, 5)).has_warnings
    assert not check(sample, rules.value_range("value", 0, 15)).has_warnings
    assert check(sample, rules.categorical_values("category", {"A", "B", "C"})).passed
    report = check(sample, rules.categorical_values("category", {"A"}))
    assert report.has_errors and "67 outside the set, least: B" in report.results[0].message
    assert check(sample, rules.date_range("date", "2020-01-01", "2021-01-01")).passed
    assert not check(sample, rules.date_range("date", "2020-02-01")).passed
    words = spark.createDataFrame([("2020-01-05",), ("no date",)], "date string")
    assert check(words, rules.date_range("date", "2020-01-01", "2020-12-31")).passed
    assert check(sample, rules.row_count(10)).passed and check(sample, rules.row_count(1000)).has_errors
    assert not check(sample, rules.row_count(max_rows=10)).passed
    assert check(sample, rules.no_duplicate_rows(["id"])).passed
    assert "3 surplus rows" in check(repeated, rules.no_duplicate_rows(["id", "value"])).results[0].message
    assert "3 surplus rows" in check(repeated, rules.no_duplicate_rows()).results[0].message
    assert check(repeated, rules.no_duplicate_rows(["none"])).has_errors
    assert check(sample, rules.positive_values("value"), rules.non_negative("value"), rules.strictly_positive("value")).passed
    assert check(sample, rules.string_length("category", 1, 1), rules.value_pattern("category", "[ABC]")).passed
    assert not check(sample, rules.string_length("category", 2)).passed
    assert not check(sample, rules.value_pattern("category", "[AB]")).passed
    assert check(sample, rules.no_future_dates("date")).passed
    assert check(sample, rules.value_range("absent", 0)).has_warnings
    points = spark.createDataFrame([(10.0, 20.0), (95.0, 0.0), (None, 0.0)], "latitude double, longitude double")
    assert "2 off the globe" in check(points, rules.valid_coordinates()).results[0].message


def test_one_job_for_all_row_rules(sample):
    given = [rules.no_missing_values(["id"]), rules.value_range("value", 0, 9), rules.string_length("category", 1), rules.row_count(1)]
    plan = rules.DataValidator().add_rules(given).results(sample)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") == 1


def test_broken_rule_is_a_failed_rule(sample):
    broken = rules.condition_rule("broken", ["value"], F.col("no_such_column") > 1, "bad", "good", "error")
    report = check(sample, rules.row_count(1), broken)
    assert [r.passed for r in report.results] == [True, False]
    assert "not evaluated" in report.results[1].message


def test_report(sample, repeated):
    with pytest.raises(ValueError, match="rules broken"):
        rules.DataValidator().add_rule(rules.unique_values("id")).validate_or_raise(repeated)
    empty = rules.ValidationReport()
    assert empty.total == 0 and empty.passed and not empty.has_errors
    report = check(sample, rules.row_count(1), rules.value_range("value", 0, 1))
    assert "1 of 2 rules broken" in report.format() and report.to_dict()["total"] == 2
    assert (report.error_count, report.warning_count) == (0, 1)
    assert rules.DataValidator().add_rule(rules.row_count(1)).validate_or_raise(sample).total == 1
    assert rules.DataValidator().validate(sample).total == 0


def test_schema(sample):
    v = rules.DataValidator()
    assert v.validate_schema(sample, rules.create_schema({"id": "int", "value": "float", "category": "str", "date": "datetime"})).passed
    assert v.validate_schema(sample, {"none": {"dtype": "int64", "required": True}}).has_errors
    assert not v.validate_schema(sample, {"none": {"dtype": "int64", "required": False}}).has_errors
    assert v.validate_schema(sample, {"id": "float"}).has_warnings
    report = v.validate_schema(sample, SCHEMA)
    failed = {r.rule_name for r in report.results if not r.passed}
    assert failed == {"categorical_values:category"}


def test_input_rules(sample):
    assert not rules.input_rules(sample).validate(sample).has_errors
    assert rules.input_rules(sample, ["id", "none"]).validate(sample).has_errors
    assert rules.input_rules(sample).validate(sample.limit(0)).has_errors


def test_invalid_values_by_table(spark, sample):
    allowed = spark.createDataFrame([("A",), ("B",)], "ok string")
    assert [r["category"] for r in rules.invalid_values(sample, "category", allowed).collect()] == ["C"]
    assert check(sample, rules.categorical_values("category", allowed)).has_errors


def test_audit(spark, sample, tmp_path):
    holes = sample.withColumn("value", F.when(F.col("id") > 4, F.col("value")))
    sources.save_data(holes, f"{tmp_path}/data_work/s1.parquet")
    sources.save_data(sample.filter("id <= 80").withColumn("new_col", F.lit(1)), f"{tmp_path}/data_work/s2.parquet")
    paths = {"s1": "data_work/s1.parquet", "gone": "data_work/none.parquet", "s2": "data_work/s2.parquet"}
    pipeline = audit.PipelineAudit(spark, str(tmp_path), paths)
    rows = {r["stage_name"]: r for r in pipeline.run_full_audit().collect()}
    assert rows["s1"]["row_count"] == 100 and rows["s1"]["missing_by_column"] == {"value": 4}
    assert rows["s1"]["file_size_mb"] > 0 and rows["s1"]["modified_time"] is not None
    assert not rows["gone"]["exists"] and rows["gone"]["notes"] == "no file"
    step = audit.attrition(pipeline.run_full_audit()).collect()
    assert len(step) == 1 and (step[0]["difference"], step[0]["percent_change"]) == (-20, -20.0)
    compared = pipeline.compare_stages("s1", "s2").first()
    assert compared["row_diff"] == -20 and compared["columns_added"] == ["new_col"]
    missing = audit.stage_missing(pipeline.run_full_audit()).collect()
    assert [(r["column_name"], r["n_missing"], r["percent_missing"]) for r in missing] == [("value", 4, 4.0)]
    pipeline.save(f"{tmp_path}/report")
    assert spark.read.json(f"{tmp_path}/report/stages.json").count() == 3
    with pytest.raises(ValueError, match="no such stage"):
        pipeline.compare_stages("s1", "nope")
    assert "s00_raw" in audit.PipelineAudit(spark).stages


def test_manifests(spark):
    schema = "path string, size_bytes bigint, mtime string, sha256 string"
    a = spark.createDataFrame([("x", 1, "t", "h1"), ("y", 1, "t", None), ("z", 1, "t", "h"), ("same", 1, "t", "h"), ("touched", 1, "t", "h")], schema)
    b = spark.createDataFrame([("x", 1, "t", "h2"), ("y", 2, "t", "h"), ("w", 1, "t", "h"), ("same", 1, "t", "h"), ("touched", 1, "later", "h")], schema)
    got = {r["path"]: r["status"] for r in manifest.compare_manifests(a, b).collect()}
    assert got == {"x": "changed", "y": "changed", "z": "left_only", "w": "right_only"}
    files = spark.createDataFrame([("a/b.py", 1), ("c.JSON", 2), ("d.yml", 3), ("e", 4), (".git/f.py", 5), ("g/__pycache__/h.py", 6), ("i.HTML", 7)], "path string, size_bytes bigint")
    kinds = {r["path"]: r["category"] for r in manifest.classify_files(files).collect()}
    assert kinds == {"a/b.py": "code", "c.JSON": "data", "d.yml": "config", "e": "other", "i.HTML": "output"}
    modules = spark.createDataFrame([("data_loader", "src/data_loader.py"), ("x", "plots/x.py"), ("y", "helpers/y.py"), ("y", "core/y.py")], "name string, path string")
    assert [(r["stage"], r["matched_by"]) for r in manifest.map_modules(modules).collect()] == [
        ("s00_ingest", "name"), ("s05_figures", "path"), ("utils", "utility"), (None, "none")
    ]


def test_tables(demo):
    from panelweave.operators.panel import add_treatment_columns

    data = add_treatment_columns(demo)
    profile = {r["event_time"]: r for r in tables.event_profile(data).collect()}
    assert {k: r["mean"] for k, r in profile.items()} == {-2: 10.0, -1: 11.5, 0: 13.0, 1: 14.2}
    assert all(r["count"] == 1 and r["std"] is None for r in profile.values())
    trend = {r["period"]: r for r in tables.trend_means(data).collect()}
    assert [trend[t]["control"] for t in range(4)] == pytest.approx([8.75, 9.15, 9.55, 9.8])
    assert [trend[t]["treatment"] for t in range(4)] == pytest.approx([10.0, 11.5, 13.0, 14.2])
    assert trend[0]["treatment_start"] == 2
    bars = tables.histogram(demo, "outcome", 5).collect()
    assert len(bars) == 5 and sum(b["count"] for b in bars) == 12
    steps = tables.sample_construction(demo, {"late": F.col("period") > 0, "treated": F.col("treatment") == 1}).collect()
    assert [(s["observations"], round(s["percent_retained"], 1)) for s in steps] == [(12, 100.0), (9, 75.0), (2, 16.7)]
    summary = {r["treatment"]: r for r in tables.group_summary(demo, "treatment", "outcome").collect()}
    assert summary[1]["mean"] == 13.6 and summary[0]["count"] == 10


def test_any_number_of_rules_reads_once(spark):
    """Key sets that overlap, repeat and hold NULLs, in one scan, with row rules."""
    rows = [(1, "a", 1.0), (2, "a", None), (2, "a", None), (None, "b", 3.0), (None, None, 3.0), (4, None, -1.0)]
    df = spark.createDataFrame(rows, "k int, g string, v double")
    df.write.mode("overwrite").saveAsTable("read_once")
    held = spark.table("read_once")
    made = [
        rules.unique_values("k"), rules.no_duplicate_rows(), rules.no_duplicate_rows(["g", "k"]), rules.unique_values("g"),
        rules.no_duplicate_rows(["v"]), rules.no_missing_values(["k", "v"]), rules.value_range("v", 0), rules.unique_values("absent"), rules.unique_values("k"),
    ]
    validator = rules.DataValidator().add_rules(made)
    plan = validator.results(held)
    assert plan._jdf.queryExecution().optimizedPlan().toString().count("Relation") == 1
    got = [(r["rule_name"], r["n_violations"]) for r in plan.orderBy("rule_no").collect()]
    assert [n for _, n in got] == [3, 1, 1, 4, 2, 4, 1, 1, 3]
    empty = validator.results(held.limit(0)).orderBy("rule_no").collect()
    assert [r["n_violations"] for r in empty] == [0, 0, 0, 0, 0, 0, 0, 1, 0]
    spark.sql("drop table read_once")
