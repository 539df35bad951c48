from pyspark.sql import Observation
from pyspark.sql import functions as F

from panelweave.operators import cleaning
from panelweave.operators.grouping import dense_codes, exact_quantiles, hash_ranked_sample

INF = float("inf")


def test_clean_data(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (None, None), (2, None), (2, None)], "k int, s string")
    seen = Observation()
    assert {tuple(r) for r in cleaning.clean_data(df, observation=seen).collect()} == {(1, "a"), (2, None)}
    assert seen.get == {"n_input": 5, "n_non_empty": 4}
    assert cleaning.clean_data(df, drop_duplicates=False).count() == 4
    assert tuple(cleaning.cleaning_counts(df).first()) == (5, 1, 2, 2)


def test_convert_types(spark):
    df = spark.createDataFrame([("1", "x", 1.0), ("2", "3", None)], "a string, b string, c double")
    out = cleaning.convert_types(df, {"a": "int64", "b": "int64", "c": "int64", "zz": "int64"})
    assert dict(out.dtypes) == {"a": "bigint", "b": "string", "c": "double"}


def test_clean_numeric(spark):
    df = spark.createDataFrame([(1.0, 1), (INF, 2), (-INF, 3), (4.0, 4), (float("nan"), 5)], "a double, b int")
    assert [r["a"] for r in cleaning.clean_numeric(df, ["a", "zz"]).orderBy("b").collect()] == [1.0, None, None, 4.0, None]
    filled = cleaning.clean_numeric(df, ["a"], fill_value=0.0).orderBy("b").collect()
    assert [r["a"] for r in filled] == [1.0, 0.0, 0.0, 4.0, 0.0]


def test_recode_derive_rename(spark):
    df = spark.createDataFrame([(-999, "", 500.0), (3, "x", 2000.0)], "n int, s string, price double")
    assert [tuple(r) for r in cleaning.recode_sentinels(df).orderBy("price").collect()] == [(None, None, 500.0), (3, "x", 2000.0)]
    wide = cleaning.derive_columns(df, clips={"price": (1000.0, None)}, logs=["n"])
    assert sorted(r["price"] for r in wide.collect()) == [1000.0, 2000.0]
    assert wide.filter("n < 0").first()["log_n"] is None
    assert cleaning.snake_case_columns(spark.createDataFrame([(1, 2)], "`SalePrice` int, `my col` int")).columns == ["sale_price", "my_col"]


def test_impute_and_policy(spark):
    df = spark.createDataFrame([(1, 2.0), (1, None), (2, None), (None, 5.0)], "g int, v double")
    out = {(r["g"], r["v"]) for r in cleaning.impute_group_mean(df, ["v"], "g").collect()}
    assert out == {(1, 2.0), (2, None), (None, 5.0)}
    kept, counts = cleaning.missing_policy(df, "v", ["g"])
    assert kept.count() == 2 and tuple(counts.first()) == ("g", 1, True)


def test_coverage(spark):
    row = cleaning.column_coverage(spark.range(1), ["id", "x"]).first()
    assert (row["present"], row["missing"], row["coverage_rate"]) == (["id"], ["x"], 0.5)
    assert cleaning.column_coverage(spark.range(1), []).first()["coverage_rate"] == 1.0


def test_dense_codes_match_sorted_order(spark):
    words = [f"w{(i * 37) % 211:03d}" for i in range(500)]
    df = spark.createDataFrame([(w,) for w in words] + [(None,)], "w string")
    got = {r["w"]: r["c"] for r in dense_codes(df, "w", "c", buckets=7).collect()}
    assert got == {w: i for i, w in enumerate(sorted(set(words)))}


def test_exact_quantiles_match_sorting(spark):
    import numpy as np

    # One value holds a third of the rows of its group.
    values = [(g, float((i * 7919) % 997) if i % 3 else 500.0) for g in (0, 1) for i in range(1000 + 13 * g)]
    df = spark.createDataFrame(values + [(0, None)], "g int, v double")
    wanted = {"a": 0.01, "b": 0.25, "c": 0.5, "d": 0.99, "e": 0.0, "f": 1.0}
    for row in exact_quantiles(df, "v", wanted, ["g"], buckets=8).collect():
        mine = [v for g, v in values if g == row["g"]]
        for name, p in wanted.items():
            assert abs(row[name] - np.percentile(mine, p * 100)) < 1e-9
    single = exact_quantiles(df, "v", {"m": 0.5}).first()["m"]
    assert abs(single - np.median([v for _, v in values])) < 1e-9


def test_sample_has_exact_size_and_is_stable(spark):
    df = spark.range(1013).select("id", (F.col("id") % 7).alias("t"))
    first = hash_ranked_sample(df, ["id", "t"], 0.8)
    again = hash_ranked_sample(df.repartition(9), ["id", "t"], 0.8)
    ids = {r["id"] for r in first.collect()}
    assert len(ids) == round(1013 * 0.8) and ids == {r["id"] for r in again.collect()}
