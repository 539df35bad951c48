import pytest
from pyspark.sql import functions as F

from panelweave.operators import panel, rules


def test_demo_columns(demo):
    wide = panel.create_fixed_effects(panel.add_treatment_columns(demo)).orderBy("id", "period").collect()
    one = [r for r in wide if r["id"] == 1]
    assert [r["event_time"] for r in one] == [-2, -1, 0, 1]
    assert [r["post_treatment"] for r in one] == [0, 0, 1, 1]
    assert {r["treatment_period"] for r in one} == {2} and {r["ever_treated"] for r in one} == {1}
    rest = [r for r in wide if r["id"] != 1]
    assert all(r["treatment_period"] is None and r["event_time"] is None for r in rest)
    assert all(r["ever_treated"] == 0 and r["post_treatment"] == 0 for r in rest)
    assert all(r["unit_fe"] == r["id"] - 1 and r["time_fe"] == r["period"] for r in wide)


def test_demo_diagnostics(demo):
    d = panel.calculate_panel_diagnostics(demo).first()
    assert (d["n_units"], d["n_periods"], d["n_observations"], d["is_balanced"], d["balance_rate"]) == (3, 4, 12, True, 1.0)
    assert d["treatment_share"] == pytest.approx(1 / 6)
    assert (d["n_treated_units"], d["n_control_units"]) == (1, 2)
    plain = panel.calculate_panel_diagnostics(demo.drop("treatment")).first()
    assert (plain["treatment_share"], plain["n_treated_units"], plain["n_control_units"]) == (0.0, 0, 3)
    with pytest.raises(ValueError, match="missing required"):
        panel.calculate_panel_diagnostics(demo.drop("period"))


def test_balancing(noisy_panel):
    grid = panel.balance_panel(noisy_panel, "zero")
    assert grid.count() == 40 * 15
    assert grid.filter("outcome is null").count() == 0
    drop = panel.balance_panel(noisy_panel, "drop")
    sizes = {r["count"] for r in drop.groupBy("id").count().collect()}
    assert sizes <= {15}
    filled = panel.balance_panel(noisy_panel, "ffill")
    assert filled.count() == 600
    seen = {(r["id"], r["period"]): r["outcome"] for r in noisy_panel.collect()}
    for r in filled.collect():
        known = [t for t in range(r["period"] + 1) if (r["id"], t) in seen]
        assert r["outcome"] == (seen[r["id"], known[-1]] if known else None)


def test_duplicates_fail_balancing(demo):
    with pytest.raises(Exception, match="duplicate unit and period"):
        panel.balance_panel(demo.union(demo.limit(1)), "ffill").collect()
    results = rules.panel_rules().validate(demo.union(demo.limit(1)))
    assert results.has_errors
    assert not rules.panel_rules().validate(demo).has_errors


def test_codes_of_missing_keys(spark):
    df = spark.createDataFrame([(None, 1), (5, 2), (3, None)], "id int, period int")
    assert {(r["id"], r["unit_fe"], r["time_fe"]) for r in panel.create_fixed_effects(df).collect()} == {
        (None, -1, 0),
        (5, 1, 1),
        (3, 0, -1),
    }


def test_given_start_column(demo):
    out = panel.create_event_time(demo.withColumn("start", F.lit(1)), treatment_period_col="start")
    assert "treatment_period" not in out.columns
    assert {r["event_time"] - r["period"] for r in out.collect()} == {-1}


def test_dummies_and_bins(demo):
    wide = panel.event_dummies(panel.add_treatment_columns(demo))
    assert len([c for c in wide.columns if c.startswith("event_k")]) == 24 and "event_km1" not in wide.columns
    assert {r["event_km2"] + r["event_k0"] + r["event_k1"] for r in wide.filter("id = 2").collect()} == {0}
    binned = panel.event_bins(panel.add_treatment_columns(demo), (-1, 0)).filter("id = 1").orderBy("period").collect()
    assert [r["event_time_binned"] for r in binned] == [-1, -1, 0, 0]
    assert binned[3]["treat_x_post"] == 1 and binned[0]["fe_unit_time"] == "1_0" and binned[0]["treatment_cohort"] == "2"


def test_changes_gaps_outliers(demo, spark):
    rows = panel.outcome_changes(demo).filter("id = 1").orderBy("period").collect()
    assert rows[0]["outcome_change"] is None and rows[1]["outcome_change"] == pytest.approx(1.5)
    assert rows[1]["outcome_pct_change"] == pytest.approx(15.0)
    gaps = panel.time_gaps(demo.filter("NOT (id = 2 AND period IN (1, 2))")).collect()
    assert [tuple(r) for r in gaps] == [(2, 0, 3, 2)]
    values = spark.createDataFrame([(float(i % 5),) for i in range(100)] + [(100.0,)], "v double")
    assert panel.flag_outliers(values, "v").filter("is_outlier").count() == 1


def test_timing(demo):
    declared = demo.withColumn("start", F.when(F.col("id") == 1, 2).when(F.col("id") == 3, 1))
    out = {r["id"]: r["is_consistent"] for r in panel.timing_check(declared, "start").collect()}
    assert out == {1: True, 2: True, 3: False}


def test_skeleton_and_entry(spark):
    units = spark.range(1, 5)
    wide = panel.panel_skeleton(units, 24, 12, F.col("id") <= 2, "2020-01-01")
    assert wide.count() == 96 and wide.agg(F.sum("treatment")).first()[0] == 24
    last = wide.filter("id = 1 AND period = 23").first()
    assert (str(last["date"]), last["year"], last["month"]) == ("2021-12-01", 2021, 12)
    exits = spark.createDataFrame([(1, 3)], "id bigint, exit_period int")
    late = spark.createDataFrame([(9, 5, 5)], "id bigint, period int, entry_period int")
    out = panel.panel_entry_exit(wide, exits, late)
    assert out.count() == 3 + 72 + 1 and out.filter("id = 9").first()["entry_period"] == 5


def test_chunked_timelines_match_plain_windows(spark):
    from pyspark.sql import Window

    from panelweave.operators.grouping import last_known, previous_row

    # Unit 0 holds a third of all rows; values have holes at chunk borders.
    rows = [(0, t, None if t % 7 < 4 else float(t)) for t in range(400)]
    rows += [(u, t, None if (u + t) % 3 else float(u + t)) for u in range(1, 41) for t in range(0, 400, 20) if (u * t) % 5]
    df = spark.createDataFrame(rows, "id int, period int, v double")
    w = Window.partitionBy("id").orderBy("period")
    plain = df.select("id", "period", F.last("v", ignorenulls=True).over(w).alias("f"), F.lag("v").over(w).alias("p"), F.lag("period").over(w).alias("t"))
    expected = {(r["id"], r["period"]): (r["f"], r["p"], r["t"]) for r in plain.collect()}
    for chunks in (4, 16, 64):
        filled = {(r["id"], r["period"]): r["v"] for r in last_known(df, "id", "period", ["v"], chunks).collect()}
        before = {(r["id"], r["period"]): (r["p"], r["t"]) for r in previous_row(df, "id", "period", {"v": "p", "period": "t"}, chunks).collect()}
        assert filled == {k: v[0] for k, v in expected.items()}
        assert before == {k: v[1:] for k, v in expected.items()}
