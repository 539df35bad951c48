import numpy as np
import pytest
from pyspark.sql import functions as F

from panelweave.operators import panel, regression, robustness
from panelweave.plans import SPECIFICATIONS, Specification

KEYS = ("id", "period")


def fit(x, y, groups=None, robust=False):
    """Plain NumPy: coefficients, errors and R squared with an intercept."""
    design = np.column_stack([np.ones(len(y)), x])
    bread = np.linalg.inv(design.T @ design)
    beta = bread @ design.T @ y
    u = y - design @ beta
    n, k = design.shape
    if groups is not None or robust:
        groups = np.arange(n) if robust else groups
        labels = np.unique(groups)
        meat = sum(np.outer(s, s) for s in (design[groups == g].T @ u[groups == g] for g in labels))
        g = len(labels)
        cov = g / (g - 1) * (n - 1) / (n - k) * bread @ meat @ bread
    else:
        cov = u @ u / (n - k) * bread
    return beta, np.sqrt(np.diag(cov)), 1 - u @ u / ((y - y.mean()) ** 2).sum()


def demeaned(pdf, columns, effects):
    out = pdf.copy()
    out[columns] = out[columns].astype(float)
    for e in effects:
        out[columns] = out[columns] - out.groupby(e)[columns].transform("mean")
    return out


@pytest.fixture(scope="module")
def pdf(noisy_panel):
    return noisy_panel.toPandas().sort_values(["id", "period"]).reset_index(drop=True)


@pytest.fixture(scope="module")
def coded(demo):
    return panel.create_fixed_effects(panel.add_treatment_columns(demo))


def test_demo_goldens(coded):
    results, skipped = regression.run_specifications(coded)
    rows = {r["specification"]: r for r in results.collect()}
    assert not skipped
    base = rows["baseline"]
    assert (round(base["coefficient"], 6), round(base["std_error"], 6), round(base["r_squared"], 6)) == (2.125, 0.068122, 0.807443)
    assert base["t_stat"] == pytest.approx(31.193973, abs=1e-5)
    assert (base["n_obs"], base["n_units"], base["n_periods"]) == (12, 3, 4)
    plain = rows["no_fe"]
    assert (round(plain["coefficient"], 6), round(plain["std_error"], 6), round(plain["r_squared"], 6)) == (4.0, 0.652687, 0.789733)
    unit = rows["unit_fe_only"]
    assert round(unit["coefficient"], 6) == 2.85 and unit["std_error"] == 0.0
    assert unit["t_stat"] is None and unit["p_value"] is None
    assert round(unit["r_squared"], 6) == 0.721679
    assert rows["with_controls"]["coefficient"] is None


def test_demo_historical_inference(coded):
    row = regression.run_fe_estimation(coded, "no_fe", method="estimation").first()
    assert row["p_value"] == pytest.approx(0.203, abs=5e-4)
    assert row["ci_upper"] - row["coefficient"] == pytest.approx(1.96 * 1.05 * 0.652687, abs=1e-5)


def test_unknown_and_missing(coded):
    with pytest.raises(ValueError, match="Unknown specification"):
        regression.run_fe_estimation(coded, "nope")
    _, skipped = regression.run_specifications(coded.drop("covariate_3"), ["no_fe", "with_controls"])
    assert list(skipped) == ["with_controls"]
    assert set(SPECIFICATIONS) == {"baseline", "no_fe", "with_controls", "unit_fe_only"}


@pytest.mark.parametrize("mode", ["plain", "cluster", "robust"])
@pytest.mark.parametrize("xs", [["treatment"], ["treatment", "covariate_1"], ["treatment", "covariate_1", "covariate_2"]])
def test_ols_against_numpy(noisy_panel, pdf, xs, mode):
    out = regression.run_ols(
        noisy_panel.repartition(5), "outcome", xs, cluster="id" if mode == "cluster" else None, robust=mode == "robust", all_terms=True
    )
    beta, se, r2 = fit(
        pdf[xs].to_numpy(float), pdf["outcome"].to_numpy(), pdf["id"].to_numpy() if mode == "cluster" else None, mode == "robust"
    )
    rows = {r["term"]: r for r in out.collect()}
    for i, x in enumerate(xs):
        assert rows[x]["coefficient"] == pytest.approx(beta[i + 1], rel=1e-8)
        assert rows[x]["std_error"] == pytest.approx(se[i + 1], rel=1e-8)
    assert rows[xs[0]]["r_squared"] == pytest.approx(r2, rel=1e-8) and rows[xs[0]]["n_obs"] == len(pdf)


@pytest.mark.parametrize("mode", ["plain", "cluster", "robust"])
def test_wide_design_against_numpy(noisy_panel, pdf, mode):
    extra = {f"z{j}": ((F.col("id") * (j + 3) + F.col("period") * (2 * j + 5)) % (7 + j)).cast("double") for j in range(6)}
    wide = pdf.copy()
    for j in range(6):
        wide[f"z{j}"] = ((wide["id"] * (j + 3) + wide["period"] * (2 * j + 5)) % (7 + j)).astype(float)
    xs = ["treatment", *extra]
    out = regression.run_ols(
        noisy_panel.withColumns(extra).repartition(3), "outcome", xs, cluster="id" if mode == "cluster" else None, robust=mode == "robust", all_terms=True
    )
    beta, se, _ = fit(wide[xs].to_numpy(float), wide["outcome"].to_numpy(), wide["id"].to_numpy() if mode == "cluster" else None, mode == "robust")
    rows = {r["term"]: r for r in out.collect()}
    for i, x in enumerate(xs):
        assert rows[x]["coefficient"] == pytest.approx(beta[i + 1], rel=1e-7)
        assert rows[x]["std_error"] == pytest.approx(se[i + 1], rel=1e-7)


@pytest.mark.parametrize("effects", [("id",), ("id", "period")])
def test_within_estimates(noisy_panel, pdf, effects):
    spec = Specification(fe=effects, cluster="id", controls=("covariate_1",))
    row = regression.run_fe_estimation(noisy_panel, spec).first()
    inner = demeaned(pdf, ["outcome", "treatment", "covariate_1"], effects)
    beta, se, r2 = fit(inner[["treatment", "covariate_1"]].to_numpy(), inner["outcome"].to_numpy(), pdf["id"].to_numpy())
    assert row["coefficient"] == pytest.approx(beta[1], rel=1e-8) and row["std_error"] == pytest.approx(se[1], rel=1e-8)
    assert row["r_squared"] == pytest.approx(r2, rel=1e-8)


def test_unit_constant_does_not_matter(noisy_panel):
    spec = Specification(fe=KEYS, cluster="id")
    moved = noisy_panel.withColumn("outcome", F.col("outcome") + F.col("id") * 10)
    a, b = (regression.run_fe_estimation(df, spec).first()["coefficient"] for df in (noisy_panel, moved))
    assert a == pytest.approx(b, rel=1e-9)


def test_more_rounds_reach_the_two_way_estimator(noisy_panel, pdf):
    spec = Specification(fe=KEYS, cluster="id")
    row = regression.run_fe_estimation(noisy_panel, spec, iterations=12).first()
    dummies = np.column_stack(
        [pdf["treatment"]] + [(pdf["id"] == i) for i in sorted(pdf["id"].unique())[1:]] + [(pdf["period"] == t) for t in range(1, 15)]
    ).astype(float)
    beta, _, _ = fit(dummies, pdf["outcome"].to_numpy())
    assert row["coefficient"] == pytest.approx(beta[1], abs=1e-5)


def dummy_matrix(pdf, xs):
    """Regressors, a constant aside, and dummies of units and periods."""
    blocks = [pdf[xs]] + [(pdf[k].to_numpy()[:, None] == np.sort(pdf[k].unique())[1:]) for k in KEYS]
    return np.column_stack(blocks).astype(float)


def test_converged_effects_equal_dummies(noisy_panel, pdf):
    """On a panel with holes, also where a period is seen by few units."""
    rare = noisy_panel.filter("period <> 9 or id < 3").withColumn("outcome", F.col("outcome") + 1e4)
    kept = pdf[(pdf["period"] != 9) | (pdf["id"] < 3)]
    xs = ["treatment", "covariate_1"]
    spec = Specification(fe=KEYS, cluster="id", controls=("covariate_1",))
    row = regression.run_fe_estimation(rare, spec, tolerance=1e-11).first()
    beta, _, _ = fit(dummy_matrix(kept, xs), kept["outcome"].to_numpy())
    assert row["coefficient"] == pytest.approx(beta[1], rel=1e-7)


@pytest.mark.parametrize("xs", [["treatment"], ["treatment", "covariate_1", "covariate_2"]])
def test_error_types_after_demeaning(noisy_panel, pdf, xs):
    spec = Specification(fe=KEYS, cluster="id", controls=tuple(xs[1:]))
    inner = demeaned(pdf, ["outcome", *xs], KEYS)
    x, y = inner[xs].to_numpy(), inner["outcome"].to_numpy()

    def error(groups):
        return fit(x, y, groups)[1][1]

    robust = regression.run_fe_estimation(noisy_panel, spec, se="robust").first()
    n, k = len(pdf), len(xs) + 1
    rows = error(np.arange(n)) / np.sqrt(n / (n - 1) * (n - 1) / (n - k)) * np.sqrt(n / (n - k))
    assert robust["std_error"] == pytest.approx(rows, rel=1e-7) and robust["cluster"] == "robust"
    two = regression.run_fe_estimation(noisy_panel, spec, se="two_way").first()
    both = error((pdf["id"] * 100 + pdf["period"]).to_numpy()) ** 2
    assert two["std_error"] == pytest.approx(np.sqrt(max(error(pdf["id"].to_numpy()) ** 2 + error(pdf["period"].to_numpy()) ** 2 - both, 0)), rel=1e-6)
    drawn = regression.run_fe_estimation(noisy_panel, spec, se="bootstrap", replicates=400).first()
    assert drawn["std_error"] == pytest.approx(error(pdf["id"].to_numpy()), rel=0.15)
    assert (drawn["n_units"], drawn["n_periods"], drawn["n_obs"]) == (40, 15, n)
    assert robust["coefficient"] == pytest.approx(two["coefficient"]) == pytest.approx(drawn["coefficient"])
    with pytest.raises(ValueError):
        regression.run_fe_estimation(noisy_panel, spec, se="other")


def test_collinear_design_is_reported(noisy_panel):
    twice = noisy_panel.withColumn("again", F.col("covariate_1") * 2)
    for xs in (["covariate_1", "again"], ["covariate_1", "covariate_2", "again"]):
        row = regression.run_ols(twice, "outcome", xs).first()
        assert row["coefficient"] is None and row["std_error"] is None and not row["identified"]
    flat = regression.run_ols(noisy_panel.withColumn("one", F.lit(1.0)), "outcome", ["one"]).first()
    assert flat["coefficient"] is None


def test_two_way_clusters(noisy_panel, pdf):
    row = regression.two_way_ols(noisy_panel, "outcome", ["treatment", "covariate_1"], KEYS).first()
    x, y = pdf[["treatment", "covariate_1"]].to_numpy(float), pdf["outcome"].to_numpy()
    parts = [fit(x, y, pdf[k].to_numpy())[1][1] ** 2 for k in KEYS]
    both = fit(x, y, (pdf["id"] * 100 + pdf["period"]).to_numpy())[1][1] ** 2
    assert row["std_error"] == pytest.approx(np.sqrt(sum(parts) - both), rel=1e-8)


def test_leave_one_out(noisy_panel, pdf):
    for row in regression.leave_one_cluster_out(noisy_panel, "outcome", "treatment", "id").filter("id < 6").collect():
        rest = pdf[pdf["id"] != row["id"]]
        beta, se, _ = fit(rest[["treatment"]].to_numpy(float), rest["outcome"].to_numpy())
        assert row["coefficient"] == pytest.approx(beta[1], rel=1e-8) and row["std_error"] == pytest.approx(se[1], rel=1e-8)


def test_rd_and_groups(noisy_panel, pdf):
    row = regression.run_rd_estimation(noisy_panel, "period", 7, 5, "outcome").first()
    near = pdf[(pdf["period"] - 7).abs() <= 5]
    c = (near["period"] - 7).to_numpy(float)
    d = (c >= 0).astype(float)
    beta, se, _ = fit(np.column_stack([d, c, c * d]), near["outcome"].to_numpy())
    assert row["coefficient"] == pytest.approx(beta[1], rel=1e-8) and row["std_error"] == pytest.approx(se[1], rel=1e-8)
    groups = regression.grouped_ols(noisy_panel, "outcome", "covariate_1", "id").collect()
    for g in groups[:5]:
        mine = pdf[pdf["id"] == g["id"]]
        assert g["coefficient"] == pytest.approx(fit(mine[["covariate_1"]].to_numpy(), mine["outcome"].to_numpy())[0][1], rel=1e-8)


def test_event_study_and_pretrend(noisy_panel, pdf):
    data = panel.add_treatment_columns(noisy_panel)
    rows = {r["event_time"]: r for r in regression.event_study_regression(data, (-4, 4), fe=KEYS).collect()}
    periods = [k for k in range(-4, 5) if k != -1]
    start = pdf[pdf["treatment"] == 1].groupby("id")["period"].min()
    wide = pdf.assign(event=pdf["period"] - pdf["id"].map(start))
    names = []
    for k in periods:
        wide[f"d{k}"] = (wide["event"] == k).astype(float)
        names.append(f"d{k}")
    inner = demeaned(wide, ["outcome", *names], KEYS)
    beta, se, _ = fit(inner[names].to_numpy(), inner["outcome"].to_numpy(), pdf["id"].to_numpy())
    for i, k in enumerate(periods):
        assert rows[k]["coefficient"] == pytest.approx(beta[i + 1], rel=1e-6)
        assert rows[k]["std_error"] == pytest.approx(se[i + 1], rel=1e-6)
    f = regression.pretrend_f_test(data, 3, KEYS).first()
    leads = [f"l{k}" for k in (-3, -2, -1)]
    for k, name in zip((-3, -2, -1), leads):
        wide[name] = (wide["event"] == k).astype(float)
    inner = demeaned(wide, ["outcome", *leads], KEYS)
    _, _, r2 = fit(inner[leads].to_numpy(), inner["outcome"].to_numpy())
    assert f["f_stat"] == pytest.approx((r2 / 3) / ((1 - r2) / (len(pdf) - 4)), rel=1e-6)


def test_bootstrap_is_close_and_repeatable(noisy_panel):
    a = regression.bootstrap_se(noisy_panel, "outcome", ["treatment"], "id", 300).first()
    b = regression.bootstrap_se(noisy_panel.repartition(7), "outcome", ["treatment"], "id", 300).first()
    clustered = regression.run_ols(noisy_panel, "outcome", ["treatment"], cluster="id").first()
    assert a["std_error"] == pytest.approx(b["std_error"], rel=1e-9)
    assert a["std_error"] == pytest.approx(clustered["std_error"], rel=0.25)


def test_demo_battery(coded):
    rows = {r["test_name"]: r for r in robustness.run_battery(coded, pre_period_end=11, method="power").collect()}
    for name, coefficient, error, p, n in (
        ("main", 4.0, 0.652687, 0.000411, 12),
        ("with_control", 2.388189, 0.796225, 0.044235, 12),
        ("placebo_t1", 3.511111, 0.517639, 0.000181, 12),
        ("placebo_t2", 4.0, 0.652687, 0.000411, 12),
        ("trim_outliers", 3.277778, 0.836291, 0.013751, 10),
    ):
        got = rows[name]
        assert (got["coefficient"], got["std_error"], got["p_value"]) == pytest.approx((coefficient, error, p), abs=2e-6)
        assert got["n_obs"] == n and got["significant"] == (p < 0.05)
    assert "trim_endpoints" not in rows
    assert rows["subsample_80"]["n_obs"] == 10
    assert robustness.placebo_results(robustness.run_placebo_time(coded)).count() == 2


def test_restrictions_agree_with_direct_filters(noisy_panel):
    data = panel.add_treatment_columns(noisy_panel)
    tagged = {r["test_name"]: r for r in robustness.run_sample_restrictions(data, extra={"late": F.col("period") > 5}).collect()}
    direct = {
        "trim_endpoints": robustness.trim_endpoints(data),
        "trim_outliers": robustness.trim_outliers(data, "outcome"),
        "subsample_80": robustness.subsample(data),
        "late": data.filter("period > 5"),
    }
    for name, sample in direct.items():
        row = robustness.run_simple_ols(sample, "outcome", "treatment").first()
        assert tagged[name]["n_obs"] == row["n_obs"]
        assert tagged[name]["coefficient"] == pytest.approx(row["coefficient"], rel=1e-9)
    assert robustness.run_simple_ols(data.limit(5), "outcome", "treatment").first()["reason"] == "fewer than 10 rows"


def test_balance_table(noisy_panel, pdf):
    data = panel.add_treatment_columns(noisy_panel)
    row = regression.balance_table(data, ["covariate_1"]).first()
    even = pdf[pdf["id"] % 2 == 0]["covariate_1"]
    odd = pdf[pdf["id"] % 2 == 1]["covariate_1"]
    assert row["difference"] == pytest.approx(even.mean() - odd.mean())
    assert row["std_difference"] == pytest.approx((even.mean() - odd.mean()) / np.sqrt((even.var() + odd.var()) / 2))


@pytest.mark.parametrize("mode", ["plain", "cluster"])
def test_values_far_from_zero_keep_their_digits(noisy_panel, pdf, mode):
    shifted = noisy_panel.withColumn("x", F.col("covariate_1") + 1e9).withColumn("y", F.col("outcome") + 1e9)
    row = regression.run_ols(shifted, "y", ["x"], cluster="id" if mode == "cluster" else None).first()
    beta, se, _ = fit(pdf[["covariate_1"]].to_numpy(), pdf["outcome"].to_numpy(), pdf["id"].to_numpy() if mode == "cluster" else None)
    assert row["coefficient"] == pytest.approx(beta[1], rel=1e-4) and row["std_error"] == pytest.approx(se[1], rel=1e-4)


def test_wide_design_far_from_zero(spark):
    """Any number of regressors, far from zero, by either route."""
    rng = np.random.default_rng(5)
    n, k = 400, 8
    x = rng.normal(size=(n, k)) + 1e8
    y = x[:, 0] * 0.9 - x[:, 3] * 0.4 + rng.normal(size=n)
    centred = x - x.mean(axis=0)
    expected = np.linalg.lstsq(centred, y - y.mean(), rcond=None)[0]
    rows = [(i % 5, float(y[i]), *map(float, x[i])) for i in range(n)]
    names = [f"x{i}" for i in range(k)]
    df = spark.createDataFrame(rows, ["g", "y", *names])
    for matrix in (False, True):
        fit = regression.run_ols(df, "y", names, cluster="g", all_terms=True, matrix=matrix).collect()
        found = {r["term"]: r["coefficient"] for r in fit}
        assert [found[c] for c in names] == pytest.approx(list(expected), abs=1e-5)
    grouped = regression.run_ols(df, "y", names, keys=["g"], all_terms=True).filter("g = 2 and term = 'x3'").first()
    own = np.arange(n) % 5 == 2
    part = np.linalg.lstsq(x[own] - x[own].mean(axis=0), y[own] - y[own].mean(), rcond=None)[0]
    assert grouped["coefficient"] == pytest.approx(part[3], abs=1e-5)


def test_small_groups_keep_their_row(spark):
    rows = [("few", 1.0, float(i)) for i in range(3)] + [("flat", float(i), 1.0) for i in range(12)]
    rows += [("fine", 2.0 * i + i % 2, float(i)) for i in range(12)]
    found = {r["g"]: r for r in regression.grouped_ols(spark.createDataFrame(rows, "g string, y double, x double"), "y", "x", "g").collect()}
    assert found["few"]["reason"] == "fewer than 10 rows" and found["few"]["coefficient"] is None and found["few"]["n_obs"] == 3
    assert found["flat"]["reason"] == "not identified" and found["fine"]["reason"] is None


def test_nan_is_missing(spark):
    from panelweave.operators import audit, grouping, rules, tables

    rows = [(float(i), 1.0 * (i % 7)) for i in range(50)] + [(float("nan"), 1.0), (None, 2.0)]
    df = spark.createDataFrame(rows, "y double, x double")
    assert audit.missing_counts(df).collect()[0]["n_missing"] == 2
    assert not rules.DataValidator().add_rule(rules.no_missing_values(["y"])).validate(df).passed
    assert grouping.exact_quantiles(df, "y", {"m": 0.5}).first()["m"] == pytest.approx(24.5)
    assert sum(r["count"] for r in tables.histogram(df, "y", 5).collect()) == 50
