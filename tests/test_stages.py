import pytest
from conftest import DEMO, DEMO_SCHEMA

from panelweave import sources
from panelweave.operators import audit
from panelweave.plans import stages


@pytest.fixture(scope="module")
def work(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("run")
    raw = root / "data_raw"
    raw.mkdir()
    names = [c.split()[0] for c in DEMO_SCHEMA.split(", ")]
    lines = [",".join(names)] + [",".join(map(str, r)) for r in DEMO]
    # A repeated and an empty line, which cleaning removes.
    (raw / "sample.csv").write_text("\n".join([*lines, lines[1], ",,,,,,"]) + "\n")
    folder = str(root / "data_work")
    assert stages.ingest_data(spark, str(raw), folder).count() == 12
    spark.createDataFrame([(1, "north"), (2, "south")], "id bigint, region string").write.parquet(f"{folder}/regions.parquet")
    return folder


def test_linking(spark, work):
    linked = stages.link_records(spark, work)
    assert linked.count() == 12 and {"source_file", "link_status"} < set(linked.columns)
    linked = stages.link_records(spark, work, ["regions.parquet", "gone.parquet"])
    assert linked.filter("region IS NOT NULL").count() == 8
    row = sources.load_diagnostic(spark, f"{work}/diagnostics", "linkage_summary").first()
    assert (row["source"], row["n_matched"], row["n_unmatched"]) == ("regions.parquet", 8, 4)


def test_panel_estimation_robustness(spark, work):
    stages.link_records(spark, work)
    built = stages.build_panel(spark, work, balance=True, fill_method="drop")
    assert built.count() == 12
    added = {"unit_fe", "time_fe", "event_time", "treatment_period", "ever_treated", "post_treatment"}
    assert added < set(built.columns)
    assert sources.load_diagnostic(spark, f"{work}/diagnostics", "panel_summary").first()["n_units"] == 3
    results, skipped = stages.run_estimation(spark, work, ["baseline", "no_fe"])
    assert not skipped and {round(r["coefficient"], 3) for r in results.collect()} == {2.125, 4.0}
    assert sources.load_diagnostic(spark, f"{work}/diagnostics", "coefficients").columns == [
        "specification", "coefficient", "std_error", "p_value", "n_obs"
    ]
    assert stages.estimate_robustness(spark, work).count() == 6
    assert sources.load_diagnostic(spark, f"{work}/diagnostics", "placebo_results").count() == 2
    full = audit.PipelineAudit(spark, work.rsplit("/", 1)[0]).run_full_audit()
    assert {r["row_count"] for r in full.collect()} == {12}


def test_failures(spark, work, tmp_path):
    with pytest.raises(stages.StageError):
        stages.ingest_data(spark, str(tmp_path), str(tmp_path / "w"))
    (tmp_path / "x.csv").write_text("id,v\n,1\n2,3\n")
    with pytest.raises(stages.StageError, match="no_missing_values"):
        stages.ingest_data(spark, str(tmp_path), str(tmp_path / "w"))
