"""Command line: list and run (uses the test session)."""

import tempfile

from shelfwise.__main__ import main
from tests.conftest import SF_SMALL


def test_list(capsys):
    assert main(["list"]) == 0
    out = capsys.readouterr().out
    assert "act_prioritized_list" in out and out.count("\n") == 54


def test_run_family_to_parquet(spark):
    out = tempfile.mkdtemp(prefix="run-cli-")
    assert main(["run", "sup", "--sf-dir", SF_SMALL, "--out", out]) == 0
    assert spark.read.parquet(f"{out}/sup_profile").count() == 10


def test_unknown_report():
    assert main(["run", "nope", "--sf-dir", SF_SMALL]) == 2


def test_param_override_changes_classes(spark, capsys):
    out = tempfile.mkdtemp(prefix="run-cli-")
    assert main(["run", "sup_lead_time_risk", "--sf-dir", SF_SMALL, "--out", out,
                 "--param", "lead_high_days=100", "--param", "lead_medium_days=100"]) == 0
    classes = {r["lead_time_risk"] for r in spark.read.parquet(f"{out}/sup_lead_time_risk").collect()}
    assert classes == {"Low Risk"}
    assert main(["run", "sup_overall", "--sf-dir", SF_SMALL, "--param", "nope=1"]) == 2


def test_summary_param_override_rebuilds_summary(spark):
    out = tempfile.mkdtemp(prefix="run-cli-")
    base = tempfile.mkdtemp(prefix="run-cli-")
    assert main(["run", "risk_overstock_exposure", "--sf-dir", SF_SMALL, "--out", base]) == 0
    assert main(["run", "risk_overstock_exposure", "--sf-dir", SF_SMALL, "--out", out,
                 "--param", "overstock_rop_multiple=3.0"]) == 0
    a = spark.read.parquet(f"{base}/risk_overstock_exposure")
    b = spark.read.parquet(f"{out}/risk_overstock_exposure")
    assert b.count() < a.count()
