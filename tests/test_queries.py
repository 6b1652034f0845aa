"""Every query that has SQL gives SQL's rows; every other one runs."""

import pytest

from ironsieve.operators import environment as env
from ironsieve.plans import catalog
from tests.oracle import difference, views

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return views(SF)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_same_as_sql(spark, con, name):
    assert difference(catalog.queries()[name](spark, SF), con, catalog.oracle_sql()[name]) == ""


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_runs(spark, name):
    rows = catalog.queries()[name](spark, SF).collect()
    # what SQL cannot state; its rules and ways have tests of their own
    some = {"scan_rulebook_rest", "rulebook_findings", "rulebook_trust_grade", "data_flow_paths"}
    assert name in some | {"threats_first_evidence"} and rows
    if name == "threats_first_evidence":
        assert len({r.id for r in rows} & {t.id for t in env.THREATS}) >= 15
    if name == "data_flow_paths":
        assert all(r.path.startswith(f"{r.source}>handleNation") and r.path.endswith(f">{r.sink}") for r in rows)
    if name == "rulebook_trust_grade":
        assert {r.grade for r in rows} <= set("ABCDF")


@pytest.mark.parametrize("also", [(), ("corpus_pipeline.py",)])
def test_entry_without_the_llm_parts(tmp_path, also):
    """A copy of the whole repository without both llm folders (and the pipeline) still imports and runs."""
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parents[1]
    shutil.copytree(root, tmp_path / "copy", ignore=shutil.ignore_patterns("llm", ".git", "__pycache__", ".pytest_cache", *also))
    code = (
        "import __spark_entry__ as e; q = e.queries(); assert len(q) > 50 and not any(k.startswith('op') and k[2].isdigit() for k in q) and 'pipeline' not in q, q;"
        " assert set(e.oracle_sql()) <= set(q)"
    )
    env = {"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path / "copy"), "PYTHONDONTWRITEBYTECODE": "1"}
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "copy", check=True, env=env)
    collected = subprocess.run([sys.executable, "-m", "pytest", "tests/", "--collect-only", "-q"], cwd=tmp_path / "copy", env=env, capture_output=True, text=True)
    assert collected.returncode == 0, collected.stdout[-2000:]


def test_all_open_orders(spark):
    rows = catalog.queries()["all_orders_by_severity"](spark, SF).collect()
    assert len(rows) == spark.read.parquet(f"{SF}/orders.parquet").where("o_orderstatus = 'O'").count()
    assert [r.rank for r in rows] == sorted(r.rank for r in rows)
