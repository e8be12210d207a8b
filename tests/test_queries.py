"""Each registered query against its SQL on the smallest tables."""

import pytest

from tests.conftest import plain
from tidemark.plans.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, duck, sf, name):
    got = QUERIES[name](spark, sf).toPandas()
    want = duck.sql(ORACLES[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    assert plain(got, columns) == plain(want, columns)


def test_harness_sees_a_wrong_answer(spark, duck, sf):
    got = QUERIES["source_counts"](spark, sf).selectExpr("source", "n + 1 AS n").toPandas()
    assert plain(got, ["n", "source"]) != plain(duck.sql(ORACLES["source_counts"]).df(), ["n", "source"])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_sql_runs(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_entry_without_the_optional_folder_and_with_a_broken_one(tmp_path):
    """Without the folder the other queries are there; an import error within it isn't hidden."""
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    repo = Path(__file__).parent.parent
    shutil.copytree(repo / "tidemark", tmp_path / "tidemark", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(repo / "__spark_entry__.py", tmp_path)
    run = lambda: subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()))"], cwd=tmp_path, capture_output=True, text=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})
    assert run().stdout.strip() == str(len(QUERIES))
    (tmp_path / "tidemark" / "llm").mkdir()
    (tmp_path / "tidemark" / "llm" / "__init__.py").write_text("")
    (tmp_path / "tidemark" / "llm" / "queries.py").write_text("import no_such_module")
    (tmp_path / "corpus_pipeline.py").write_text("")
    assert "no_such_module" in run().stderr


def test_facets_partition_the_rows(spark, sf):
    from tidemark.plans import views

    n = views.sessions(spark, sf).count()
    facets = QUERIES["facet_counts"](spark, sf).where("facet = 'project'").groupBy().sum("n").first()[0]
    assert facets == n


def test_pushdown_and_pruning(spark, sf):
    plan = QUERIES["delete_by_source"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    scan = next(x for x in plan.splitlines() if "ReadSchema" in x)
    assert "o_totalprice" not in scan


def test_results_do_not_depend_on_partitions(spark, sf):
    from tidemark.operators import cost
    from tidemark.plans import views

    df = views.priced(spark, sf)
    one = sorted(map(str, cost.by_model(df.coalesce(1)).collect()))
    assert one == sorted(map(str, cost.by_model(df.repartition(7)).collect()))
