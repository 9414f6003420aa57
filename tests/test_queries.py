"""Every registered query next to its SQL, and what their plans must not hold."""

import re
import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
import __spark_entry__ as entry

SLOW = {"gbt_scores", "gbt_grid", "model_comparison", "gbt_importance", "stream_score", "training_windows"}
# Streams are run before there is a plan to look at.
STREAMS = {"stream_rates", "stream_late", "stream_alerts", "stream_counters"}


@pytest.fixture(scope="module")
def db(sf):
    c = duckdb.connect()
    for f in Path(sf).glob("*.parquet"):
        c.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return c


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    show = lambda v: f"{v + 0.0:.9g}" if isinstance(v, float) else str(v)
    return sorted(tuple(show(r[i]) for i in order) for r in data)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_matches_its_sql(spark, sf, db, name):
    df = entry.queries()[name](spark, sf)
    cursor = db.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(df.columns)
    assert rows(df.columns, df.collect()) == rows(names, cursor.fetchall())


@pytest.mark.parametrize("name", sorted(set(entry.queries()) - SLOW - STREAMS))
def test_plan_has_no_cross_join_and_no_whole_window(spark, sf, name):
    plan = entry.queries()[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    # A window's second list holds its partition keys.
    assert not re.search(r"\+- Window \[.*\], \[\], \[", plan)
    assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan


def test_entry(spark):
    assert entry.entry(spark).count() == 24
