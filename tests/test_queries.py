"""Every registered cohort query against its SQL on the smallest tables."""

import pytest

from stayframe.jobs import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(name, same_rows):
    same_rows(queries.QUERIES[name], queries.ORACLE_SQL[name])


def test_every_query_has_sql():
    assert set(queries.QUERIES) == set(queries.ORACLE_SQL)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_plan_has_no_python_and_no_product(name, spark, data_dir):
    plan = queries.QUERIES[name](spark, data_dir)._jdf.queryExecution().optimizedPlan().toString()
    if name != "halves_by_user_code":  # hands rows to a function of the user's
        assert not any(x in plan for x in ("PythonUDF", "MapInPandas", "MapInArrow", "FlatMapGroups", "ArrowEvalPython", "BatchEvalPython"))
    if name != "counted_values":  # joins its one-row total
        assert "Join Cross" not in plan and "Join Inner\n" not in plan


def test_entry_has_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0


def test_value_trends_of_zeros_ties_and_undated_values(spark, tmp_path):
    """Exactly what the SQL gives: infinite ratios over zero, binary rounding of 8.2390625, undated values last."""
    import duckdb

    cases = {1: [0.0, 23.78], 2: [0.0, 0.0], 3: [6.4, 52.73, 102.9], 4: [-0.0, 5.0], 5: [0.0], 6: [0.0, float("nan")], 7: [1e-300, 1e300], 8: [2.0, None, 3.0], 9: [-6.4, 52.73], 10: [5.0, float("inf")], 11: [None]}
    values = ", ".join(
        f"({100 * u + i}, TIMESTAMP '2024-01-01 00:00:00' + INTERVAL {i} MINUTE, {u}, 'view', {'NULL' if v is None else f"'{v}'::DOUBLE"})"
        for u, vs in cases.items() for i, v in enumerate(vs)
    )
    con = duckdb.connect()
    con.execute(f"CREATE TABLE events AS SELECT * FROM (VALUES {values}, (1200, NULL, 12, 'view', 7.0), (1201, '2024-01-01', 12, 'view', 3.0)) t(event_id, ts, user_id, event_type, value)")
    con.execute(f"COPY events TO '{tmp_path}/events.parquet'")
    cur = con.execute(queries.ORACLE_SQL["value_trends"])
    names = [c[0] for c in cur.description]
    shown = lambda rows: sorted(tuple("nan" if x != x else repr(x) for x in r) for r in rows)
    found = queries.QUERIES["value_trends"](spark, str(tmp_path)).select(*names).collect()
    assert shown(found) == shown(cur.fetchall())
