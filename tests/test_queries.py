"""Queries against their own SQL, on small tables."""

import duckdb

from millrace.operators import analysis, graph
from millrace.plans import views
from millrace.plans.queries import QUERIES, SQL

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")
SF = "/root/testdata/sf0.001"


def same(spark, name, sf_dir=SF):
    """The query's columns are those of its SQL, and its rows are the same."""
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as from '{sf_dir}/{t}.parquet'")
    wanted = c.execute(SQL[name])
    columns = [d[0] for d in wanted.description]
    got = QUERIES[name](spark, sf_dir)
    assert sorted(got.columns) == sorted(columns)
    assert sorted(map(repr, map(tuple, got.select(columns).collect()))) == sorted(map(repr, wanted.fetchall()))


def test_property_report_has_the_columns_of_its_sql(spark):
    same(spark, "property_report")


def test_trade_is_summed_by_nations_only(spark):
    """No task holds a row for each order: every aggregate is by two nations."""
    plan = views.sold(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [" in plan and all(line.split("Aggregate ")[1].startswith("[s#") for line in plan.splitlines() if "Aggregate " in line)
    same(spark, "trade_view")
    same(spark, "terminal")


def test_a_chain_is_followed_without_looking_back(spark, monkeypatch):
    """Where no node can be met twice, a level is one join, and no table is read but the last level and the moves."""
    tables, keep = [], graph.keep
    monkeypatch.setattr(graph, "keep", lambda df, label: tables.append((label, df)) or keep(df, label))
    same(spark, "traverse_orders")
    plans = [df._jdf.queryExecution().optimizedPlan().toString() for label, df in tables if label == "level"]
    assert len(plans) > 4 and all(p.count("Join ") == 1 and "Window" not in p for p in plans)


def test_hops_read_the_last_two_only(spark, monkeypatch):
    tables, keep = [], analysis.keep
    monkeypatch.setattr(analysis, "keep", lambda df, label: tables.append((label, df)) or keep(df, label))
    same(spark, "isolation_orders")
    plans = [df._jdf.queryExecution().optimizedPlan().toString() for label, df in tables if label == "isolation" and "late" in df.columns]
    # Roles are a column of the steps, and used pipes are those of one hop.
    assert len(plans) > 4 and all(p.count("Join ") == 3 for p in plans[1:16])


def test_lines_tell_each_node_once(spark, monkeypatch):
    tables, keep = [], analysis.keep
    monkeypatch.setattr(analysis, "keep", lambda df, label: tables.append((label, df)) or keep(df, label))
    same(spark, "trace_line")
    nodes = next(df for label, df in tables if label == "nodes")
    assert nodes.count() == nodes.select("node").distinct().count()
    same(spark, "line_rows")


def test_chains_of_signals(spark):
    same(spark, "signal_chain")
    same(spark, "service_instrument_loop")
