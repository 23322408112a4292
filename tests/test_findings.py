"""What queries look up, and tables whose keys repeat, against DuckDB."""

from __future__ import annotations

import duckdb
import pytest
from test_catalog import SF, rows

from narralake import catalog
from narralake.operators import consistency, joins, network, templates, validation
from narralake.plans.adapter import DRIVER, Story


@pytest.fixture(scope="module")
def repeated(tmp_path_factory):
    """The smallest tables, with some orders of two dates, parts of two names and lines that are there twice."""
    at = tmp_path_factory.mktemp("repeated")
    con = duckdb.connect()
    more = {
        "orders": f"UNION ALL SELECT * REPLACE (o_orderdate - INTERVAL 300 DAY AS o_orderdate) FROM '{SF}/orders.parquet' WHERE o_orderkey % 3 = 0",
        "part": f"UNION ALL SELECT * REPLACE ('cold hot ' || p_name AS p_name) FROM '{SF}/part.parquet' WHERE p_partkey % 5 = 0",
        "lineitem": f"UNION ALL SELECT * FROM '{SF}/lineitem.parquet' WHERE l_orderkey % 7 = 0",
    }
    for t in DRIVER:
        con.execute(f"COPY (SELECT * FROM '{SF}/{t}.parquet' {more.get(t, '')}) TO '{at}/{t}.parquet' (FORMAT parquet)")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{at}/{t}.parquet'")
    return str(at), con


@pytest.fixture(scope="module")
def twice(tmp_path_factory):
    """Keys are unique here; some lines are there twice, some names hold others, and some orders have no customer."""
    at = tmp_path_factory.mktemp("twice")
    con = duckdb.connect()
    tables = {
        "part": f"SELECT * REPLACE (CASE p_partkey % 4 WHEN 0 THEN concat(p_name, ' cold hot') ELSE p_name END AS p_name) FROM '{SF}/part.parquet'",
        "customer": f"SELECT * FROM '{SF}/customer.parquet' WHERE c_custkey % 6 <> 0",
        "lineitem": f"SELECT * REPLACE (l_suppkey % 3 AS l_suppkey) FROM '{SF}/lineitem.parquet' WHERE l_orderkey < 700 UNION ALL SELECT * REPLACE (l_suppkey % 3 AS l_suppkey) FROM '{SF}/lineitem.parquet' WHERE l_orderkey < 700 AND l_orderkey % 7 = 0",
    }
    for t in DRIVER:
        con.execute(f"COPY ({tables.get(t, f"SELECT * FROM '{SF}/{t}.parquet'")}) TO '{at}/{t}.parquet' (FORMAT parquet)")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{at}/{t}.parquet'")
    return str(at), con


@pytest.fixture
def unlinked(monkeypatch):
    """A graph whose links can't be looked up."""
    plain = Story.__getitem__

    def get(self, name):
        assert name != "contradicts"
        return plain(self, name)

    monkeypatch.setattr(Story, "__getitem__", get)


def agrees(spark, repeated, name):
    at, con = repeated
    found, want = catalog.QUERIES[name](spark, at), con.execute(catalog.ORACLE_SQL[name])
    names = [d[0] for d in want.description]
    assert rows(found.columns, found.collect()) == rows(names, want.fetchall())


@pytest.mark.parametrize("name", ["temporal_conflict_counts", "character_consistency_report", "timeline_report"])
def test_conflicts_need_no_links(spark, unlinked, name):
    assert catalog.QUERIES[name](spark, SF).count() > 0


@pytest.mark.parametrize("name", ["temporal_conflict_counts", "character_consistency_report", "timeline_report"])
def test_conflicts_where_orders_repeat(spark, repeated, name):
    agrees(spark, repeated, name)


def test_edges_are_planned_by_kind(spark):
    """Each of the eight kinds is planned apart, and only with the rules that can meet it."""
    plan = validation.validate_edges(validation.edges_of(Story(spark, SF)))._jdf.queryExecution().optimizedPlan().toString()
    kinds = [line for line in plan.splitlines() if "Project" in line and "is_valid" in line]
    assert len(kinds) == 8
    assert sum("Self-loop detected" in line for line in kinds) == 1
    assert sum("Switch is_on" in line for line in kinds) == 1


RULES = ["temporal_contradictions", "state_contradictions", "relationship_contradictions", "location_contradictions", "unlinked_contradictions", "contradiction_details", "contradiction_report", "severity_breakdown"]


@pytest.mark.parametrize("name", RULES)
def test_contradictions_need_no_links_of_all(spark, unlinked, name):
    catalog.QUERIES[name](spark, SF).collect()


@pytest.mark.parametrize("name", [*RULES, "plot_holes"])
def test_contradictions_where_keys_repeat(spark, repeated, name):
    agrees(spark, repeated, name)


@pytest.mark.parametrize("name", RULES)
def test_contradictions_where_lines_and_names_repeat(spark, twice, name):
    """Lines that are there twice, contents that hold another one or both words of a rule, scenes without a place."""
    agrees(spark, twice, name)


@pytest.mark.parametrize("name", ["plot_thread_resolution_status", "story_graph_counts", "schema_property"])
def test_links_are_told_from_rows(spark, twice, unlinked, name):
    """Links are read off the rows, also where lines and names repeat."""
    agrees(spark, twice, name)


@pytest.mark.parametrize("name", ["plot_thread_resolution_status", "story_graph_counts", "schema_property", "constraint_violations"])
def test_counts_where_keys_repeat(spark, repeated, name):
    agrees(spark, repeated, name)


def test_links_of_a_forbidden_kind_are_counted(spark, monkeypatch):
    monkeypatch.setitem(validation.SCHEMA["CONTRADICTS"], "severity", {"values": ("critical", "major", "minor")})
    g = Story(spark, SF)
    found = {r.error: r.n for r in validation.schema_property(g).filter("kind = 'CONTRADICTS'").collect()}
    assert list(found.values()) == [g["contradicts"].filter("severity = 'potential'").count()]


def test_lines_are_not_hashed_by_their_key(spark):
    """Keys that hardly ever repeat are sorted after the shuffle; no task hashes all of its lines before it."""
    plan = validation.constraint_violations(Story(spark, SF))._jdf.queryExecution().executedPlan().toString()
    assert not [x for x in plan.splitlines() if "HashAggregate(keys=[l_orderkey" in x and "l_linenumber" in x.split("]")[0]]


@pytest.fixture(scope="module")
def chain(tmp_path_factory):
    """Twelve characters of one story; each met only the next one, once."""
    at = tmp_path_factory.mktemp("chain")
    con = duckdb.connect()
    tables = {
        "supplier": f"SELECT * REPLACE (i AS s_suppkey, 1 AS s_nationkey) FROM (SELECT * FROM '{SF}/supplier.parquet' LIMIT 1), range(12) t(i)",
        "lineitem": f"SELECT * REPLACE (i AS l_orderkey, i + j AS l_suppkey) FROM (SELECT * FROM '{SF}/lineitem.parquet' LIMIT 1), range(11) t(i), range(2) u(j)",
    }
    for t in DRIVER:
        con.execute(f"COPY ({tables.get(t, f"SELECT * FROM '{SF}/{t}.parquet'")}) TO '{at}/{t}.parquet' (FORMAT parquet)")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{at}/{t}.parquet'")
    return str(at), con


@pytest.mark.parametrize("steps", [50_000_000, 1])
def test_betweenness_counts_paths_of_any_length(spark, chain, monkeypatch, steps):
    """Paths of up to eleven steps, by story and by joins."""
    monkeypatch.setattr(network, "GROUP_STEPS", steps)
    agrees(spark, chain, "betweenness")
    assert {r.character_id: r.betweenness for r in catalog.QUERIES["betweenness"](spark, chain[0]).collect()} == {i: 2.0 * i * (11 - i) for i in range(12)}


OF_EACH = ["temporal_knowledge_conflicts_of_all", "unlinked_pairs"]


@pytest.mark.parametrize("name", OF_EACH)
def test_partners_of_each_need_no_links(spark, twice, unlinked, name):
    """Links aren't looked up, also where lines and names repeat."""
    agrees(spark, twice, name)


@pytest.fixture(scope="module")
def gaps(tmp_path_factory):
    """Keys are unique here; some are missing or negative, some days, line numbers, flags, names and stories are null, and some lines
    are there twice."""
    at = tmp_path_factory.mktemp("gaps")
    con = duckdb.connect()
    null = lambda column, when: f"CASE WHEN {when} THEN NULL ELSE {column} END AS {column}"
    tables = {
        "part": f"SELECT * REPLACE (CASE WHEN p_partkey % 11 = 3 THEN NULL WHEN p_partkey % 4 = 0 THEN concat(p_name, ' cold hot') ELSE p_name END AS p_name, p_partkey * 3 - 100 AS p_partkey) FROM '{SF}/part.parquet' WHERE p_partkey % 7 <> 1",
        "orders": f"SELECT * REPLACE ({null('o_orderdate', 'o_orderkey % 9 = 2')}) FROM '{SF}/orders.parquet' WHERE o_orderkey % 13 <> 0",
        "supplier": f"SELECT * REPLACE (CASE WHEN s_suppkey <> 4 THEN s_nationkey % 2 END AS s_nationkey) FROM '{SF}/supplier.parquet' WHERE s_suppkey <> 5",
        "lineitem": f"SELECT * REPLACE (l_partkey * 3 - 100 AS l_partkey, {null('l_shipdate', 'l_orderkey % 17 = 0')}, {null('l_linenumber', 'l_orderkey % 19 = 0')}, {null('l_returnflag', 'l_orderkey % 23 = 0')}) FROM (FROM '{SF}/lineitem.parquet' UNION ALL SELECT * FROM '{SF}/lineitem.parquet' WHERE l_orderkey % 10 < 3)",
    }
    for t in DRIVER:
        con.execute(f"COPY ({tables.get(t, f"SELECT * FROM '{SF}/{t}.parquet'")}) TO '{at}/{t}.parquet' (FORMAT parquet)")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{at}/{t}.parquet'")
    return str(at), con


@pytest.mark.parametrize("name", OF_EACH)
def test_partners_of_each_with_nulls(spark, gaps, name):
    agrees(spark, gaps, name)


@pytest.mark.parametrize("name", OF_EACH)
def test_partners_of_each_where_keys_repeat(spark, repeated, name):
    agrees(spark, repeated, name)


def test_rows_among_keys(spark, monkeypatch):
    """Runs of keys, with gaps, negative and missing ones, and keys of too many runs, against a join."""
    rows = spark.createDataFrame([(k,) for k in [None, *range(-70, 70)] * 2], "x long")
    keys = spark.createDataFrame([(k,) for k in [None, *range(-66, -8), -3, 0, 1, *range(5, 41), 63, 64, 64]], "k long")
    want = sorted(r.x for r in rows.join(keys.distinct(), rows["x"] == keys["k"], "left_semi").collect())
    for block, most in ((1 << 16, 16), (16, 16), (16, 0)):
        monkeypatch.setattr(joins, "BLOCK", block)
        monkeypatch.setattr(joins, "BLOCK_RUNS", most)
        assert sorted(r.x for r in joins.among(rows, "x", keys, "k").collect()) == want != []


def test_partners_of_characters_of_many_lines(spark, twice, monkeypatch):
    monkeypatch.setattr(templates, "CHARACTER_LINES", 1)
    monkeypatch.setattr(templates, "_conflicts_of_lines", None)
    agrees(spark, twice, "temporal_knowledge_conflicts_of_all")
