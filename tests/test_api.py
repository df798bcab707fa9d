import pytest
from pyspark.sql import functions as F

from weftgraph.api import Graph


@pytest.fixture
def g(spark, testdata):
    return Graph(spark, testdata, [lambda n: n.withColumn("size", F.length("name"))], cached=2)


def test_sql_reads_only(g):
    assert g.sql("select count(*) as n from edges;").first().n > 0
    assert g.sql("-- a comment\nwith x as (select 1 as a) select * from x").first().a == 1
    for bad in ("drop table edges", "insert into edges values (1)", "select 1; drop table edges", "create view v as select 1"):
        with pytest.raises(PermissionError):
            g.sql(bad)


def test_hooks_reach_cypher(g):
    rows = g.cypher("MATCH (n) WHERE n.size > 10 RETURN n.size AS size ORDER BY size LIMIT 1").collect()
    assert rows and rows[0].size == 11


def test_queries_are_kept_and_forgotten(g):
    a = g.query("hub_functions")
    assert g.query("hub_functions") is a
    g.query("hub_targets"), g.query("domain_stats")
    assert "hub_functions" not in g._cache and len(g._cache) == 2
    g.forget()
    assert not g._cache
