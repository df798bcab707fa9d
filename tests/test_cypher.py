import pytest

from weftgraph.plans.cypher import Cypher, CypherError, parse


@pytest.fixture(scope="module")
def g(spark):
    nodes = spark.createDataFrame(
        [("a1", "load", ["gate", "public"], "port", 7, 3), ("a2", "plan", ["inner"], "port", 31, 9), ("a3", "ship", ["sink"], "yard", 12, 4), ("a4", "track", ["gate"], "yard", 58, 6), ("a5", "bill", [], "yard", 90, 1)],
        "id string, name string, labels array<string>, domain string, line int, complexity int",
    )
    edges = spark.createDataFrame([("a1", "a2", "INVOKES"), ("a2", "a3", "INVOKES"), ("a1", "a2", "INVOKES"), ("a2", "a4", "INVOKES"), ("a4", "a1", "HOLDS")], "src string, dst string, relation string")
    return Cypher(spark, nodes, edges, spark.createDataFrame([("a1", "CONFIG_X AND CONFIG_Y"), ("a3", "NOT CONFIG_X")], "id string, predicate string"))


def got(g, q):
    return [tuple(r) for r in g.run(q).collect()]


@pytest.mark.parametrize(
    "q,want",
    [
        ("MATCH (n) RETURN COUNT(*) AS c, SUM(n.complexity) AS s, AVG(n.complexity) AS a, MIN(n.complexity) AS lo, MAX(n.complexity) AS hi", [(5, 23.0, 4.6, 1.0, 9.0)]),
        ("MATCH (n) RETURN n.domain AS d, SUM(n.complexity) AS s GROUP BY n.domain HAVING s > 11 ORDER BY d", [("port", 12.0)]),
        ("MATCH (n) RETURN n.line ORDER BY n.line DESC LIMIT 2", [(90,), (58,)]),
        ("match (a)-[:INVOKES]->(b) return a.name, b.name order by b.name", [("load", "plan"), ("plan", "ship"), ("plan", "track")]),
        ("MATCH (a)<-[:INVOKES]-(b) RETURN a.id, b.id ORDER BY a.id", [("a2", "a1"), ("a3", "a2"), ("a4", "a2")]),
        ("MATCH (a {name='load'})-[:INVOKES*1..3]->(b) RETURN b.id ORDER BY b.id", [("a2",), ("a3",), ("a4",)]),
        ("MATCH (a {name='load'})-[*2]->(b) RETURN b.id ORDER BY b.id", [("a3",), ("a4",)]),
        ("MATCH (a)-[*]->(b) WHERE a.id = 'a2' RETURN b.id ORDER BY b.id", [("a3",), ("a4",)]),
        ("MATCH (a)-[*2..]->(b:gate) RETURN a.id, b.id ORDER BY a.id", [("a1", "a4"), ("a2", "a1")]),
        ("MATCH (n:gate) WHERE n.line > 10 OR n.name LIKE 'l%' RETURN n.id ORDER BY n.id", [("a1",), ("a4",)]),
        ("MATCH (n) WHERE NOT n.domain = 'yard' AND n.name IN ['load', 'bill'] RETURN n.id", [("a1",)]),
        ("MATCH (n) WHERE 'sink' IN n.labels RETURN n.id", [("a3",)]),
        ("MATCH (n) WHERE n.name =~ 'pl..' RETURN n.id ORDER BY n.id", [("a2",)]),
        ("MATCH (n) WHERE CONFIG(n, 'CONFIG_X') RETURN n.id", [("a1",)]),
        ("MATCH (a)-[:INVOKES]->(b), (b)-[:INVOKES]->(c) RETURN a.id, c.id ORDER BY c.id", [("a1", "a3"), ("a1", "a4")]),
        ("MATCH (a)-[:INVOKES]->(b)-[:INVOKES]->(c) RETURN a.id, c.id ORDER BY c.id", [("a1", "a3"), ("a1", "a4")]),
        ("MATCH (n) WHERE n.missing = null RETURN COUNT(*)", [(5,)]),
        ("MATCH (n) WHERE n.missing > 3 RETURN n.id", []),
        ("MATCH (n:none) RETURN SUM(n.line)", [(0.0,)]),
        ("MATCH (n) WHERE n.name RETURN COUNT(n.id)", [(5,)]),
    ],
)
def test_query(g, q, want):
    assert got(g, q) == want


@pytest.mark.parametrize("q", ["", "MATCH", "MATCH (n RETURN n", "MATCH (n) RETURN n extra", "MATCH (a)-[*3..1]->(b) RETURN a", "MATCH (a), (b) RETURN a.id, b.id", "MATCH (n) WHERE n.x ~ 3 RETURN n", "MATCH (a)-[:R]-(b) RETURN a"])
def test_errors(g, q):
    with pytest.raises(CypherError):
        g.run(q)


def test_default_alias():
    assert [a for _, a in parse("MATCH (n) RETURN n.name, COUNT(*), SUM(n.line)").items] == ["n.name", "count(*)", "sum(n.line)"]
