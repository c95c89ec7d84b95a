"""Small graphs with known answers: patterns, paths, nulls, writes."""

import pytest
from pyspark.sql import functions as F

from loomgraph.graph import Conflict, Graph, empty
from loomgraph.plans.expressions import Unknown


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def graph(spark):
    """A diamond a-b-d, a-c-d, then d-e, a cycle e-a, and a loop at b."""
    nodes = spark.createDataFrame([(k, n, v) for k, (n, v) in enumerate([("a", 1), ("b", 2), ("c", None), ("d", 4), ("e", 5)])], "_id long, name string, v long")
    edges = spark.createDataFrame([(0, 1, 5), (0, 2, 6), (1, 3, 7), (2, 3, 8), (3, 4, 9), (4, 0, 1), (1, 1, 2)], "_src long, _dst long, w long")
    return Graph(spark, {"P": nodes}, {("P", "R", "P"): edges}, {"P": 0})


def test_diamond_ends_twice(graph):
    assert rows(graph.cypher("MATCH (a:P {name: 'a'})-[:R*2..2]->(x) RETURN x.name AS n")) == [("d",), ("d",)]


def test_cycle_never_returns_to_the_start(graph):
    found = rows(graph.cypher("MATCH (a:P {name: 'a'})-[:R*1..4]->(x) RETURN x.name AS n"))
    assert found == [("b",), ("c",), ("d",), ("d",), ("e",), ("e",)]


def test_loop_is_no_path(graph):
    assert rows(graph.cypher("MATCH (a:P {name: 'b'})-[:R*1..1]->(x) RETURN x.name AS n")) == [("d",)]
    assert rows(graph.cypher("MATCH (a:P {name: 'b'})-[:R]->(x) RETURN x.name AS n")) == [("b",), ("d",)]


def test_zero_hops_and_distinct(graph):
    assert rows(graph.cypher("MATCH (a:P {name: 'a'})-[:R*0..1]->(x) RETURN DISTINCT x.name AS n")) == [("a",), ("b",), ("c",)]
    assert rows(graph.cypher("MATCH (a:P {name: 'a'})-[:R*]->(x) RETURN DISTINCT x.name AS n")) == [("b",), ("c",), ("d",), ("e",)]
    assert rows(graph.cypher("MATCH (a:P {name: 'a'})<-[:R*1..2]-(x) RETURN DISTINCT x.name AS n")) == [("d",), ("e",)]


def test_undirected_counts_a_loop_once(graph):
    assert rows(graph.cypher("MATCH (a:P {name: 'b'})-[:R]-(x) RETURN x.name AS n")) == [("a",), ("b",), ("d",)]


def test_shortest(graph):
    text = "MATCH (a:P {name: 'a'}), (x:P) RETURN x.name AS n, shortestPath((a)-[:R*]->(x)) AS d"
    assert rows(graph.cypher(text)) == [("a", 0), ("b", 1), ("c", 1), ("d", 2), ("e", 3)]
    assert rows(graph.cypher("MATCH (a:P {name: 'c'}), (x:P {name: 'b'}) RETURN shortestPath((a)-[:R*..2]->(x)) AS d")) == [(None,)]


def test_nulls_in_where(graph):
    assert rows(graph.cypher("MATCH (n:P) WHERE n.v <> 1 RETURN n.name AS n")) == [("b",), ("c",), ("d",), ("e",)]
    assert rows(graph.cypher("MATCH (n:P) WHERE NOT n.v > 2 RETURN n.name AS n")) == [("a",), ("b",), ("c",)]
    assert rows(graph.cypher("MATCH (n:P) WHERE n.v IS NULL AND n.missing = n.v RETURN n.name AS n")) == [("c",)]
    assert rows(graph.cypher("MATCH (n:P) WHERE n.v IN [1, null] RETURN n.name AS n")) == [("a",), ("c",)]


def test_null_order(graph):
    assert [r[0] for r in graph.cypher("MATCH (n:P) RETURN n.name AS n ORDER BY n.v, n").collect()] == ["c", "a", "b", "d", "e"]
    assert [r[0] for r in graph.cypher("MATCH (n:P) RETURN n.name AS n ORDER BY n.v DESC LIMIT 2").collect()] == ["e", "d"]


def test_mixed_types_do_not_fail(graph):
    assert rows(graph.cypher("MATCH (n:P) WHERE n.name = 1 OR n.v > 'x' RETURN n.name AS n")) == []
    assert rows(graph.cypher("RETURN 'a' + 1 AS x, 1 / 0 AS y, 'a' < 1 AS z")) == [(None, None, None)]


def test_parameters(graph):
    assert rows(graph.cypher("MATCH (n:P) WHERE n.name IN $names AND n.v >= $low RETURN n.name AS n", {"names": ["a", "b"], "low": 2})) == [("b",)]
    assert rows(graph.cypher("UNWIND $none AS x RETURN x")) == []


def test_optional_and_chains(graph):
    text = "MATCH (n:P) OPTIONAL MATCH (n)-[r:R]->(m:P) WHERE r.w > 7 RETURN n.name AS n, m.name AS m"
    assert rows(graph.cypher(text)) == sorted([("a", None), ("b", None), ("c", "d"), ("d", "e"), ("e", None)], key=repr)
    text = "MATCH (n:P) OPTIONAL MATCH (n)-[r:R]->(m:P) WHERE m.v > n.v + 1 RETURN n.name AS n, count(m) AS c"
    assert rows(graph.cypher(text)) == [("a", 0), ("b", 1), ("c", 0), ("d", 0), ("e", 0)]


def test_correlated_call_keeps_zero(graph):
    text = "MATCH (n:P) CALL { WITH n MATCH (n)-[:R]->(m) WHERE m.v > 3 RETURN count(m) AS c } RETURN n.name AS n, c"
    assert rows(graph.cypher(text)) == [("a", 0), ("b", 1), ("c", 1), ("d", 1), ("e", 0)]


def test_aggregate_expressions(graph):
    assert rows(graph.cypher("MATCH (n:P) RETURN count(n) + sum(n.v) * 10 AS x, avg(n.v) AS y, size(collect(n.v)) AS z")) == [(125, 3.0, 4)]
    assert rows(graph.cypher("MATCH (n:P)-[r:R]->() WITH n, max(r.w) AS top WHERE top > 6 RETURN n.name AS n, top")) == [("b", 7), ("c", 8), ("d", 9)]


def test_parallel_edges(spark):
    g = Graph(spark, {"P": spark.range(2).withColumnRenamed("id", "_id")}, {("P", "R", "P"): spark.createDataFrame([(0, 1, 2), (0, 1, 1)], "_src long, _dst long, w long")}, {"P": 0})
    assert g.cypher("MATCH (a)-[:R]->(b) RETURN count(*) AS n").first()[0] == 2
    assert rows(g.distinct().cypher("MATCH (a)-[r:R]->(b) RETURN r.w AS w")) == [(1,)]


def test_unknown_names(graph):
    assert rows(graph.cypher("MATCH (x:Q)-[:S]->(y) RETURN count(*) AS n")) == [(0,)]
    with pytest.raises(Unknown):
        graph.cypher("RETURN nope(1) AS x")
    with pytest.raises(Unknown):
        graph.cypher("MATCH (n:P) RETURN m.name AS x")


def test_writes(spark):
    g = empty(spark)
    g.cypher("CREATE (a:P {name: 'x'})-[:K {w: 1}]->(b:P:Extra {name: 'y'})")
    assert rows(g.cypher("MATCH (a:P)-[r:K]->(b:Extra) RETURN a.name AS a, r.w AS w, labels(b) AS l")) == [("x", 1, ["P", "Extra"])]
    g.cypher("MERGE (a:P {name: 'x'}) ON MATCH SET a.n = 1 ON CREATE SET a.n = 2")
    g.cypher("MERGE (a:P {name: 'z'}) ON MATCH SET a.n = 1 ON CREATE SET a.n = 2")
    assert rows(g.cypher("MATCH (a:P) RETURN a.name AS a, a.n AS n")) == [("x", 1), ("y", None), ("z", 2)]
    before = g.snapshot()
    with pytest.raises(Conflict):
        g.cypher("MATCH (a:P {name: 'x'}) DELETE a")
    g.cypher("MATCH (a:P {name: 'x'}) DETACH DELETE a")
    assert g.cypher("MATCH (a:P) RETURN count(*) AS n").first()[0] == 2 and g.counts() == (2, 0)
    assert before.cypher("MATCH (a:P) RETURN count(*) AS n").first()[0] == 3
    g.cypher("CREATE CONSTRAINT ON (p:P) ASSERT p.name IS UNIQUE")
    with pytest.raises(Conflict):
        g.cypher("CREATE (a:P {name: 'y'})")
    assert g.cypher("MATCH (a:P) RETURN count(*) AS n").first()[0] == 2
    with pytest.raises(ValueError, match="reserved"):
        g.cypher("CREATE (a:__SO_x {name: 'y'})")


def test_save_and_open(spark, tmp_path):
    g = empty(spark)
    g.cypher("CREATE (a:P {name: 'x'})-[:K]->(b:P {name: 'y'})")
    g.save(str(tmp_path))
    again = Graph.open(spark, str(tmp_path))
    assert rows(again.cypher("MATCH (a)-[:K]->(b) RETURN a.name AS a, b.name AS b")) == [("x", "y")]
    again.cypher("MATCH (a:P {name: 'x'}) SET a.v = 3")
    again.cypher("CHECKPOINT")
    assert rows(Graph.open(spark, str(tmp_path)).cypher("MATCH (a:P) RETURN a.v AS v")) == [(3,), (None,)]
    assert Graph.open(spark, str(tmp_path / "new")).labels() == []


def test_two_writers_of_one_path(spark, tmp_path):
    g = empty(spark)
    g.cypher("CREATE (a:P {name: 'x'})")
    assert g.save(str(tmp_path)) == 1
    one, two = Graph.open(spark, str(tmp_path)), Graph.open(spark, str(tmp_path))
    one.cypher("MATCH (a:P) SET a.v = 1")
    two.cypher("MATCH (a:P) SET a.v = 2")
    assert one.save(str(tmp_path)) == 2
    with pytest.raises(Conflict):
        two.save(str(tmp_path))
    with pytest.raises(Conflict):
        two.cypher("CHECKPOINT")
    assert rows(Graph.open(spark, str(tmp_path)).cypher("MATCH (a:P) RETURN a.v AS v")) == [(1,)]
    assert len([p for p in tmp_path.iterdir() if p.name.startswith("data-")]) == 2


def test_reading_at_a_version(spark, tmp_path):
    from loomgraph.sources.storage import vacuum, versions

    path, g = str(tmp_path), empty(spark)
    g.cypher("CREATE (a:P {name: 'x'})")
    for k in range(3):
        g.cypher("MATCH (a:P) SET a.v = $k", {"k": k})
        g.save(path)
    assert [rows(Graph.open(spark, path, n).cypher("MATCH (a:P) RETURN a.v AS v")) for n in (1, 2, 3)] == [[(0,)], [(1,)], [(2,)]]
    with pytest.raises(ValueError, match="version 9"):
        Graph.open(spark, path, 9)
    assert vacuum(spark, path) == [1, 2] and versions(spark, path) == [3]
    assert rows(Graph.open(spark, path).cypher("MATCH (a:P) RETURN a.v AS v")) == [(2,)]
    (tmp_path / "commits" / f"{4:012d}").write_text("half a fi")
    with pytest.raises(ValueError):
        Graph.open(spark, path)


def test_publishing_takes_no_taken_number(spark, tmp_path):
    from loomgraph.sources.storage import _publish

    (tmp_path / "a").write_text("first")
    (tmp_path / "b").write_text("second")
    assert _publish(spark, str(tmp_path / "a"), str(tmp_path / "n")) and not _publish(spark, str(tmp_path / "b"), str(tmp_path / "n"))
    assert (tmp_path / "n").read_text() == "first"


def test_batch_is_one(spark):
    g = empty(spark)
    g.cypher("CREATE (a:P {name: 'x'})")
    with pytest.raises(Unknown):
        g.batch(["CREATE (a:P {name: 'y'})", "CREATE FULLTEXT INDEX i FOR (p:P) ON EACH [p.name]", "CREATE CONSTRAINT ON (p:P) ASSERT p.name IS UNIQUE", "RETURN nope(1) AS x"])
    assert not g.fulltext and not g.unique and g.cypher("MATCH (a:P) RETURN count(*) AS n").first()[0] == 1
    out = g.batch(["CREATE (a:P {name: $n})", "MATCH (a:P) RETURN count(*) AS n"], {"n": "z"})
    assert out[1].first()[0] == 2 and g.cypher("MATCH (a:P) RETURN count(*) AS n").first()[0] == 2


def test_one_writer_at_a_time(spark):
    import threading

    g, turned = empty(spark), []

    def other():
        try:
            g.cypher("CREATE (a:P {name: 'y'})")
        except Conflict:
            turned.append(True)

    lock = g.write()
    t = threading.Thread(target=other)
    t.start()
    t.join()
    lock.release()
    assert turned == [True]
    g.cypher("CREATE (a:P {name: 'y'})")
    assert g.counts() == (1, 0)


def test_upsert(spark):
    g = empty(spark)
    first = g.merge_node_by_property("P", "name", "x", {"v": 1})
    assert g.merge_node_by_property("P", "name", "x", {"v": 2}) == first
    other = g.merge_node_by_property("P", "name", "it's", None)
    assert other != first and g.set_property(other, "v", 7) and not g.set_property(12345, "v", 7)
    assert rows(g.cypher("MATCH (a:P) RETURN a.name AS n, a.v AS v")) == [("it's", 7), ("x", 2)]
    with pytest.raises(ValueError, match="not names"):
        g.merge_node_by_property("P", "name: 1}) //", "x")


def test_keys_that_have_no_room(spark):
    from pyspark.errors import PySparkException

    from loomgraph.graph import node_id

    keys = spark.createDataFrame([(5,), (None,)], "k long")
    assert [r[0] for r in keys.select(node_id(2, F.col("k"), True)).collect()] == [(2 << 48) + 5, None]
    for k in (-1, 1 << 48):
        with pytest.raises(PySparkException, match="out of range"):
            spark.createDataFrame([(k,)], "k long").select(node_id(2, F.col("k"), True)).collect()


def test_patterns_in_optional_matches(graph):
    text = "MATCH (n:P) OPTIONAL MATCH (n)-[:R]->(m:P) WHERE (m)-[:R]->(:P {name: 'e'}) OR m.name = 'a' RETURN n.name AS n, m.name AS m"
    assert rows(graph.cypher(text)) == sorted([("a", None), ("b", "d"), ("c", "d"), ("d", None), ("e", "a")], key=repr)
    text = "MATCH (n:P) OPTIONAL MATCH (n)-[:R]->(m:P) WHERE NOT EXISTS { (m)-[:R]->(x:P) WHERE x.v > n.v } RETURN n.name AS n, count(m) AS c"
    assert rows(graph.cypher(text)) == [("a", 0), ("b", 0), ("c", 1), ("d", 1), ("e", 1)]


def test_call_with_a_relationship(spark):
    g = Graph(spark, {"P": spark.range(2).withColumnRenamed("id", "_id")}, {("P", "R", "P"): spark.createDataFrame([(0, 1, 2), (0, 1, 1)], "_src long, _dst long, w long")}, {"P": 0})
    assert rows(g.cypher("MATCH (a)-[r:R]->(b) CALL { WITH r RETURN r.w * 10 AS x } RETURN r.w AS w, x")) == [(1, 10), (2, 20)]


def test_timeout(spark):
    g = empty(spark)
    assert [r[0] for r in g.execute_with_timeout("RETURN 1 AS x", 60)] == [1]
    with pytest.raises(TimeoutError):
        g.execute_with_timeout("UNWIND range(1, 3000) AS x UNWIND range(1, 3000) AS y UNWIND range(1, 3000) AS z RETURN sum(x * y % 7 + z) AS s", 2)


def test_vector_index_recall(spark):
    """Against the exact search, with a fifth of the cells; and later changes."""
    import numpy as np

    rng = np.random.default_rng(3)
    middle = rng.normal(size=(30, 16)) * 2
    x = middle[rng.integers(0, 30, 3000)] + rng.normal(size=(3000, 16))
    nodes = spark.createDataFrame([(k, v) for k, v in enumerate(x.tolist())] + [(3000, None), (3001, [1.0])], "_id long, v array<double>")
    g = Graph(spark, {"P": nodes}, {}, {"P": 0})
    g.create_vector_index("P", "v", 16, "euclidean")
    index, found = g.build_vector_index("P", "v", 50), 0
    for k in range(0, 3000, 300):
        query = (x[k] + 0.1).tolist()
        exact = {r[0] for r in g.vector_search("P", "v", query, 10).collect()}
        found += len(exact & {r[0] for r in g.vector_search("P", "v", query, 10, probes=10).collect()})
    assert found >= 90
    with pytest.raises(ValueError, match="dimensions"):
        g.vector_search("P", "v", [1.0])
    g.cypher("CREATE (p:P {v: $v})", {"v": x[7].tolist()})
    new = g.cypher("MATCH (p:P) RETURN max(id(p)) AS n").first()[0]
    index.insert(g.nodes["P"].where(F.col("_id") == new).select("_id", F.col("v").alias("vector")))
    assert [r[0] for r in g.vector_search("P", "v", x[7].tolist(), 2, probes=2).collect()] == [7, new]
    g.cypher("MATCH (p:P) WHERE id(p) = 7 DETACH DELETE p")
    assert g.vector_search("P", "v", x[7].tolist(), 1, probes=2).first()[0] == new


def stars(spark, hubs=2, leaves=3000):
    """Leaves of two labels that all point at few hubs: as many pairs as leaves squared."""
    hub = spark.createDataFrame([(k, f"h{k}") for k in range(hubs)], "_id long, name string")
    leaf = {x: spark.range(leaves).select((F.col("id") + (n << 48)).alias("_id"), (F.col("id") % 5).alias("v"), (F.col("id") / 2).alias("f"), F.col("id").alias("k")) for x, n in (("A", 1), ("B", 2))}
    edges = {(x, "IN", "H"): t.select("_id", F.when(F.col("k") % 10 < 9, F.col("k") % hubs).alias("d"), (F.col("k") % 3).alias("w")).toDF("_src", "_dst", "w") for x, t in leaf.items()}
    return Graph(spark, {"H": hub, **leaf}, edges, {"H": 0, "A": 1, "B": 2})


def test_pairs_of_comma_patterns_are_counted_not_made(spark):
    """The join makes as many rows as there are nodes, not pairs."""
    g = stars(spark)
    for text in ("MATCH (a:A)-[:IN]->(h:H), (b:B)-[:IN]->(h) RETURN h.name AS n, count(*) AS c", "MATCH (a:A)-[:IN]->(h:H)<-[:IN]-(b:B) RETURN h.name AS n, count(*) AS c"):
        plan = g.cypher(text)
        made = plan._jdf.queryExecution().optimizedPlan().toString()
        # Both sides of the join are grouped below it.
        assert made.count("Aggregate [") == 3 and rows(plan) == [("h0", 1500**2), ("h1", 1200**2)]


def test_folded_pairs_have_the_same_aggregates(spark):
    """Against the pairs one by one, which collect() makes."""
    g, match = stars(spark, 2, 40), "MATCH (a:A)-[r:IN]->(h:H), (b:B)-[:IN]->(h) "
    for where, by in (("", "h.name AS x, "), ("", ""), ("WHERE a.v < b.v ", "b.v AS x, "), ("WHERE (a)-[:IN]->(h) AND r.w > 0 ", "h.name AS x, ")):
        for what in (("count(*)", "count(b)", "count(r)", "count(a.nope)"), ("sum(a.v)", "avg(a.v)", "sum(a.f)", "avg(a.f)"), ("sum(a.v * b.v)", "count(DISTINCT a.v)", "min(b.v)", "sum(DISTINCT b.v)"), ("max(a.k)", "count(DISTINCT a)")):
            text = f"{match}{where}RETURN {by}{', '.join(f'{w} AS y{k}' for k, w in enumerate(what))}"
            assert rows(g.cypher(text)) == rows(g.cypher(f"{text}, size(collect(a.k)) AS z").drop("z")), text
    # Inline properties that look at an earlier path, crossed patterns, nothing found.
    assert rows(g.cypher("MATCH (a:A)-[:IN]->(h:H), (b:B {k: a.k})-[:IN]->(h) RETURN count(*) AS n")) == [(36,)]
    assert rows(g.cypher("MATCH (a:A), (b:B) RETURN count(*) AS n")) == [(1600,)]
    assert rows(g.cypher("MATCH (a:A), (b:B {v: 9}) RETURN a.v AS v, count(*) AS n")) == []
    assert rows(g.cypher("MATCH (a:A), (b:B {v: 9}) RETURN count(*) AS n, sum(a.v) AS s")) == [(0, 0)]
    # Three legs, and rows bound before.
    assert rows(g.cypher("MATCH (a:A)-[:IN]->(h:H), (b:B)-[:IN]->(h), (c:A)-[:IN]->(h) RETURN h.name AS n, count(c) AS c")) == [("h0", 20**3), ("h1", 16**3)]
    assert rows(g.cypher("MATCH (h:H) WITH h MATCH (a:A)-[:IN]->(h), (b:B)-[:IN]->(h) WITH h.name AS n, count(b) AS c WHERE c > 300 RETURN n, c")) == [("h0", 400)]
    assert rows(g.cypher("MATCH (h:H) CALL { WITH h MATCH (a:A)-[:IN]->(h), (b:B)-[:IN]->(h) RETURN count(*) AS c } RETURN h.name AS n, c")) == [("h0", 400), ("h1", 256)]


def test_saving_writes_what_has_changed(spark, tmp_path):
    """A version shares the tables that are the same with the one before."""
    import json

    from loomgraph.sources.storage import vacuum

    path, g = str(tmp_path), empty(spark)
    g.cypher("CREATE (a:P {name: 'x'})-[:K]->(b:Q {name: 'y'})")
    g.save(path)
    for k in range(2):  # from the graph that was saved, and from one that was opened
        g.cypher("MATCH (a:P) SET a.v = $k", {"k": k})
        g.save(path)
        g = Graph.open(spark, path)
    at = [json.loads((tmp_path / "commits" / f"{v:012d}").read_text())["at"] for v in (1, 2, 3)]
    assert len({x["nodes/P"] for x in at}) == 3 and len({x["nodes/Q"] for x in at}) == 1 == len({x["edges/P.K.Q"] for x in at})
    assert sorted(str(p.relative_to(tmp_path)) for p in tmp_path.glob("data-*/*/*")) == sorted({f"{f}/{p}" for x in at for p, f in x.items()})
    text = "MATCH (a:P)-[:K]->(b:Q) RETURN a.v AS v, b.name AS n"
    assert [rows(Graph.open(spark, path, v).cypher(text)) for v in (1, 2, 3)] == [[(None, "y")], [(0, "y")], [(1, "y")]]
    # Older versions go, what the last one shares with them stays.
    assert vacuum(spark, path, 2) == [1] and vacuum(spark, path) == [2]
    assert sorted(str(p.relative_to(tmp_path)) for p in tmp_path.glob("data-*/*/*")) == sorted(f"{f}/{p}" for p, f in at[2].items())
    assert rows(Graph.open(spark, path).cypher(text)) == [(1, "y")]
    # A checkpoint of nothing new writes nothing; another path gets all; what was deleted goes.
    g.cypher("CHECKPOINT")
    g.cypher("CHECKPOINT")
    assert len(list(tmp_path.glob("data-*/*/*"))) == 3 and g.version == 5
    g.save(f"{path}/copy")
    assert len(list(tmp_path.glob("copy/data-*/*/*"))) == 3 and rows(Graph.open(spark, f"{path}/copy").cypher(text)) == [(1, "y")]
    g = Graph.open(spark, path)
    g.cypher("MATCH (b:Q) DETACH DELETE b")
    g.save(path)
    vacuum(spark, path)
    assert rows(Graph.open(spark, path).cypher("MATCH (n) RETURN n.name AS n")) == [("x",)] and len(list(tmp_path.glob("data-*/*/*"))) == 3


def test_versions_with_one_folder_are_read(spark, tmp_path):
    """As they were written before tables could be shared."""
    import json

    from loomgraph.sources.storage import vacuum

    path, g = str(tmp_path), empty(spark)
    g.cypher("CREATE (a:P {name: 'x'})-[:K]->(b:Q {name: 'y'})")
    g.save(path)
    commit = tmp_path / "commits" / f"{1:012d}"
    m = json.loads(commit.read_text())
    del m["at"]
    (tmp_path / "commits" / f".{1:012d}.crc").unlink(missing_ok=True)
    commit.write_text(json.dumps(m))
    again = Graph.open(spark, path)
    again.cypher("MATCH (a:P) SET a.v = 1")
    assert again.save(path) == 2 and vacuum(spark, path) == [1]
    assert rows(Graph.open(spark, path).cypher("MATCH (a:P)-[:K]->(b:Q) RETURN a.v AS v, b.name AS n")) == [(1, "y")]
