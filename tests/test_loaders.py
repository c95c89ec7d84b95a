import json

from loomgraph.graph import empty
from loomgraph.sources.loaders import classify, dot_lines, load_apoc, load_ldbc, result_json


def test_classify():
    assert classify("person_0_0.csv") == ("node", "person")
    assert classify("a/person_knows_person_0_0.csv") == ("edge", "person", "knows", "person")
    assert classify("readme.txt") is None


def test_ldbc(spark, tmp_path):
    (tmp_path / "person_0_0.csv").write_text("id|firstName\n1|Ann\n2|Bob\n")
    (tmp_path / "person_knows_person_0_0.csv").write_text("Person.id|Person.id|creationDate\n1|2|2020\n")
    g = empty(spark)
    assert load_ldbc(g, [str(p) for p in sorted(tmp_path.iterdir())]) == {"nodes": 1, "edges": 1, "skipped": 0}
    assert g.cypher("MATCH (a:Person)-[:KNOWS]->(b:Person) RETURN a.firstName AS a, b.ldbc_id AS b").first() == ("Ann", 2)


def test_apoc(spark, tmp_path):
    (tmp_path / "n.csv").write_text("_id,_labels,name\n7,:Person:Admin,Ann\n8,:Person,Bob\n9,:City,Oslo\n")
    (tmp_path / "r.csv").write_text("_start,_end,_type,since\n7,9,LIVES,2001\n8,7,KNOWS,\n")
    g = empty(spark)
    load_apoc(g, str(tmp_path / "n.csv"), str(tmp_path / "r.csv"))
    assert g.cypher("MATCH (a:Admin)-[l:LIVES]->(c:City) RETURN a.name AS a, l.since AS s, c.name AS c").first() == ("Ann", 2001, "Oslo")
    assert g.labels() == ["City", "Person"] and g.relationship_types() == ["KNOWS", "LIVES"]
    lines = [r[0] for r in dot_lines(g).collect()]
    assert lines[0] == "digraph graph_ {" and lines[-1] == "}" and len(lines) == 7


def test_result_json(spark):
    found = [json.loads(r[0]) for r in result_json(spark.createDataFrame([(1, "x"), (2**60, None)], "n long, s string")).collect()]
    assert found == [{"n": 1, "s": "x"}, {"n": str(2**60)}]


def test_json_keeps_types_and_nulls(spark, tmp_path):
    from loomgraph.sources.loaders import export_json, import_json

    g = empty(spark)
    g.cypher("CREATE (a:P {name: 'x', v: 1.5, n: 7})-[:K {w: 2}]->(b:P {name: '8'}), (c:Q {tags: ['a', 'b']})")
    export_json(g, str(tmp_path / "d"))
    text = "MATCH (a:P) RETURN a.name AS name, a.v AS v, a.n AS n ORDER BY name"
    again = import_json(spark, str(tmp_path / "d"))
    assert again.cypher(text).collect() == g.cypher(text).collect() and again.cypher(text).dtypes == g.cypher(text).dtypes
    assert again.cypher("MATCH (c:Q) RETURN c.tags AS t").first()[0] == ["a", "b"]
    assert again.cypher("MATCH (a)-[k:K]->(b) RETURN k.w AS w").first()[0] == 2
    (tmp_path / "d" / "schemas.json").unlink()
    bare = import_json(spark, str(tmp_path / "d"))
    assert bare.cypher("MATCH (a:P {name: 'x'}) RETURN a.v AS v, a.n AS n").first() == (1.5, 7)
