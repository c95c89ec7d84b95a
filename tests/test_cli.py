import json

from loomgraph.cli import answer
from loomgraph.graph import Graph, empty
from loomgraph.metrics import Metrics


def test_answers(spark, tmp_path):
    g, m = empty(spark), Metrics()
    g.path = str(tmp_path)
    assert json.loads(answer(g, "CREATE (a:P {n: 1})", m))["rows"] == []
    assert json.loads(answer(g, json.dumps({"query": "MATCH (a:P) WHERE a.n = $x RETURN a.n AS n", "params": {"x": 1}}), m)) == {"columns": ["n"], "rows": [{"n": 1}]}
    assert "error" in json.loads(answer(g, "MATCH (", m))
    assert Graph.open(spark, str(tmp_path)).counts() == (1, 0)
    m.measure(g)
    assert "loomgraph_queries_total 3" in m.render() and "loomgraph_query_errors_total 1" in m.render() and "loomgraph_nodes 1" in m.render()
