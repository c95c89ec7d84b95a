"""python -m loomgraph.cli PATH query TEXT | serve | import | info

serve reads a statement (text, or {"query": .., "params": ..}) from each line of
standard input and answers with a line of JSON; import loads CSV files of nodes and
edges. PATH is a saved graph; what a statement changes is saved as a new version."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession

from loomgraph.graph import Graph
from loomgraph.metrics import Metrics
from loomgraph.plans.ast import Create, Delete, Merge, Query, SetProps
from loomgraph.plans.parser import parse
from loomgraph.sources.loaders import load_edges, load_nodes, result_json


def writes(text: str) -> bool:
    tree = parse(text)
    return not isinstance(tree, Query) or any(isinstance(c, Create | Merge | SetProps | Delete) for c in tree.clauses)


def answer(graph: Graph, line: str, metrics: Metrics) -> str:
    """One line for one statement; a failure is an answer too."""
    try:
        request = json.loads(line) if line.lstrip().startswith("{") else {"query": line}
        with metrics.timed():
            df = graph.cypher(request["query"], request.get("params"))
            rows = [json.loads(r[0]) for r in result_json(df).collect()]
            if graph.path and writes(request["query"]):
                graph.save(graph.path)
        return json.dumps({"columns": df.columns, "rows": rows})
    except Exception as x:  # noqa: BLE001  the server goes on
        return json.dumps({"error": f"{type(x).__name__}: {str(x).splitlines()[0] if str(x) else ''}"})


def main(args: list[str]) -> int:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("path")
    p.add_argument("what", choices=["query", "serve", "import", "info"])
    p.add_argument("text", nargs="?")
    for name in ("nodes", "label", "edges", "type", "src", "dst"):
        p.add_argument(f"--{name}")
    a = p.parse_args(args)
    spark = SparkSession.builder.getOrCreate()
    graph, metrics = Graph.open(spark, a.path), Metrics()
    if a.what == "query":
        print(answer(graph, a.text, metrics))
    elif a.what == "serve":
        for line in sys.stdin:
            if line.strip():
                print(answer(graph, line, metrics), flush=True)
    elif a.what == "import":
        if a.nodes:
            load_nodes(graph, a.nodes, a.label)
        if a.edges:
            load_edges(graph, a.edges, a.type, a.src, a.dst)
        graph.save(a.path)
    else:
        metrics.measure(graph)
        print(metrics.render())
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
