"""The interactive queries of the social network benchmark, over the test tables as
a social network, each with its SQL twin. Ties in an order are broken by ids."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loomgraph.sources.social import social

_PERSON = 10
_KNOWS = "k AS (SELECT a.c_custkey AS x, b.c_custkey AS y FROM customer a JOIN customer b ON b.c_custkey IN (a.c_custkey + 1, a.c_custkey + 7, a.c_custkey + 31))"
_BOTH = f"{_KNOWS}, f AS (SELECT y AS f FROM k WHERE x = {_PERSON} UNION ALL SELECT x FROM k WHERE y = {_PERSON})"
_OUT = f"{_KNOWS}, f AS (SELECT y AS f FROM k WHERE x = {_PERSON})"
_P = f"(p:Person {{ldbc_id: {_PERSON}}})"

READS: dict[str, tuple[str, str]] = {
    "ic1_friends_named": (
        f"MATCH {_P}-[:knows*1..3]->(f:Person) WHERE f.firstName = 'BUILDING' RETURN DISTINCT f.ldbc_id AS id, f.lastName AS name ORDER BY name, id LIMIT 20",
        f"WITH {_KNOWS}, a AS (SELECT y AS f FROM k WHERE x = {_PERSON}), b AS (SELECT y AS f FROM k JOIN a ON x = f), c AS (SELECT y AS f FROM k JOIN b ON x = f), w AS (SELECT * FROM a UNION SELECT * FROM b UNION SELECT * FROM c) SELECT c_custkey AS id, c_name AS name FROM w JOIN customer ON c_custkey = f WHERE f <> {_PERSON} AND c_mktsegment = 'BUILDING' ORDER BY name, id LIMIT 20",
    ),
    "ic2_recent_messages": (
        f"MATCH {_P}-[:knows]-(f:Person)<-[:hasCreator]-(m:Post) WHERE m.creationDate <= '1997-12-31' RETURN f.ldbc_id AS f, m.ldbc_id AS m, m.content AS c, m.creationDate AS d ORDER BY d DESC, m LIMIT 20",
        f"WITH {_BOTH} SELECT f, o_orderkey AS m, o_orderpriority AS c, strftime(o_orderdate, '%Y-%m-%d') AS d FROM f JOIN orders ON o_custkey = f WHERE o_orderdate < TIMESTAMP '1998-01-01' ORDER BY d DESC, m LIMIT 20",
    ),
    "ic3_friends_in_places": (
        f"MATCH {_P}-[:knows*1..2]->(f:Person)-[:isLocatedIn]->(c:Place) WHERE c.name IN ['NATION_1', 'NATION_2', 'NATION_3', 'NATION_4', 'NATION_5', 'NATION_6', 'NATION_7', 'NATION_8'] RETURN DISTINCT f.ldbc_id AS id, f.lastName AS name, c.name AS place ORDER BY name, id LIMIT 20",
        f"WITH {_KNOWS}, a AS (SELECT y AS f FROM k WHERE x = {_PERSON}), w AS (SELECT f FROM a UNION SELECT y FROM k JOIN a ON x = f) SELECT c_custkey AS id, c_name AS name, n_name AS place FROM w JOIN customer ON c_custkey = f JOIN nation ON n_nationkey = c_nationkey WHERE n_nationkey BETWEEN 1 AND 8 ORDER BY name, id LIMIT 20",
    ),
    "ic4_new_tags": (
        f"MATCH {_P}-[:knows]->(f:Person)<-[:hasCreator]-(m:Post)-[:hasTag]->(t:Tag) WHERE m.creationDate >= '1995-01-01' AND NOT EXISTS {{ (f)<-[:hasCreator]-(o:Post)-[:hasTag]->(t) WHERE o.creationDate < '1995-01-01' }} RETURN t.name AS tag, count(*) AS n ORDER BY n DESC, tag LIMIT 10",
        f"WITH {_OUT}, m AS (SELECT DISTINCT f, o_orderkey, o_orderdate, l_partkey AS t FROM f JOIN orders ON o_custkey = f JOIN lineitem ON l_orderkey = o_orderkey) SELECT 'tag ' || t AS tag, count(*) AS n FROM m WHERE o_orderdate >= TIMESTAMP '1995-01-01' AND NOT EXISTS (SELECT 1 FROM m o WHERE o.f = m.f AND o.t = m.t AND o.o_orderdate < TIMESTAMP '1995-01-01') GROUP BY t ORDER BY n DESC, tag LIMIT 10",
    ),
    "ic5_forums": (
        f"MATCH {_P}-[:knows]->(f:Person)<-[:hasMember]-(g:Forum) RETURN g.title AS title, g.ldbc_id AS id, count(f) AS n ORDER BY n DESC, id LIMIT 20",
        f"WITH {_OUT}, g AS (SELECT DISTINCT l_suppkey, f FROM f JOIN orders ON o_custkey = f JOIN lineitem ON l_orderkey = o_orderkey) SELECT s_name AS title, s_suppkey AS id, count(*) AS n FROM g JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1, 2 ORDER BY n DESC, id LIMIT 20",
    ),
    "ic6_tag_co_occurrence": (
        "MATCH (p:Person)<-[:hasCreator]-(m:Post)-[:hasTag]->(t:Tag {name: 'tag 7'}) MATCH (m)-[:hasTag]->(o:Tag) WHERE o.name <> 'tag 7' RETURN o.name AS tag, count(m) AS n ORDER BY n DESC, tag LIMIT 10",
        "WITH t AS (SELECT DISTINCT l_orderkey AS m, l_partkey AS t FROM lineitem) SELECT 'tag ' || o.t AS tag, count(*) AS n FROM t JOIN t o ON t.m = o.m JOIN orders ON o_orderkey = t.m WHERE t.t = 7 AND o.t <> 7 GROUP BY o.t ORDER BY n DESC, tag LIMIT 10",
    ),
    "ic7_likes": (
        f"MATCH (l:Person)-[:likes]->(m:Post)-[:hasCreator]->{_P.replace('(p', '(c')} RETURN l.ldbc_id AS l, l.lastName AS name, m.ldbc_id AS m, m.creationDate AS d ORDER BY d DESC, m LIMIT 20",
        f"SELECT c_custkey AS l, c_name AS name, o_orderkey AS m, strftime(o_orderdate, '%Y-%m-%d') AS d FROM orders JOIN customer ON c_custkey = o_custkey + 5 WHERE o_custkey = {_PERSON} ORDER BY d DESC, m LIMIT 20",
    ),
    "ic8_replies": (
        "MATCH (c:Comment)-[:replyOf]->(m:Post)-[:hasCreator]->(p:Person {ldbc_id: 10}) MATCH (c)-[:hasCreator]->(a:Person) RETURN a.ldbc_id AS a, c.ldbc_id AS c, c.content AS content ORDER BY c LIMIT 20",
        f"SELECT user_id AS a, event_id AS c, event_type AS content FROM events JOIN orders ON o_orderkey = event_id JOIN customer ON c_custkey = user_id WHERE o_custkey = {_PERSON} ORDER BY c LIMIT 20",
    ),
    "ic9_recent_of_circle": (
        f"MATCH {_P}-[:knows*1..2]->(f:Person) WITH DISTINCT f MATCH (f)<-[:hasCreator]-(m:Post) WHERE m.creationDate < '1997-01-01' RETURN f.ldbc_id AS f, m.ldbc_id AS m, m.creationDate AS d ORDER BY d DESC, m LIMIT 20",
        f"WITH {_KNOWS}, a AS (SELECT y AS f FROM k WHERE x = {_PERSON}), w AS (SELECT f FROM a UNION SELECT y FROM k JOIN a ON x = f) SELECT f, o_orderkey AS m, strftime(o_orderdate, '%Y-%m-%d') AS d FROM w JOIN orders ON o_custkey = f WHERE o_orderdate < TIMESTAMP '1997-01-01' ORDER BY d DESC, m LIMIT 20",
    ),
    "ic10_recommendation": (
        f"MATCH {_P}-[:knows]->(f:Person)-[:knows]->(g:Person)-[:isLocatedIn]->(c:Place) WHERE NOT (p)-[:knows]->(g) RETURN g.ldbc_id AS id, c.name AS place, count(f) AS common ORDER BY common DESC, id LIMIT 10",
        f"WITH {_OUT} SELECT y AS id, n_name AS place, count(*) AS common FROM f JOIN k ON x = f JOIN customer ON c_custkey = y JOIN nation ON n_nationkey = c_nationkey WHERE y NOT IN (SELECT f FROM f) GROUP BY 1, 2 ORDER BY common DESC, id LIMIT 10",
    ),
    "ic11_job_referral": (
        f"MATCH {_P}-[:knows*1..2]->(f:Person) WITH DISTINCT f MATCH (f)-[:workAt]->(o:Organisation) RETURN f.ldbc_id AS id, o.name AS org ORDER BY id LIMIT 10",
        f"WITH {_KNOWS}, a AS (SELECT y AS f FROM k WHERE x = {_PERSON}), w AS (SELECT f FROM a UNION SELECT y FROM k JOIN a ON x = f) SELECT f AS id, s_name AS org FROM w JOIN supplier ON s_suppkey = f % 10 ORDER BY id LIMIT 10",
    ),
    "ic12_expert_search": (
        f"MATCH {_P}-[:knows]->(f:Person)<-[:hasCreator]-(m:Post)-[:hasTag]->(t:Tag)-[:hasType]->(k:TagClass) WHERE k.name = 'PROMO' RETURN f.ldbc_id AS id, count(DISTINCT m) AS posts, count(DISTINCT t) AS tags ORDER BY posts DESC, id LIMIT 20",
        f"WITH {_OUT} SELECT f AS id, count(DISTINCT o_orderkey) AS posts, count(DISTINCT p_partkey) AS tags FROM f JOIN orders ON o_custkey = f JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey WHERE p_type = 'PROMO' GROUP BY f ORDER BY posts DESC, id LIMIT 20",
    ),
    "ic13_shortest_path": (
        f"MATCH {_P}, (b:Person) RETURN b.ldbc_id AS id, shortestPath((p)-[:knows*..3]->(b)) AS hops",
        f"WITH {_KNOWS}, a AS (SELECT y AS f FROM k WHERE x = {_PERSON}), b AS (SELECT DISTINCT y AS f FROM k JOIN a ON x = f), c AS (SELECT DISTINCT y AS f FROM k JOIN b ON x = f), d AS (SELECT {_PERSON} AS f, 0 AS d UNION ALL SELECT f, 1 FROM a UNION ALL SELECT f, 2 FROM b UNION ALL SELECT f, 3 FROM c) SELECT c_custkey AS id, CAST(min(d) AS BIGINT) AS hops FROM customer LEFT JOIN d ON f = c_custkey GROUP BY 1",
    ),
}


def _reader(text: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: social(spark, sf_dir).cypher(text)


QUERIES = {k: _reader(t) for k, (t, _) in READS.items()}
ORACLES = {k: s for k, (_, s) in READS.items()}
