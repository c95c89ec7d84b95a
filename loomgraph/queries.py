"""Queries of the engine over the test tables, each with its SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loomgraph import interactive
from loomgraph.sources.shop import shop

#: name: (statement, SQL)
READS: dict[str, tuple[str, str]] = {
    # Scans and access paths
    "label_scan": ("MATCH (n:Nation) RETURN n.nationkey AS k, n.name AS name", "SELECT n_nationkey AS k, n_name AS name FROM nation"),
    "scan_filter": ("MATCH (c:Customer) WHERE c.acctbal > 5000 AND c.mktsegment STARTS WITH 'B' RETURN c.name AS name", "SELECT c_name AS name FROM customer WHERE c_acctbal > 5000 AND c_mktsegment LIKE 'B%'"),
    "all_label_scan": ("MATCH (n) WHERE n.name IS NOT NULL RETURN n.name AS name", "SELECT r_name AS name FROM region UNION ALL SELECT n_name FROM nation UNION ALL SELECT c_name FROM customer UNION ALL SELECT s_name FROM supplier UNION ALL SELECT p_name FROM part"),
    "multi_label_none": ("MATCH (n:Nation:Region) RETURN count(n) AS n", "SELECT CAST(0 AS BIGINT) AS n"),
    "index_equality": ("MATCH (p:Part {partkey: 7}) RETURN p.name AS name, p.brand AS brand", "SELECT p_name AS name, p_brand AS brand FROM part WHERE p_partkey = 7"),
    "index_range": ("MATCH (p:Part) WHERE p.size >= 10 AND p.size < 12 RETURN p.partkey AS k", "SELECT p_partkey AS k FROM part WHERE p_size >= 10 AND p_size < 12"),
    "text_contains": ("MATCH (p:Part) WHERE p.type CONTAINS 'DI' AND p.name ENDS WITH 'ring' RETURN p.partkey AS k", "SELECT p_partkey AS k FROM part WHERE contains(p_type, 'DI') AND p_name LIKE '%ring'"),
    "label_count": ("MATCH (o:Order) RETURN count(o) AS n", "SELECT count(*) AS n FROM orders"),
    "unknown_label": ("MATCH (x:Nowhere) RETURN count(*) AS n", "SELECT CAST(0 AS BIGINT) AS n"),
    "standalone_return": ("RETURN 7 / 2 AS a, -7 / 2 AS b, -7 % 3 AS c, 7 / 0 AS d, 'x' + 'y' AS e, 2 * 3 - 1 AS f", "SELECT CAST(3 AS BIGINT) AS a, CAST(-3 AS BIGINT) AS b, CAST(-1 AS BIGINT) AS c, CAST(NULL AS BIGINT) AS d, 'xy' AS e, CAST(5 AS BIGINT) AS f"),
    "unwind": ("UNWIND [3, 1, 2] AS x RETURN x", "SELECT CAST(unnest([3, 1, 2]) AS BIGINT) AS x"),
    "unwind_range": ("UNWIND range(1, 20, 3) AS x WITH x WHERE x % 2 = 0 RETURN x * x AS y", "SELECT x * x AS y FROM range(1, 21, 3) t(x) WHERE x % 2 = 0"),
    "unwind_match": ("UNWIND [1, 5, 9] AS k MATCH (c:Customer {custkey: k}) RETURN k, c.name AS name", "SELECT c_custkey AS k, c_name AS name FROM customer WHERE c_custkey IN (1, 5, 9)"),
    # Predicates and expressions
    "null_semantics": (
        "UNWIND [1, 2, 3] AS x WITH x, CASE WHEN x = 2 THEN null ELSE x END AS y WHERE NOT y > 2 RETURN x, y IS NULL AS n",
        "SELECT CAST(x AS BIGINT) AS x, x = 2 AS n FROM (VALUES (1), (2)) t(x)",
    ),
    "not_equal_null": ("UNWIND [1, 2, 3] AS x WITH x, CASE WHEN x = 2 THEN null ELSE x END AS y WHERE y <> 1 RETURN x", "SELECT CAST(x AS BIGINT) AS x FROM (VALUES (2), (3)) t(x)"),
    "in_list": ("MATCH (c:Customer) WHERE c.mktsegment IN ['BUILDING', 'MACHINERY'] AND NOT c.nationkey IN [1, 2] RETURN c.custkey AS k", "SELECT c_custkey AS k FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_nationkey NOT IN (1, 2)"),
    "case_when": (
        "MATCH (c:Customer) RETURN c.custkey AS k, CASE WHEN c.acctbal < 0 THEN 'debt' WHEN c.acctbal < 1000 THEN 'low' ELSE 'ok' END AS s, CASE c.mktsegment WHEN 'BUILDING' THEN 1 ELSE 0 END AS b",
        "SELECT c_custkey AS k, CASE WHEN c_acctbal < 0 THEN 'debt' WHEN c_acctbal < 1000 THEN 'low' ELSE 'ok' END AS s, CAST(c_mktsegment = 'BUILDING' AS BIGINT) AS b FROM customer",
    ),
    "list_predicates": (
        "UNWIND [1, 2, 3, 4] AS n WITH n, range(1, n) AS l RETURN n, ANY(x IN l WHERE x = 3) AS a, ALL(x IN l WHERE x < 3) AS b, NONE(x IN l WHERE x > 3) AS c, SINGLE(x IN l WHERE x % 2 = 0) AS d, size([x IN l WHERE x > 1 | x * 2]) AS e",
        "SELECT CAST(n AS BIGINT) AS n, n >= 3 AS a, n < 3 AS b, n <= 3 AS c, n IN (2, 3) AS d, CAST(n - 1 AS BIGINT) AS e FROM (VALUES (1), (2), (3), (4)) t(n)",
    ),
    # Traversals
    "one_hop_agg": (
        "MATCH (c:Customer)-[:PLACED]->(o:Order) WHERE o.totalprice > 1000 RETURN c.name AS name, count(o) AS n ORDER BY n DESC, name LIMIT 10",
        "SELECT c_name AS name, count(*) AS n FROM customer JOIN orders ON c_custkey = o_custkey WHERE o_totalprice > 1000 GROUP BY c_custkey, c_name ORDER BY n DESC, name LIMIT 10",
    ),
    "incoming": ("MATCH (o:Order)<-[:PLACED]-(c:Customer {custkey: 11}) RETURN o.orderkey AS k", "SELECT o_orderkey AS k FROM orders WHERE o_custkey = 11"),
    "undirected": (
        "MATCH (a:Part {partkey: 3})-[:NEXT_PART]-(b:Part) RETURN b.partkey AS k",
        "WITH e AS (SELECT DISTINCT a.l_partkey x, b.l_partkey y FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1) SELECT y AS k FROM e WHERE x = 3 UNION ALL SELECT x FROM e WHERE y = 3 AND x != y",
    ),
    "two_hop": ("MATCH (n:Nation)<-[:IN_NATION]-(c:Customer)-[:PLACED]->(o:Order) WHERE n.nationkey = 4 RETURN c.custkey AS c, o.orderkey AS o", "SELECT c_custkey AS c, o_orderkey AS o FROM customer JOIN orders ON o_custkey = c_custkey WHERE c_nationkey = 4"),
    "three_hop": (
        "MATCH (r:Region)<-[:IN_REGION]-(n:Nation)<-[:IN_NATION]-(c:Customer)-[:PLACED]->(o:Order) RETURN r.name AS region, count(o) AS n, round(sum(o.totalprice) * 100) / 100 AS s",
        "SELECT r_name AS region, count(*) AS n, floor(sum(o_totalprice) * 100 + 0.5) / 100 AS s FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey GROUP BY r_name",
    ),
    "four_hop_parts": (
        "MATCH (n:Nation)<-[:IN_NATION]-(c:Customer)-[:PLACED]->(o:Order)-[:CONTAINS]->(p:Part) WHERE p.brand = 'Brand#11' RETURN n.name AS name, count(DISTINCT c.custkey) AS buyers, count(*) AS lines",
        "SELECT n_name AS name, count(DISTINCT c_custkey) AS buyers, count(*) AS lines FROM nation JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey WHERE p_brand = 'Brand#11' GROUP BY n_name",
    ),
    "any_label_ends": ("MATCH (a)-[r:IN_NATION]->(b:Nation {nationkey: 3}) RETURN type(r) AS t, labels(a) AS l, count(*) AS n", "SELECT 'IN_NATION' AS t, ['Customer'] AS l, count(*) AS n FROM customer WHERE c_nationkey = 3 HAVING count(*) > 0 UNION ALL SELECT 'IN_NATION', ['Supplier'], count(*) FROM supplier WHERE s_nationkey = 3 HAVING count(*) > 0"),
    "type_alternation": ("MATCH (c:Customer {custkey: 5})-[:PLACED|IN_NATION]->(x) RETURN count(*) AS n", "SELECT (SELECT count(*) FROM orders WHERE o_custkey = 5) + 1 AS n"),
    "edge_props": ("MATCH (o:Order)-[l:CONTAINS]->(p:Part) WHERE l.quantity > 49 AND l.returnflag = 'R' RETURN o.orderkey AS o, p.partkey AS p, l.linenumber AS l", "SELECT l_orderkey AS o, l_partkey AS p, l_linenumber AS l FROM lineitem WHERE l_quantity > 49 AND l_returnflag = 'R'"),
    "mutual": (
        "MATCH (a:Part)-[:NEXT_PART]->(m:Part)<-[:NEXT_PART]-(b:Part) WHERE a.partkey IN [14, 4, 7529] AND b.partkey IN [134, 121, 14685] RETURN DISTINCT a.partkey AS a, b.partkey AS b, m.partkey AS k",
        "WITH e AS (SELECT DISTINCT a.l_partkey x, b.l_partkey y FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1) SELECT DISTINCT a.x AS a, b.x AS b, a.y AS k FROM e a JOIN e b ON a.y = b.y WHERE a.x IN (14, 4, 7529) AND b.x IN (134, 121, 14685)",
    ),
    "cartesian": ("MATCH (n:Nation), (r:Region) WHERE n.regionkey < r.regionkey RETURN count(*) AS n", "SELECT count(*) AS n FROM nation, region WHERE n_regionkey < r_regionkey"),
    "comma_patterns": (
        "MATCH (c:Customer)-[:IN_NATION]->(n:Nation), (s:Supplier)-[:IN_NATION]->(n) RETURN n.name AS name, count(*) AS pairs",
        "SELECT n_name AS name, count(*) AS pairs FROM nation JOIN customer ON c_nationkey = n_nationkey JOIN supplier ON s_nationkey = n_nationkey GROUP BY n_name",
    ),
    # Optional and correlated
    "optional_match": (
        "MATCH (c:Customer) OPTIONAL MATCH (c)-[:PLACED]->(o:Order) WHERE o.totalprice > 400000 RETURN c.custkey AS k, count(o) AS n",
        "SELECT c_custkey AS k, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > 400000 GROUP BY c_custkey",
    ),
    "optional_leading": ("OPTIONAL MATCH (c:Customer {custkey: -5}) RETURN c.name AS name", "SELECT CAST(NULL AS VARCHAR) AS name"),
    "exists_semi": ("MATCH (c:Customer) WHERE EXISTS { (c)-[:PLACED]->(o:Order) WHERE o.totalprice > 400000 } RETURN c.custkey AS k", "SELECT c_custkey AS k FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)"),
    "not_exists": ("MATCH (c:Customer) WHERE NOT EXISTS { (c)-[:PLACED]->(:Order {orderpriority: '1-URGENT'}) } RETURN c.custkey AS k", "SELECT c_custkey AS k FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')"),
    "not_pattern": ("MATCH (c:Customer) WHERE NOT (c)-[:PLACED]->(:Order {orderstatus: 'P'}) RETURN c.custkey AS k", "SELECT c_custkey AS k FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')"),
    "exists_in_or": ("MATCH (c:Customer) WHERE c.acctbal > 9000 OR (c)-[:PLACED]->(:Order {orderpriority: '5-LOW'}) RETURN count(*) AS n", "SELECT count(*) AS n FROM customer WHERE c_acctbal > 9000 OR EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '5-LOW')"),
    "with_having": ("MATCH (c:Customer)-[:PLACED]->(o:Order) WITH c, count(o) AS n WHERE n > 15 RETURN c.name AS name, n", "SELECT c_name AS name, count(*) AS n FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey, c_name HAVING count(*) > 15"),
    "with_pipeline": (
        "MATCH (c:Customer) WITH c ORDER BY c.acctbal DESC, c.custkey LIMIT 5 MATCH (c)-[:PLACED]->(o:Order) RETURN c.custkey AS k, count(o) AS n",
        "SELECT k, count(*) AS n FROM (SELECT c_custkey AS k FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 5) JOIN orders ON o_custkey = k GROUP BY k",
    ),
    "call_unit": ("MATCH (r:Region) CALL { MATCH (o:Order) RETURN count(o) AS n } RETURN r.name AS name, n", "SELECT r_name AS name, (SELECT count(*) FROM orders) AS n FROM region"),
    "call_correlated": (
        "MATCH (c:Customer) CALL { WITH c MATCH (c)-[:PLACED]->(o:Order) WHERE o.totalprice > 300000 RETURN count(o) AS n } RETURN c.custkey AS k, n",
        "SELECT c_custkey AS k, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000) AS n FROM customer",
    ),
    "call_top": (
        "MATCH (n:Nation) CALL { WITH n MATCH (n)<-[:IN_NATION]-(c:Customer) RETURN c.custkey AS k ORDER BY c.acctbal DESC, k LIMIT 2 } RETURN n.name AS name, k",
        "SELECT n_name AS name, c_custkey AS k FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS i FROM customer) JOIN nation ON n_nationkey = c_nationkey WHERE i <= 2",
    ),
    # Aggregation, order, sets
    "aggregates": (
        "MATCH (c:Customer) RETURN c.mktsegment AS s, count(*) AS n, count(DISTINCT c.nationkey) AS d, min(c.acctbal) AS lo, max(c.acctbal) AS hi, avg(c.nationkey) AS m, round(sum(c.acctbal) * 100) / 100 AS t",
        "SELECT c_mktsegment AS s, count(*) AS n, count(DISTINCT c_nationkey) AS d, min(c_acctbal) AS lo, max(c_acctbal) AS hi, avg(c_nationkey) AS m, floor(sum(c_acctbal) * 100 + 0.5) / 100 AS t FROM customer GROUP BY c_mktsegment",
    ),
    "aggregate_empty": ("MATCH (c:Customer) WHERE c.custkey < -1 RETURN count(c) AS n, sum(c.nationkey) AS s, avg(c.acctbal) AS a, size(collect(c.name)) AS l", "SELECT CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS s, CAST(NULL AS DOUBLE) AS a, CAST(0 AS BIGINT) AS l"),
    "collect_preds": (
        "MATCH (c:Customer)-[:PLACED]->(o:Order) RETURN c.custkey AS k, ANY(x IN collect(o.orderstatus) WHERE x = 'F') AS f, ALL(x IN collect(o.totalprice) WHERE x > 50000) AS g",
        "SELECT o_custkey AS k, bool_or(o_orderstatus = 'F') AS f, bool_and(o_totalprice > 50000) AS g FROM orders GROUP BY o_custkey",
    ),
    "collect_sorted": ("MATCH (n:Nation) RETURN n.regionkey AS r, sort(collect(n.name)) AS l", "SELECT n_regionkey AS r, list_sort(list(n_name)) AS l FROM nation GROUP BY n_regionkey"),
    "distinct": ("MATCH (c:Customer)-[:PLACED]->(o:Order) RETURN DISTINCT c.mktsegment AS s, o.orderstatus AS o", "SELECT DISTINCT c_mktsegment AS s, o_orderstatus AS o FROM customer JOIN orders ON o_custkey = c_custkey"),
    "order_skip_limit": ("MATCH (p:Part) RETURN p.partkey AS k, p.retailprice AS r ORDER BY r DESC, k SKIP 5 LIMIT 10", "SELECT p_partkey AS k, p_retailprice AS r FROM part ORDER BY r DESC, k LIMIT 10 OFFSET 5"),
    "union": ("MATCH (n:Nation) RETURN n.regionkey AS x UNION MATCH (r:Region) RETURN r.regionkey AS x", "SELECT n_regionkey AS x FROM nation UNION SELECT r_regionkey FROM region"),
    "union_all": ("MATCH (n:Nation) RETURN n.regionkey AS x UNION ALL MATCH (r:Region) RETURN r.regionkey AS x", "SELECT n_regionkey AS x FROM nation UNION ALL SELECT r_regionkey FROM region"),
    "degree_topk": (
        "MATCH (p:Part) RETURN p.partkey AS k, out_degree(p) AS degree ORDER BY out_degree(p) DESC, k LIMIT 10",
        "WITH e AS (SELECT DISTINCT a.l_partkey x, b.l_partkey y FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1) SELECT p_partkey AS k, count(x) AS degree FROM part LEFT JOIN e ON x = p_partkey GROUP BY p_partkey ORDER BY degree DESC, k LIMIT 10",
    ),
    "degree_count": (
        "MATCH (c:Customer)-[:PLACED]->(o:Order) RETURN c.custkey AS k, count(o) AS n ORDER BY n DESC, k LIMIT 10",
        "SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY o_custkey ORDER BY n DESC, k LIMIT 10",
    ),
    # Functions
    "string_functions": (
        "MATCH (p:Part) RETURN p.partkey AS k, toUpper(p.type) AS a, toLower(p.brand) AS b, substring(p.name, 2, 3) AS c, size(p.name) AS d, replace(p.brand, '#', '-') AS e, reverse(p.brand) AS f, trim('  x ') AS g, left(p.type, 2) AS h, size(split(p.name, ' ')) AS i, startsWith(p.type, 'S') AS j",
        "SELECT p_partkey AS k, upper(p_type) AS a, lower(p_brand) AS b, substring(p_name, 3, 3) AS c, length(p_name) AS d, replace(p_brand, '#', '-') AS e, reverse(p_brand) AS f, 'x' AS g, left(p_type, 2) AS h, CAST(len(string_split(p_name, ' ')) AS BIGINT) AS i, starts_with(p_type, 'S') AS j FROM part",
    ),
    "math_functions": (
        "MATCH (c:Customer) RETURN c.custkey AS k, abs(c.acctbal) AS a, ceil(c.acctbal) AS b, floor(c.acctbal) AS c, round(c.acctbal) AS d, sign(c.acctbal) AS e, round(sqrt(abs(c.acctbal)) * 1000) / 1000 AS f, round(log(c.custkey + 1) * 1000) / 1000 AS g, exp(0) AS h, log10(1000) AS i",
        "SELECT c_custkey AS k, abs(c_acctbal) AS a, ceil(c_acctbal) AS b, floor(c_acctbal) AS c, round(c_acctbal) AS d, CAST(sign(c_acctbal) AS BIGINT) AS e, floor(sqrt(abs(c_acctbal)) * 1000 + 0.5) / 1000 AS f, floor(ln(c_custkey + 1) * 1000 + 0.5) / 1000 AS g, CAST(1 AS DOUBLE) AS h, CAST(3 AS DOUBLE) AS i FROM customer",
    ),
    "cast_functions": (
        "RETURN toInteger('42') AS a, toInteger('3.9') AS b, toInteger('x') AS c, toFloat('2.5') AS d, toString(3.0) AS e, toString(2.5) AS f, toBoolean('TRUE') AS g, coalesce(null, 5) AS h, duration('P1DT2H') AS i, isNull(null) AS j",
        "SELECT CAST(42 AS BIGINT) AS a, CAST(3 AS BIGINT) AS b, CAST(NULL AS BIGINT) AS c, CAST(2.5 AS DOUBLE) AS d, '3' AS e, '2.5' AS f, true AS g, CAST(5 AS BIGINT) AS h, CAST(93600000 AS BIGINT) AS i, true AS j",
    ),
    "list_functions": (
        "WITH [3, 1, 2, 3] AS l RETURN head(l) AS a, last(l) AS b, size(tail(l)) AS c, sort(l) AS d, size(distinct(l)) AS e, reverse(l) AS f, range(5, 1, -2) AS g, size(range(5, 1)) AS h, l[1] AS i, 2 IN l AS j",
        "SELECT CAST(3 AS BIGINT) AS a, CAST(3 AS BIGINT) AS b, CAST(3 AS BIGINT) AS c, CAST([1, 2, 3, 3] AS BIGINT[]) AS d, CAST(3 AS BIGINT) AS e, CAST([3, 2, 1, 3] AS BIGINT[]) AS f, CAST([5, 3, 1] AS BIGINT[]) AS g, CAST(0 AS BIGINT) AS h, CAST(1 AS BIGINT) AS i, true AS j",
    ),
    "more_functions": (
        "MATCH (p:Part) RETURN p.partkey AS k, ltrim('  x ') AS a, rtrim('  x ') AS b, endsWith(p.name, 'ring') AS c, contains(p.type, 'O') AS d, isNotNull(p.brand) AS e, size(vector([1, 2])) AS f, size(toFloatVector([1, 2, 3])) AS g, rand() < 1 AS h, size(keys(properties(p))) AS i",
        "SELECT p_partkey AS k, 'x ' AS a, '  x' AS b, p_name LIKE '%ring' AS c, contains(p_type, 'O') AS d, true AS e, CAST(2 AS BIGINT) AS f, CAST(3 AS BIGINT) AS g, true AS h, (SELECT count(*) FROM information_schema.columns WHERE table_name = 'part') AS i FROM part",
    ),
    "graph_functions": ("MATCH (n:Nation)-[r:IN_REGION]->(m) RETURN n.nationkey AS k, type(r) AS t, labels(m) AS l, size(keys(n)) AS s, id(m) % 1000 AS i", "SELECT n_nationkey AS k, 'IN_REGION' AS t, ['Region'] AS l, CAST(3 AS BIGINT) AS s, CAST(n_regionkey AS BIGINT) AS i FROM nation"),
    # Search
    "vector_topk": (
        "MATCH (a:Vector {vec_id: 0}), (b:Vector) RETURN b.vec_id AS k, round(vector_similarity(a.embedding, b.embedding) * 10000) / 10000 AS s ORDER BY s DESC, k LIMIT 10",
        "WITH q AS (SELECT CAST(embedding AS DOUBLE[]) AS q FROM embeddings WHERE vec_id = 0), d AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings) SELECT vec_id AS k, CASE WHEN list_dot_product(q, e) < 0 THEN -floor(-list_dot_product(q, e) / sqrt(list_dot_product(q, q)) / sqrt(list_dot_product(e, e)) * 10000 + 0.5) ELSE floor(list_dot_product(q, e) / sqrt(list_dot_product(q, q)) / sqrt(list_dot_product(e, e)) * 10000 + 0.5) END / 10000 AS s FROM d, q ORDER BY s DESC, k LIMIT 10",
    ),
    "vector_metrics": (
        "MATCH (a:Vector {vec_id: 1}), (b:Vector) RETURN b.vec_id AS k, floor(vector_distance(a.embedding, b.embedding) * 10000) AS d, floor(vector_dot(a.embedding, b.embedding) * 10000) AS p",
        "WITH q AS (SELECT CAST(embedding AS DOUBLE[]) AS q FROM embeddings WHERE vec_id = 1), d AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings) SELECT vec_id AS k, floor(list_distance(q, e) * 10000) AS d, floor(list_dot_product(q, e) * 10000) AS p FROM d, q",
    ),
    "full_text_search": (
        "MATCH (d:Document) WHERE full_text_search('Document', 'text', 'idiot worthless') RETURN d.doc_id AS k",
        "SELECT doc_id AS k FROM documents WHERE list_has_any(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), ['idiot', 'worthless'])",
    ),
    "bm25_score": (
        "MATCH (d:Document) WHERE full_text_search('Document', 'text', 'idiot nicht') RETURN d.doc_id AS k, round(bm25_score(d.text, 'idiot nicht') * 10000) / 10000 AS s",
        "WITH t AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: strlen(x) >= 2) AS t FROM documents), f AS (SELECT doc_id, len(t) AS n, len(list_filter(t, lambda x: x = 'idiot')) AS a, len(list_filter(t, lambda x: x = 'nicht')) AS b FROM t), s AS (SELECT count(*) AS c, avg(n) AS m, count(*) FILTER (WHERE a > 0) AS da, count(*) FILTER (WHERE b > 0) AS db FROM f) SELECT doc_id AS k, floor((ln((c - da + 0.5) / (da + 0.5) + 1) * a * 2.2 / (a + 1.2 * (0.25 + 0.75 * n / m)) + ln((c - db + 0.5) / (db + 0.5) + 1) * b * 2.2 / (b + 1.2 * (0.25 + 0.75 * n / m))) * 10000 + 0.5) / 10000 AS s FROM f, s WHERE a > 0 OR b > 0",
    ),
    "rrf_fusion": (
        "UNWIND rrf_fusion([1, 2, 3], [3, 4]) AS r RETURN r.id AS id, floor(r.score * 1000000) AS s",
        "SELECT CAST(id AS BIGINT) AS id, floor((1.0 / (60 + a) + 1.0 / (60 + b)) * 1000000) AS s FROM (VALUES (1, 1, 3), (2, 2, 3), (3, 3, 1), (4, 4, 2)) t(id, a, b)",
    ),
    "weighted_fusion": (
        "UNWIND weighted_fusion([{id: 1, score: 2.0}, {id: 2, score: 1.0}], [{id: 2, score: 5.0}], 0.25) AS r RETURN r.id AS id, r.score AS s",
        "SELECT CAST(id AS BIGINT) AS id, CAST(s AS DOUBLE) AS s FROM (VALUES (1, 0.25), (2, 0.75)) t(id, s)",
    ),
    "schema_procedure": ("CALL db.schema() YIELD type, name RETURN type, count(*) AS n", "SELECT 'node' AS type, CAST(10 AS BIGINT) AS n UNION ALL SELECT 'relationship', 7"),
    "stats_procedure": ("CALL db.stats() YIELD metric, value WITH metric, value WHERE metric IN ['nodes.Order', 'edges.Order.CONTAINS.Part'] RETURN metric, value", "SELECT 'nodes.Order' AS metric, count(*) AS value FROM orders UNION ALL SELECT 'edges.Order.CONTAINS.Part', count(*) FROM lineitem"),
}

_EDGES = "e AS (SELECT DISTINCT a.l_partkey x, b.l_partkey y FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1)"
_WALK = f"WITH RECURSIVE {_EDGES}, w(t, path, d) AS (SELECT CAST(1 AS BIGINT), [CAST(1 AS BIGINT)], 0 UNION ALL SELECT y, list_append(path, y), d + 1 FROM w JOIN e ON x = t WHERE d < {{n}} AND NOT list_contains(path, y))"
READS |= {
    "var_len": ("MATCH (p:Part {partkey: 1})-[:NEXT_PART*1..3]->(q:Part) RETURN q.partkey AS k, count(*) AS n", _WALK.format(n=3) + " SELECT t AS k, count(*) AS n FROM w WHERE d >= 1 GROUP BY t"),
    "var_len_exact": ("MATCH (p:Part {partkey: 1})-[:NEXT_PART*2]->(q:Part) RETURN count(*) AS n", _WALK.format(n=2) + " SELECT count(*) AS n FROM w WHERE d = 2"),
    "var_len_distinct": ("MATCH (p:Part {partkey: 1})-[:NEXT_PART*1..2]->(q:Part) RETURN DISTINCT q.partkey AS k", _WALK.format(n=2) + " SELECT DISTINCT t AS k FROM w WHERE d >= 1"),
    "var_len_incoming": (
        "MATCH (p:Part {partkey: 1})<-[:NEXT_PART*1..2]-(q:Part) RETURN count(*) AS n",
        f"WITH RECURSIVE {_EDGES}, w(t, path, d) AS (SELECT CAST(1 AS BIGINT), [CAST(1 AS BIGINT)], 0 UNION ALL SELECT x, list_append(path, x), d + 1 FROM w JOIN e ON y = t WHERE d < 2 AND NOT list_contains(path, x)) SELECT count(*) AS n FROM w WHERE d >= 1",
    ),
    "var_len_then_hop": (
        "MATCH (p:Part {partkey: 1})-[:NEXT_PART*1..2]->(q:Part)<-[:SUPPLIES]-(s:Supplier) RETURN count(*) AS n",
        _WALK.format(n=2) + " SELECT count(*) AS n FROM w JOIN (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem) ON l_partkey = t WHERE d >= 1",
    ),
    "shortest_path": (
        "MATCH (a:Part {partkey: 1}), (b:Part) RETURN b.partkey AS k, shortestPath((a)-[:NEXT_PART*..3]->(b)) AS d",
        f"WITH RECURSIVE {_EDGES}, w(t, d) AS (SELECT CAST(1 AS BIGINT), 0 UNION SELECT y, d + 1 FROM w JOIN e ON x = t WHERE d < 3) SELECT p_partkey AS k, CAST(min(d) AS BIGINT) AS d FROM part LEFT JOIN w ON t = p_partkey GROUP BY p_partkey",
    ),
    "all_shortest_paths": (
        "MATCH (a:Part {partkey: 1}), (b:Part {partkey: 5}) RETURN allShortestPaths((a)-[:NEXT_PART*..3]->(b)) AS d",
        f"WITH RECURSIVE {_EDGES}, w(t, d) AS (SELECT CAST(1 AS BIGINT), 0 UNION SELECT y, d + 1 FROM w JOIN e ON x = t WHERE d < 3) SELECT CAST(min(d) AS BIGINT) AS d FROM w WHERE t = 5",
    ),
    "optional_exists": (
        "MATCH (c:Customer) OPTIONAL MATCH (c)-[:PLACED]->(o:Order) WHERE EXISTS { (o)-[l:CONTAINS]->(p:Part) WHERE l.quantity > 49 AND p.partkey > c.custkey } RETURN c.custkey AS k, count(o) AS n",
        "SELECT c_custkey AS k, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 49 AND l_partkey > c_custkey) GROUP BY 1",
    ),
    "call_relationship": (
        "MATCH (o:Order)-[l:CONTAINS]->(p:Part {partkey: 3}) CALL { WITH l, o RETURN l.quantity * 2 AS q } RETURN o.orderkey AS o, l.linenumber AS l, q",
        "SELECT l_orderkey AS o, l_linenumber AS l, l_quantity * 2 AS q FROM lineitem WHERE l_partkey = 3",
    ),
    "named_path": ("MATCH p = (a:Part {partkey: 1})-[:NEXT_PART]->(b:Part)-[:NEXT_PART]->(c:Part) RETURN length(p) AS l, size(nodes(p)) AS s, count(*) AS n", f"WITH {_EDGES} SELECT CAST(2 AS BIGINT) AS l, CAST(3 AS BIGINT) AS s, count(*) AS n FROM e a JOIN e b ON a.y = b.x WHERE a.x = 1 HAVING count(*) > 0"),
}


def _reader(text: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: shop(spark, sf_dir).cypher(text)


def _after(*texts: str) -> Callable[[SparkSession, str], DataFrame]:
    """The last statement's rows, after the ones before it have written."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        graph = shop(spark, sf_dir)
        for t in texts[:-1]:
            graph.cypher(t)
        return graph.cypher(texts[-1])

    return run


WRITES: dict[str, tuple[Callable, str]] = {
    "multi_label": (_after("CREATE (a:City:Capital {name: 'X'}), (b:City {name: 'Y'})", "MATCH (n:City:Capital) RETURN n.name AS name, size(labels(n)) AS l"), "SELECT 'X' AS name, CAST(2 AS BIGINT) AS l"),
    "delete_node": (_after("CREATE (a:City {name: 'X'}), (b:City {name: 'Y'})", "MATCH (c:City {name: 'X'}) DELETE c", "MATCH (c:City) RETURN c.name AS name"), "SELECT 'Y' AS name"),
    "create": (_after("CREATE (a:City {name: 'X', size: 3})-[:NEAR {km: 4}]->(b:City {name: 'Y'})", "MATCH (a:City)-[r:NEAR]->(b) RETURN a.name AS a, a.size AS s, r.km AS km, b.name AS b, b.size AS t"), "SELECT 'X' AS a, CAST(3 AS BIGINT) AS s, CAST(4 AS BIGINT) AS km, 'Y' AS b, CAST(NULL AS BIGINT) AS t"),
    "match_create": (_after("MATCH (n:Nation), (r:Region {regionkey: 1}) WHERE n.nationkey < 3 CREATE (n)-[:LIKES {w: n.nationkey}]->(r)", "MATCH (n)-[l:LIKES]->(r:Region) RETURN n.name AS n, l.w AS w, r.name AS r"), "SELECT n_name AS n, n_nationkey AS w, r_name AS r FROM nation, region WHERE n_nationkey < 3 AND r_regionkey = 1"),
    "merge_node": (
        _after("MERGE (n:Nation {name: 'NATION_1'}) ON MATCH SET n.tag = 'old'", "MERGE (n:Nation {name: 'Nowhere'}) ON CREATE SET n.tag = 'new'", "MATCH (n:Nation) WHERE n.tag IS NOT NULL RETURN n.name AS name, n.tag AS tag"),
        "SELECT 'NATION_1' AS name, 'old' AS tag UNION ALL SELECT 'Nowhere', 'new'",
    ),
    "merge_edge": (
        _after("MATCH (n:Nation {nationkey: 0}), (r:Region) MERGE (n)-[:IN_REGION]->(r)", "MATCH (n:Nation {nationkey: 0})-[:IN_REGION]->(r:Region) RETURN r.name AS name, count(*) AS n"),
        "SELECT r_name AS name, CAST(1 AS BIGINT) AS n FROM region",
    ),
    "set_property": (_after("MATCH (c:Customer) WHERE c.acctbal < 0 SET c.mktsegment = 'DEBT', c.flag = 1", "MATCH (c:Customer) RETURN c.mktsegment AS s, c.flag AS f, count(*) AS n"), "SELECT CASE WHEN c_acctbal < 0 THEN 'DEBT' ELSE c_mktsegment END AS s, CASE WHEN c_acctbal < 0 THEN CAST(1 AS BIGINT) END AS f, count(*) AS n FROM customer GROUP BY 1, 2"),
    "delete_edge": (_after("MATCH (c:Customer)-[p:PLACED]->(o:Order) WHERE o.orderstatus = 'F' DELETE p", "MATCH (c:Customer)-[:PLACED]->(o:Order) RETURN o.orderstatus AS s, count(*) AS n"), "SELECT o_orderstatus AS s, count(*) AS n FROM orders WHERE o_orderstatus <> 'F' GROUP BY 1"),
    "detach_delete": (_after("MATCH (n:Nation) WHERE n.regionkey = 2 DETACH DELETE n", "MATCH (c:Customer) OPTIONAL MATCH (c)-[:IN_NATION]->(n:Nation) RETURN n.name AS name, count(*) AS c"), "SELECT n_name AS name, count(*) AS c FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey AND n_regionkey <> 2 GROUP BY 1"),
}


def _index_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph = shop(spark, sf_dir)
    graph.cypher("CREATE FULLTEXT INDEX parts FOR (p:Part) ON EACH [p.type]")
    return graph.cypher("CALL db.index.fulltext.queryNodes('parts', 'STANDARD steel economy') YIELD node, score RETURN node.partkey AS k, score")


def _hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with the vector of the same number."""
    from pyspark.sql import functions as F

    graph = shop(spark, sf_dir)
    vectors = graph.nodes["Vector"].select(F.col("vec_id").alias("doc_id"), "embedding")
    graph.nodes["Document"] = graph.nodes["Document"].join(vectors, "doc_id")
    query = [0.125] * 64
    return graph.hybrid_search("Document", "text", "embedding", query, "idiot nicht", 10)


def _approximate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With all cells probed, the index finds what the exact search does."""
    graph = shop(spark, sf_dir)
    graph.create_vector_index("Vector", "embedding", 64)
    index = graph.build_vector_index("Vector", "embedding")
    found = graph.vector_search("Vector", "embedding", [0.125] * 64, 10, probes=index.cells)
    return found.selectExpr("_id % 281474976710656 as k", "round(score, 6) as s")


def _hybrid_sql(alpha: str | None = None) -> str:
    return """
WITH d AS (SELECT doc_id, text, CAST(embedding AS DOUBLE[]) AS e FROM documents JOIN embeddings ON vec_id = doc_id),
q AS (SELECT list_transform(range(64), lambda x: CAST(0.125 AS DOUBLE)) AS q),
v0 AS (SELECT doc_id, round(list_dot_product(q, e) / sqrt(list_dot_product(q, q)) / sqrt(list_dot_product(e, e)), 9) AS s FROM d, q),
v AS (SELECT doc_id, row_number() OVER (ORDER BY s DESC, doc_id) AS r FROM v0 QUALIFY r <= 20),
t AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: strlen(x) >= 2) AS t FROM d),
f AS (SELECT doc_id, len(t) AS n, len(list_filter(t, lambda x: x = 'idiot')) AS a, len(list_filter(t, lambda x: x = 'nicht')) AS b FROM t),
s AS (SELECT count(*) AS c, avg(n) AS m, count(*) FILTER (WHERE a > 0) AS da, count(*) FILTER (WHERE b > 0) AS db FROM f),
b0 AS (SELECT doc_id, round(ln((c - da + 0.5) / (da + 0.5) + 1) * a * 2.2 / (a + 1.2 * (0.25 + 0.75 * n / m)) + ln((c - db + 0.5) / (db + 0.5) + 1) * b * 2.2 / (b + 1.2 * (0.25 + 0.75 * n / m)), 9) AS s FROM f, s WHERE a > 0 OR b > 0),
b AS (SELECT doc_id, row_number() OVER (ORDER BY s DESC, doc_id) AS r FROM b0 QUALIFY r <= 20),
j AS (SELECT coalesce(v.doc_id, b.doc_id) AS doc_id, round(1.0 / (60 + coalesce(v.r, (SELECT count(*) FROM v) + 1)) + 1.0 / (60 + coalesce(b.r, (SELECT count(*) FROM b) + 1)), 9) AS score FROM v FULL JOIN b ON v.doc_id = b.doc_id)
SELECT doc_id + 8 * 281474976710656 AS _id, CAST(score AS DOUBLE) AS score, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM j QUALIFY rank <= 10"""


def _saved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A graph that was saved, changed, saved again and opened."""
    from loomgraph.graph import Graph
    from loomgraph.sources.storage import scratch

    path = scratch(spark, "saved")
    graph = shop(spark, sf_dir)
    graph.save(path)
    graph.cypher("MATCH (r:Region {regionkey: 0}) SET r.name = 'changed'")
    graph.save(path)
    return Graph.open(spark, path).cypher("MATCH (n:Nation)-[:IN_REGION]->(r:Region) RETURN r.name AS name, count(n) AS n")


def _json_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomgraph.graph import Graph
    from loomgraph.sources.loaders import export_json, import_json
    from loomgraph.sources.storage import scratch

    path = scratch(spark, "dump")
    whole = shop(spark, sf_dir)
    export_json(Graph(spark, {x: whole.nodes[x] for x in ("Region", "Nation", "Customer")}, {k: whole.edges[k] for k in (("Nation", "IN_REGION", "Region"), ("Customer", "IN_NATION", "Nation"))}, whole.numbers), path)
    return import_json(spark, path).cypher("MATCH (c:Customer)-[:IN_NATION]->(n:Nation)-[:IN_REGION]->(r:Region) RETURN r.name AS name, count(c) AS n, round(sum(c.acctbal) * 100) / 100 AS s")


def _csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomgraph.graph import empty
    from loomgraph.sources.loaders import load_edges, load_nodes
    from loomgraph.sources.storage import scratch

    path = scratch(spark, "csv")
    spark.read.parquet(f"{sf_dir}/customer.parquet").selectExpr("c_custkey as id", "c_name as name", "c_acctbal as acctbal").write.csv(f"{path}/c", header=True)
    spark.read.parquet(f"{sf_dir}/orders.parquet").selectExpr("o_orderkey as id", "o_totalprice as price").write.csv(f"{path}/o", header=True)
    spark.read.parquet(f"{sf_dir}/orders.parquet").selectExpr("o_custkey as src_id", "o_orderkey as dst_id", "o_orderstatus as status").write.csv(f"{path}/e", header=True)
    graph = empty(spark)
    load_nodes(graph, f"{path}/c", "Customer")
    load_nodes(graph, f"{path}/o", "Order")
    load_edges(graph, f"{path}/e", "PLACED", "Customer", "Order")
    return graph.cypher("MATCH (c:Customer)-[p:PLACED]->(o:Order) WHERE o.price > 200000 RETURN c.id AS k, p.status AS s, count(o) AS n")


def _dot(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomgraph.graph import Graph
    from loomgraph.sources.loaders import dot_lines

    whole = shop(spark, sf_dir)
    kinds = (("Nation", "IN_REGION", "Region"), ("Customer", "IN_NATION", "Nation"))
    return dot_lines(Graph(spark, {x: whole.nodes[x] for x in ("Region", "Nation", "Customer")}, {k: whole.edges[k] for k in kinds}, whole.numbers))


_ID = {label: f"{k} * 281474976710656" for label, k in (("Region", 0), ("Nation", 1), ("Customer", 2))}
_DOT = " UNION ALL ".join([
    "SELECT 'digraph graph_ {' AS value UNION ALL SELECT '}'",
    *[f"SELECT '  n' || ({key} + {_ID[x]}) || ' [label=\"{x}: ' || {name} || '\"];' FROM {t}" for x, key, name, t in (("Region", "r_regionkey", "r_name", "region"), ("Nation", "n_nationkey", "n_name", "nation"), ("Customer", "c_custkey", "c_name", "customer"))],
    f"SELECT '  n' || (n_nationkey + {_ID['Nation']}) || ' -> n' || (n_regionkey + {_ID['Region']}) || ' [label=\"IN_REGION\"];' FROM nation",
    f"SELECT '  n' || (c_custkey + {_ID['Customer']}) || ' -> n' || (c_nationkey + {_ID['Nation']}) || ' [label=\"IN_NATION\"];' FROM customer",
])


def _with_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shop(spark, sf_dir).cypher("MATCH (c:Customer) WHERE c.mktsegment IN $segments AND c.acctbal > $low RETURN c.custkey AS k, $tag AS t", {"segments": ["BUILDING", "MACHINERY"], "low": 5000, "tag": "x"})


def _bare_node(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What RETURN n gives, as JSON."""
    from pyspark.sql import functions as F

    found = shop(spark, sf_dir).cypher("MATCH (r:Region) RETURN r")
    return found.select(F.col("r.regionkey").cast("long").alias("k"), F.col("r.name").alias("name"))


def _unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A constraint, a write that breaks it, and one that doesn't."""
    from loomgraph.graph import Conflict

    graph, refused = shop(spark, sf_dir), 0
    graph.cypher("CREATE CONSTRAINT ON (n:Nation) ASSERT n.name IS UNIQUE")
    for name in ("NATION_3", "Elsewhere"):
        try:
            graph.cypher("CREATE (n:Nation {name: $name, nationkey: 99})", {"name": name})
        except Conflict:
            refused += 1
    return graph.cypher("MATCH (n:Nation) RETURN count(n) AS n, $refused AS refused", {"refused": refused})


def _checkpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions by CHECKPOINT and OPTIMIZE, and a read of an older one."""
    from loomgraph.graph import Graph
    from loomgraph.sources.storage import scratch

    whole = shop(spark, sf_dir)
    graph = Graph(spark, {x: whole.nodes[x] for x in ("Customer", "Order")}, {k: whole.edges[k] for k in (("Customer", "PLACED", "Order"),)}, whole.numbers)
    path = scratch(spark, "versions")
    graph.save(path)
    graph.cypher("MATCH (c:Customer)-[p:PLACED]->(o:Order) WHERE o.orderstatus = 'F' DELETE p")
    graph.cypher("CHECKPOINT")
    graph.cypher("OPTIMIZE")
    text = "MATCH (c:Customer)-[:PLACED]->(o:Order) RETURN o.orderstatus AS s, count(*) AS n"
    old, new = Graph.open(spark, path, 1).cypher(text), Graph.open(spark, path).cypher(text)
    return old.selectExpr("1 as version", "s", "n").union(new.selectExpr(f"{graph.version} as version", "s", "n")).selectExpr("cast(version as bigint) as version", "s", "n")


def _batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch that fails leaves nothing; one that succeeds leaves all."""
    graph = shop(spark, sf_dir)
    for last in ("MATCH (x:Region) RETURN nope(x) AS n", "CREATE (a:City {name: 'Z'})"):
        try:
            graph.batch(["CREATE (a:City {name: 'X'})", "CREATE FULLTEXT INDEX cities FOR (c:City) ON EACH [c.name]", last])
        except ValueError:
            pass
    return graph.cypher("MATCH (c:City) RETURN c.name AS name, count(*) AS n")


def _upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph = shop(spark, sf_dir)
    graph.merge_node_by_property("Nation", "name", "NATION_2", {"tag": "old"})
    graph.merge_node_by_property("Nation", "name", "Nowhere", {"tag": "new"})
    graph.set_property((1 << 48) + 4, "tag", "set")
    return graph.cypher("MATCH (n:Nation) WHERE n.tag IS NOT NULL RETURN n.name AS name, n.tag AS tag")


def _ldbc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers and orders written as files of the benchmark's names and loaded."""
    from loomgraph.graph import empty
    from loomgraph.sources.loaders import load_ldbc
    from loomgraph.sources.storage import scratch

    root, read = scratch(spark, "ldbc"), lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    tables = {"person_0_0.csv": read("customer").selectExpr("c_custkey as id", "c_name as lastName"), "post_0_0.csv": read("orders").selectExpr("o_orderkey as id", "o_orderpriority as content"), "post_hasCreator_person_0_0.csv": read("orders").selectExpr("o_orderkey as `Post.id`", "o_custkey as `Person.id`"), "readme": read("region")}
    for name, t in tables.items():
        t.write.csv(f"{root}/{name}", header=True, sep="|")
    graph = empty(spark)
    load_ldbc(graph, [f"{root}/{name}" for name in tables])
    return graph.cypher("MATCH (m:Post)-[:HAS_CREATOR]->(p:Person) RETURN p.ldbc_id AS k, p.lastName AS name, count(m) AS n")


def _apoc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations and regions written as an APOC export and loaded."""
    from loomgraph.graph import empty
    from loomgraph.sources.loaders import load_apoc
    from loomgraph.sources.storage import scratch

    root, read = scratch(spark, "apoc"), lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    nation = read("nation").selectExpr("n_nationkey + 100 as _id", "if(n_nationkey % 2 = 0, ':Nation:Even', ':Nation') as _labels", "n_name as name")
    nation.union(read("region").selectExpr("r_regionkey as _id", "':Region'", "r_name")).write.csv(f"{root}/n", header=True)
    read("nation").selectExpr("n_nationkey + 100 as _start", "n_regionkey as _end", "'IN_REGION' as _type", "n_nationkey as w").write.csv(f"{root}/r", header=True)
    graph = empty(spark)
    load_apoc(graph, f"{root}/n", f"{root}/r")
    return graph.cypher("MATCH (n:Even)-[e:IN_REGION]->(r:Region) RETURN n.name AS n, r.name AS r, e.w AS w")


def _every_term(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    found = shop(spark, sf_dir).fulltext_candidates("Document", "text", "the idiot", every=True)
    return found.select((F.col("_id") % F.lit(1 << 48)).alias("k"))


def _top_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shop(spark, sf_dir).top_degree_nodes("Customer", 10).selectExpr("_id % 281474976710656 as k", "degree")


def _counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, labels and types, and one node by its id."""
    graph = shop(spark, sf_dir)
    name = graph.get_node((1 << 48) + 3).first()["name"]
    n, e = graph.counts()
    return spark.createDataFrame([(n, e, len(graph.labels()), len(graph.relationship_types()), name)], "n long, e long, labels long, types long, name string")


OTHERS: dict[str, tuple[Callable, str]] = {
    "fulltext_index": (_index_search, "SELECT p_partkey AS k, CAST(len(list_intersect(list_distinct(list_filter(regexp_split_to_array(lower(p_type), '[^\\p{L}\\p{N}]+'), lambda x: strlen(x) >= 2)), ['standard', 'steel', 'economy'])) AS DOUBLE) / 3 AS score FROM part WHERE score > 0"),
    "hybrid_search": (_hybrid, _hybrid_sql()),
    "vector_index": (_approximate, "WITH q AS (SELECT list_transform(range(64), lambda x: CAST(0.125 AS DOUBLE)) AS q), v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings) SELECT vec_id AS k, round(list_dot_product(q, e) / sqrt(list_dot_product(q, q)) / sqrt(list_dot_product(e, e)), 6) AS s FROM v, q ORDER BY s DESC, k LIMIT 10"),
    "save_and_open": (_saved, "SELECT CASE WHEN r_regionkey = 0 THEN 'changed' ELSE r_name END AS name, count(*) AS n FROM nation JOIN region ON r_regionkey = n_regionkey GROUP BY 1"),
    "json_round_trip": (_json_round_trip, "SELECT r_name AS name, count(*) AS n, floor(sum(c_acctbal) * 100 + 0.5) / 100 AS s FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY 1"),
    "csv_round_trip": (_csv_round_trip, "SELECT o_custkey AS k, o_orderstatus AS s, count(*) AS n FROM orders WHERE o_totalprice > 200000 GROUP BY 1, 2"),
    "dot_export": (_dot, _DOT),
    "params": (_with_params, "SELECT c_custkey AS k, 'x' AS t FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_acctbal > 5000"),
    "return_node": (_bare_node, "SELECT CAST(r_regionkey AS BIGINT) AS k, r_name AS name FROM region"),
    "unique_constraint": (_unique, "SELECT count(*) + 1 AS n, CAST(1 AS BIGINT) AS refused FROM nation"),
    "checkpoint_optimize": (_checkpoint, "SELECT CAST(1 AS BIGINT) AS version, o_orderstatus AS s, count(*) AS n FROM orders GROUP BY 2 UNION ALL SELECT 3, o_orderstatus, count(*) FROM orders WHERE o_orderstatus <> 'F' GROUP BY 2"),
    "batch": (_batch, "SELECT name, CAST(1 AS BIGINT) AS n FROM (VALUES ('X'), ('Z')) t(name)"),
    "upsert": (_upsert, "SELECT 'NATION_2' AS name, 'old' AS tag UNION ALL SELECT 'Nowhere', 'new' UNION ALL SELECT 'NATION_4', 'set'"),
    "ldbc_load": (_ldbc, "SELECT c_custkey AS k, c_name AS name, count(*) AS n FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1, 2"),
    "apoc_load": (_apoc, "SELECT n_name AS n, r_name AS r, CAST(n_nationkey AS BIGINT) AS w FROM nation JOIN region ON r_regionkey = n_regionkey WHERE n_nationkey % 2 = 0"),
    "full_text_every_term": (_every_term, "SELECT doc_id AS k FROM documents WHERE list_has_all(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), ['the', 'idiot'])"),
    "top_degree_nodes": (_top_degree, "SELECT o_custkey AS k, count(*) + 1 AS degree FROM orders GROUP BY 1 ORDER BY degree DESC, k LIMIT 10"),
    "db_counts": (_counts, "SELECT CAST((SELECT count(*) FROM region) + (SELECT count(*) FROM nation) + (SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier) + (SELECT count(*) FROM part) + (SELECT count(*) FROM orders) + (SELECT count(*) FROM events) + (SELECT count(DISTINCT user_id) FROM events) + (SELECT count(*) FROM documents) + (SELECT count(*) FROM embeddings) AS BIGINT) AS n, CAST((SELECT count(*) FROM nation) + (SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier) + (SELECT count(*) FROM orders) + (SELECT count(*) FROM lineitem) + (SELECT count(*) FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem)) + (SELECT count(*) FROM events) + (SELECT count(*) FROM (SELECT DISTINCT a.l_partkey, b.l_partkey FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1)) AS BIGINT) AS e, CAST(10 AS BIGINT) AS labels, CAST(7 AS BIGINT) AS types, 'NATION_3' AS name"),
}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {**{k: _reader(t) for k, (t, _) in READS.items()}, **{k: f for k, (f, _) in (WRITES | OTHERS).items()}, **interactive.QUERIES}
ORACLES: dict[str, str] = {k: s for k, (_, s) in (READS | WRITES | OTHERS).items()} | interactive.ORACLES
