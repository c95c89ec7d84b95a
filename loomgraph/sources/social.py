"""The test tables as a social network, for the interactive queries: customers are
persons who know each other, orders are their posts, parts the tags of posts,
suppliers forums and employers, and events comments on posts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.graph import Graph, node_id

NUMBERS = {x: k for k, x in enumerate(("Person", "Place", "Post", "Tag", "TagClass", "Forum", "Comment", "Organisation"))}
#: Whom a person knows, by the distance of their keys; who likes a post, likewise.
KNOWS, LIKES, EMPLOYERS = (1, 7, 31), 5, 10


def social(spark: SparkSession, sf_dir: str) -> Graph:
    """A graph of its own to write to; schemas are read once a session and folder."""
    opened = spark.__dict__.setdefault("_loomgraph_social", {})
    if sf_dir not in opened:
        opened[sf_dir] = _open(spark, sf_dir)
    return opened[sf_dir].snapshot()


def _open(spark: SparkSession, sf_dir: str) -> Graph:
    person, place, post, line, tag, forum, event = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("customer", "nation", "orders", "lineitem", "part", "supplier", "events"))

    def nodes(label: str, t: DataFrame, key: str, **props: str) -> DataFrame:
        return t.select(node_id(NUMBERS[label], F.expr(key)), F.expr(key).alias("ldbc_id"), *[F.expr(e).alias(p) for p, e in props.items()])

    def edges(t: DataFrame, a: str, src: str, b: str, dst: str) -> DataFrame:
        return t.select(node_id(NUMBERS[a], F.expr(src)).alias("_src"), node_id(NUMBERS[b], F.expr(dst)).alias("_dst"))

    ids = person.select("c_custkey")
    near = ids.select("c_custkey", F.explode(F.array(*[F.col("c_custkey") + k for k in KNOWS])).alias("to"))
    known = near.join(ids.withColumnRenamed("c_custkey", "to"), "to", "left_semi")
    liked = post.select("o_orderkey", (F.col("o_custkey") + LIKES).alias("by")).join(ids, F.col("by") == F.col("c_custkey"), "left_semi")
    comments = event.join(post, F.col("event_id") == F.col("o_orderkey"), "left_semi")
    said = comments.join(ids, F.col("user_id") == F.col("c_custkey"), "left_semi")
    members = line.join(post, F.col("l_orderkey") == F.col("o_orderkey")).select("l_suppkey", "o_custkey").distinct()
    employed = person.withColumn("at", F.col("c_custkey") % EMPLOYERS).join(forum, F.col("at") == F.col("s_suppkey"), "left_semi")
    kinds = tag.select("p_type").distinct().withColumn("k", F.expr("crc32(p_type)"))
    all_nodes = {
        "Person": nodes("Person", person, "c_custkey", firstName="c_mktsegment", lastName="c_name"),
        "Place": nodes("Place", place, "n_nationkey", name="n_name"),
        "Post": nodes("Post", post, "o_orderkey", content="o_orderpriority", creationDate="date_format(o_orderdate, 'yyyy-MM-dd')"),
        "Tag": nodes("Tag", tag, "p_partkey", name="concat('tag ', p_partkey)"),
        "TagClass": nodes("TagClass", kinds, "k", name="p_type"),
        "Forum": nodes("Forum", forum, "s_suppkey", title="s_name"),
        "Comment": nodes("Comment", comments, "event_id", content="event_type"),
        "Organisation": nodes("Organisation", forum.where(F.col("s_suppkey") < EMPLOYERS), "s_suppkey", name="s_name"),
    }
    all_edges = {
        ("Person", "knows", "Person"): edges(known, "Person", "c_custkey", "Person", "to"),
        ("Person", "isLocatedIn", "Place"): edges(person, "Person", "c_custkey", "Place", "c_nationkey"),
        ("Post", "hasCreator", "Person"): edges(post, "Post", "o_orderkey", "Person", "o_custkey"),
        ("Post", "hasTag", "Tag"): edges(line.select("l_orderkey", "l_partkey").distinct(), "Post", "l_orderkey", "Tag", "l_partkey"),
        ("Tag", "hasType", "TagClass"): edges(tag, "Tag", "p_partkey", "TagClass", "crc32(p_type)"),
        ("Forum", "hasMember", "Person"): edges(members, "Forum", "l_suppkey", "Person", "o_custkey"),
        ("Person", "likes", "Post"): edges(liked, "Person", "by", "Post", "o_orderkey"),
        ("Comment", "replyOf", "Post"): edges(comments, "Comment", "event_id", "Post", "event_id"),
        ("Comment", "hasCreator", "Person"): edges(said, "Comment", "event_id", "Person", "user_id"),
        ("Person", "workAt", "Organisation"): edges(employed, "Person", "c_custkey", "Organisation", "at"),
    }
    return Graph(spark, all_nodes, all_edges, NUMBERS)
