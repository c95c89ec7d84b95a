r"""Chat formatting of reply trees.

Messages with parents form trees. Pointer doubling, a self-join per round, gives
each message its root, its depth and the summed score of its branch after a number
of rounds that grows with the logarithm of the depth; leaves are ranked by the mean
score of their branch, and doubling again enumerates the messages of each chosen
branch. Each branch becomes one conversation. Only DataFrame functions are used.

    <|im_start|>role<|im_sep|>text<|im_end|>

Inside roles and texts a backslash becomes two, and one is put after the first
character of every control string (those of this template and of other common
ones). So no control string is left inside, and removing one backslash before each
character gives the text back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.llm.common import bounded, stored

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
#: First characters and rests of what must not stand in a text. The rest of a
#: control string begins with one of these.
CONTROLS = (("<", "|"), ("<", "s>"), ("<", "/s>"), ("[", "INST]"), ("[", "/INST]"), ("<", "<SYS>>"), ("<", "</SYS>>"), ("<", "start_of_turn>"), ("<", "end_of_turn>"))


def escape(text: Column) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for head, rest in CONTROLS:
        out = F.replace(out, F.lit(head + rest), F.lit(f"{head}\\{rest}"))
    return out


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _pointers(nodes: DataFrame) -> DataFrame:
    """Depth (root: 0), score of the branch down to the message, for all messages
    below a root; those on a cycle, or below one, never reach a root and go."""
    up = nodes.select("conv", "node", F.col("parent").alias("ptr"), F.col("score").alias("total"), F.when(F.col("parent").isNull(), 0).otherwise(1).cast("long").alias("depth"))
    most = nodes.groupBy("conv").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    up, reach = stored(up, "up"), 1
    jumps = [up.select("conv", "node", "ptr")]
    while reach <= most and not bounded(up.where("ptr is not null"), 0):
        far = up.select("conv", F.col("node").alias("ptr"), F.col("ptr").alias("_ptr"), F.col("total").alias("_total"), F.col("depth").alias("_depth"))
        joined = up.join(far, ["conv", "ptr"], "left")
        up = stored(joined.select("conv", "node", F.col("_ptr").alias("ptr"), (F.col("total") + F.coalesce("_total", F.lit(0.0))).alias("total"), (F.col("depth") + F.coalesce("_depth", F.lit(0))).alias("depth")), "up")
        jumps.append(up.select("conv", "node", "ptr"))
        reach *= 2
    return up.where("ptr is null").select("conv", "node", "total", "depth"), jumps


def branches(nodes: DataFrame, most: int | None = None) -> DataFrame:
    """(conv, leaf, rank, node, depth): the messages of each conversation's best
    branches, all of them if most is None.

    nodes: (conv, node, parent, score), node unique in conv. A parent that isn't
    there makes a message a root. Ties in rank go to the lesser leaf."""
    named = nodes.select("conv", F.col("node").alias("parent"), F.lit(True).alias("_there"))
    nodes = nodes.join(named, ["conv", "parent"], "left").withColumn("parent", F.when(F.col("_there"), F.col("parent"))).drop("_there")
    nodes = stored(nodes, "nodes")
    placed, jumps = _pointers(nodes)
    inner = nodes.where("parent is not null").select("conv", F.col("parent").alias("node")).distinct()
    leaves = placed.join(inner, ["conv", "node"], "left_anti").withColumn("mean", F.col("total") / (F.col("depth") + 1))
    order = Window.partitionBy("conv").orderBy(F.desc("mean"), "node")
    leaves = leaves.withColumn("rank", F.row_number().over(order))
    if most is not None:
        leaves = leaves.where(F.col("rank") <= most)
    path = leaves.select("conv", F.col("node").alias("leaf"), "rank", "node")
    for jump in jumps:  # the ancestors at up to 1, 3, 7, ... steps
        path = stored(path, "path")
        path = path.union(path.join(jump.where("ptr is not null"), ["conv", "node"]).select("conv", "leaf", "rank", F.col("ptr").alias("node")))
    return path.join(placed.select("conv", "node", "depth"), ["conv", "node"])


def formatted(messages: DataFrame, most: int | None = None) -> DataFrame:
    """(conv, rank, formatted, mask): each chosen branch as one text, and the
    [start, end) code-point spans of it that bear loss, which are the escaped
    texts of the assistant.

    messages: (conv, node, parent, score, role, text). Null role or text: empty.
    A null conv is a conversation of its own."""
    key = F.to_json(F.struct("conv"))
    keyed = stored(messages.select(key.alias("conv"), F.col("conv").alias("id"), "node", "parent", F.coalesce("score", F.lit(0)).cast("double").alias("score"), "role", "text"), "messages")
    chosen = branches(keyed.select("conv", "node", "parent", "score"), most)
    turns = chosen.join(keyed.select("conv", "id", "node", "role", "text"), ["conv", "node"])
    clean = {x: F.coalesce(escape(F.col(x)), F.lit("")) for x in ("role", "text")}
    head = F.concat(F.lit(START), clean["role"], F.lit(SEP))
    turns = turns.select("conv", "id", "leaf", "rank", "depth", head.alias("head"), clean["text"].alias("text"), F.coalesce(F.col("role") == "assistant", F.lit(False)).alias("loss"))
    # Ends of the turns in code points, as running sums.
    path = ["conv", "leaf", "rank"]
    before = Window.partitionBy(*path).orderBy("depth").rowsBetween(Window.unboundedPreceding, -1)
    size = F.length("head") + F.length("text") + len(END)
    turns = turns.withColumn("start", (F.coalesce(F.sum(size).over(before), F.lit(0)) + F.length("head")).cast("int"))
    turns = turns.select(*path, "id", F.struct("depth", F.concat("head", "text", F.lit(END)).alias("said"), "start", (F.col("start") + F.length("text")).alias("end"), "loss").alias("t"))
    whole = turns.groupBy(*path).agg(F.first("id").alias("id"), F.array_sort(F.collect_list("t")).alias("t"))
    mask = F.transform(F.filter("t", lambda t: t["loss"]), lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end")))
    return whole.select(F.col("id").alias("conv"), "rank", F.array_join("t.said", "").alias("formatted"), mask.alias("mask"))


def turns(formatted: Column) -> Column:
    """Read roles and texts back from a formatted conversation."""
    parts = F.slice(F.split(formatted, r"<\|im_start\|>"), 2, F.greatest(F.size(F.split(formatted, r"<\|im_start\|>")) - 1, F.lit(0)))

    def read(part: Column) -> Column:
        body = F.substring_index(part, END, 1)
        return F.struct(unescape(F.substring_index(body, SEP, 1)).alias("role"), unescape(F.substring_index(body, SEP, -1)).alias("text"))

    return F.transform(parts, read)


def linear(rows: DataFrame) -> DataFrame:
    """Conversations without branches, by turn, as reply trees: each message
    replies to the one before it. Rows of one turn (repeated rows too) follow each
    other by role and text; a null turn comes first."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    numbered = rows.withColumn("node", F.row_number().over(order).cast("long"))
    return numbered.select(F.col("conv_id").alias("conv"), "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), F.lit(0.0).alias("score"), "role", "text")


def described(formatted_: DataFrame) -> DataFrame:
    """What a reader of the formatted text finds in it."""
    out = formatted_.select(F.col("conv").alias("conv_id"), "formatted", "mask", turns(F.col("formatted")).alias("turns"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    masked = unescape(F.array_join(F.transform("mask", lambda m: F.substring(F.col("formatted"), m["start"] + 1, m["end"] - m["start"])), ""))
    out = out.withColumn("said", said).withColumn("masked", masked)
    return out.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2("said", 256).alias("turns_sha256"), F.length("masked").cast("long").alias("loss_chars"), F.sha2("masked", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))
