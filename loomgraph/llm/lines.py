"""Line dedup by a deletion-neighbourhood join, in DataFrame functions only.

Lines within one character edit (insertion, deletion or substitution) of each
other are copies, and the earliest stays. Every line yields its variants with one
character left out, keyed by a hash. Two lines of one length that differ in one
place share the variant and the place; a line that lacks one character equals a
variant of the other. So each line needs only the earliest line under each of its
keys: sums with partial aggregation, no pairs, however many lines share a key.

A variant of a whole line for each of its characters would be the square of the
line. So lines are cut into about as many blocks as a block has characters. An edit
falls into one block, and what stands before and behind that block is the same in
both lines. Only lines that share such a frame (place of the block, what is before
it and what is behind) get variants, and only of the block inside it: a hash of the
frame and the block without one character. Before that, equal lines are folded, and
lines that share neither their first nor their last half with another are left out,
as an edit leaves one half the same. None of this loses a copy, and a line of n
characters never takes more than n characters of keys and variants at a time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import sent, stored


def _key(*parts: Column) -> list[Column]:
    return [F.xxhash64(*parts).alias("k1"), F.hash(*parts).alias("k2")]


def _norm(line: Column) -> Column:
    return F.trim(line, F.lit(" \t\v\f\r"))


def _row() -> Column:
    """Tells texts apart that share a doc_id."""
    return F.xxhash64("text")


def _exploded(docs: DataFrame) -> DataFrame:
    lines = docs.select("doc_id", _row().alias("row"), F.posexplode(F.split("text", "\n")).alias("at", "raw"))
    return lines.select("doc_id", "row", "at", _norm(F.col("raw")).alias("line")).where("line != ''")


def _halves(line: Column, n: Column) -> Column:
    """Of the shorter of two lines with m characters, the first m // 2 and the last
    m - m // 2. A line may be the shorter one or the one with m + 1."""
    heads = F.array_distinct(F.array(F.floor(n / 2), F.floor((n - 1) / 2)))
    tails = F.array_distinct(F.array(F.ceil(n / 2), F.ceil((n - 1) / 2)))
    return F.concat(
        F.transform(heads, lambda h: F.xxhash64(F.lit("head"), F.substring(line, F.lit(1), h.cast("int")))),
        F.transform(tails, lambda t: F.xxhash64(F.lit("tail"), F.substring(line, (n - t + 1).cast("int"), t.cast("int")))),
    )


def _frames(line: Column, n: Column) -> Column:
    """(m, at, size, frame) of every block: m is the length of the shorter of two
    lines, this one's or one less, and the frame a hash of what is around it."""

    def of(m: Column) -> Column:
        w = F.ceil(F.sqrt(m)).cast("int")
        starts = F.transform(F.sequence(F.lit(0), F.ceil(m / w).cast("int") - 1), lambda k: k * w)

        def frame(at: Column) -> Column:
            behind = F.greatest(m - at - w, F.lit(0))
            around = F.xxhash64(m, at, F.substring(line, F.lit(1), at), F.substring(line, n - behind + 1, behind))
            return F.struct(m.alias("m"), at.alias("at"), (n - behind - at).alias("size"), around.alias("frame"))

        return F.transform(starts, frame)

    return F.flatten(F.transform(F.filter(F.array(n, n - 1), lambda m: m > 0), of))


def _within_one() -> Column:
    """Whether line and e_line are the same around a block and have one edit in it.
    Comparing whole lines would take the square of their length."""
    m, at = F.col("in.m"), F.col("in.at")
    behind = F.greatest(m - at - F.ceil(F.sqrt(m)).cast("int"), F.lit(0))

    def parts(line: str, n: str) -> tuple[Column, Column, Column]:
        end = F.col(n) - behind
        return F.substring(line, F.lit(1), at), F.substring(line, at + 1, end - at), F.substring(line, end + 1, behind)

    (a, x, b), (c, y, d) = parts("line", "n"), parts("e_line", "e_n")
    return (a == c) & (b == d) & F.levenshtein(x, y, 1).between(0, 1)


def repeated_lines(docs: DataFrame, least_chars: int = 0) -> DataFrame:
    """(doc_id, row, at): the lines, by number, that have an earlier copy; row is a
    hash of the text. Earlier is by doc_id, then row, then line number. Lines of
    fewer than least_chars characters are only compared for equality."""
    known = docs.where("doc_id is not null and text is not null")
    lines = _exploded(known).withColumn("n", F.length("line"))
    keyed = stored(lines.select("doc_id", "row", "at", "n", *_key(F.col("line")), _halves(F.col("line"), F.col("n")).alias("halves")), "lines")
    whole = ["k1", "k2", "n"]
    first = F.min(F.struct("doc_id", "row", "at")).alias("first")
    folded = stored(keyed.groupBy(*whole).agg(first, F.count("*").alias("copies"), F.any_value("halves").alias("halves")), "folded")

    placed = folded.where(f"n >= {least_chars}").select("first", F.explode("halves").alias("half"))
    shared = placed.groupBy("half").agg(F.count("*").alias("c")).where("c > 1").select("half")
    near = stored(placed.join(shared, "half").select("first.*").distinct(), "near")
    near = lines.drop("n").join(sent(near), ["doc_id", "row", "at"], "left_semi")
    # A text that stands twice under one doc_id is one occurrence.
    near = near.select(F.struct("doc_id", "row", "at").alias("first"), "line").dropDuplicates(["first"])
    near = stored(near.withColumn("n", F.length("line")), "candidates")

    frames = stored(near.select("first", F.explode(_frames(F.col("line"), F.col("n"))).alias("b")).select("first", "b.*"), "frames")
    shared = frames.groupBy("frame").agg(F.count("*").alias("c")).where("c > 1").select("frame")
    blocks = frames.join(shared, "frame").groupBy("first").agg(F.collect_list(F.struct("m", "at", "size", "frame")).alias("blocks"))
    inner = near.join(blocks, "first").select("first", "line", "n", F.explode("blocks").alias("b"))
    inner = inner.select("first", (F.col("n") > F.col("b.m")).alias("longer"), F.struct("b.m", "b.at").alias("in"), "b.frame", F.substring("line", F.col("b.at") + 1, F.col("b.size")).alias("block"), "b.size")

    # Variants of the block with the place of the missing character, which two lines
    # of one length must share; a longer line's variant is the shorter one's block.
    cut = F.transform(F.sequence(F.lit(1), F.col("size")), lambda i: F.struct(F.when(F.col("longer"), 0).otherwise(i).alias("i"), F.concat(F.substring("block", F.lit(1), i - 1), F.substring("block", i + 1, F.col("size"))).alias("v")))
    whole_block = F.when(F.col("longer"), F.array().cast("array<struct<i:int,v:string>>")).otherwise(F.array(F.struct(F.lit(0).alias("i"), F.col("block").alias("v"))))
    variants = inner.select("first", "longer", "in", "frame", F.explode(F.concat(cut, whole_block)).alias("x"))
    kind = F.when(F.col("longer"), 2).when(F.col("x.i") == 0, 1).otherwise(0)  # 1: the block as it is
    variants = stored(variants.select("first", kind.alias("kind"), "in", *_key(F.col("frame"), F.col("x.i"), F.col("x.v"))), "variants")
    longer, other = F.when(F.col("kind") == 2, F.col("first")), F.when(F.col("kind") != 2, F.col("first"))
    earliest = variants.groupBy("k1", "k2").agg(F.min(longer).alias("longer"), F.min(other).alias("other"), F.count("*").alias("c")).where("c > 1").drop("c")
    pairs = variants.join(earliest, ["k1", "k2"]).select("first", F.when(F.col("kind") == 1, F.col("longer")).otherwise(F.col("other")).alias("e"), "in").where("e < first").distinct()
    # Verify the distance, so a hash collision does no harm.
    text = near.select(F.col("first").alias("e"), F.col("line").alias("e_line"), F.col("n").alias("e_n"))
    copies = pairs.join(near.select("first", "line", "n"), "first").join(text, "e").where(_within_one())
    copies = stored(copies.select("first").distinct(), "copies").withColumn("gone", F.lit(True))

    # All occurrences: those that are not the first of their line, and the first
    # ones that are copies of an earlier line.
    repeated = folded.drop("halves").join(copies, "first", "left").where("copies > 1 or gone")
    out = keyed.drop("halves").join(repeated.select(*whole, "first", "gone"), whole)
    return out.where(F.col("gone") | (F.struct("doc_id", "row", "at") != F.col("first"))).select("doc_id", "row", "at")


def without_repeated_lines(docs: DataFrame, least_chars: int = 0) -> DataFrame:
    """(doc_id, text, n_lines, n_removed) for every row of docs (doc_id, text),
    text being what is left of it.

    Lines are compared without white space at their ends; blank lines stay and are not
    counted. Null texts stay null; rows without doc_id are returned as they are.
    Rows that share a doc_id and a text are one occurrence, and rows that share only
    a doc_id are texts of their own. A line of any length is taken whole. An empty
    table gives an empty result; other columns are ignored."""
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    gone = repeated_lines(docs, least_chars).groupBy(F.col("doc_id").alias("_id"), F.col("row").alias("_row")).agg(F.collect_set("at").alias("gone"))
    joined = docs.withColumn("row", _row())
    joined = joined.join(gone, (F.col("doc_id") == F.col("_id")) & (F.col("row") == F.col("_row")), "left").withColumn("all", F.split("text", "\n"))
    places = F.array_except(F.sequence(F.lit(0), F.size("all") - 1), F.col("gone"))
    kept = F.array_join(F.transform(places, lambda i: F.get("all", i)), "\n")
    n = F.coalesce(F.size(F.filter("all", lambda line: _norm(line) != "")), F.lit(0))
    return joined.select("doc_id", F.when(F.col("gone").isNull(), F.col("text")).otherwise(kept).alias("text"), F.greatest(n, F.lit(0)).cast("long").alias("n_lines"), F.greatest(F.coalesce(F.size("gone"), F.lit(0)), F.lit(0)).cast("long").alias("n_removed"))
