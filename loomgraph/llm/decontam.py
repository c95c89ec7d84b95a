"""Benchmark decontamination by template canonicalisation.

Numbers, runs of names and units become typed placeholders, so that a question
whose parameters were changed keeps its template. Windows of template tokens of
every document are hash-joined with those of the benchmark; a document that holds
enough of an item's windows is looked at again: along the best alignment, each
slot value of the item must stand for one value of the document. Only DataFrame
functions are used.

Names are told by their case, which a document in capitals lacks. So windows of the
plain lower-cased words are joined too, and a document that holds enough of those
has the item word for word: its slots are not looked at.

Most items have so many windows of literal tokens alone that a text which reaches the
coverage holds one of them, and there the template is the plain words: only texts
with such a window are canonicalised. If an item has too few, all texts are.

A name is a run of capitalised words inside a sentence: after a lower-case letter, a
digit or one of `,;:`, and one space. An item that has no window of enough literal
tokens, being too short or of slots alone, would be met by chance in any document;
it is found where its whole template is the whole of a text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.llm.common import MOST_BROADCAST, sent, stored

#: Template tokens to a window; windows of an item that a document must hold.
WIDTH, COVERAGE = 5, 0.8
#: Literal tokens that a window needs.
LEAST_LITERAL = 3
#: Item values with one counterpart, of all item values.
CONSISTENT = 0.9
BLANK = r"[\x20\x09-\x0D]+"
#: Possessive, so that a run of any length is read in a loop and not by recursion.
NAMES = r"([\p{Ll}\p{N},;:] )(\p{Lu}[\p{L}'\-]*+(?: \p{Lu}[\p{L}'\-]*+)*+)"
NUMBERS = r"(\p{N}+(?:[.,:/]\p{N}+)*)"
UNITS = "kg|g|mg|lb|lbs|oz|km|m|cm|mm|mi|miles?|feet|ft|inch(?:es)?|hours?|hrs?|minutes?|mins?|seconds?|secs?|days?|weeks?|months?|years?|percent|dollars?|euros?|cents?|pounds?|litres?|liters?|l|ml|mph|kmh"
PUNCTUATION = r"[^\p{L}\p{N}<>=\x20\x09-\x0D]+"


def _unmarked(text: Column) -> Column:
    """Without the signs of placeholders, which few texts hold."""
    held = [F.contains(text, F.lit(sign)) for sign in "<>="]
    return F.when(held[0] | held[1] | held[2], F.regexp_replace(text, "[<>=]", "")).otherwise(text)


def _split(text: Column) -> Column:
    return F.array_remove(F.split(text, BLANK), "")


def template(text: Column, values: bool = False) -> Column:
    """The canonical text; with values, placeholders keep what they stand for."""
    of = (lambda kind, group: f"<{kind}=${group}>") if values else (lambda kind, _: f"<{kind}>")
    out = F.regexp_replace(_unmarked(text), NAMES, f"$1{of('name', 2)}")
    out = F.regexp_replace(out, NUMBERS, of("num", 1))
    # Only a number may be followed by a unit.
    after = r"(<num[^>]*>)( ?)((?i:" + UNITS + r"))\b"
    out = F.regexp_replace(out, after, f"$1$2{of('unit', 3)}")
    return F.regexp_replace(F.lower(out), PUNCTUATION, "")


def tokens(text: Column, values: bool = False) -> Column:
    """Template tokens; a run of names is one of them."""
    if values:  # blanks inside a placeholder don't part tokens
        return F.regexp_extract_all(template(text, True), F.lit(r"(?:<[^<>]*+>|[^<>\x20\x09-\x0D])++"), F.lit(0))
    return _split(template(text))


def plain(text: Column) -> Column:
    """Lower-cased words without punctuation."""
    return _split(F.regexp_replace(F.lower(_unmarked(text)), PUNCTUATION, ""))


def _bare(token: Column) -> Column:
    return F.regexp_replace(token, "<(num|name|unit)=[^>]*>", "<$1>")


def hashed(tokens: Column) -> Column:
    return F.transform(tokens, lambda t: F.xxhash64(t))


def windows(hashes: Column, width: int) -> Column:
    """Hashes of all windows of so many tokens, by position, from those of the tokens.
    These must be a column of their own: an expression would be evaluated once for
    each window."""
    n = F.size(hashes) - width
    at = F.when(n >= 0, F.sequence(F.lit(0), n)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(width)]))


def whole(hashes: Column, longest: int) -> Column:
    """The hash of all tokens, if there are no more than that."""
    return F.when(F.size(hashes).between(1, longest), F.array(F.xxhash64(F.lit("whole"), hashes))).otherwise(F.array().cast("array<bigint>"))


def _literals(tokens: Column) -> Column:
    return F.size(F.filter(tokens, lambda t: ~F.contains(t, F.lit("<"))))


def item_windows(benchmark: DataFrame, width: int) -> DataFrame:
    """(item_id, item, plain, literal, window, item_at, size, windows, literals) of
    windows with enough literal tokens, numbers among plain words being none; item is a hash of the
    text, for texts that share an item_id, and size the number of tokens; literal are
    windows of a template that hold no placeholder, and literals is their number. An
    item without such a window of its template has its whole template instead, at -1."""
    items = benchmark.where("item_id is not null and text is not null").select("item_id", "text").distinct()
    texts = items.select("item_id", F.xxhash64("text").alias("item"), "text")
    items = texts.select("item_id", "item", F.lit(False).alias("plain"), tokens(F.col("text")).alias("t"))
    items = stored(items.union(texts.select("item_id", "item", F.lit(True), plain(F.col("text")))).withColumn("h", hashed(F.col("t"))), "items")
    placed = items.select("item_id", "item", "plain", "t", F.posexplode(windows(F.col("h"), width)).alias("item_at", "window"))
    own = F.slice("t", F.col("item_at") + 1, width)
    words = F.size(F.filter(own, lambda t: ~F.rlike(t, F.lit(r"\p{N}"))))
    enough = placed.where(F.when(F.col("plain"), words).otherwise(_literals(own)) >= LEAST_LITERAL)
    enough = enough.select("item_id", "item", "plain", (~F.col("plain") & (_literals(own) == width)).alias("literal"), "window", "item_at", F.size("t").alias("size"))
    rest = items.where("not plain and size(t) > 0").join(enough.where("not plain").select("item_id", "item").distinct(), ["item_id", "item"], "left_anti")
    rest = rest.select("item_id", "item", "plain", F.lit(False).alias("literal"), F.xxhash64(F.lit("whole"), "h").alias("window"), F.lit(-1).alias("item_at"), F.size("t").alias("size"))
    of_item = Window.partitionBy("item_id", "item", "plain")
    return enough.union(rest).withColumns({"windows": F.count("*").over(of_item), "literals": F.count_if("literal").over(of_item)})


def held_items(texts: DataFrame, benchmark: DataFrame, width: int = WIDTH, coverage: float = COVERAGE, most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """(row, item_id, matched, windows, slots, changed) for texts (row, text): see
    contaminated(). row is a hash that stands for the text."""
    items = stored(item_windows(benchmark, width), "windows")
    # Whether a text may hold an item's template without any of its literal windows.
    apart = ~F.col("plain") & (F.col("windows") - F.col("literals") >= coverage * F.col("windows"))
    longest, any_text = items.agg(F.max(F.when(F.col("item_at") < 0, F.col("size"))), F.bool_or(apart)).first()
    longest = longest or 0
    key = ["row", "item_id", "item"]

    def found_in(rows: DataFrame, items: DataFrame) -> DataFrame:
        asked = sent(items.select("window", "item_id", "item", "plain", "item_at", "windows"), most_broadcast)
        return rows.join(asked, "window").groupBy(*key, "plain", "item_at").agg(F.first("windows").alias("windows"))

    rows = texts.select("row", plain(F.col("text")).alias("p")).select("row", hashed(F.col("p")).alias("p"))
    rows = rows.select("row", F.explode(F.array_distinct(windows(F.col("p"), width))).alias("window"))
    words = stored(found_in(rows, items.where("plain or literal")), "words")
    if not any_text:
        may = words.where("not plain").select("row").distinct()
        canonical = texts.join(sent(may, most_broadcast), "row", "left_semi")
    else:
        canonical = texts
    rows = canonical.select("row", tokens(F.col("text")).alias("t")).select("row", hashed(F.col("t")).alias("t"))
    rows = rows.select("row", F.explode(F.concat(F.array_distinct(windows(F.col("t"), width)), whole(F.col("t"), longest))).alias("window"))
    # A literal window counts among the plain words too, where the template has a name.
    found = words.union(found_in(rows, items.where("not plain"))).distinct()
    held = found.groupBy(*key, "plain").agg(F.count("*").alias("matched"), F.first("windows").alias("windows")).where(F.col("matched") >= coverage * F.col("windows"))
    held = stored(held, "held")
    verbatim, held = held.where("plain").drop("plain"), held.where("not plain").drop("plain")

    # A second look at the few texts that may be copies, with slot values.
    near = texts.join(sent(held.select("row").distinct(), most_broadcast), "row", "left_semi").dropDuplicates(["row"])

    def valued(df: DataFrame, key: str, at: str, prefix: str) -> DataFrame:
        t = df.select(key, tokens(F.col("text"), True).alias("v")).withColumn("t", F.transform("v", lambda v: F.xxhash64(_bare(v))))
        own = t.select(key, "v", F.posexplode(windows(F.col("t"), width)).alias(at, "window"))
        own = own.union(t.select(key, "v", F.lit(-1), F.explode(whole(F.col("t"), longest))))
        at_ = F.col(at)
        slots = F.filter(F.when(at_ < 0, F.col("v")).otherwise(F.slice("v", F.greatest(at_, F.lit(0)) + 1, width)), lambda x: F.contains(x, F.lit("<")))
        return own.select(key, at, "window", slots.alias(f"{prefix}_slots"))

    asked = benchmark.where("text is not null").select("item_id", F.xxhash64("text").alias("item"), "text").distinct()
    asked = asked.join(held.select("item_id", "item").distinct(), ["item_id", "item"], "left_semi").select(F.struct("item_id", "item").alias("_item"), "text")
    asked = valued(asked, "_item", "item_at", "item").select("_item.*", "item_at", "window", "item_slots")
    pairs = valued(near, "row", "doc_at", "doc").join(held.select(*key), "row")
    aligned = pairs.join(asked, ["item_id", "item", "window"]).withColumn("shift", F.col("doc_at") - F.col("item_at"))
    aligned = stored(aligned.select(*key, "shift", "doc_slots", "item_slots"), "aligned")
    best = aligned.groupBy(*key, "shift").agg(F.count("*").alias("n")).groupBy(*key).agg(F.max_by("shift", F.struct("n", "shift")).alias("shift"))
    # The table compresses so well that Spark would take it for one to broadcast.
    slots = aligned.hint("merge").join(best, [*key, "shift"]).select(*key, F.explode(F.arrays_zip("item_slots", "doc_slots")).alias("s")).select(*key, "s.item_slots", "s.doc_slots").distinct()
    values = slots.groupBy(*key, "item_slots").agg(F.count("*").alias("n"), F.max((F.col("doc_slots") != F.col("item_slots")).cast("int")).alias("other"))
    checked = values.groupBy(*key).agg(F.count("*").alias("slots"), F.sum("other").alias("changed"), F.avg((F.col("n") == 1).cast("int")).alias("_share"))
    out = held.join(checked, key, "left").where((F.col("_share") >= CONSISTENT) | F.col("_share").isNull())
    out = out.select(*key, "matched", "windows", F.coalesce("slots", F.lit(0)).cast("long").alias("slots"), F.coalesce("changed", F.lit(0)).cast("long").alias("changed"))
    none = F.lit(0).cast("long")
    out = out.withColumn("plain", F.lit(False)).union(verbatim.select(*key, "matched", "windows", none, none, F.lit(True)))
    # The template counts if it is held, and of texts that share an item_id the one
    # of which most is held.
    rest = ["matched", "windows", "slots", "changed"]
    best = out.groupBy("row", "item_id").agg(F.max_by(F.struct(*rest), F.struct(~F.col("plain"), F.col("matched") / F.col("windows"), "matched", "item")).alias("_best"))
    return best.select("row", "item_id", "_best.*")


def contaminated(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, coverage: float = COVERAGE, most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """A row (doc_id, item_id, matched, windows, slots, changed) for each document
    and item whose template it holds: how many of the item's windows were found,
    how many distinct slot values the item has along the best alignment, and how
    many of them have another value in the document. If only the plain words reach
    the coverage, the windows are theirs, and there are no slots. An item without a
    window of its own is found as a whole: one window.

    Null texts and ids match nothing, nor do items without a letter or digit. Texts
    are looked at one by one: those that share a doc_id or an item_id are not added
    up, and the best one's row is given. Repeated rows count once. Texts of any
    length are taken whole. Empty tables give no rows; other columns are ignored."""
    docs = docs.where("doc_id is not null and text is not null").select("doc_id", "text", F.xxhash64("text").alias("row"))
    held = stored(held_items(docs.select("row", "text"), benchmark, width, coverage, most_broadcast), "contaminated")
    rest = ["matched", "windows", "slots", "changed"]
    out = docs.select("doc_id", "row").join(sent(held, most_broadcast), "row")
    best = out.groupBy("doc_id", "item_id").agg(F.max_by(F.struct(*rest), F.struct(F.col("matched") / F.col("windows"), *rest)).alias("_best"))
    return best.select("doc_id", "item_id", "_best.*")
