"""Scalar functions of the query language as Spark expressions.

Each takes compiled argument columns and a function that tells a column's type.
A null first argument gives null, as built-in expressions do by themselves."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

TypeOf = Callable[[Column], T.DataType]
FLOATS = (T.FloatType, T.DoubleType, T.DecimalType)
WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def is_text(t: T.DataType) -> bool:
    return isinstance(t, T.StringType)


def is_number(t: T.DataType) -> bool:
    return isinstance(t, T.NumericType)


def double(x: Column) -> Column:
    return x.cast("double")


def to_text(x: Column, type_of: TypeOf) -> Column:
    """A whole float is written without its fraction."""
    if isinstance(type_of(x), FLOATS):
        whole = (x == F.floor(x)) & (F.abs(x) < 1e15)
        return F.when(whole, x.cast("long").cast("string")).otherwise(x.cast("string"))
    return x.cast("string")


def to_integer(x: Column, type_of: TypeOf) -> Column:
    if is_text(type_of(x)):
        t = F.trim(x)
        return F.coalesce(t.try_cast("bigint"), F.when(~F.isnan(t.try_cast("double")), t.try_cast("double").try_cast("bigint")))
    return x.try_cast("bigint")


def to_boolean(x: Column, type_of: TypeOf) -> Column:
    kind = type_of(x)
    if is_text(kind):
        low = F.lower(F.trim(x))
        return F.when(low == "true", F.lit(True)).when(low == "false", F.lit(False))
    return x if isinstance(kind, T.BooleanType) else (x != 0)


def size(x: Column, type_of: TypeOf) -> Column:
    kind = type_of(x)
    if isinstance(kind, T.ArrayType | T.MapType):
        return F.when(x.isNotNull(), F.size(x)).cast("long")
    return F.length(x).cast("long")


def span(*bounds: Column) -> Column:
    """range(): both ends count; empty where the step leads away."""
    low, high = (b.cast("long") for b in bounds[:2])
    step = bounds[2].cast("long") if len(bounds) > 2 else F.lit(1).cast("long")
    ok = ((step > 0) & (low <= high)) | ((step < 0) & (low >= high))
    # A step of 0 is an error, as it is in the language.
    safe = F.when(step == 0, F.raise_error(F.lit("range() needs a step other than 0")).cast("long")).otherwise(step)
    return F.when(ok | (step == 0), F.sequence(low, high, safe)).otherwise(F.array().cast("array<bigint>"))


def substring(text: Column, start: Column, *length: Column) -> Column:
    start = F.greatest(start.cast("int"), F.lit(0))
    n = F.greatest(length[0].cast("int"), F.lit(0)) if length else F.length(text)
    return F.substring(text, start + 1, n)


def log(x: Column, base: float | None = None) -> Column:
    """Minus infinity at 0, not a number below: Spark's own is null there."""
    x = double(x)
    inside = F.ln(x) if base is None else F.log10(x)
    return F.when(x > 0, inside).when(x == 0, F.lit(float("-inf"))).when(x.isNotNull(), F.lit(float("nan")))


def rounded(x: Column) -> Column:
    """Half away from zero, as a float."""
    x = double(x)
    return F.signum(x) * F.floor(F.abs(x) + 0.5)


UNITS = (("Y", 365 * 86_400_000), ("M", 30 * 86_400_000), ("W", 7 * 86_400_000), ("D", 86_400_000))
CLOCK = (("H", 3_600_000), ("M", 60_000), ("S", 1000))


def duration(x: Column) -> Column:
    """An ISO 8601 duration in milliseconds; a year is 365 days, a month 30."""
    ok = F.regexp_like(x, F.lit(r"^P(?=.)(\d+(\.\d+)?Y)?(\d+(\.\d+)?M)?(\d+(\.\d+)?W)?(\d+(\.\d+)?D)?(T(?=.)(\d+(\.\d+)?H)?(\d+(\.\d+)?M)?(\d+(\.\d+)?S)?)?$"))
    date, time = F.regexp_extract(x, "^P([^T]*)", 1), F.regexp_extract(x, "T(.*)$", 1)
    total = F.lit(0.0)
    for part, units in ((date, UNITS), (time, CLOCK)):
        for letter, ms in units:
            total = total + F.coalesce(F.regexp_extract(part, rf"(\d+(?:\.\d+)?){letter}", 1).try_cast("double"), F.lit(0.0)) * ms
    return F.when(ok, total.cast("long"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: double(x) * double(y)), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + double(x) * double(x)))


def cosine(a: Column, b: Column) -> Column:
    """0 where a vector is all zero; between -1 and 1."""
    scale = norm(a) * norm(b)
    same = F.size(a) == F.size(b)
    return F.when(same, F.when(scale == 0, F.lit(0.0)).otherwise(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b) / scale))))


def euclidean(a: Column, b: Column) -> Column:
    return F.when(F.size(a) == F.size(b), F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: double(x) - double(y)), F.lit(0.0), lambda s, x: s + x * x)))


def vector(x: Column) -> Column:
    v = x.cast("array<float>")
    return F.when(F.forall(v, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))), v)


def rrf(a: Column, b: Column, k: Column | None = None) -> Column:
    """Fuse two lists of ids, best first: 1 / (k + rank) from each; an id that one
    lacks has the rank after its last. By score, then id."""
    k = F.lit(60.0) if k is None else double(k)
    ids = F.array_distinct(F.concat(a, b))

    def part(of: Column, x: Column) -> Column:
        at = F.array_position(of, x)
        return 1 / (k + F.when(at == 0, F.size(of) + 1).otherwise(at))

    scored = F.transform(ids, lambda x: F.struct((-(part(a, x) + part(b, x))).alias("s"), x.alias("id")))
    return F.transform(F.array_sort(scored), lambda x: F.struct(x["id"].alias("id"), (-x["s"]).alias("score")))


def weighted(a: Column, b: Column, alpha: Column | None = None) -> Column:
    """Blend two lists of {id, score}: each min-max scaled (a constant list is all
    1), what a list lacks counts 0, alpha for the first. By score, then id."""
    alpha = F.lit(0.5) if alpha is None else double(alpha)
    ids = F.array_distinct(F.concat(F.transform(a, lambda x: x["id"]), F.transform(b, lambda x: x["id"])))

    def part(of: Column, x: Column) -> Column:
        scores = F.transform(of, lambda e: double(e["score"]))
        low, high = F.array_min(scores), F.array_max(scores)
        own = F.get(F.filter(of, lambda e: e["id"] == x), F.lit(0))["score"]
        return F.when(own.isNull(), F.lit(0.0)).when(high == low, F.lit(1.0)).otherwise((double(own) - low) / F.nullif(high - low, F.lit(0.0)))

    scored = F.transform(ids, lambda x: F.struct((-(alpha * part(a, x) + (1 - alpha) * part(b, x))).alias("s"), x.alias("id")))
    return F.transform(F.array_sort(scored), lambda x: F.struct(x["id"].alias("id"), (-x["s"]).alias("score")))


#: name: (fewest, most arguments, function of the columns, needs types)
FUNCTIONS: dict[str, tuple] = {
    "toupper": (1, 1, F.upper, False),
    "tolower": (1, 1, F.lower, False),
    "upper": (1, 1, F.upper, False),
    "lower": (1, 1, F.lower, False),
    "trim": (1, 1, lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""), False),
    "ltrim": (1, 1, lambda x: F.regexp_replace(x, r"^\s+", ""), False),
    "rtrim": (1, 1, lambda x: F.regexp_replace(x, r"\s+$", ""), False),
    "split": (2, 2, lambda x, y: F.split(x, F.concat(F.lit("\\Q"), y, F.lit("\\E"))), False),
    "substring": (2, 3, substring, False),
    "left": (2, 2, lambda x, n: F.substring(x, F.lit(1), n.cast("int")), False),
    "right": (2, 2, lambda x, n: F.when(n <= 0, F.lit("")).otherwise(F.right(x, n.cast("int"))), False),
    "size": (1, 1, size, True),
    "length": (1, 1, size, True),
    "startswith": (2, 2, F.startswith, False),
    "endswith": (2, 2, F.endswith, False),
    "contains": (2, 2, F.contains, False),
    "replace": (3, 3, F.replace, False),
    "abs": (1, 1, F.abs, False),
    "ceil": (1, 1, lambda x: F.ceil(double(x)).cast("double"), False),
    "floor": (1, 1, lambda x: F.floor(double(x)).cast("double"), False),
    "round": (1, 1, rounded, False),
    "sqrt": (1, 1, lambda x: F.sqrt(double(x)), False),
    "log": (1, 1, log, False),
    "ln": (1, 1, log, False),
    "log10": (1, 1, lambda x: log(x, 10), False),
    "exp": (1, 1, lambda x: F.exp(double(x)), False),
    "sign": (1, 1, lambda x: F.signum(x).cast("long"), False),
    "rand": (0, 0, F.rand, False),
    "random": (0, 0, F.rand, False),
    "range": (2, 3, span, False),
    "head": (1, 1, lambda x: F.get(x, F.lit(0)), False),
    "tail": (1, 1, lambda x: F.slice(x, F.lit(2), F.greatest(F.size(x), F.lit(1))), False),
    "last": (1, 1, lambda x: F.when(F.size(x) > 0, F.element_at(x, -1)), False),
    "reverse": (1, 1, F.reverse, False),
    "sort": (1, 1, F.array_sort, False),
    "distinct": (1, 1, F.array_distinct, False),
    "tostring": (1, 1, to_text, True),
    "tointeger": (1, 1, to_integer, True),
    "tofloat": (1, 1, lambda x: x.try_cast("double"), False),
    "toboolean": (1, 1, to_boolean, True),
    "coalesce": (1, None, F.coalesce, False),
    "isnull": (1, 1, lambda x: x.isNull(), False),
    "isnotnull": (1, 1, lambda x: x.isNotNull(), False),
    "datetime": (0, 0, lambda: F.unix_millis(F.current_timestamp()), False),
    "timestamp": (0, 0, lambda: F.unix_millis(F.current_timestamp()), False),
    "date": (0, 0, lambda: F.unix_date(F.current_date()).cast("long"), False),
    "duration": (1, 1, duration, False),
    "vector_similarity": (2, 2, cosine, False),
    "vector_cosine": (2, 2, cosine, False),
    "vector_distance": (2, 2, euclidean, False),
    "vector_euclidean": (2, 2, euclidean, False),
    "vector_dot": (2, 2, lambda a, b: F.when(F.size(a) == F.size(b), dot(a, b)), False),
    "vector_dot_product": (2, 2, lambda a, b: F.when(F.size(a) == F.size(b), dot(a, b)), False),
    "vector": (1, 1, vector, False),
    "tofloatvector": (1, 1, vector, False),
    "rrf_fusion": (2, 3, rrf, False),
    "weighted_fusion": (2, 3, weighted, False),
}
