"""Edited, cropped, turned and resized copies of images, by local descriptors.

An image is a grey-scale array. Harris corners of several scales, the strongest of
each tile, get an orientation from the moments of their patch; 256 comparisons of
fixed point pairs, turned by that orientation, make a binary descriptor.
Descriptors of query and index images meet where they agree in one of eight 32-bit
words (a Hamming table for each word). Up to seven differing bits cannot spread
over all eight, and no more are accepted, so the tables find every match.

For each pair of images, matches vote for a scale, a turn and a shift; the votes of
one cell are the geometric consensus, and a similarity transform is fitted to them.
At last the two images are laid over each other by that transform: where they
overlap, their grey values must correlate.

Equal images fold into one class first, equal queries too, and only classes are
compared.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import sent, stored

SCALES = (1.0, 0.89, 0.79, 0.71, 0.63, 0.56, 0.5)
#: Corners of each tile of so many pixels square, and of each scale.
CORNERS, TILE = 5, 32
BITS, RADIUS, BLUR = 256, 10, 2
#: Descriptor bits that may differ: one less than there are tables.
TABLES, MOST_BITS = 8, 7
#: Votes that make a candidate, pixels to a cell, steps to a full turn.
LEAST_VOTES, CELL, TURNS = 2, 8, 12
#: Correlation of the grey values, and the overlap, of the smaller image's pixels.
LEAST_CORRELATION, LEAST_OVERLAP = 0.85, 0.4
WORDS = [f"w{k}" for k in range(TABLES)]
DESCRIBED = "key long, no int, x float, y float, scale float, angle float, " + ", ".join(f"{w} int" for w in WORDS)
#: Pixels that are worked on at a time.
PIXELS = 1 << 18
_rng = np.random.default_rng(20240607)
_PAIRS = np.clip(_rng.normal(0, RADIUS / 2.2, (BITS, 2, 2)), -RADIUS + 2, RADIUS - 2)


def _unfiltered(data: np.ndarray, at: int, h: int, line: int, step: int) -> tuple[np.ndarray, int]:
    """Rows of a PNG whose filters are undone: h rows of so many bytes, step bytes
    to a pixel, from data[at:]; and where the next ones start."""
    out = np.zeros((h + 1, line + step), np.int32)
    for y in range(h):
        kind, own = data[at], data[at + 1 : at + 1 + line].astype(np.int32)
        at += 1 + line
        up = out[y, step:]
        if kind == 1:
            padded = np.zeros(-(-line // step) * step, np.int32)
            padded[:line] = own
            own = np.cumsum(padded.reshape(-1, step), axis=0).ravel()[:line]
        elif kind == 2:
            own = own + up
        if kind < 3:
            out[y + 1, step:] = own & 255
            continue
        row, above = out[y + 1].tolist(), out[y].tolist()
        for x, v in enumerate(own.tolist(), step):
            a, b, c = row[x - step], above[x], above[x - step]
            if kind == 3:
                guess = (a + b) // 2
            else:
                to_a, to_b, to_c = abs(b - c), abs(a - c), abs(a + b - 2 * c)
                guess = a if to_a <= to_b and to_a <= to_c else b if to_b <= to_c else c
            row[x] = (v + guess) & 255
        out[y + 1] = row
    return out[1:, step:].astype(np.uint8), at


def _png(raw: bytes) -> np.ndarray | None:
    at, data, palette = 8, b"", None
    while at < len(raw):
        n, kind = struct.unpack(">I4s", raw[at : at + 8])
        body = raw[at + 8 : at + 8 + n]
        if kind == b"IHDR":
            w, h, depth, colour, _, _, interlaced = struct.unpack(">IIBBBBB", body)
        elif kind == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3).astype(np.float32)
        elif kind == b"IDAT":
            data += body
        at += 12 + n
    channels = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[colour]
    flat, at = np.frombuffer(zlib.decompress(data), np.uint8), 0
    # Rows and columns of each pass: first one and step.
    passes = ((0, 0, 8, 8), (0, 4, 8, 8), (4, 0, 8, 4), (0, 2, 4, 4), (2, 0, 4, 2), (0, 1, 2, 2), (1, 0, 2, 1)) if interlaced else ((0, 0, 1, 1),)
    out = np.zeros((h, w, channels), np.float32)
    for y, x, dy, dx in passes:
        rows, columns = len(range(y, h, dy)), len(range(x, w, dx))
        if not rows or not columns:
            continue
        line = (columns * channels * depth + 7) // 8
        own, at = _unfiltered(flat, at, rows, line, max(1, channels * depth // 8))
        if depth == 16:
            values = own.view(">u2").astype(np.float32) / (1 if colour == 3 else 257)
        elif depth == 8:
            values = own.astype(np.float32)
        else:
            bits = np.unpackbits(own, axis=1)[:, : columns * depth].reshape(rows, columns, depth)
            values = (bits * (1 << np.arange(depth)[::-1])).sum(2).astype(np.float32) * (1 if colour == 3 else 255 / ((1 << depth) - 1))
        out[y::dy, x::dx] = values.reshape(rows, columns, channels)
    if colour == 3:
        return palette[out[:, :, 0].astype(int)].mean(axis=2)
    return out[:, :, :3].mean(axis=2) if channels >= 3 else out[:, :, 0]


def decode(raw: bytes | None) -> np.ndarray | None:
    """A PNG of any kind or an 8-bit binary PGM as a grey array of 0 to 255; None
    for anything else."""
    try:
        if raw[:2] == b"P5":
            head = raw.split(maxsplit=4)
            w, h = int(head[1]), int(head[2])
            return np.frombuffer(raw[-w * h :], np.uint8).reshape(h, w).astype(np.float32)
        return _png(raw).astype(np.float32) if raw[:8] == b"\x89PNG\r\n\x1a\n" else None
    except (ValueError, TypeError, IndexError, KeyError, AttributeError, struct.error, zlib.error, UnboundLocalError):
        return None


def encode_pgm(image: np.ndarray) -> bytes:
    h, w = image.shape
    return f"P5 {w} {h} 255\n".encode() + np.clip(image, 0, 255).round().astype(np.uint8).tobytes()


def resized(image: np.ndarray, scale: float) -> np.ndarray:
    h, w = (max(1, round(n * scale)) for n in image.shape[-2:])
    y, x = np.meshgrid((np.arange(h) + 0.5) / scale - 0.5, (np.arange(w) + 0.5) / scale - 0.5, indexing="ij")
    return sampled(image, y, x)


def sampled(image: np.ndarray, y: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Grey values between pixels, of an image or of each of a stack; beyond the
    edge those at the edge."""
    h, w = image.shape[-2:]
    y, x = np.clip(y, 0, h - 1), np.clip(x, 0, w - 1)
    a, b = np.floor(y).astype(int), np.floor(x).astype(int)
    c, d = np.minimum(a + 1, h - 1), np.minimum(b + 1, w - 1)
    u, v = y - a, x - b
    return image[..., a, b] * (1 - u) * (1 - v) + image[..., a, d] * (1 - u) * v + image[..., c, b] * u * (1 - v) + image[..., c, d] * u * v


def _box(images: np.ndarray, r: int) -> np.ndarray:
    """Mean over a square of each image of a stack, by running sums."""
    for axis in (1, 2):
        wide = np.pad(images, [(r + 1, r) if k == axis else (0, 0) for k in range(3)], mode="edge").cumsum(axis=axis)
        n = images.shape[axis]
        images = (np.take(wide, range(2 * r + 1, 2 * r + 1 + n), axis) - np.take(wide, range(n), axis)) / (2 * r + 1)
    return images


def _corners(images: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(image, y, x) of the strongest Harris corners of each tile of a stack."""
    gy, gx = np.gradient(images, axis=(1, 2))
    a, b, c = _box(gx * gx, 2), _box(gy * gy, 2), _box(gx * gy, 2)
    strength = a * b - c * c - 0.05 * (a + b) ** 2
    inner = np.zeros_like(strength)
    cut = (slice(None), slice(RADIUS, -RADIUS), slice(RADIUS, -RADIUS))
    inner[cut] = strength[cut]
    peak = inner.copy()
    for dy in (-1, 0, 1):
        for dx in (-1, 0, 1):
            peak = np.maximum(peak, np.roll(inner, (dy, dx), (1, 2)))
    of, y, x = np.nonzero((inner > 1e-3) & (inner >= peak))
    tile = (of * (images.shape[1] // TILE + 1) + y // TILE) * (images.shape[2] // TILE + 1) + x // TILE
    order = np.lexsort((x, y, -inner[of, y, x], tile))
    tile = tile[order]
    first = np.searchsorted(tile, tile)
    keep = order[np.arange(len(order)) - first < CORNERS]
    return of[keep], y[keep], x[keep]


def describe(images: np.ndarray) -> pd.DataFrame:
    """Descriptors (no, of, x, y, scale, angle, w0 to w7) of a stack of images of
    one size; places are relative to the middle of the image."""
    out, (_, height, width) = [], images.shape
    r = np.arange(-RADIUS, RADIUS + 1)
    inside = (r[:, None] ** 2 + r[None] ** 2 <= RADIUS**2).astype(float)
    for scale in SCALES:
        scaled = resized(images, scale) if scale != 1 else images
        if min(scaled.shape[1:]) < 2 * RADIUS + 3:
            continue
        of, y, x = _corners(_box(scaled.astype(np.float64), 1))
        scaled = _box(scaled.astype(np.float64), BLUR)
        for k in range(0, len(of), 1000):
            i, v, u = of[k : k + 1000], y[k : k + 1000], x[k : k + 1000]
            patch = scaled[i[:, None, None], v[:, None, None] + r[None, :, None], u[:, None, None] + r[None, None, :]] * inside
            angle = np.arctan2((patch * r[None, :, None]).sum((1, 2)), (patch * r[None, None, :]).sum((1, 2)))
            cos, sin = np.cos(angle)[:, None, None], np.sin(angle)[:, None, None]
            py, px = _PAIRS[None, :, :, 0], _PAIRS[None, :, :, 1]
            at_y, at_x = v[:, None, None] + sin * px + cos * py, u[:, None, None] + cos * px - sin * py
            h, w = scaled.shape[1:]
            at_y, at_x = np.clip(at_y, 0, h - 1.001), np.clip(at_x, 0, w - 1.001)
            b, a = at_y.astype(int), at_x.astype(int)
            f, g, flat = at_y - b, at_x - a, scaled.reshape(-1)
            place = (i[:, None, None] * h + b) * w + a
            values = (flat[place] * (1 - g) + flat[place + 1] * g) * (1 - f) + (flat[place + w] * (1 - g) + flat[place + w + 1] * g) * f
            words = np.packbits(values[:, :, 0] < values[:, :, 1], axis=1).view(np.int32)
            found = pd.DataFrame(words, columns=WORDS)
            found.insert(0, "angle", angle.astype(np.float32))
            found.insert(0, "scale", np.float32(scale))
            found.insert(0, "y", ((v + 0.5) / scale - height / 2).astype(np.float32))
            found.insert(0, "x", ((u + 0.5) / scale - width / 2).astype(np.float32))
            found.insert(0, "of", i)
            out.append(found)
    return pd.concat(out) if out else pd.DataFrame({"of": []})


def _describe(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        stacks: dict[tuple, list] = {}

        def done(shape: tuple) -> Iterator[pd.DataFrame]:
            keys, images = zip(*stacks.pop(shape), strict=True)
            found = describe(np.stack(images))
            if len(found):
                found["no"] = found.groupby("of").cumcount().astype(np.int32)
                found["key"] = np.array(keys)[found["of"].to_numpy()]
                yield found[["key", "no", "x", "y", "scale", "angle", *WORDS]]

        for key, raw in zip(frame["key"], frame["image"], strict=True):
            image = decode(raw)
            if image is not None and image.size:
                stack = stacks.setdefault(image.shape, [])
                stack.append((key, image))
                if len(stack) * image.size >= PIXELS:
                    yield from done(image.shape)
        for shape in list(stacks):
            yield from done(shape)


def descriptors(images: DataFrame) -> DataFrame:
    """(key, no, x, y, scale, angle, w0 to w7) of images (key, image)."""
    return images.select("key", "image").mapInPandas(_describe, DESCRIBED)


def unreadable(images: DataFrame) -> DataFrame:
    """image_id of the images (image_id, image) that edited_copies cannot decode."""

    @F.pandas_udf("boolean")
    def known(raw: pd.Series) -> pd.Series:
        return raw.map(lambda x: decode(x) is not None).astype(bool)

    return images.where("image is null").select("image_id").union(images.where("image is not null").where(~known("image")).select("image_id"))


def _correlation(a: np.ndarray, b: np.ndarray, turn: tuple) -> tuple[float, float]:
    """Of the grey values of a and of b where the transform (p, q, x, y) puts a's
    pixels on b; and how much of the smaller image overlaps."""
    p, q, dx, dy = turn
    h, w = a.shape
    step = max(1, int(np.sqrt(a.size / 40_000)))  # some 40,000 pixels are enough
    v, u = np.meshgrid(np.arange(0, h, step) + 0.5 - h / 2, np.arange(0, w, step) + 0.5 - w / 2, indexing="ij")
    x, y = p * u - q * v + dx + b.shape[1] / 2 - 0.5, q * u + p * v + dy + b.shape[0] / 2 - 0.5
    on = (x >= 0) & (y >= 0) & (x <= b.shape[1] - 1) & (y <= b.shape[0] - 1)
    if on.sum() < 50:
        return 0.0, 0.0
    zoom = p * p + q * q
    overlap = on.mean() / min(1.0, b.size / max(a.size * zoom, 1e-9))
    left, right = a[::step, ::step][on], sampled(b, y[on], x[on])
    left, right = left - left.mean(), right - right.mean()
    return float((left * right).sum() / (np.sqrt((left**2).sum() * (right**2).sum()) + 1e-9)), float(overlap)


def _confirm(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        good = []
        for raw_a, raw_b, turn in zip(frame["q_image"], frame["i_image"], frame[["p", "q", "dx", "dy"]].itertuples(index=False), strict=True):
            correlation, overlap = _correlation(decode(raw_a), decode(raw_b), tuple(turn))
            good.append(correlation >= LEAST_CORRELATION and overlap >= LEAST_OVERLAP)
        yield frame.loc[good, ["q_key", "i_key", "votes"]]


def _meeting(asked: DataFrame, known: DataFrame) -> DataFrame:
    """Matching descriptors (q_key, q_no, i_key, i_no), each pair once."""

    longs = [F.shiftleft(F.col(WORDS[k]).cast("long"), 32).bitwiseOR(F.col(WORDS[k + 1]).cast("long").bitwiseAND(F.lit(0xFFFFFFFF))) for k in range(0, TABLES, 2)]

    def tables(of: DataFrame, side: str) -> DataFrame:
        names = [c.alias(f"{side}_{k}") for k, c in enumerate(longs)]
        return of.select(F.col("key").alias(f"{side}_key"), F.col("no").alias(f"{side}_no"), *names, F.posexplode(F.array(*WORDS)).alias("word", "value"))

    left, right = tables(known, "i"), sent(tables(asked, "q"))
    differ = sum((F.bit_count(F.col(f"q_{k}").bitwiseXOR(F.col(f"i_{k}"))) for k in range(len(longs))), F.lit(0))
    # A pair that agrees in several words is taken in the first of them.
    first = F.lit(TABLES)
    for k in reversed(range(TABLES)):
        x = F.col(f"q_{k // 2}").bitwiseXOR(F.col(f"i_{k // 2}"))
        half = F.shiftrightunsigned(x, 32) if k % 2 == 0 else x.bitwiseAND(F.lit(0xFFFFFFFF))
        first = F.when(half == 0, k).otherwise(first)
    # The tests belong to the join: of what meets in a table, few rows are made.
    met = left.join(right, (left["word"] == right["word"]) & (left["value"] == right["value"]) & (differ <= MOST_BITS) & (left["word"] == first))
    return stored(met.select("q_key", "q_no", "i_key", "i_no").distinct(), "pairs")


def _placed(pairs: DataFrame, asked: DataFrame, known: DataFrame) -> DataFrame:
    """Matches that can agree on something (q_key, i_key, n, q_x, .., i_y, ratio, turn,
    x, y): n are the matches of the two images, the last four the cell of each."""

    def whole(of: DataFrame, side: str) -> DataFrame:
        return of.select(*[F.col(c).alias(f"{side}_{c}") for c in of.columns if c not in WORDS])

    # Two images that have met only once or in one corner have nothing to agree on.
    ends = [f(c).alias(f"{c}_{f.__name__}") for c in ("q_no", "i_no") for f in (F.min, F.max)]
    several = pairs.groupBy("q_key", "i_key").agg(F.count("*").alias("n"), *ends).where("q_no_min < q_no_max and i_no_min < i_no_max")
    several = stored(pairs.join(several.select("q_key", "i_key", "n"), ["q_key", "i_key"]), "several")
    met = whole(known, "i").join(sent(several), ["i_key", "i_no"]).join(sent(whole(asked, "q")), ["q_key", "q_no"])
    zoom, turn = F.col("q_scale") / F.col("i_scale"), F.col("i_angle") - F.col("q_angle")
    x = F.col("i_x") - zoom * (F.cos(turn) * F.col("q_x") - F.sin(turn) * F.col("q_y"))
    y = F.col("i_y") - zoom * (F.sin(turn) * F.col("q_x") + F.cos(turn) * F.col("q_y"))
    cell = {"ratio": F.floor(3 * F.log2(zoom) + 0.25), "turn": F.floor(turn * TURNS / (2 * np.pi)), "x": F.floor(x / CELL), "y": F.floor(y / CELL)}
    points = [F.col(f"{s}_{c}").cast("double").alias(f"{s}_{c}") for s in "qi" for c in "xy"]
    # A repeated row of an image has all its matches once more.
    met = met.select("q_key", "i_key", "n", "q_no", "i_no", *points, *[c.alias(k) for k, c in cell.items()]).distinct()
    return stored(met.drop("q_no", "i_no"), "met")


#: Each match votes for its cell and the next ones, so one at an edge counts.
NEAR = [(z, k, i, j) for z in (0, 1) for k in (0, 1) for i in (0, 1) for j in (0, 1)]
AGREED = "q_key long, i_key long, votes long, p double, q double, dx double, dy double"
#: Matches of two images that are taken into memory at once.
MOST_MATCHES = 10_000


def _agreed(met: pd.DataFrame) -> pd.DataFrame:
    """(q_key, i_key, votes, p, q, dx, dy) of the cell with the most votes, of those of
    all pairs of images in met, in which the matches of a pair lie together."""
    q_key, i_key, q_x, q_y, i_x, i_y = (met[c].to_numpy() for c in ("q_key", "i_key", "q_x", "q_y", "i_x", "i_y"))
    pair = np.cumsum(np.r_[0, (np.diff(q_key) != 0) | (np.diff(i_key) != 0)])
    first = np.searchsorted(pair, np.arange(pair[-1] + 1))
    near = np.array(NEAR)[:, :, None]
    ratio, turn, x, y = (met[c].to_numpy()[None] + near[:, k] for k, c in enumerate(("ratio", "turn", "x", "y")))
    keys = [np.tile(pair, len(NEAR)), ratio.ravel(), (turn % TURNS).ravel(), x.ravel(), y.ravel()]
    order = np.lexsort(keys[::-1])
    keys = [k[order] for k in keys]
    starts = np.r_[True, np.any([np.diff(k) != 0 for k in keys], axis=0)]
    cell, of = np.cumsum(starts) - 1, order % len(pair)
    starts = np.flatnonzero(starts)

    def points(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Distinct points of each cell."""
        no = np.unique(np.c_[a, b], axis=0, return_inverse=True)[1].ravel()
        return np.bincount(np.unique(cell * (no.max() + 1) + no[of]) // (no.max() + 1), minlength=len(starts))

    votes = np.minimum(points(q_x, q_y), points(i_x, i_y))
    # The least-squares fit of (i_x, i_y) = (p x - q y + dx, q x + p y + dy).
    n = np.diff(np.r_[starts, len(of)])
    sx, sy, su, sv, sr, sp, sq = (np.add.reduceat(v[of], starts) for v in (q_x, q_y, i_x, i_y, q_x * q_x + q_y * q_y, q_x * i_x + q_y * i_y, q_x * i_y - q_y * i_x))
    den = sr - (sx * sx + sy * sy) / n
    good = np.flatnonzero((votes >= LEAST_VOTES) & (den > 1))
    # Of the cells with the most votes the last one.
    good = good[np.lexsort((good, votes[good], keys[0][starts[good]]))]
    of_pair = keys[0][starts[good]]
    good = good[np.diff(np.r_[of_pair, -1]) != 0]
    n, sx, sy, su, sv, sp, sq, den = (v[good] for v in (n, sx, sy, su, sv, sp, sq, den))
    p, q = (sp - (sx * su + sy * sv) / n) / den, (sq - (sx * sv - sy * su) / n) / den
    at = first[keys[0][starts[good]]]
    return pd.DataFrame({"q_key": q_key[at], "i_key": i_key[at], "votes": votes[good], "p": p, "q": q, "dx": (su - p * sx + q * sy) / n, "dy": (sv - q * sx - p * sy) / n})


def _agree(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    rest = None
    for frame in frames:
        if not len(frame):
            continue
        frame = frame if rest is None else pd.concat([rest, frame], ignore_index=True)
        last = (frame["q_key"].to_numpy() == frame["q_key"].iat[-1]) & (frame["i_key"].to_numpy() == frame["i_key"].iat[-1])
        rest, whole = frame[last], frame[~last]  # the last pair may go on
        if len(whole):
            yield _agreed(whole)
    if rest is not None:
        yield _agreed(rest)


def _agreed_spread(met: DataFrame) -> DataFrame:
    """The same as _agreed() for pairs of images with too many matches for the memory of
    a task, whose cells are counted one by one."""
    cells = F.explode(F.array(*[F.struct((F.col("ratio") + z).alias("ratio"), F.pmod(F.col("turn") + k, F.lit(TURNS)).alias("turn"), (F.col("x") + i).alias("x"), (F.col("y") + j).alias("y")) for z, k, i, j in NEAR]))
    votes = met.select("q_key", "i_key", cells.alias("cell"), "q_x", "q_y", "i_x", "i_y")

    def total(of: str) -> Column:
        return F.sum(F.expr(of))

    sums = {"n": F.count("*"), "sx": total("q_x"), "sy": total("q_y"), "su": total("i_x"), "sv": total("i_y"), "sr": total("q_x * q_x + q_y * q_y"), "sp": total("q_x * i_x + q_y * i_y"), "sq": total("q_x * i_y - q_y * i_x")}
    counted = votes.groupBy("q_key", "i_key", "cell").agg(F.countDistinct("q_x", "q_y").alias("votes"), F.countDistinct("i_x", "i_y").alias("_i"), *[c.alias(k) for k, c in sums.items()])
    counted = counted.withColumn("votes", F.least("votes", "_i")).withColumn("den", F.expr("sr - (sx * sx + sy * sy) / n")).where((F.col("votes") >= LEAST_VOTES) & (F.col("den") > 1))
    counted = counted.withColumn("p", F.expr("(sp - (sx * su + sy * sv) / n) / den")).withColumn("q", F.expr("(sq - (sx * sv - sy * su) / n) / den"))
    counted = counted.withColumn("dx", F.expr("(su - p * sx + q * sy) / n")).withColumn("dy", F.expr("(sv - q * sx - p * sy) / n"))
    return counted.groupBy("q_key", "i_key").agg(F.max_by(F.struct("votes", "p", "q", "dx", "dy"), F.struct("votes", "cell")).alias("b")).select("q_key", "i_key", "b.*")


def _agreeing(met: DataFrame) -> DataFrame:
    """(q_key, i_key, votes, p, q, dx, dy): what most matches of two images agree on."""
    few = F.col("n") <= MOST_MATCHES
    best = met.where(few).drop("n").repartition("q_key", "i_key").sortWithinPartitions("q_key", "i_key").mapInPandas(_agree, AGREED)
    many = met.where(~few)
    return best if many.isEmpty() else best.union(_agreed_spread(many))


def edited_copies(queries: DataFrame, images: DataFrame) -> DataFrame:
    """(query_id, class_id, copies, votes): the classes of equal images that each
    query image shows a part or an edit of. class_id is the least id of the class;
    votes are the query's corners that agree on how the one lies in the other.

    queries: (query_id, image); images: (image_id, image). Null ids and images and
    what cannot be decoded match nothing (unreadable() names them). Images without
    corners, or of fewer than 23 pixels in height or width, match nothing. Of
    repeated queries with one id the least image counts; other columns are ignored;
    empty tables give an empty result."""
    known = images.where("image_id is not null and image is not null").select(F.col("image_id").cast("long"), "image", F.sha2("image", 256).alias("same"))
    # Pictures stay where they are: only their hashes are grouped.
    classes = known.groupBy("same").agg(F.min("image_id").alias("key"), F.countDistinct("image_id").alias("copies"))
    # One id may stand for several images; it is the class of one of them.
    classes = stored(classes.groupBy("key").agg(F.min_by("copies", "same").alias("copies"), F.min("same").alias("same")), "classes")
    pictured = known.join(sent(classes.select("same", "key")), "same").where("image_id = key").select("key", "image")
    asked = queries.where("query_id is not null and image is not null").groupBy(F.col("query_id").cast("long").alias("key")).agg(F.min("image").alias("image"))
    asked = stored(asked.withColumn("same", F.sha2("image", 256)), "asked")
    firsts = stored(asked.groupBy("same").agg(F.min("key").alias("q_key")), "firsts")
    alike = stored(asked.select("key", "same").join(sent(firsts), "same").select("q_key", F.col("key").alias("query_id")), "alike")
    asked = asked.join(sent(firsts.select(F.col("q_key").alias("key"))), "key").select("key", "image")
    described = stored(descriptors(asked), "q"), stored(descriptors(pictured), "i")
    best = stored(_agreeing(_placed(_meeting(*described), *described)), "best")
    shown = pictured.select(F.col("key").alias("i_key"), F.col("image").alias("i_image")).join(sent(best), "i_key")
    shown = shown.join(asked.select(F.col("key").alias("q_key"), F.col("image").alias("q_image")), "q_key")
    good = shown.select("q_key", "i_key", "votes", "p", "q", "dx", "dy", "q_image", "i_image").mapInPandas(_confirm, "q_key long, i_key long, votes long")
    named = classes.select(F.col("key").alias("i_key"), "copies")
    return good.distinct().join(named, "i_key").join(sent(alike), "q_key").select("query_id", F.col("i_key").alias("class_id"), "copies", "votes")


EDITS = ("crop", "turn", "tilt", "half", "zoom")


def edited(image: np.ndarray, edit: str) -> np.ndarray:
    """A crop that is darker and of less contrast, a quarter turn, a tilt by 20
    degrees of the middle, three quarters of the height and two thirds of the width,
    or four fifths of the size."""
    h, w = image.shape
    if edit == "crop":
        return 10 + 0.8 * image[round(h * 0.09) : round(h * 0.91), round(w * 0.06) : round(w * 0.88)]
    if edit == "turn":
        return np.rot90(image)
    if edit == "half":
        return image[h // 4 :, : -(-2 * w // 3)]
    if edit == "zoom":
        return resized(image, 0.8)
    side, t = int(min(h, w) * 0.72), np.deg2rad(20)
    y, x = np.meshgrid(np.arange(side) - (side - 1) / 2, np.arange(side) - (side - 1) / 2, indexing="ij")
    return sampled(image, (h - 1) / 2 + np.cos(t) * y - np.sin(t) * x, (w - 1) / 2 + np.sin(t) * y + np.cos(t) * x)


def pictures(vectors: DataFrame, edit: str | None = None) -> DataFrame:
    """Draw each vector (vec_id, embedding) as a picture of 64 by 64 pixels, a
    smooth field with one bump per number; or an edited copy of it."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            images = []
            for v in frame["embedding"]:
                v = np.asarray([] if v is None else v, np.float64)
                v = v[np.isfinite(v)]
                if not len(v):
                    images.append(None)
                    continue
                side = int(np.ceil(np.sqrt(len(v))))
                grid = np.resize((v - v.mean()) / (v.std() + 1e-12), (side, side))
                at = np.linspace(0, side - 1, 64)
                y, x = np.meshgrid(at, at, indexing="ij")
                image = np.clip(128 + 45 * sampled(grid, y, x), 0, 255)
                images.append(encode_pgm(edited(image, edit) if edit else image))
            yield pd.DataFrame({"image_id": frame["vec_id"], "image": images})

    return vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>")).mapInPandas(run, "image_id long, image binary")
