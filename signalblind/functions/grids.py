"""Steps on packed grids: ``pixels array<int>`` (row-major), ``height``, ``width``.

Every step looks only inside its own row, so a chain of steps never shuffles.
Borders follow public OpenCV behaviour: blur and sharpen mirror without repeating
the edge, adaptive threshold, median and Sobel repeat it, morphology ignores
what lies outside.
"""


from pyspark.sql import Column, functions as F

from .columns import let


def _range(n: Column) -> Column:
    return F.sequence(F.lit(0), n - 1)


def grid(height: Column, width: Column, cell) -> Column:
    """Build a packed grid from ``cell(y, x)``."""
    return F.flatten(F.transform(_range(height), lambda y: F.transform(_range(width), lambda x: cell(y, x))))


def mirrored(i: Column, n: Column) -> Column:
    period = F.greatest(2 * (n - 1), F.lit(1))
    return F.least(F.pmod(i, period), period - F.pmod(i, period))


def repeated(i: Column, n: Column) -> Column:
    return F.least(F.greatest(i, F.lit(0)), n - 1)


def half_up(value: Column) -> Column:
    return F.floor(value + F.lit(0.5)).cast("int")


def to_byte(value: Column) -> Column:
    return F.least(F.greatest(value, F.lit(0)), F.lit(255))


# --- colour and pointwise ------------------------------------------------------------


def channels(px, height, width) -> Column:
    """Values per cell, 1 or 3; any other length is an error."""
    n = F.size(px)
    refused = F.raise_error(F.concat(n.cast("string"), F.lit(" values are no frame of "), height.cast("string"), F.lit(" rows, "), width.cast("string"), F.lit(" columns and one or three channels")))
    return F.when(n == height * width, F.lit(1)).when(n == 3 * height * width, F.lit(3)).otherwise(refused.cast("int"))


def one_channel(px, height, width) -> Column:
    """G1: BT.601 luma of interleaved B, G, R values; one channel passes through."""
    gray = grid(height, width, lambda y, x: F.floor((
        114 * px[(y * width + x) * 3] + 587 * px[(y * width + x) * 3 + 1] + 299 * px[(y * width + x) * 3 + 2] + 500
    ) / 1000).cast("int"))
    return F.when(channels(px, height, width) == 1, px).otherwise(gray)


def moved(px, height, width, to_height, to_width, source) -> Column:
    """Cells at (y, x) taken whole, with all their channels, from cell number ``source(y, x)``."""
    plain = grid(to_height, to_width, lambda y, x: px[source(y, x)])
    interleaved = F.flatten(grid(to_height, to_width, lambda y, x: F.slice(px, source(y, x) * 3 + 1, 3)))
    return F.when(channels(px, height, width) == 1, plain).otherwise(interleaved)


def invert(px) -> Column:
    """G8"""
    return F.transform(px, lambda v: F.lit(255) - v)


def threshold(px, level) -> Column:
    """G4"""
    return F.transform(px, lambda v: F.when(v > level, F.lit(255)).otherwise(F.lit(0)))


# --- histogram based -----------------------------------------------------------------


def cumulative_histogram(px) -> Column:
    """Distinct values in order, each with the number and the sum of cells up to it.

    One pass over the sorted values; at most 256 entries come out.
    """
    start = F.struct(
        F.array().cast("array<struct<v:int,n:bigint,s:bigint>>").alias("done"),
        F.lit(-1).alias("v"), F.lit(0).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("s"),
    )

    def closed(state):
        entry = F.struct(state["v"].alias("v"), state["n"].alias("n"), state["s"].alias("s"))
        return F.when(state["n"] == 0, state["done"]).otherwise(F.concat(state["done"], F.array(entry)))

    def step(state, v):
        return F.struct(
            F.when(v == state["v"], state["done"]).otherwise(closed(state)).alias("done"),
            v.alias("v"), (state["n"] + 1).alias("n"), (state["s"] + v).alias("s"),
        )

    return F.aggregate(F.sort_array(px), start, step, closed)


def otsu_level(px) -> Column:
    """Threshold with the largest between-class variance; the lowest one wins a tie."""

    def pick(levels):
        last = F.element_at(levels, -1)
        total, weight = last["n"], last["s"]

        def score(entry):
            spread = (total * entry["s"] - entry["n"] * weight).cast("double")
            pairs = (entry["n"] * (total - entry["n"])).cast("double")
            return F.when(pairs > 0, spread * spread / pairs).otherwise(F.lit(0.0))

        start = F.struct(F.lit(0.0).alias("best"), F.lit(0).alias("v"))

        def step(state, entry):
            return let(score(entry), lambda s: F.when(
                s > state["best"], F.struct(s.alias("best"), entry["v"].alias("v"))
            ).otherwise(state))

        return F.aggregate(levels, start, step, lambda state: state["v"])

    return let(cumulative_histogram(px), pick)


def otsu(px) -> Column:
    """G3"""
    return let(otsu_level(px), lambda level: threshold(px, level))


# --- bit masks -----------------------------------------------------------------------


def pack_bits(mask) -> Column:
    """Cells above zero as bits of 64-bit words, first cell highest: 1/32 of the bytes."""
    words = F.sequence(F.lit(0), F.ceil(F.size(mask) / 64).cast("int") - 1)
    return F.transform(words, lambda k: F.aggregate(
        F.slice(mask, k * 64 + 1, 64), F.lit(0).cast("bigint"),
        lambda a, v: F.shiftleft(a, 1).bitwiseOR(F.when(v > 0, 1).otherwise(0).cast("bigint"))))


def bit_at(words, i, cells) -> Column:
    """Cell ``i`` of packed words that hold ``cells`` cells."""
    word = F.floor(i / 64).cast("int")
    last = F.least(F.lit(64), cells - word * 64) - 1
    return F.call_function("shiftrightunsigned", words[word], last - i % 64).bitwiseAND(F.lit(1).cast("bigint"))


def bit_overlap(left, right) -> Column:
    """Intersection over union of two packed masks of one shape; an empty union gives 0."""
    count = lambda op: F.aggregate(F.zip_with(left, right, lambda a, b: F.bit_count(op(a, b))), F.lit(0), lambda a, n: a + n)
    both = count(lambda a, b: a.bitwiseAND(b))
    either = count(lambda a, b: a.bitwiseOR(b))
    return F.when(either == 0, F.lit(0.0)).otherwise(both / F.greatest(either, F.lit(1)))


def area_resize(px, height, width, out_h, out_w) -> Column:
    """Mean of the covered area of each target cell, rounded half up."""

    def overlap(start, end, k):
        return F.greatest(F.least(end, k + 1.0) - F.greatest(start, k + F.lit(0.0)), F.lit(0.0))

    def covered(i, size, out):
        first = F.floor(i * size / out).cast("int")
        last = F.least(F.ceil((i + 1) * size / out).cast("int"), size) - 1
        return F.sequence(first, F.greatest(last, first))

    def cell(i, j):
        y0, y1 = i * height / out_h, (i + 1) * height / out_h
        x0, x1 = j * width / out_w, (j + 1) * width / out_w
        total = F.aggregate(covered(i, height, out_h), F.lit(0.0), lambda a, y: a + overlap(y0, y1, y) * F.aggregate(
            covered(j, width, out_w), F.lit(0.0), lambda b, x: b + overlap(x0, x1, x) * px[y * width + x]))
        return half_up(total / ((y1 - y0) * (x1 - x0)))

    # A grid of the target's size stays as it is.
    same = (height == out_h) & (width == out_w)
    return F.when(same, px.cast("array<int>")).otherwise(grid(F.lit(out_h), F.lit(out_w), cell))
