"""Preprocessing steps on stacks of equally sized frames, one Arrow batch at a time.

A stack has the shape (frames, height, width). Whole-number steps give the same cells as the
SQL twins; sums of fractions are added in one fixed order, tap by tap. Borders follow public
OpenCV behaviour: blur and sharpen mirror without repeating the edge, adaptive threshold,
median and Sobel repeat it, morphology ignores what lies outside.
"""

import functools
import math
from typing import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from .kernels import GRID_TYPE, _labels

#: Cells that one step looks at together; larger batches are taken in slices.
SLICE = 1 << 20

# Low and high edge thresholds.
CANNY = {"canny_edges": (50, 150), "canny_low": (25, 100), "canny_high": (100, 220), "canny_high_200": (100, 200)}


def mirrored(i, n):
    period = max(2 * (n - 1), 1)
    return np.minimum(i % period, period - i % period)


def repeated(i, n):
    return np.clip(i, 0, n - 1)


def half_up(x):
    return np.floor(x + 0.5).astype(np.int32)


def taken(stack, axis, offset, border):
    """The stack moved by ``offset`` cells along an axis, places outside by ``border``."""
    n = stack.shape[axis]
    return np.take(stack, border(np.arange(n) + offset, n), axis=axis)


def weighted(stack, weights, border, zero):
    """Separable weighted sum along rows, then along columns."""
    radius = len(weights) // 2
    for axis in (2, 1):
        total = np.full(stack.shape, zero)
        for k, w in enumerate(weights):
            total += w * taken(stack, axis, k - radius, border)
        stack = total
    return stack


# --- colour, levels and histograms


def gray(stack):
    """G1: BT.601 luma of B, G, R in the last axis."""
    b, g, r = (stack[..., k].astype(np.int64) for k in range(3))
    return ((114 * b + 587 * g + 299 * r + 500) // 1000).astype(np.int32)


def histograms(stack):
    """Counts of the values 0..255 of each frame."""
    n = len(stack)
    at = stack.reshape(n, -1) + 256 * np.arange(n)[:, None]
    return np.bincount(at.ravel(), minlength=256 * n).reshape(n, 256)


def otsu_levels(stack):
    """Level of the largest between-class variance; the lowest wins a tie."""
    counts = histograms(stack)
    n, s = counts.cumsum(axis=1), (counts * np.arange(256)).cumsum(axis=1)
    total, weight = n[:, -1:], s[:, -1:]
    spread, pairs = (total * s - n * weight).astype(float), (n * (total - n)).astype(float)
    return np.divide(spread * spread, pairs, out=np.zeros_like(pairs), where=pairs > 0).argmax(axis=1)


def above(stack, level):
    return np.where(stack > level, 255, 0).astype(np.int32)


def otsu(stack):
    return above(stack, otsu_levels(stack)[:, None, None])


def looked_up(stack, tables):
    return tables[np.arange(len(stack))[:, None, None], stack]


def equalize(stack):
    """Stretch by the cumulative histogram; a flat frame stays as it is."""
    n = histograms(stack).cumsum(axis=1)
    total = n[:, -1:]
    first = n[np.arange(len(n)), (n > 0).argmax(axis=1)][:, None]
    spread = (total - first).astype(float)
    table = half_up((n - first) * 255.0 / np.maximum(spread, 1.0))
    return looked_up(stack, np.where(spread == 0, np.arange(256), table).astype(np.int32))


def clahe(stack, tiles=8, clip=2.0):
    """Per-tile clipped equalisation, blended bilinearly between tile centres."""
    n, h, w = stack.shape
    th, tw = -(-h // tiles), -(-w // tiles)
    area = th * tw
    limit = max(int(clip * area / 256.0), 1)
    padded = stack[:, mirrored(np.arange(th * tiles), h)][:, :, mirrored(np.arange(tw * tiles), w)]
    cut = padded.reshape(n, tiles, th, tiles, tw).transpose(0, 1, 3, 2, 4).reshape(n * tiles * tiles, th, tw)
    clipped = np.minimum(histograms(cut), limit).cumsum(axis=1)
    over = area - clipped[:, -1:]
    batch = over // 256
    rest = over - batch * 256
    stride = np.maximum(256 // np.maximum(rest, 1), 1)
    b = np.arange(256)
    tables = np.clip(half_up((clipped + batch * (b + 1) + np.minimum(rest, b // stride + 1)) * 255.0 / area), 0, 255)
    tables = tables.reshape(n, tiles, tiles, 256)
    fy, fx = np.arange(h) / th - 0.5, np.arange(w) / tw - 0.5
    y1, x1 = np.floor(fy).astype(int), np.floor(fx).astype(int)
    wy, wx = (fy - y1)[None, :, None], (fx - x1)[None, None, :]
    frame = np.arange(n)[:, None, None]

    def corner(dy, dx):
        return tables[frame, repeated(y1 + dy, tiles)[None, :, None], repeated(x1 + dx, tiles)[None, None, :], stack]

    upper = corner(0, 0) * (1.0 - wx) + corner(0, 1) * wx
    lower = corner(1, 0) * (1.0 - wx) + corner(1, 1) * wx
    return half_up(upper * (1.0 - wy) + lower * wy)


# --- neighbourhoods


def gaussian_5(stack):
    """Binomial weights 1 4 6 4 1 in both directions, rounded half up."""
    return ((weighted(stack.astype(np.int64), [1, 4, 6, 4, 1], mirrored, 0) + 128) // 256).astype(np.int32)


def gaussian_weights(size):
    sigma = 0.3 * ((size - 1) * 0.5 - 1) + 0.8
    raw = [math.exp(-((i - size // 2) ** 2) / (2 * sigma * sigma)) for i in range(size)]
    return [w / sum(raw) for w in raw]


def adaptive_threshold(stack, size=31, offset=5):
    """Brighter than the rounded Gaussian local mean minus ``offset``; even sizes grow by one."""
    means = weighted(stack.astype(float), gaussian_weights(size | 1), repeated, 0.0)
    return above(stack, half_up(means) - offset)


def sharpen(stack):
    """G9"""
    sides = sum(taken(stack, axis, d, mirrored) for axis in (1, 2) for d in (-1, 1))
    return np.clip(5 * stack - sides, 0, 255)


def box(stack, size, pick):
    """Minimum or maximum over a size x size box by doubling: log2(size) passes a direction."""
    low = -(size // 2)
    for axis in (2, 1):
        n, done, reach = stack.shape[axis], stack, 1
        at = repeated(np.arange(low, n + size - 1 + low), n)
        done = np.take(stack, at, axis=axis)
        while reach < size:
            step = min(reach, size - reach)
            end = done.shape[axis] - step
            done = pick(np.take(done, np.arange(end), axis=axis), np.take(done, np.arange(step, end + step), axis=axis))
            reach += step
        stack = done
    return stack


def dilate(stack, size):
    return box(stack, size, np.maximum)


def erode(stack, size):
    return box(stack, size, np.minimum)


def median(stack, size=5):
    """G15"""
    r = size // 2
    rows = [taken(stack.astype(np.int16), 1, d, repeated) for d in range(-r, r + 1)]
    near = np.stack([taken(row, 2, d, repeated) for row in rows for d in range(-r, r + 1)])
    return np.partition(near, size * size // 2, axis=0)[size * size // 2].astype(np.int32)


def bilateral(stack, size=9, sigma_value=75.0, sigma_space=75.0):
    """Mean over a disc, weighted by distance and by difference in value."""
    r = size // 2
    fall = np.exp(np.arange(256.0) ** 2 * (-1.0 / (2 * sigma_value * sigma_value)))
    top, bottom = np.zeros(stack.shape), np.zeros(stack.shape)
    for dy in range(-r, r + 1):
        row = taken(stack, 1, dy, mirrored)
        for dx in range(-r, r + 1):
            if dy * dy + dx * dx <= r * r:
                there = taken(row, 2, dx, mirrored)
                w = math.exp(-(dy * dy + dx * dx) / (2 * sigma_space * sigma_space)) * fall[np.abs(there - stack)]
                top += w * there
                bottom += w
    return half_up(top / bottom)


def resize_2x(stack):
    """Cubic (a = -0.75) enlargement by two; only two phases of weights occur."""

    def cubic(t):
        a = -0.75
        near = ((a + 2) * t - (a + 3)) * t * t + 1
        u, v = t + 1, 1 - t
        far = ((a * u - 5 * a) * u + 8 * a) * u - 4 * a
        near_right = ((a + 2) * v - (a + 3)) * v * v + 1
        return [far, near, near_right, 1 - far - near - near_right]

    out = stack.astype(float)
    for axis in (2, 1):
        # target 2i sits at source i - 0.25, target 2i + 1 at i + 0.25
        phases = []
        for first, weights in ((-2, cubic(0.75)), (-1, cubic(0.25))):
            total = np.zeros(out.shape)
            for k, w in enumerate(weights):
                total += w * taken(out, axis, first + k, repeated)
            phases.append(total)
        shape = list(out.shape)
        shape[axis] *= 2
        out = np.stack(phases, axis=axis + 1).reshape(shape)
    return np.clip(half_up(out), 0, 255)


def sobel(stack):
    """Horizontal and vertical 3x3 Sobel responses, the edge repeated."""

    def response(across, along):
        smooth = taken(stack, along, -1, repeated) + 2 * stack + taken(stack, along, 1, repeated)
        return taken(smooth, across, 1, repeated) - taken(smooth, across, -1, repeated)

    return response(2, 1), response(1, 2)


def canny(stack, low, high):
    """Sobel edges thinned along their gradient, weak ones kept beside strong ones.

    A cell stays when its magnitude |gx| + |gy| peaks along its gradient, which is taken as
    horizontal below 22.5 degrees, vertical above 67.5 and diagonal between.
    """
    gx, gy = sobel(stack)
    ax, ay = np.abs(gx), np.abs(gy)
    m = ax + ay
    rim = np.pad(m, ((0, 0), (1, 1), (1, 1)))
    h, w = stack.shape[1:]
    at = lambda dy, dx: rim[:, 1 + dy : 1 + dy + h, 1 + dx : 1 + dx + w]
    tan_22 = math.tan(math.radians(22.5))
    flat, steep = ay < ax * tan_22, ay > ax * (tan_22 + 2.0)
    other = (gx < 0) != (gy < 0)
    diagonal = np.where(other, (m > at(-1, 1)) & (m > at(1, -1)), (m > at(-1, -1)) & (m > at(1, 1)))
    peak = np.where(flat, (m > at(0, -1)) & (m >= at(0, 1)), np.where(steep, (m > at(-1, 0)) & (m >= at(1, 0)), diagonal))
    kept = (m > low) & peak
    label = _labels(kept, 8) + np.where(kept, (np.arange(len(stack)) * h * w)[:, None, None], 0)
    strong = np.zeros(stack.size + 1, bool)
    strong[label[kept & (m > high)]] = True
    return np.where(kept & strong[label], 255, 0).astype(np.int32)


# --- steps by name


def stencil(step):
    """The step as a function of a stack, or None for a name that is not one of these."""
    fixed = {
        "grayscale": lambda s: s, "gaussian_blur": gaussian_5, "otsu_threshold": otsu, "adaptive_threshold": adaptive_threshold,
        "adaptive_threshold_11_2": functools.partial(adaptive_threshold, size=11, offset=2), "histogram_equalization": equalize,
        "clahe": clahe, "invert": lambda s: 255 - s, "sharpen": sharpen, "bilateral": bilateral, "resize_2x": resize_2x,
    }
    if step in fixed:
        return fixed[step]
    if step in CANNY:
        return functools.partial(canny, low=CANNY[step][0], high=CANNY[step][1])
    name, _, number = step.rpartition("_")
    sized = {
        "threshold": lambda s, n: above(s, n), "adaptive_threshold": lambda s, n: adaptive_threshold(s, n), "median": median,
        "morph_close": lambda s, n: erode(dilate(s, n), n), "morph_open": lambda s, n: dilate(erode(s, n), n),
        "morph_gradient": lambda s, n: dilate(s, n) - erode(s, n),
    }
    if name in sized and number.isdigit():
        return functools.partial(lambda s, fn, n: fn(s, n), fn=sized[name], n=int(number))
    return None


def stacks(pixels, height, width, *more):
    """(rows, one-channel stack) of the frames of equal size and equal values of ``more``.

    Three interleaved values a cell are B, G, R and become gray; any other length is refused.
    """
    sizes = pd.DataFrame({"h": np.asarray(height), "w": np.asarray(width), "n": [len(p) for p in pixels], **{f"m{k}": np.asarray(c) for k, c in enumerate(more)}})
    for (h, w, n, *_), rows in sizes.groupby(list(sizes.columns)).groups.items():
        if n not in (h * w, 3 * h * w):
            raise ValueError(f"{n} values are no frame of {h} rows, {w} columns and one or three channels")
        rows = np.asarray(rows)
        for at in np.array_split(rows, 1 + len(rows) * n // SLICE):
            stack = np.stack([np.asarray(pixels.iloc[i]) for i in at]).astype(np.int32)
            yield at, stack.reshape(-1, h, w) if n == h * w else gray(stack.reshape(-1, h, w, 3))


def chain(lists):
    """Arrow UDF of (pixels, height, width, number): the frame after the steps of that list."""

    def run(pixels: pd.Series, height: pd.Series, width: pd.Series, number: pd.Series) -> pd.Series:
        out = [None] * len(pixels)
        for at, stack in stacks(pixels, height, width, number):
            for step in lists[int(number.iloc[at[0]])]:
                stack = stencil(step)(stack) if stack.size else stack
            for i, frame in zip(at, stack):
                out[i] = frame.ravel()
        return pd.Series(out)

    return F.pandas_udf(run, GRID_TYPE)


def sliced(kernel, kind):
    """Arrow UDF of (pixels, height, width): the lists that ``kernel`` gives for a slice of the rows.

    A batch is taken in slices of about SLICE cells, and the lists of one are handed on before
    the next is begun. So a task holds one batch and the lists of one slice, however many
    frames a batch has.
    """

    def run(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for columns in batches:
            cells = columns[0].value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            starts = np.flatnonzero(np.diff((np.cumsum(cells) - cells) // SLICE, prepend=-1))
            for start, end in zip(starts, [*starts[1:], len(cells)]):
                yield kernel(*(c.slice(start, end - start).to_pandas() for c in columns))

    return F.arrow_udf(run, kind)


def lists(lengths, values):
    """Arrow lists of these lengths over the values."""
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(lengths)), pa.int32()), values)


def edge_grid(low, high):
    """Arrow UDF of (pixels, height, width): the edge cells of a frame."""

    def run(pixels, height, width):
        out = [None] * len(pixels)
        for at, stack in stacks(pixels, height, width):
            for i, frame in zip(at, canny(stack, low, high) if stack.size else stack):
                out[i] = frame.ravel()
        return lists([len(frame) for frame in out], pa.array(np.concatenate(out), pa.int32()))

    return sliced(run, GRID_TYPE)
