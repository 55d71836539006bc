"""Features of frames, measured on stacks of equal size, and what is left as Column expressions."""

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .columns import round6
from .kernels import BOXES_TYPE, GRID_TYPE, _boxes
from .stencils import histograms, lists, mirrored, otsu, sliced, stacks, taken


def _nlogn(counts):
    return (counts * np.log2(np.maximum(counts, 1))).sum(axis=-1)


def _variance(values):
    """Population variance of whole numbers from exact sums."""
    flat = values.reshape(len(values), -1).astype(np.int64)
    n, s = float(flat.shape[1]), flat.sum(axis=1).astype(float)
    return (n * (flat * flat).sum(axis=1) - s * s) / (n * n)


def entropy_texture(stack):
    """Histogram entropy, population deviation, variance of the 4-neighbour Laplacian."""
    n = float(stack[0].size)
    sides = sum(taken(stack, axis, d, mirrored) for axis in (1, 2) for d in (-1, 1))
    return {
        "entropy": np.log2(n) - _nlogn(histograms(stack)) / n, "contrast_std": np.sqrt(_variance(stack)),
        "laplacian_variance": _variance(sides - 4 * stack)}


def box_sums(stack, size):
    """Sums over a size x size box with mirrored edges, from running sums in each direction."""
    r = size // 2
    for axis in (2, 1):
        n = stack.shape[axis]
        wide = np.take(stack, mirrored(np.arange(-r, n + size - 1 - r), n), axis=axis).cumsum(axis=axis)
        wide = np.concatenate([np.zeros_like(np.take(wide, [0], axis=axis)), wide], axis=axis)
        stack = np.take(wide, np.arange(size, size + n), axis=axis) - np.take(wide, np.arange(n), axis=axis)
    return stack


def speckle(stack, window=7):
    """Local contrast K = deviation / mean over a box, mirrored edges; box sums are exact."""
    size = max(3, window)
    area, wide = float(size * size), stack.astype(np.int64)
    s, q = box_sums(wide, size).astype(float), box_sums(wide * wide, size).astype(float)
    v = np.maximum(0.0, (q * area - s * s) / (area * area))
    k = np.sqrt(v) / (s / area + 1e-6)
    mean = k.mean(axis=(1, 2))
    return {
        "contrast_mean": mean, "contrast_spread": np.sqrt(np.maximum(0.0, (k * k).mean(axis=(1, 2)) - mean * mean)),
        "variance_mean": v.mean(axis=(1, 2)), "saturated_fraction": (stack >= 250).mean(axis=(1, 2))}


def pair_texture(stack, levels=16):
    """Texture of neighbour pairs (right and below), counted in both directions."""
    low, high = stack.min(axis=(1, 2), keepdims=True), stack.max(axis=(1, 2), keepdims=True)
    q = ((stack - low) * (levels - 1) // np.maximum(high - low, 1)).astype(np.int64)
    n, matrix = len(stack), np.zeros((len(stack), levels * levels))
    frame = (np.arange(n) * levels * levels)[:, None, None]
    for a, b in ((q[:, :, :-1], q[:, :, 1:]), (q[:, :-1], q[:, 1:])):
        for x, y in ((a, b), (b, a)):
            matrix += np.bincount((frame + x * levels + y).ravel(), minlength=matrix.size).reshape(matrix.shape)
    gap = np.abs(np.arange(levels)[:, None] - np.arange(levels)[None]).ravel().astype(float)
    total = matrix.sum(axis=1)
    some = np.maximum(total, 1.0)
    return {
        "contrast": (matrix * gap * gap).sum(axis=1) / some, "homogeneity": (matrix / (gap + 1.0)).sum(axis=1) / some,
        "energy": np.sqrt((matrix * matrix).sum(axis=1)) / some, "entropy": np.log2(some) - _nlogn(matrix) / some}


def measured(kernel, names, **options):
    """Arrow UDF of (pixels, height, width) giving a struct of one kernel's doubles; null without cells."""

    def run(pixels: pd.Series, height: pd.Series, width: pd.Series) -> pd.DataFrame:
        out = np.full((len(pixels), len(names)), np.nan)
        for at, stack in stacks(pixels, height, width):
            if stack.size:
                values = kernel(stack, **options)
                out[at] = np.column_stack([values[k] for k in names])
        return pd.DataFrame(out, columns=names)

    return F.pandas_udf(run, StructType([StructField(k, DoubleType()) for k in names]))


# What each kernel measures.
TEXTURE = ["entropy", "contrast_std", "laplacian_variance"]
SPECKLE = ["contrast_mean", "contrast_spread", "variance_mean", "saturated_fraction"]
PAIRS = ["contrast", "homogeneity", "energy", "entropy"]


def rounded(struct, names):
    """The struct's fields rounded to six decimals, as a list of columns."""
    return [round6(F.col(f"{struct}.{k}")).alias(k) for k in names]


def binary(stack):
    """0/1 frames are scaled to 0/255 first, then Otsu."""
    tops = stack.max(axis=(1, 2), keepdims=True)
    return otsu(np.where(tops <= 1, stack * 255, stack))


@F.pandas_udf(GRID_TYPE)
def binary_grid(pixels: pd.Series, height: pd.Series, width: pd.Series) -> pd.Series:
    """T2"""
    out = [None] * len(pixels)
    for at, stack in stacks(pixels, height, width):
        for i, frame in zip(at, binary(stack) if stack.size else stack):
            out[i] = frame.ravel()
    return pd.Series(out)


def _dark_boxes(pixels, height, width):
    lengths, rows, parts = np.zeros(len(pixels), int), [], []
    for at, stack in stacks(pixels, height, width):
        if stack.size:
            lengths[at], columns = _boxes(binary(stack) == 0)
            rows.append(np.repeat(at, lengths[at]))
            parts.append(columns)
    order = np.argsort(np.concatenate([*rows, np.empty(0, int)]), kind="stable")
    found = [np.concatenate(c)[order] for c in zip(*parts)] or [np.empty(0)] * len(_BOX)
    return lists(lengths, pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(found, _BOX.values())], list(_BOX)))


_BOX = {**{c: pa.int32() for c in ("label", "x", "y", "w", "h")}, "area": pa.int64(), "outer": pa.bool_()}
#: Arrow UDF of (pixels, height, width): boxes of the dark regions of a frame's binary mask.
dark_boxes = sliced(_dark_boxes, BOXES_TYPE)


def bright_share(px) -> Column:
    """Share of cells above zero."""
    return round6(F.size(F.filter(px, lambda v: v > 0)) / F.size(px))
