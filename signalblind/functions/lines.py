"""Straight lines in edge frames: votes by angle and distance, and the runs on well-voted lines."""

import math

import numpy as np
import pyarrow as pa
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StructField, StructType

from .stencils import SLICE, lists, sliced, stacks

COS, SIN = (np.array([fn(math.radians(d)) for d in range(180)]) for fn in (math.cos, math.sin))
_LINE = [StructField("theta", IntegerType()), StructField("rho", IntegerType()), StructField("votes", LongType())]
VOTES_TYPE = ArrayType(StructType(_LINE))
LINES_TYPE = ArrayType(StructType(_LINE + [StructField("length", DoubleType())]))


def _aimed(y, x, h, w):
    """The line of every edge cell at every angle, in blocks of angles, with the votes of a block's lines.

    A line is its distance from the corner, moved by the width to be positive, plus a range
    of numbers per angle.
    """
    span = h + 2 * w + 2
    step = max(1, SLICE // max(1, len(y)))
    for first in range(0, 180, step):
        theta = np.arange(first, min(180, first + step))
        line = np.floor(x[:, None] * COS[theta] + y[:, None] * SIN[theta] + 0.5).astype(np.int64) + w + span * np.arange(len(theta))
        yield theta, span, line, np.bincount(line.ravel(), minlength=span * len(theta))


def _joined(parts, n):
    """Columns of the parts one after the other; ``n`` empty ones without any."""
    return [np.concatenate(p) for p in zip(*parts)] if parts else [np.empty(0, int)] * n


def frame_votes(edge, votes):
    """Columns theta, rho, votes of the lines of one frame that get at least ``votes``, 1 degree and 1 cell apart."""
    y, x = np.nonzero(edge)
    found = []
    for theta, span, _, counts in _aimed(y, x, *edge.shape) if len(y) >= votes else ():
        at = np.flatnonzero(counts >= max(1, votes))
        found.append((theta[at // span], at % span - edge.shape[1], counts[at]))
    return _joined(found, 3)


def frame_lines(edge, votes, max_gap, k):
    """Columns theta, rho, votes, length of the best-voted straight runs of one frame.

    The cells of a line are walked in its direction; a gap of more than ``max_gap`` ends a
    run. A run is at least 10 cells long, or a twentieth of the frame's shorter side.
    """
    y, x = np.nonzero(edge)
    h, w = edge.shape
    parts = []
    for theta, span, line, counts in _aimed(y, x, h, w) if len(y) >= votes else ():
        cell, angle = np.nonzero(counts[line] >= votes)
        if not len(cell):
            continue
        on, cy, cx = line[cell, angle], y[cell], x[cell]
        along = cy * COS[theta[angle]] - cx * SIN[theta[angle]]
        order = np.lexsort((cx, cy, along, on))
        on, along, cy, cx = on[order], along[order], cy[order], cx[order]
        cuts = np.flatnonzero((np.diff(on) != 0) | (np.diff(along) > max_gap)) + 1
        start, end = np.append(0, cuts), np.append(cuts, len(on)) - 1
        parts.append((theta[on[start] // span], on[start] % span - w, counts[on[start]], np.hypot(cx[end] - cx[start], cy[end] - cy[start])))
    theta, rho, got, length = _joined(parts, 4)
    long = np.flatnonzero(length >= max(10, min(h, w) // 20))
    best = long[np.lexsort((long, rho[long], theta[long], -got[long]))][:k]
    return [c[best] for c in (theta, rho, got, length)]


def _per_frame(kernel, kind, **columns):
    def run(edges, height, width):
        out = [None] * len(edges)
        for at, stack in stacks(edges, height, width):
            for i, edge in zip(at, stack):
                out[i] = kernel(edge)
        found = [pa.array(np.concatenate(c), t) for c, t in zip(zip(*out), columns.values())]
        return lists([len(lines[0]) for lines in out], pa.StructArray.from_arrays(found, list(columns)))

    return sliced(run, kind)


_COLUMNS = {"theta": pa.int32(), "rho": pa.int32(), "votes": pa.int64()}


def vote_lists(votes):
    """Arrow UDF of (edge cells, height, width): the lines of a frame with their votes."""
    return _per_frame(lambda edge: frame_votes(edge, votes), VOTES_TYPE, **_COLUMNS)


def line_lists(votes=50, max_gap=8, k=100):
    """Arrow UDF of (edge cells, height, width): at most ``k`` runs of a frame, best first."""
    return _per_frame(lambda edge: frame_lines(edge, votes, max_gap, k), LINES_TYPE, **_COLUMNS, length=pa.float64())
