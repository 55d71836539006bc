"""Arrow UDFs for the three steps Spark has no built-in for: FFT, phase, labels.

Each works on one Arrow batch of packed grids, stacked by shape, and nothing else.
"""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, IntegerType, LongType, StructField, StructType

GRID_TYPE = ArrayType(IntegerType())
BOXES_TYPE = ArrayType(StructType(
    [StructField(c, IntegerType()) for c in ("label", "x", "y", "w", "h")]
    + [StructField("area", LongType()), StructField("outer", BooleanType())]))
SPECTRUM_TYPE = StructType([StructField(c, DoubleType()) for c in ("prominence", "radius", "angle", "ring")])
SHIFT_TYPE = StructType([StructField(c, DoubleType()) for c in ("shift_x", "shift_y", "shift_magnitude", "response")])


@F.pandas_udf(GRID_TYPE)
def unpack_bytes(data: pd.Series) -> pd.Series:
    """IO2: bytes as integers 0..255."""
    return data.map(lambda b: np.frombuffer(b, dtype="uint8").astype("int32"))


def _stacks(heights, widths, *columns):
    """Yield (positions, stacked arrays) for every grid shape in the batch."""
    shapes = pd.DataFrame({"h": np.asarray(heights), "w": np.asarray(widths)})
    for (h, w), rows in shapes.groupby(["h", "w"]).groups.items():
        at = np.asarray(rows)
        yield at, [np.stack([np.asarray(col.iloc[i]) for i in at]).reshape(-1, h, w) for col in columns]


def _labels(mask, connectivity):
    """Smallest cell index of each component, -1 outside; all grids of a stack at once."""
    n, h, w = mask.shape
    cells = n * h * w
    own = np.where(mask, np.arange(cells).reshape(mask.shape), cells)
    steps = [(0, 1), (1, 0)] + ([(1, 1), (1, -1)] if connectivity == 8 else [])
    label = own
    while True:
        spread = np.full((n, h + 2, w + 2), cells)
        spread[:, 1:-1, 1:-1] = label
        best = label
        for dy, dx in steps:
            for sy, sx in ((dy, dx), (-dy, -dx)):
                best = np.minimum(best, spread[:, 1 + sy:1 + sy + h, 1 + sx:1 + sx + w])
        best = np.where(mask, best, cells)
        lowered = np.append(best.ravel(), cells)
        # A component root takes over the best label any of its cells has seen.
        np.minimum.at(lowered, label.ravel(), best.ravel())
        jumped = lowered[lowered[lowered]][:cells].reshape(mask.shape)
        if np.array_equal(jumped, label):
            offset = (np.arange(n) * h * w)[:, None, None]
            return np.where(mask, label - offset, -1)
        label = jumped


def _boxes(dark):
    """Bounding boxes of the 8-connected regions of a stack: boxes per grid, and their columns.

    ``outer`` tells whether background 4-connected to the border touches the region.
    """
    n, h, w = dark.shape
    label = _labels(dark, 8)
    rim = np.pad(~dark, ((0, 0), (1, 1), (1, 1)), constant_values=True)
    open_air = _labels(rim, 4) == 0
    touched = np.zeros_like(dark)
    for dy, dx in ((0, 1), (2, 1), (1, 0), (1, 2)):
        touched |= open_air[:, dy:dy + h, dx:dx + w]
    grid, y, x = np.nonzero(dark)
    found, at = np.unique(grid * (h * w) + label[grid, y, x], return_inverse=True)
    k = len(found)
    top, left, bottom, right = np.full(k, h), np.full(k, w), np.full(k, -1), np.full(k, -1)
    np.minimum.at(top, at, y), np.minimum.at(left, at, x)
    np.maximum.at(bottom, at, y), np.maximum.at(right, at, x)
    area, outer = np.bincount(at, minlength=k), np.bincount(at, weights=touched[grid, y, x], minlength=k) > 0
    per_grid = np.bincount(found // (h * w), minlength=n)
    return per_grid, [found % (h * w), left, top, right - left + 1, bottom - top + 1, area, outer]


def _spectrum(stack):
    n, h, w = stack.shape
    if h < 4 or w < 4:
        return np.zeros((n, 4))
    gray = stack - stack.mean(axis=(1, 2), keepdims=True)
    taper = np.outer(np.hanning(h), np.hanning(w))
    magnitude = np.log1p(np.abs(np.fft.fftshift(np.fft.fft2(gray * taper), axes=(1, 2))))
    cy, cx = h // 2, w // 2
    yy, xx = np.indices((h, w))
    radius = np.hypot(xx - cx, yy - cy)
    side = min(h, w)
    outer = radius > max(3, side * 0.04)
    if not outer.any():
        return np.zeros((n, 4))
    # Real input mirrors every peak; looking at one of each mirrored pair settles the tie.
    mirror = ((2 * cy - yy) % h) * w + (2 * cx - xx) % w
    first = outer & (yy * w + xx <= mirror)
    flat = np.where(first, magnitude, -1.0).reshape(n, -1)
    peak = flat.argmax(axis=1)
    background = magnitude[:, outer]
    top = flat[np.arange(n), peak]
    prominence = np.maximum(0.0, (top - background.mean(axis=1)) / (background.std(axis=1) + 1e-6))
    peak_radius = radius.ravel()[peak]
    angle = np.degrees(np.arctan2(peak // w - cy, peak % w - cx))
    ring = np.abs(radius[None] - peak_radius[:, None, None]) <= max(2.0, side * 0.015)
    total = background.sum(axis=1)
    share = (magnitude * ring).sum(axis=(1, 2)) / np.where(total == 0, 1.0, total)
    return np.stack([prominence, peak_radius / max(1.0, side / 2.0), angle, share], axis=1)


@F.pandas_udf(SPECTRUM_TYPE)
def spectrum_peak(pixels: pd.Series, height: pd.Series, width: pd.Series) -> pd.DataFrame:
    """Strongest off-centre peak of the tapered 2-D spectrum and its ring share."""
    out = np.zeros((len(pixels), 4))
    for at, (stack,) in _stacks(height, width, pixels):
        out[at] = _spectrum(stack.astype("float64"))
    return pd.DataFrame(out, columns=["prominence", "radius", "angle", "ring"])


def window_power(size):
    """Arrow UDF of (places, values) giving the power at the frequencies 1 .. size / 2 of a window."""

    def run(places: pd.Series, values: pd.Series) -> pd.Series:
        grid = np.zeros((len(places), size))
        for row, at, v in zip(grid, places, values):
            row[np.asarray(at)] = np.asarray(v) - np.mean(v)
        power = np.abs(np.fft.rfft(grid, axis=1)[:, 1:]) ** 2
        return pd.Series(list(power))

    return F.pandas_udf(run, ArrayType(DoubleType()))


def _fast_size(n):
    """Smallest length >= n whose only prime factors are 2, 3 and 5."""
    while True:
        rest = n
        for p in (2, 3, 5):
            while rest % p == 0:
                rest //= p
        if rest == 1:
            return n
        n += 1


def _shift(reference, moving):
    n, h, w = reference.shape
    size = (_fast_size(h), _fast_size(w))
    cross = np.fft.fft2(reference, size) * np.conj(np.fft.fft2(moving, size))
    surface = np.fft.fftshift(np.fft.ifft2(cross / (np.abs(cross) + np.finfo("float64").eps)).real, axes=(1, 2))
    frame, peak = np.arange(n), surface.reshape(n, -1).argmax(axis=1)
    # the 5 x 5 cells around each peak; places outside weigh nothing
    yy, xx = (p[:, None] + np.arange(-2, 3) for p in np.divmod(peak, size[1]))
    there = ((yy >= 0) & (yy < size[0]))[:, :, None] & ((xx >= 0) & (xx < size[1]))[:, None, :]
    near = surface[frame[:, None, None], yy.clip(0, size[0] - 1)[:, :, None], xx.clip(0, size[1] - 1)[:, None, :]] * there
    mass = near.sum(axis=(1, 2))
    scale = mass + np.finfo("float64").eps
    dx = size[1] / 2.0 - (xx[:, None, :] * near).sum(axis=(1, 2)) / scale
    dy = size[0] / 2.0 - (yy[:, :, None] * near).sum(axis=(1, 2)) / scale
    return np.stack([dx, dy, np.hypot(dx, dy), mass], axis=1)


@F.pandas_udf(SHIFT_TYPE)
def phase_shift(reference: pd.Series, moving: pd.Series, height: pd.Series, width: pd.Series) -> pd.DataFrame:
    """Sub-pixel shift by phase correlation with a 5x5 centroid; null reference -> zeros."""
    out = np.zeros((len(moving), 4))
    have = np.flatnonzero(reference.notna().to_numpy())
    if len(have):
        picked = [s.iloc[have].reset_index(drop=True) for s in (height, width, reference, moving)]
        for at, (ref, mov) in _stacks(*picked):
            out[have[at]] = _shift(ref.astype("float64"), mov.astype("float64"))
    return pd.DataFrame(out.round(6) + 0.0, columns=["shift_x", "shift_y", "shift_magnitude", "response"])
