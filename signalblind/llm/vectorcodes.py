"""Product codes of vectors by exact integer k-means with norm-of-sum bounds.

Vectors are cut into parts, each part has a codebook, and rounds of assignment and averaging
refine it. A vector keeps, per part and group of entries, a lower bound of its distance to
every entry of the group but its own, and the number of the round in which that bound was
measured. The codebooks of all rounds are kept, so a bound of round s is worth its value less
the largest net way that an entry of the group has gone from round s to now. That norm of a
sum is never more than the sum of the norms of all steps, which other bounds subtract. Only
groups whose bound falls to the distance of the own entry are measured again, exactly.

Components are integers. Where all of them are small, sums of squares are exact in doubles;
rows and entries beyond that (:data:`SMALL`) are compared by whole numbers of any size.
"""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signalblind.session import cut, scratch_path, spread

SCALE = 1024
SMALL = float(1 << 22)
GROUP = 32
SLICE = 1 << 18
LABELS = 1 << 20
LIMB = 30
_MOST = (1 << 63) - 1


def whole(x):
    """floor(1024 x), exact for floats of either width as long as doubles hold the product."""
    return np.floor(np.asarray(x, np.float64) * SCALE)


class Round:
    """Codebook number t of one part beside all earlier ones."""

    def __init__(self, history):
        self.t, self.exact = len(history) - 1, history[-1]
        books = [np.array(b, np.float64) for b in history]
        small = [np.abs(b).max(axis=1) < SMALL for b in books]
        self.now, self.small = books[-1], small[-1]
        self.large = np.flatnonzero(~self.small)
        self.square = np.where(self.small, (self.now**2).sum(axis=1), np.inf)
        self.flat = np.where(self.small[:, None], self.now, 0.0)
        n = len(self.now)
        self.groups = [(lo, min(n, lo + GROUP)) for lo in range(0, n, GROUP)]
        #: way[s][g]: how far an entry of group g has gone since round s, rounded up
        gone = [np.where(s & self.small, np.sqrt(((self.now - b) ** 2).sum(axis=1)) * (1 + 1e-9), np.where(s, 0.0, np.inf)) for b, s in zip(books, small)]
        self.way = np.array([[g[lo:hi].max() for lo, hi in self.groups] for g in gone] + [[np.inf] * len(self.groups)])

    def by_whole_numbers(self, row):
        """Nearest entry of a row and its squared distance, without rounding at any size."""
        x = [int(v) for v in row]
        return min((sum((a - b) ** 2 for a, b in zip(x, c)), j) for j, c in enumerate(self.exact))

    def assign(self, x, own, stamp, bound):
        """Nearest entries of the rows ``x``; ``own``, ``stamp`` and ``bound`` are brought up to date.

        Returns squared distances (None where only whole numbers will do, see ``slow``), the
        slow rows with their exact distances, and how many groups were measured.
        """
        n, large_rows = len(x), np.abs(x).max(axis=1) >= SMALL
        started = stamp[:, 0] != 255 if self.t else np.zeros(n, bool)
        at = np.where(started, own, 0).astype(np.int64)
        started &= self.small[at] & ~large_rows
        mine = np.where(started, ((x - self.flat[at]) ** 2).sum(axis=1), np.inf)
        mine[large_rows] = 0.0  # these are settled below
        s = np.where(started[:, None], np.minimum(stamp, len(self.way) - 1), len(self.way) - 1)
        lower = bound.astype(np.float64) - self.way[s, np.arange(len(self.groups))]
        ask = ~((lower > 0) & (lower * lower * (1 - 1e-9) > mine[:, None])) & ~large_rows[:, None]
        best, near = np.where(started, at, -1), mine.copy()
        seen = {}
        squares = (x * x).sum(axis=1)
        for g, (lo, hi) in enumerate(self.groups):
            rows = np.flatnonzero(ask[:, g])
            if not len(rows):
                continue
            d = squares[rows, None] + self.square[None, lo:hi] - 2.0 * (x[rows] @ self.flat[lo:hi].T)
            first = d.argmin(axis=1)
            k = np.arange(len(rows))
            least = d[k, first]
            d[k, first] = np.inf
            seen[g] = rows, lo + first, least, d.min(axis=1)
            better = (least < near[rows]) | ((least == near[rows]) & (lo + first < best[rows])) | (best[rows] < 0)
            r = rows[better]
            best[r], near[r] = (lo + first)[better], least[better]
        # the entry that a row leaves now belongs to what its group's bound is about
        left = np.flatnonzero(started & (best != at))
        g = at[left] // GROUP
        held = ~ask[left, g]
        left, g = left[held], g[held]
        self._stamp(bound, stamp, left, g, np.minimum(np.maximum(lower[left, g], 0), np.sqrt(mine[left])))
        for g, (rows, first, least, second) in seen.items():
            self._stamp(bound, stamp, rows, g, np.sqrt(np.where(first == best[rows], second, least)))
        slow = large_rows | ~np.isfinite(near)
        for j in self.large:
            with np.errstate(over="ignore"):
                slow |= ((x - self.now[j]) ** 2).sum(axis=1) * (1 - 1e-9) <= near
        exact = {}
        for i in np.flatnonzero(slow).tolist():
            exact[i], best[i] = self.by_whole_numbers(x[i])
            stamp[i] = 255
        own[:] = best
        return near, exact, int(ask.sum())

    def _stamp(self, bound, stamp, rows, g, value):
        low = value.astype(np.float32)
        bound[rows, g] = np.where(low > value, np.nextafter(low, np.float32(0)), low)
        stamp[rows, g] = self.t


class Codebooks:
    """All rounds' codebooks: history[t][part][entry] is a list of whole numbers."""

    def __init__(self, first):
        self.history = [first]
        self.parts, self.entries, self.width = len(first), len(first[0]), len(first[0][0])
        self.groups = -(-self.entries // GROUP)
        self.bytes = self.parts * (1 + 5 * self.groups)

    def rounds(self):
        return [Round([h[p] for h in self.history]) for p in range(self.parts)]

    def unpack(self, data, n):
        """(own entry, stamps, bounds) of each part from the rows' state."""
        if data is None:
            state = np.full((n, self.bytes), 255, np.uint8)
        else:
            state = np.frombuffer(data, np.uint8).reshape(n, self.bytes)
        g, out, at = self.groups, [], 0
        for _ in range(self.parts):
            bound = np.ascontiguousarray(state[:, at + 1 + g : at + 1 + 5 * g]).view(np.float32).copy()
            out.append((state[:, at].copy(), state[:, at + 1 : at + 1 + g].copy(), bound if data is not None else np.zeros((n, g), np.float32)))
            at += 1 + 5 * g
        return out

    def pack(self, parts):
        return np.concatenate([y for own, stamp, bound in parts for y in (own[:, None], stamp, bound.view(np.uint8))], axis=1)

    def moved(self, totals):
        """The next codebooks from {(part, entry): (count, sums)}; unused entries stay."""
        book = [[list(e) for e in p] for p in self.history[-1]]
        for (p, j), (count, sums) in totals.items():
            if count:
                book[p][j] = [s // count for s in sums]
        self.history.append(book)

    def digest(self):
        return hashlib.sha256(",".join(str(v) for p in self.history[-1] for e in p for v in e).encode()).hexdigest()


def binaries(rows):
    """Arrow binaries of the rows of a byte matrix."""
    n, width = rows.shape
    offsets = np.arange(n + 1, dtype=np.int64) * width
    return pa.Array.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(rows))]).cast(pa.binary())


def limbs(value):
    """Digits of a whole number to the base 2**30; the last carries the sign."""
    out = []
    while not -(1 << LIMB) < value < (1 << LIMB):
        out.append(value & ((1 << LIMB) - 1))
        value >>= LIMB
    return [*out, value]


def matrix(batch, width):
    """The embeddings of a batch as whole numbers."""
    column = batch.column("embedding")
    return whole(column.flatten().to_numpy(zero_copy_only=False)).reshape(len(column), width)


def advance(rows: DataFrame, books: Codebooks, last: bool) -> DataFrame:
    """One assignment of all rows.

    Rows come out with their new state, and at the end of a task come the sums of what it
    saw; the last assignment gives codes and errors instead.
    """
    width = books.parts * books.width
    kind = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    tail = "code string, error bigint" if last else "state binary, limb int, sums binary, asked bigint"
    schema = f"vec_id {kind['vec_id']}, label {kind['label']}, " + ("" if last else f"embedding {kind['embedding']}, ") + tail

    def run(batches):
        rounds, shape = books.rounds(), (books.parts, books.entries, books.width + 1)
        sums, large, asked, types = np.zeros(shape, np.int64), {}, 0, None
        for whole_batch in batches:
            for at in range(0, whole_batch.num_rows, step := max(1, SLICE // width)):
                batch = whole_batch.slice(at, step)
                types = batch.schema
                x = matrix(batch, width)
                n = len(x)
                old = batch.column("state") if "state" in batch.schema.names else None
                state = books.unpack(None if old is None else b"".join(old.to_pylist()), n)
                error = [0] * n
                for p, (r, (own, stamp, bound)) in enumerate(zip(rounds, state)):
                    part = np.ascontiguousarray(x[:, p * books.width : (p + 1) * books.width])
                    near, exact, k = r.assign(part, own, stamp, bound)
                    asked += k
                    if last:
                        near[list(exact)] = 0
                        error = [e + d for e, d in zip(error, near.astype(np.int64).tolist())]
                        for i, d in exact.items():
                            error[i] += d
                        continue
                    fits = np.abs(part).max(axis=1) < SMALL
                    for d in range(books.width):
                        sums[p, :, d] += np.bincount(own[fits], part[fits, d], books.entries).astype(np.int64)
                    sums[p, :, -1] += np.bincount(own, minlength=books.entries)
                    for i in np.flatnonzero(~fits).tolist():
                        held = large.setdefault((p, int(own[i])), [0] * books.width)
                        large[p, int(own[i])] = [a + int(v) for a, v in zip(held, part[i])]
                ids, labels = batch.column("vec_id"), batch.column("label")
                if last:
                    code = np.column_stack([own for own, _, _ in state])
                    yield pa.RecordBatch.from_arrays([ids, labels, pa.array([c.tobytes().hex() for c in code]), pa.array([min(e, _MOST) for e in error], pa.int64())], ["vec_id", "label", "code", "error"])
                else:
                    nothing = [pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary()), pa.nulls(n, pa.int64())]
                    yield pa.RecordBatch.from_arrays([ids, labels, batch.column("embedding"), binaries(books.pack(state)), *nothing], ["vec_id", "label", "embedding", "state", "limb", "sums", "asked"])
        if types is None or last:
            return
        planes = [sums]
        for (p, j), values in large.items():
            for d, v in enumerate(values):
                for k, digit in enumerate(limbs(v)):
                    if k == len(planes):
                        planes.append(np.zeros(shape, np.int64))
                    planes[k][p, j, d] += digit
        blank = [pa.nulls(len(planes), types.field(c).type) for c in ("vec_id", "label", "embedding")]
        found = [pa.nulls(len(planes), pa.binary()), pa.array(range(len(planes)), pa.int32()), pa.array([s.tobytes() for s in planes], pa.binary()), pa.array([asked] + [0] * (len(planes) - 1), pa.int64())]
        yield pa.RecordBatch.from_arrays([*blank, *found], ["vec_id", "label", "embedding", "state", "limb", "sums", "asked"])

    return rows.mapInArrow(run, schema)


def totals(done: DataFrame, books: Codebooks):
    """({(part, entry): (count, sums)}, groups measured) of a written assignment: numbers of fixed size."""
    shape = (books.parts, books.entries, books.width + 1)

    def run(batches):
        held, asked = {}, 0
        for batch in batches:
            for k, data, a in zip(*(batch.column(c).to_pylist() for c in ("limb", "sums", "asked"))):
                held[k] = held.get(k, 0) + np.frombuffer(data, np.int64)
                asked += a
        for k, s in held.items():
            at = np.flatnonzero(s)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), k, np.int32)), pa.array(at.astype(np.int32)), pa.array(s[at])], ["limb", "at", "value"])
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), pa.array([0], pa.int32()), pa.array([asked], pa.int64())], ["limb", "at", "value"])

    parts = done.filter("limb is not null").select("limb", "sums", "asked").mapInArrow(run, "limb int, at int, value bigint")
    sums, asked = np.zeros(shape, object), 0
    for r in parts.groupBy("limb", "at").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value")).collect():
        if r["limb"] < 0:
            asked = int(r["value"])
        else:
            sums[np.unravel_index(r["at"], shape)] += int(r["value"]) << (LIMB * r["limb"])
    return {(p, j): (sums[p, j, -1], sums[p, j, :-1]) for p in range(shape[0]) for j in range(shape[1])}, asked


def removed(spark, path):
    """Delete a folder that this module wrote."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def usable(vectors: DataFrame) -> DataFrame:
    """Rows whose vector is there and all of whose components are finite numbers."""
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.filter(F.col("embedding").isNotNull() & F.coalesce(fine, F.lit(False))).select("vec_id", "embedding", "label")


def compress(vectors: DataFrame, parts=4, entries=256, rounds=4, report=None) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) of every row with a whole vector.

    Rows with a null vector, or null or non-finite components, are left out. A code has two
    hex digits a part, the 0-based index of the nearest of at most 256 ``entries`` (ties: the
    lower index). Codebooks start as the parts of the smallest vec_ids (nulls last, equal ids
    by vector; fewer rows give fewer entries), and ``rounds`` times every entry becomes the
    floor of its mean. ``error`` is the squared distance over all parts, ``label_error`` its
    sum over rows of equal label, nulls being equal; both stop at the largest long.

    All vectors are as wide as the one of the smallest vec_id whose width is a positive
    multiple of ``parts``; rows of other width come out with null code and error (their
    label's sum is of the others). Repeated rows give repeated results, an empty table no
    rows; null ids and labels stay null. Other columns are ignored. ``report`` (a list) gets
    the share of groups measured in each round but the last assignment.

    A round reads and writes the rows once, in the checkpoint folder; the round before is
    deleted. The driver holds the codebooks, nothing else.
    """
    spark = vectors.sparkSession
    rows = spread(usable(vectors))
    size = F.size("embedding")
    order = [F.col("vec_id").asc_nulls_last(), "embedding"]
    first = rows.filter((size > 0) & (size % parts == 0)).orderBy(*order).select(size.alias("n")).limit(1).collect()
    if not first:
        odd = rows
        coded = spark.createDataFrame([], f"vec_id {vectors.schema['vec_id'].dataType.simpleString()}, label {vectors.schema['label'].dataType.simpleString()}, code string, error bigint")
        digest = hashlib.sha256(b"").hexdigest()
    else:
        width = first[0]["n"]
        alike, odd = rows.filter(size == width), rows.filter(size != width)
        seeds = [[int(v) for v in whole(r["embedding"])] for r in alike.orderBy(*order).limit(min(entries, 256)).collect()]
        w = width // parts
        books = Codebooks([[s[p * w : (p + 1) * w] for s in seeds] for p in range(parts)])
        path, now = None, alike
        for _ in range(rounds):
            done = scratch_path(spark, "vectorcodes")
            advance(now, books, False).write.parquet(done)
            if path:
                removed(spark, path)
            path, found = done, spark.read.parquet(done)
            sums, asked = totals(found, books)
            if report is not None:
                n = sum(sums[0, j][0] for j in range(books.entries))
                report.append(asked / (n * parts * books.groups))
            books.moved(sums)
            now = found.filter("limb is null").select("vec_id", "embedding", "label", "state")
        coded = cut(advance(now, books, True))
        if path:
            removed(spark, path)
        digest = books.digest()
    every = coded.unionByName(odd.select("vec_id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("bigint").alias("error")))
    return with_label_error(every).select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def with_label_error(coded: DataFrame) -> DataFrame:
    """Adds the error summed over equal labels; a hot label is spread by a salt where the sums are not small."""
    total, most = F.sum(F.col("error").cast("decimal(38,0)")), F.lit(_MOST).cast("decimal(38,0)")
    sums = coded.groupBy(F.col("label").alias("_label")).agg(F.when(total > most, most).otherwise(total).cast("bigint").alias("label_error"))
    same = F.col("label").eqNullSafe(F.col("_label"))
    if sums.count() <= LABELS:
        return coded.join(F.broadcast(sums), same, "left")
    salts = 64
    salted = coded.withColumn("_salt", F.pmod(F.xxhash64("vec_id", "code"), F.lit(salts)))
    each = sums.withColumn("_each", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(each, same & (F.col("_salt") == F.col("_each")), "left")
