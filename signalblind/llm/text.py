"""Batch kernels on the bytes of whole texts: words, hashes of words and of word runs.

Everything works on Arrow batches inside a task. Texts go in groups of a
quarter megabyte, so that memory does not follow the batch; one text is never cut.
"""

import ctypes

import numpy as np
import pyarrow as pa

GROUP_BYTES = 1 << 18
_U = np.uint64


def mix(x):
    """Finaliser of a 64-bit hash (splitmix)."""
    x = x.copy()
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def table(seed, n=256):
    """``n`` 64-bit constants that depend on ``seed`` only."""
    with np.errstate(over="ignore"):
        return mix((np.arange(1, n + 1, dtype=np.uint64) + _U(seed) * _U(1 << 20)) * _U(0x9E3779B97F4A7C15))


_SEP = np.zeros(256, bool)
_SEP[[32, 9, 10, 11, 12, 13]] = True
_EXACT = table(1)
_LOWER = _EXACT.copy()
_LOWER[65:91] = _EXACT[97:123]
_BASE = _U(0xD6E8FEB86659FD93 | 1)
_BACK = _U(pow(int(_BASE), -1, 1 << 64))
_powers = {}


def powers(n):
    """Powers of the base and of its inverse modulo 2**64, at least ``n`` of each."""
    if _powers.get("n", -1) < n:
        size = max(n, GROUP_BYTES + 4096)
        for k, b in (("up", _BASE), ("down", _BACK)):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            _powers[k] = np.cumprod(p, dtype=np.uint64)
        _powers["n"] = size
    return _powers["up"], _powers["down"]


def column(batch, name):
    """The column as one Arrow array with nulls as empty texts."""
    a = batch.column(name) if isinstance(batch, pa.RecordBatch) else batch.column(name).combine_chunks()
    if isinstance(a, pa.ChunkedArray):
        a = pa.concat_arrays(a.chunks) if a.num_chunks else pa.array([], a.type)
    a = a.cast(pa.large_string())
    return a.fill_null("") if a.null_count else a


def groups(texts, limit=GROUP_BYTES):
    """(first row, last row + 1, bytes, offsets) of groups of about ``limit`` bytes."""
    n = len(texts)
    if not n:
        return
    _, off, buf = texts.buffers()
    offsets = np.frombuffer(off, np.int64, n + 1, texts.offset * 8)
    data = np.frombuffer(buf, np.uint8) if buf is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def released(run, *caches):
    """The mapInArrow function ``run``, giving memory back to the system when its task ends.

    Workers live on after a task, and what their allocators keep adds up beside the executor.
    ``caches`` are called to forget what only helps within a task.
    """

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            for forget in caches:
                forget()
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # not in every C library
            if trim:
                trim(0)

    return wrapped


class Words:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a group of texts and a 64-bit hash of each."""

    def __init__(self, data, offsets, lower=False):
        n = len(data)
        word = ~_SEP[data]
        before, after = np.ones(n, bool), np.ones(n, bool)
        before[1:] = ~word[:-1]
        after[:-1] = ~word[1:]
        full = offsets[1:] > offsets[:-1]
        before[offsets[:-1][full]] = True
        after[offsets[1:][full] - 1] = True
        self.data = data
        self.start = np.flatnonzero(word & before)
        self.end = np.flatnonzero(word & after) + 1
        #: first[d] .. first[d + 1] are the words of text d
        self.first = np.searchsorted(self.start, offsets)
        up, down = powers(n)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum((_LOWER if lower else _EXACT)[data] * up[:n], out=total[1:])
        self.hash = mix((total[self.end] - total[self.start]) * down[self.start] + (self.end - self.start).astype(np.uint64))

    def runs(self, k, seed=0):
        """Hash of the ``k`` words from each word on; the last k - 1 of a text run over its end."""
        n = len(self.hash)
        up, down = powers(n)
        total = np.zeros(n + 1, np.uint64)
        own = mix(self.hash + _U(seed * 0x9E3779B97F4A7C15 % (1 << 64))) if seed else self.hash
        np.cumsum(own * up[:n], out=total[1:])
        at = np.arange(max(0, n - k + 1))
        return mix((total[at + k] - total[at]) * down[at])

    def valid(self, k):
        """Starts of the runs of ``k`` words that lie within one text."""
        n = len(self.hash)
        left = np.repeat(self.first[1:], np.diff(self.first)) - np.arange(n)
        return np.flatnonzero(left >= k)

    def shingle_sets(self, k, seed=0):
        """Per text its distinct ``k``-word shingles, sorted; a shorter text is one shingle."""
        runs = self.runs(k, seed) if len(self.hash) >= k else np.zeros(0, np.uint64)
        for d in range(len(self.first) - 1):
            a, b = self.first[d], self.first[d + 1]
            if b - a >= k:
                yield np.unique(runs[a : b - k + 1])
            elif b > a:
                up, _ = powers(k)
                whole = (self.hash[a:b] * up[: b - a]).sum(dtype=np.uint64, keepdims=True)
                yield mix(whole + _U(0xA0761D6478BD642F * int(k - (b - a)) % (1 << 64)))
            else:
                yield np.zeros(0, np.uint64)


def set_hash(values):
    """Two 64-bit hashes of a set, as signed integers."""
    a = mix(values + _U(0x2545F4914F6CDD1D)).sum(dtype=np.uint64)
    b = mix(values ^ _U(0x9E6C63D0676A9A99)).sum(dtype=np.uint64)
    return int(a.astype(np.int64)), int(b.astype(np.int64))


# --- packs: groups of documents that are visited again and answered with bits -----------

PACK_BYTES = 1 << 23


def packs(docs, per=PACK_BYTES):
    """Rows (doc_id, text, pack) and the number of bytes; a pack holds about ``per`` bytes.

    The pack follows from the row alone, so a lost task finds the same packs again, and
    questions may be numbered by their sorted order in a pack and answered by bits.
    """
    from pyspark.sql import functions as F

    total = docs.agg(F.sum(F.octet_length("text").cast("bigint"))).first()[0] or 0
    n = max(1, -(-total // per))
    key = F.col("doc_id").cast("bigint")
    return docs.select(key.alias("doc_id"), "text", F.pmod(F.xxhash64(key, "text"), F.lit(n)).cast("int").alias("pack")), total


def bucket_of(hashes, n):
    """Bucket of each hash, growing with the hash, by its upper half."""
    return ((hashes >> _U(32)) * _U(n) >> _U(32)).astype(np.int64)


def slices(buckets):
    """(bucket, from, to) of runs in a sorted array."""
    cut = np.flatnonzero(np.diff(buckets)) + 1
    return [(int(buckets[a]), int(a), int(b)) for a, b in zip([0, *cut], [*cut, len(buckets)]) if b > a]


def bits(flags):
    return np.packbits(flags).tobytes()


def flags(data, n):
    return np.unpackbits(np.frombuffer(data, np.uint8), count=n).astype(bool)


def joined(column, kind):
    return np.frombuffer(b"".join(column.to_pylist()), kind)


def met_again(values, owner_flags):
    """Values that occur more than once, or whose flag says so."""
    order = np.argsort(values, kind="stable")
    v = values[order]
    same = np.zeros(len(v), bool)
    same[1:] = v[1:] == v[:-1]
    same[:-1] |= same[1:]
    out = owner_flags.copy()
    out[order] |= same
    return out
