"""Benchmark decontamination by size-partitioned MinHash containment search.

Items are partitioned by the size of their shingle set. All items of a partition get a
bottom-k MinHash signature with the same k, one more than the number of shingles that the
largest of them may miss at the threshold. A document that holds the required share of an
item's shingles must then hold a shingle of its signature, however long the document is,
so the search has no misses. Candidates are verified by counting the item's shingles in
the document exactly.
"""

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signalblind.llm import text as T
from signalblind.session import cut as written

WORDS = 5
BLOCK_SHINGLES = 1 << 20


def signature_size(n, threshold):
    """k for items of the size partition of ``n`` (powers of two): too many to miss all."""
    top = 1 << max(0, (n - 1).bit_length())
    missed = math.floor(top * (1 - threshold) + 1e-9)
    return min(n, missed + 1)


def item_sets(items: DataFrame, words=WORDS) -> DataFrame:
    """(item_id, n, shingles as packed 64-bit hashes) of every item with a word."""
    key = items.schema["item_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            texts = T.column(batch, "text")
            for lo, hi, data, offsets in T.groups(texts):
                sets = list(T.Words(data, offsets, lower=True).shingle_sets(words))
                keep = pa.array([len(s) > 0 for s in sets])
                out = pa.RecordBatch.from_arrays([batch.column("item_id").slice(lo, hi - lo), pa.array([len(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], ["item_id", "n", "shingles"])
                yield out.filter(keep)

    return items.select("item_id", "text").mapInArrow(run, f"item_id {key}, n bigint, shingles binary")


class Index:
    """Signatures and full sets of one block of items, as flat sorted arrays."""

    def __init__(self, rows, threshold):
        self.ids = [r["item_id"] for r in rows]
        sets = [np.frombuffer(r["shingles"], np.uint64) for r in rows]
        self.n = np.array([len(s) for s in sets], np.int64)
        signed = [np.sort(T.mix(s))[: signature_size(len(s), threshold)] for s in sets]
        h, who = np.concatenate(signed), np.repeat(np.arange(len(sets)), [len(s) for s in signed])
        by = np.argsort(h, kind="stable")
        self.sig, self.sig_item = h[by], who[by]
        #: shingles of the block and, by item, their numbers
        self.all, number = np.unique(np.concatenate(sets), return_inverse=True)
        self.of_item = np.split(number, np.cumsum(self.n)[:-1])

    def matches(self, runs, threshold):
        """(item, shared shingles) for one document's distinct shingles."""
        at = np.searchsorted(self.all, runs)
        known = at[self.all[np.minimum(at, len(self.all) - 1)] == runs]
        if not len(known):
            return []
        probe = T.mix(self.all[known])
        lo, hi = np.searchsorted(self.sig, probe, "left"), np.searchsorted(self.sig, probe, "right")
        some = np.flatnonzero(hi > lo)
        found = np.unique(np.concatenate([self.sig_item[a:b] for a, b in zip(lo[some], hi[some])])) if len(some) else []
        out = []
        for i in found:
            shared = int(np.isin(self.of_item[i], known, assume_unique=True).sum())
            if shared >= threshold * self.n[i] - 1e-9:
                out.append((i, shared))
        return out


def leaks(docs: DataFrame, items: DataFrame, threshold=0.8, words=WORDS, block_shingles=BLOCK_SHINGLES, carry=()) -> DataFrame:
    """(doc_id, ``carry``, item_id, shared, containment) of each document that holds an item.

    Containment is the share of the item's distinct ``words``-word shingles (letters A-Z
    lower-cased) that the whole text holds; pairs at ``threshold`` and above are returned,
    each once for each row. An item with fewer words is one shingle, equal only to a text
    of the same words. Null or blank texts and items match nothing; an empty table gives no
    rows; repeated rows give repeated results; other columns are ignored. Items are
    searched in blocks of about ``block_shingles`` shingles, one scan of the documents a
    block, so what is broadcast stays bounded. Documents are never shuffled.
    """
    spark = docs.sparkSession
    item_key = items.schema["item_id"].dataType.simpleString()
    kept = ["doc_id", *carry]
    schema = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in kept) + f", item_id {item_key}, shared bigint, containment double"
    sets = written(item_sets(items, words))
    total = sets.agg(F.sum("n")).first()[0]
    if not total:
        return spark.createDataFrame([], schema)
    blocks = -(-total // block_shingles)
    ids = items.schema["item_id"].dataType

    def search(shared):
        def run(batches):
            index = shared.value
            for batch in batches:
                texts = T.column(batch, "text")
                for lo, hi, data, offsets in T.groups(texts):
                    rows, item, share = [], [], []
                    # a shingle that no item holds needs no set
                    w = T.Words(data, offsets, lower=True)
                    runs = w.runs(words) if len(w.hash) >= words else np.zeros(0, np.uint64)
                    at = w.valid(words)
                    seen = np.searchsorted(index.all, runs[at])
                    hit = at[index.all[np.minimum(seen, len(index.all) - 1)] == runs[at]]
                    text_of = np.searchsorted(w.first, hit, "right") - 1
                    cut = np.flatnonzero(np.diff(text_of)) + 1
                    found = [(int(text_of[g[0]]), np.unique(runs[hit[g]])) for g in np.split(np.arange(len(hit)), cut) if len(g)]
                    short = np.flatnonzero((np.diff(w.first) > 0) & (np.diff(w.first) < words))
                    if len(short):
                        sizes = {int(d) for d in short}
                        found += [(d, s) for d, s in enumerate(w.shingle_sets(words)) if d in sizes]
                    for d, s in sorted(found, key=lambda x: x[0]):
                        for i, n in index.matches(s, threshold):
                            rows.append(lo + d), item.append(index.ids[i]), share.append((n, n / int(index.n[i])))
                    if rows:
                        yield pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(rows)) for c in kept), pa.array(item, pa_type(ids)), pa.array([n for n, _ in share], pa.int64()), pa.array([c for _, c in share], pa.float64())], [*kept, "item_id", "shared", "containment"])

        return docs.select(*kept, "text").mapInArrow(T.released(run), schema)

    out = None
    for b in range(blocks):
        rows = sets.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b).collect()
        if rows:
            part = search(spark.sparkContext.broadcast(Index(rows, threshold)))
            out = part if out is None else out.unionAll(part)
    return out


def pa_type(kind):
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)
