"""Repeated word passages by fixed-block anchors.

A window of 35 words always contains one whole block of the document's fixed grid of
18-word blocks. So:

1. *index and probe*: the grid blocks of all documents are the index, the 18 words from
   every position of every document the probes. Both meet by hash; a block is hit when its
   words also start somewhere else.
2. *extend*: only windows whose own grid block is hit can be repeats. They are compared
   whole, by 96 bits, which extends a hit as far as it goes to both sides; the union of the
   repeated windows is the maximal exact repeat.

Documents travel once, to packs. Each pack asks about its distinct hashes in sorted order
and gets bits back, so a passage with millions of copies weighs no more than one question
a pack, and no pair of copies is ever formed.
"""

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from signalblind.llm import text as T
from signalblind.session import cut

QUESTIONS = "bucket int, pack int, n int, hash binary, asks binary, again binary"
ANSWERS = "pack int, step int, bucket int, yes binary"
PER_BUCKET = 12 << 20


def _pack_words(table):
    """Per group of a pack: (first row, texts, words)."""
    texts = T.column(table, "text")
    for lo, hi, data, offsets in T.groups(texts):
        yield lo, texts.slice(lo, hi - lo), T.Words(data, offsets)


def _distinct(hashes, asks):
    """Sorted distinct hashes, whether asked about, whether met again here, and where each went."""
    uniq, back, n = np.unique(hashes, return_inverse=True, return_counts=True)
    asked = np.zeros(len(uniq), bool)
    asked[back[asks]] = True
    return uniq, back, asked, n > 1


def _probes(groups, block):
    """Hashes of the ``block`` words from every position of a pack; which lie on the grid."""
    hashes, grid = [], []
    for _, _, w in groups:
        if len(w.hash) >= block:
            at = w.valid(block)
            hashes.append(w.runs(block)[at])
            start = np.repeat(w.first[:-1], np.diff(w.first))
            grid.append((at - start[at]) % block == 0)
    return np.concatenate(hashes or [np.zeros(0, np.uint64)]), np.concatenate(grid or [np.zeros(0, bool)])


def _windows(groups, window, block, hit):
    """Per group the starts of the windows whose grid block is hit, with two hashes."""
    at_probe = 0
    for _, _, w in groups:
        starts, h1, h2 = np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        if len(w.hash) >= block:
            at = w.valid(block)
            blocks = at[hit[at_probe : at_probe + len(at)]]
            at_probe += len(at)
            near = np.zeros(len(w.hash) + 1, np.int64)
            # a window's grid block is its first one: it starts at most block - 1 words in
            start = np.repeat(w.first[:-1], np.diff(w.first))
            np.add.at(near, np.maximum(blocks - block + 1, start[blocks]), 1)
            np.add.at(near, blocks + 1, -1)
            if len(w.hash) >= window:
                ok = w.valid(window)
                starts = ok[np.cumsum(near)[ok] > 0]
                h1, h2 = w.runs(window, 1)[starts], w.runs(window, 2)[starts]
        yield starts, h1, h2


def _ask(uniq, pack, n_buckets, width, asked, again, extra=None):
    rows = T.slices(T.bucket_of(uniq, n_buckets))
    own = uniq.astype(np.uint32) if width == 4 else uniq
    data = [own[a:b].tobytes() + (extra[a:b].tobytes() if extra is not None else b"") for _, a, b in rows]
    cols = [[r[0] for r in rows], [pack] * len(rows), [b - a for _, a, b in rows], data, [T.bits(asked[a:b]) for _, a, b in rows], [T.bits(again[a:b]) for _, a, b in rows]]
    kinds = [pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
    return pa.table([pa.array(c, k) for c, k in zip(cols, kinds)], names=["bucket", "pack", "n", "hash", "asks", "again"])


def _answer(step, read):
    """Which asked hashes of a bucket occur more than once in all packs together."""

    def run(table):
        n = table["n"].to_numpy()
        asks = np.concatenate([T.flags(x.as_py(), k) for x, k in zip(table["asks"], n)])
        again = np.concatenate([T.flags(x.as_py(), k) for x, k in zip(table["again"], n)])
        yes = T.met_again(read(table, n), again) & asks
        ends = np.cumsum(n)
        cols = [table["pack"].combine_chunks(), pa.array([step] * len(n), pa.int32()), table["bucket"].combine_chunks(), pa.array([T.bits(yes[e - k : e]) for e, k in zip(ends, n)], pa.binary())]
        return pa.table(cols, names=["pack", "step", "bucket", "yes"])

    return run


def _read_short(table, n):
    return T.joined(table["hash"], np.uint32)


def _read_long(table, n):
    """Number the (64-bit, 32-bit) hashes of a bucket."""
    parts = [x.as_py() for x in table["hash"]]
    h = np.concatenate([np.frombuffer(p, np.uint64, k) for p, k in zip(parts, n)])
    e = np.concatenate([np.frombuffer(p, np.uint32, k, 8 * k) for p, k in zip(parts, n)])
    order = np.lexsort((e, h))
    new = np.ones(len(h), np.int64)
    new[1:] = (h[order][1:] != h[order][:-1]) | (e[order][1:] != e[order][:-1])
    out = np.empty(len(h), np.int64)
    out[order] = np.cumsum(new)
    return out


def _told(answers, step, uniq, n_buckets):
    """The answers of a step as flags along the sorted distinct hashes."""
    own = {b: y for s, b, y in zip(answers["step"].to_pylist(), answers["bucket"].to_pylist(), answers["yes"].to_pylist()) if s == step}
    parts = [T.flags(own[b], hi - lo) if b in own else np.zeros(hi - lo, bool) for b, lo, hi in T.slices(T.bucket_of(uniq, n_buckets))]
    return np.concatenate(parts) if parts else np.zeros(0, bool)


def remove_repeats(docs: DataFrame, window=35, outputs=("n_words", "n_removed", "kept_sha256")) -> DataFrame:
    """One row per row of ``docs``: doc_id (as bigint) and ``outputs``.

    A word ``[^\\x20\\x09-\\x0D]+`` is removed when a window of ``window`` words of one text
    covers it whose words also start anywhere else, in the same text or another. Windows
    are judged on the input. Outputs may also name ``kept`` (text, words joined by one
    space) and ``spans`` (array of [first word, end)). Null and blank texts have no words;
    texts shorter than a window keep all; repeated rows are repeats of each other; rows
    without doc_id are treated like others; other columns are ignored; an empty table gives
    no rows. Words are compared by 64-bit hashes, windows by 96 bits.
    """
    block = (window + 1) // 2
    packed, total = T.packs(docs)
    n_buckets = max(1, -(-total // PER_BUCKET))

    def probe(table):
        hashes, grid = _probes(list(_pack_words(table)), block)
        uniq, _, asked, again = _distinct(hashes, grid)
        return _ask(uniq, table["pack"][0].as_py(), n_buckets, 4, asked, again)

    def candidates(table, answers):
        groups = list(_pack_words(table))
        hashes, grid = _probes(groups, block)
        uniq, back = np.unique(hashes, return_inverse=True)
        hit = _told(answers, 1, uniq, n_buckets)[back] & grid if len(uniq) else np.zeros(0, bool)
        return groups, list(_windows(groups, window, block, hit))

    def extend(table, answers):
        if not table.num_rows:
            return _ask(np.zeros(0, np.uint64), 0, n_buckets, 8, np.zeros(0, bool), np.zeros(0, bool))
        _, found = candidates(table, answers)
        h1, h2 = np.concatenate([f[1] for f in found]), np.concatenate([f[2] for f in found])
        uniq, first, n = np.unique(h1, return_index=True, return_counts=True)
        return _ask(uniq, table["pack"][0].as_py(), n_buckets, 8, np.ones(len(uniq), bool), n > 1, (h2[first] >> np.uint64(32)).astype(np.uint32))

    kinds = {"n_words": (pa.int64(), "bigint"), "n_removed": (pa.int64(), "bigint"), "kept_sha256": (pa.string(), "string"), "kept": (pa.string(), "string"), "spans": (pa.list_(pa.list_(pa.int32())), "array<array<int>>")}

    def settle(table, answers):
        out = {o: [] for o in outputs}
        if table.num_rows:
            groups, found = candidates(table, answers)
            uniq, back = np.unique(np.concatenate([f[1] for f in found]), return_inverse=True)
            repeated, seen = _told(answers, 2, uniq, n_buckets)[back] if len(uniq) else np.zeros(0, bool), 0
            for (_, texts, w), (starts, _, _) in zip(groups, found):
                own = starts[repeated[seen : seen + len(starts)]]
                seen += len(starts)
                cover = np.zeros(len(w.hash) + 1, np.int64)
                np.add.at(cover, own, 1)
                np.add.at(cover, own + window, -1)
                gone = np.cumsum(cover[:-1]) > 0
                for d, t in enumerate(texts):
                    a, b = w.first[d], w.first[d + 1]
                    mine = gone[a:b]
                    row = {"n_words": int(b - a), "n_removed": int(mine.sum())}
                    if "kept" in out or "kept_sha256" in out:
                        words = t.as_py().encode().split()
                        kept = b" ".join(compress(words, ~mine) if row["n_removed"] else words)
                        row |= {"kept_sha256": hashlib.sha256(kept).hexdigest(), "kept": kept.decode() if "kept" in out else None}
                    if "spans" in out:
                        edge = np.flatnonzero(np.diff(np.concatenate([[0], mine.astype(np.int8), [0]])))
                        row["spans"] = edge.reshape(-1, 2).tolist()
                    for o in outputs:
                        out[o].append(row[o])
        return pa.table([table["doc_id"].combine_chunks(), *(pa.array(out[o], kinds[o][0]) for o in outputs)], names=["doc_id", *outputs])

    first = packed.groupBy("pack").applyInArrow(probe, QUESTIONS).groupBy("bucket").applyInArrow(_answer(1, _read_short), ANSWERS)
    first = cut(first)
    second = packed.groupBy("pack").cogroup(first.groupBy("pack")).applyInArrow(extend, QUESTIONS).groupBy("bucket").applyInArrow(_answer(2, _read_long), ANSWERS)
    both = cut(second).unionAll(first)
    schema = "doc_id bigint, " + ", ".join(f"{o} {kinds[o][1]}" for o in outputs)
    return packed.groupBy("pack").cogroup(both.groupBy("pack")).applyInArrow(settle, schema)
