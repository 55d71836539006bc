"""Repeated byte strings by a distributed suffix sort with bucket-pointer refinement.

The suffixes are spread over tasks by q-grams: every 50-byte window belongs to the 16-gram
of smallest hash inside it, which equal windows choose alike, and the windows of one 16-gram
in one place form a short string. Two questions are asked of all packs of documents:

1. which of the chosen 16-grams occur in more than one document; all other windows are
   unique and go no further;
2. for the strings left, which windows also start in a document with a smaller id. Here the
   suffixes of a bucket are sorted to depth 50 by bucket-pointer refinement: the initial
   buckets are 16-grams; a bucket with several members is refined by the bucket numbers of
   its members' suffixes 16 bytes on, which gives 32 bytes, and with the updated numbers 18
   bytes on, which gives 50. Buckets of one member are final at once.

Equal strings of a pack travel once, with the smallest id that holds them, and answers are
bits, so a text with millions of copies costs one string a pack.

A passage that many documents share gives its outermost 16-grams a different string in each
document. Such a hot gram's strings are cut into single windows, which go to buckets by
their own hash. Between 1 and 2 packs then ask which of these windows occur in more than one
document. What is left of a window is one string a pack.
"""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from signalblind.llm import text as T
from signalblind.llm.anchors import ANSWERS, _told
from signalblind.session import cut

Q = 16
PER_BUCKET = 1 << 20
PER_QUESTION = 24 << 20
#: Differing strings of a gram, beyond one a pack, from which it is hot.
HOT = 4096
_U = np.uint64
_TABLE = T.table(7)
_LAST = np.iinfo(np.int64).max
GRAMS = "bucket int, pack int, n int, hash binary, again binary, more binary"
STRINGS = "bucket int, pack int, n int, sizes binary, bytes binary, least binary"


class Windows:
    """Windows of a group of texts and the q-gram each belongs to."""

    def __init__(self, data, offsets, depth):
        n = len(data)
        self.data, self.depth = data, depth
        up, self.down = T.powers(n)
        self.total = np.zeros(n + 1, _U)
        np.cumsum(_TABLE[data] * up[:n], out=self.total[1:])
        grams = (self.total[Q:] - self.total[:-Q]) * self.down[: n - Q + 1] if n >= depth else np.zeros(0, _U)
        width = depth - Q + 1
        # smallest hash of a window, the leftmost of equal ones: hash above, place below
        low = (grams & ~_U((1 << 28) - 1)) | np.arange(len(grams), dtype=_U)
        have = 1
        while have < width:
            step = min(have, width - have)
            low = np.minimum(low[: len(low) - step], low[step:])
            have += step
        left = np.repeat(offsets[1:], np.diff(offsets))[: len(low)] - np.arange(len(low))
        start = np.flatnonzero(left >= depth)
        gram = (low[start] & _U((1 << 28) - 1)).astype(np.int64)
        # runs of windows of one gram are one string
        new = np.ones(len(start), bool)
        new[1:] = (gram[1:] != gram[:-1]) | (start[1:] != start[:-1] + 1)
        self.at = start[new]
        self.n = np.diff(np.append(np.flatnonzero(new), len(start)))
        self.gram = T.mix(grams[gram[new]])  # the least of many, so mixed again
        self.row = np.searchsorted(offsets, self.at, "right") - 1

    def split(self, hot):
        """Cut the strings marked ``hot`` into single windows; True for each of those."""
        times = np.where(hot, self.n, 1)
        inner = np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times)
        single = np.repeat(hot, times)
        self.at = np.repeat(self.at, times) + inner
        self.n = np.where(single, 1, np.repeat(self.n, times))
        self.gram, self.row = np.repeat(self.gram, times), np.repeat(self.row, times)
        self.gram[single] = T.mix(self.strings(np.flatnonzero(single))[1])
        return single

    def strings(self, some):
        """Length and hash of the strings numbered ``some``."""
        a, size = self.at[some], self.n[some] + self.depth - 1
        return size, T.mix((self.total[a + size] - self.total[a]) * self.down[a] + size.astype(_U))


def _windows(table, depth):
    texts, ids = T.column(table, "text"), np.array([_LAST if x is None else x for x in table["doc_id"].to_pylist()], np.int64)
    return [(lo, hi, Windows(data, offsets, depth), ids[lo:hi]) for lo, hi, data, offsets in T.groups(texts)]


def _cat(parts, kind):
    return np.concatenate(parts) if parts else np.zeros(0, kind)


def _grams(found):
    return _cat([w.gram for _, _, w, _ in found], _U), _cat([ids[w.row] for _, _, w, ids in found], np.int64)


class Strings:
    """The distinct strings of a pack whose gram is hit, by bucket, with their smallest id."""

    def __init__(self, found, hit, n_buckets):
        gram, doc = _grams(found)
        self.some = np.flatnonzero(hit)
        self.group = np.repeat(np.arange(len(found)), [len(w.at) for _, _, w, _ in found])
        self.base = np.concatenate([[0], np.cumsum([len(w.at) for _, _, w, _ in found])]).astype(np.int64)
        size, h = np.zeros(len(gram), np.int64), np.zeros(len(gram), _U)
        for g, (_, _, w, _) in enumerate(found):
            own = self.some[(self.some >= self.base[g]) & (self.some < self.base[g + 1])]
            size[own], h[own] = w.strings(own - self.base[g])
        key = h[self.some]
        bucket = T.bucket_of(gram[self.some], n_buckets)
        order = np.lexsort((doc[self.some], key, bucket))
        s = self.some[order]
        first = np.ones(len(s), bool)
        first[1:] = (h[s][1:] != h[s][:-1]) | (bucket[order][1:] != bucket[order][:-1])
        self.number = np.empty(len(s), np.int64)
        self.number[order] = np.cumsum(first) - 1
        self.lead, self.bucket, self.size = s[first], bucket[order][first], size[s[first]]
        self.least, self.doc = doc[s[first]], doc

    def bytes_of(self, found, numbers):
        out = []
        for i in numbers:
            s = self.lead[i]
            g = self.group[s]
            w = found[g][2]
            a = w.at[s - self.base[g]]
            out.append(w.data[a : a + self.size[i]].tobytes())
        return b"".join(out)


def refine(bucket, places, ahead, members):
    """Bucket numbers of ``places`` refined by those ``ahead`` bytes on; singles keep theirs."""
    out = bucket.copy()
    some = places[members[bucket[places]] > 1]
    if len(some):
        pair = (bucket[some].astype(_U) << _U(32)) | bucket[some + ahead].astype(_U)
        out[some] = len(members) + np.unique(pair, return_inverse=True)[1]
    return out


def sort_suffixes(data, starts, inside, depth):
    """Number of the depth-byte bucket of each suffix in ``starts``.

    ``inside`` marks the places with a whole q-gram of their string behind them.
    """
    n = len(data)
    padded = np.concatenate([data, np.zeros(Q, np.uint8)]).astype(_U)
    halves = []
    for half in (0, 8):
        x = np.zeros(n, _U)
        for j in range(8):
            x = (x << _U(8)) | padded[half + j : half + j + n]
        halves.append(x)
    places = np.flatnonzero(inside)
    # two 64-bit halves as one number; a bucket holds far too few suffixes for a clash
    gram = T.mix(halves[0][places]) * _U(3) + T.mix(halves[1][places] ^ _U(0x5851F42D4C957F2D))
    bucket = np.zeros(n, np.int64)
    bucket[places] = np.unique(gram, return_inverse=True)[1]
    have = Q
    while have < depth:
        step = min(have, depth - have)
        later = depth - have - step
        # places that a later round still looks at
        need = np.zeros(n + 1, bool)
        need[starts] = True
        todo = later
        reach = have + step
        while todo > 0:
            jump = min(reach, todo)
            need[np.minimum(np.flatnonzero(need) + jump, n)] = True
            reach, todo = reach + jump, todo - jump
        places = np.flatnonzero(need[:n])
        members = np.bincount(bucket[places], minlength=int(bucket.max()) + 1)
        bucket = refine(bucket, places, step, members)
        have += step
    return np.unique(bucket[starts], return_inverse=True)[1]


def _answer_strings(depth):
    def run(table):
        n = table["n"].to_numpy()
        size, least = T.joined(table["sizes"], np.uint16).astype(np.int64), T.joined(table["least"], np.int64)
        data = T.joined(table["bytes"], np.uint8)
        begin = np.cumsum(size) - size
        # a string that several packs sent is sorted once
        up, down = T.powers(len(data))
        total = np.zeros(len(data) + 1, _U)
        np.cumsum(_TABLE[data] * up[: len(data)], out=total[1:])
        key = T.mix((total[begin + size] - total[begin]) * down[begin] + size.astype(_U))
        _, lead, string = np.unique(key, return_index=True, return_inverse=True)
        own_size, own_n = size[lead], size[lead] - depth + 1
        own_begin = np.cumsum(own_size) - own_size
        place = np.repeat(begin[lead] - own_begin, own_size) + np.arange(own_size.sum())
        left = np.repeat(own_begin + own_size, own_size) - np.arange(len(place))
        number = sort_suffixes(data[place], np.flatnonzero(left >= depth), left >= Q, depth)
        # the smallest id of a window: over the strings' own smallest ids
        holder = np.full(len(lead), _LAST)
        np.minimum.at(holder, string, least)
        lowest = np.full(int(number.max()) + 1, _LAST)
        np.minimum.at(lowest, number, np.repeat(holder, own_n))
        lowest = lowest[number]
        per_string = size - depth + 1
        at = np.repeat((np.cumsum(own_n) - own_n)[string] - (np.cumsum(per_string) - per_string), per_string) + np.arange(per_string.sum())
        yes = lowest[at] < np.repeat(least, per_string)
        per_row = np.add.reduceat(per_string, np.cumsum(n) - n)
        ends = np.cumsum(per_row)
        cols = [table["pack"].combine_chunks(), pa.array([2] * len(n), pa.int32()), table["bucket"].combine_chunks(), pa.array([T.bits(yes[e - k : e]) for e, k in zip(ends, per_row)], pa.binary())]
        return pa.table(cols, names=["pack", "step", "bucket", "yes"])

    return run


def _ask_grams(pack, gram, doc, n_buckets, string=None):
    """Questions about the distinct grams; with ``string``, also how many differing ones each has."""
    order = np.lexsort((doc, gram))
    g, d = gram[order], doc[order]
    first = np.ones(len(g), bool)
    first[1:] = g[1:] != g[:-1]
    at = np.flatnonzero(first)
    uniq, again = g[at], d[at] != d[np.append(at[1:], len(g)) - 1] if len(at) else np.zeros(0, bool)
    more = np.zeros(len(at), np.uint32)
    if string is not None and len(at):
        times = np.diff(np.append(at, len(g)))
        owner = np.repeat(np.arange(len(at)), times)
        several = np.repeat(times > 1, times)
        owner, own = owner[several], string[order][several]
        by = np.lexsort((own, owner))
        owner, own = owner[by], own[by]
        differs = (owner[1:] == owner[:-1]) & (own[1:] != own[:-1])
        more = np.bincount(owner[1:][differs], minlength=len(at)).astype(np.uint32)
    rows = T.slices(T.bucket_of(uniq, n_buckets))
    sparse = [np.stack([k := np.flatnonzero(more[a:b]), more[a:b][k]]).astype(np.uint32).tobytes() for _, a, b in rows]
    cols = [[r[0] for r in rows], [pack] * len(rows), [b - a for _, a, b in rows], [uniq[a:b].astype(np.uint32).tobytes() for _, a, b in rows], [T.bits(again[a:b]) for _, a, b in rows], sparse]
    return pa.table([pa.array(c, k) for c, k in zip(cols, [pa.int32()] * 3 + [pa.binary()] * 3)], names=["bucket", "pack", "n", "hash", "again", "more"])


def _answer_grams(step, hot):
    """Answers of ``step``, and as step 3 which grams have more than ``hot`` differing strings."""

    def run(table):
        n = table["n"].to_numpy()
        ends = np.cumsum(n)
        again = np.concatenate([T.flags(x.as_py(), k) for x, k in zip(table["again"], n)])
        hashes, more = T.joined(table["hash"], np.uint32), np.zeros(int(ends[-1]), np.int64)
        for x, e, k in zip(table["more"], ends, n):
            place, extra = np.frombuffer(x.as_py(), np.uint32).reshape(2, -1)
            more[e - k + place.astype(np.int64)] = extra
        yes, rows = T.met_again(hashes, again), []
        pack, bucket = table["pack"].to_pylist(), table["bucket"].to_pylist()
        rows += [(p, step, b, T.bits(yes[e - k : e])) for p, b, e, k in zip(pack, bucket, ends, n)]
        if more.sum() > hot:
            back = np.unique(hashes, return_inverse=True)[1]
            crowded = np.bincount(back, weights=more)[back] > hot
            rows += [(p, 3, b, T.bits(crowded[e - k : e])) for p, b, e, k in zip(pack, bucket, ends, n) if crowded[e - k : e].any()]
        cols = [pa.array(c, k) for c, k in zip(zip(*rows), [pa.int32()] * 3 + [pa.binary()])]
        return pa.table(cols, names=["pack", "step", "bucket", "yes"])

    return run


def remove_repeats(docs: DataFrame, depth=50, outputs=("n_bytes", "n_removed", "n_spans", "kept_sha256")) -> DataFrame:
    """One row per row of ``docs``: doc_id (as bigint) and ``outputs``.

    A byte of the UTF-8 text is removed when a ``depth``-byte string of the text covers it
    that also starts in a document with a smaller doc_id; strings are judged on the input.
    Outputs may also name ``kept`` (the remaining bytes) and ``spans`` (array of [from, to)
    removed). Null texts are empty; shorter texts keep all bytes; a row without doc_id
    counts as larger than all others; rows with the same doc_id never remove each other's
    bytes; other columns are ignored; an empty table gives no rows.
    """
    if not 2 * Q <= depth < 1 << 15:
        raise ValueError(f"depth must be from {2 * Q} to 32767")
    packed, total = T.packs(docs)
    n_grams, n_strings = max(1, -(-total // PER_QUESTION)), max(1, -(-total // PER_BUCKET))

    n_singles = max(1, -(-total // (PER_QUESTION >> 3)))

    def ask_grams(table):
        found = _windows(table, depth)
        string = _cat([w.strings(np.arange(len(w.at)))[1] for _, _, w, _ in found], _U)
        return _ask_grams(table["pack"][0].as_py(), *_grams(found), n_grams, string)

    def split(table, answers):
        """Windows of a pack, hot strings cut, with the answers to 1 and the windows cut out."""
        found = _windows(table, depth)
        uniq, back = np.unique(_grams(found)[0], return_inverse=True)
        hit, hot = (_told(answers, step, uniq, n_grams)[back] if len(uniq) else np.zeros(0, bool) for step in (1, 3))
        single = np.zeros(len(hit), bool)
        if hot.any():
            ends = np.cumsum([len(w.at) for _, _, w, _ in found])
            times = np.where(hot, _cat([w.n for _, _, w, _ in found], np.int64), 1)
            single = _cat([w.split(hot[e - len(w.at) : e]) for e, (_, _, w, _) in zip(ends, found)], bool)
            hit = np.repeat(hit, times)
        return found, hit, single

    def ask_singles(table, answers):
        if not table.num_rows:
            return _ask_grams(0, np.zeros(0, _U), np.zeros(0, np.int64), n_singles)
        found, _, single = split(table, answers)
        gram, doc = _grams(found)
        return _ask_grams(table["pack"][0].as_py(), gram[single], doc[single], n_singles)

    def strings(table, answers):
        found, hit, single = split(table, answers)
        if single.any():
            uniq, back = np.unique(_grams(found)[0][single], return_inverse=True)
            hit[single] = _told(answers, 4, uniq, n_singles)[back]
        return found, Strings(found, hit, n_strings)

    def ask_strings(table, answers):
        rows, s = [], None
        if table.num_rows:
            found, s = strings(table, answers)
            rows = T.slices(s.bucket) if len(s.bucket) else []
        pack = table["pack"][0].as_py() if rows else 0
        cols = [[r[0] for r in rows], [pack] * len(rows), [b - a for _, a, b in rows], [s.size[a:b].astype(np.uint16).tobytes() for _, a, b in rows], [s.bytes_of(found, range(a, b)) for _, a, b in rows], [s.least[a:b].tobytes() for _, a, b in rows]]
        return pa.table([pa.array(c, k) for c, k in zip(cols, [pa.int32()] * 3 + [pa.binary()] * 3)], names=["bucket", "pack", "n", "sizes", "bytes", "least"])

    kinds = {"n_bytes": (pa.int64(), "bigint"), "n_removed": (pa.int64(), "bigint"), "n_spans": (pa.int64(), "bigint"), "kept_sha256": (pa.string(), "string"), "kept": (pa.binary(), "binary"), "spans": (pa.list_(pa.list_(pa.int64())), "array<array<bigint>>")}

    def settle(table, answers):
        out = {o: [] for o in outputs}
        if table.num_rows:
            found, s = strings(table, answers)
            windows = s.size - depth + 1
            base = np.cumsum(windows) - windows
            own = {b: y for t, b, y in zip(answers["step"].to_pylist(), answers["bucket"].to_pylist(), answers["yes"].to_pylist()) if t == 2}
            yes = [T.flags(own[b], int(windows[lo:hi].sum())) for b, lo, hi in (T.slices(s.bucket) if len(s.bucket) else [])]
            yes, doc = _cat(yes, bool), s.doc[s.some]
            larger = doc > s.least[s.number]
            for g, (lo, hi, w, _) in enumerate(found):
                mine = np.flatnonzero(s.group[s.some] == g)
                n = windows[s.number[mine]]
                inner = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
                repeated = np.repeat(larger[mine], n)
                repeated |= yes[np.repeat(base[s.number[mine]], n) + inner] if len(inner) else False
                at = (np.repeat(w.at[s.some[mine] - s.base[g]], n) + inner)[repeated]
                cover = np.zeros(len(w.data) + 1, np.int32)
                cover[at] += 1  # every start occurs once
                np.add.at(cover, at + depth, -1)
                gone = np.cumsum(cover[:-1]) > 0
                texts = T.column(table, "text").slice(lo, hi - lo)
                a = 0
                for t in texts:
                    raw = t.as_buffer()
                    own_gone = gone[a : a + raw.size]
                    a += raw.size
                    removed = int(own_gone.sum())
                    edge = np.flatnonzero(np.diff(np.concatenate([[0], own_gone.astype(np.int8), [0]]))) if removed else np.zeros(0, np.int64)
                    kept = np.frombuffer(raw, np.uint8)[~own_gone].tobytes() if removed else raw.to_pybytes()
                    row = {"n_bytes": raw.size, "n_removed": removed, "n_spans": len(edge) // 2, "kept_sha256": hashlib.sha256(kept).hexdigest(), "kept": kept}
                    if "spans" in out:
                        row["spans"] = edge.reshape(-1, 2).tolist()
                    for o in outputs:
                        out[o].append(row[o])
        return pa.table([table["doc_id"].combine_chunks(), *(pa.array(out[o], kinds[o][0]) for o in outputs)], names=["doc_id", *outputs])

    first = cut(packed.groupBy("pack").applyInArrow(ask_grams, GRAMS).groupBy("bucket").applyInArrow(_answer_grams(1, HOT), ANSWERS))
    if not first.filter("step = 3").isEmpty():
        singles = packed.groupBy("pack").cogroup(first.groupBy("pack")).applyInArrow(ask_singles, GRAMS)
        first = first.unionAll(cut(singles.groupBy("bucket").applyInArrow(_answer_grams(4, HOT), ANSWERS)))
    asked = packed.groupBy("pack").cogroup(first.groupBy("pack")).applyInArrow(ask_strings, STRINGS)
    both = cut(asked.groupBy("bucket").applyInArrow(_answer_strings(depth), ANSWERS)).unionAll(first)
    schema = "doc_id bigint, " + ", ".join(f"{o} {kinds[o][1]}" for o in outputs)
    return packed.groupBy("pack").cogroup(both.groupBy("pack")).applyInArrow(settle, schema)
