"""Maximal runs of words with an exponent of four or more, by last occurrences in a suffix automaton.

The suffix links of an automaton form a tree in which the suffixes of a prefix are the path
from the prefix's state to the root. Going through the prefixes in order, every path is
recoloured with the number of the prefix (the access operation of link-cut trees), and the
segments it replaces say where its suffixes ended last: a segment of colour e whose longest
string has L words means that the last L words before i also ended at e and no nearer. With
i - e <= L the two overlap or touch, which is a square of period i - e; comparing words that
far apart extends it to a run. Nothing nearer ends there, so that period is the smallest.

Most texts have no such run, so the automaton only sees stretches that can hold one. In a
run of period q and length l >= 4q all words from the first q on begin three words (fewer at
the end) that began q words before, too. So for some power of two D with D/2 < q <= D there
are at least l - q - 2 > 1.5 D - 2 neighbouring places whose three words were last seen at
most D words before. Stretches as long as that, with D words more on their left and two on
their right, hold every run whole.
"""

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from signalblind.llm import text as T

EXPONENT, LEAST = 4, 6
#: Words of a stretch that one automaton takes, unless a longer period needs more.
WINDOW = 1 << 15


class Links:
    """Suffix automaton of a sequence; only what the tree of suffix links needs is kept."""

    def __init__(self, words):
        link, length, step, prefix = [-1], [0], [{}], []
        last = 0
        for w in words:
            now = len(link)
            link.append(0)
            length.append(length[last] + 1)
            step.append({})
            p = last
            while p >= 0 and w not in step[p]:
                step[p][w] = now
                p = link[p]
            if p >= 0:
                q = step[p][w]
                if length[q] != length[p] + 1:
                    copy = len(link)
                    link.append(link[q])
                    length.append(length[p] + 1)
                    step.append(step[q].copy())
                    while p >= 0 and step[p].get(w) == q:
                        step[p][w] = copy
                        p = link[p]
                    link[q] = copy
                    q = copy
                link[now] = q
            prefix.append(now)
            last = now
        self.link, self.length, self.prefix = link, length, prefix


def squares(words):
    """(end, distance) of squares, the end being the last word of the second half.

    Every run of period q and length 3q or more gives (i, q) for each of its words i from
    number 3q on. A preferred path is a splay tree ordered by depth whose root carries the
    colour; parents of roots are the path's upper neighbour in the tree of links.
    """
    tree = Links(words)
    up, length = tree.link, tree.length
    n = len(up)
    left, right, colour = [-1] * n, [-1] * n, [-1] * n
    up[0] = -1
    for i, v in enumerate(tree.prefix):
        below, u = -1, v
        while u >= 0:
            # bring u to the root of its splay tree
            while True:
                p = up[u]
                if p < 0 or (left[p] != u and right[p] != u):
                    break
                g = up[p]
                inner = g >= 0 and (left[g] == p or right[g] == p)
                if inner and (left[g] == p) == (left[p] == u):
                    turn = ((p, g), (u, p))
                elif inner:
                    turn = ((u, p), (u, g))
                else:
                    turn = ((u, p),)
                for c, d in turn:  # c goes above its parent d
                    o = up[d]
                    if left[d] == c:
                        k = right[c]
                        left[d], right[c] = k, d
                    else:
                        k = left[c]
                        right[d], left[c] = k, d
                    if k >= 0:
                        up[k] = d
                    up[c], up[d] = o, c
                    if o >= 0:
                        if left[o] == d:
                            left[o] = c
                        elif right[o] == d:
                            right[o] = c
                    if colour[d] >= 0 and (o < 0 or (left[o] != c and right[o] != c)):
                        colour[c] = colour[d]
            before = colour[u]
            if before >= 0 and i - before <= length[u]:
                yield i, i - before
            deeper = right[u]
            if deeper >= 0:
                colour[deeper] = before
            right[u] = below
            below = u
            u = up[u]
        # the last one visited is the root of the whole path
        colour[below] = i


def stretch(words, i, q):
    """(start, end) of the longest stretch around word ``i`` in which words ``q`` apart are equal."""

    def reach(at, way):
        """How many words on from ``at`` equal the ones q before them."""
        total, size = 0, 64
        while True:
            room = len(words) - at if way > 0 else at - q + 1
            some = min(size, room)
            if some <= 0:
                return total
            if way > 0:
                differ = words[at : at + some] != words[at - q : at - q + some]
            else:
                differ = (words[at - some + 1 : at + 1] != words[at - some + 1 - q : at + 1 - q])[::-1]
            if differ.any():
                return total + int(differ.argmax())
            total, at, size = total + some, at + way * some, size * 2

    return i - q - reach(i, -1) + 1, i + reach(i + 1, 1) + 1


def candidates(words, triples):
    """[first, last) of stretches that hold every run whole, and the longest period of each."""
    n = len(words)
    if n < LEAST:
        return []
    order = np.argsort(triples, kind="stable")
    same = triples[order][1:] == triples[order][:-1]
    back = np.full(len(triples), n, np.int64)
    back[order[1:][same]] = (order[1:] - order[:-1])[same]
    found, d = [], 1
    while EXPONENT * (d // 2 + 1) <= n:
        near = np.concatenate([[False], back <= d, [False]])
        edge = np.flatnonzero(near[1:] != near[:-1]).reshape(-1, 2)
        q = d // 2 + 1
        enough = np.diff(edge, axis=1)[:, 0] >= max(LEAST, EXPONENT * q) - q - 2
        found += [(max(0, a - d), min(n, b + 2), d) for a, b in edge[enough].tolist()]
        d *= 2
    out = []
    for a, b, d in sorted(found):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]), max(d, out[-1][2]))
        else:
            out.append((a, b, d))
    return out


def windows(a, b, d):
    """Overlapping parts of a long stretch; each run shows three periods and a word in one of them."""
    size = max(WINDOW, 8 * d)
    for at in range(a, max(a + 1, b - size // 2), size // 2):
        yield at, min(b, at + size)


def runs(words, triples):
    """(start, length, period) of every run, by start, then period.

    ``words`` numbers equal words alike, ``triples`` the three words from each one on (as
    many as there are whole ones).
    """
    found = set()
    for a, b, d in candidates(words, triples):
        for lo, hi in windows(a, b, d):
            until = {}  # by period, the last word of the run found last
            for i, q in squares(words[lo:hi].tolist()):
                if until.get(q, -1) >= i:
                    continue
                start, end = stretch(words, lo + i, q)
                until[q] = end - 1 - lo
                if end - start >= max(LEAST, EXPONENT * q):
                    found.add((start, end - start, q))
    return sorted(found, key=lambda r: (r[0], r[2]))


def planted(n, doc_id):
    """Numbers of the original words, a known share of documents ending in copies of a word sequence."""
    at = np.arange(n)
    if n and doc_id is not None:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            at[a:] = a + (at[a:] - a) % p
    return at


def collapse(n, found):
    """Flags of the words that stay: a run keeps its first period only."""
    change = np.zeros(n + 1, np.int64)
    for start, length, q in found:
        change[start + q] += 1
        change[start + length] -= 1
    return np.cumsum(change[:n]) == 0


OUTPUTS = ("n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")


def detect(docs: DataFrame, plant=False, outputs=OUTPUTS) -> DataFrame:
    """Runs of every whole ``text``: stretches of words with a smallest period q, q words apart
    equal, at least max(6, 4q) long and not extendable.

    start, length, period and exponent_milli tell the longest run (ties: smallest start, then
    period) and are null without one. ``runs_sha256`` digests ``start,length,period`` lines of
    all, ``collapsed_sha256`` the words left when every run keeps its first period, joined by
    blanks. ``outputs`` may also name ``runs`` (array of structs) and ``collapsed`` (text).
    ``plant`` first turns the ends of some documents into repetitions, as their doc_id says.
    Null and empty texts have no words and no runs; a null doc_id plants nothing; repeated
    rows give repeated results, an empty table none. Rows keep ``doc_id`` only. No shuffle.
    """
    struct = "array<struct<start:bigint,length:bigint,period:bigint>>"
    kinds = dict.fromkeys(OUTPUTS, "bigint") | {"runs_sha256": "string", "collapsed_sha256": "string", "runs": struct, "collapsed": "string"}
    arrow = {"bigint": pa.int64(), "string": pa.string(), struct: pa.list_(pa.struct([(k, pa.int64()) for k in ("start", "length", "period")]))}
    schema = ", ".join([f"doc_id {docs.schema['doc_id'].dataType.simpleString()}", *(f"{o} {kinds[o]}" for o in outputs)])

    def results(data, spans, hashes, doc_id):
        n = len(hashes)
        at = planted(n, doc_id) if plant else np.arange(n)
        numbers = hashes[at]
        with np.errstate(over="ignore"):
            triples = T.mix(numbers[:-2] + T.mix(numbers[1:-1] + T.mix(numbers[2:]))) if n > 2 else numbers[:0]
        found = runs(numbers, triples)
        kept = at[collapse(n, found)]
        text = b" ".join([data[a:b] for a, b in spans[kept].tolist()])
        best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
        return {
            "n_runs": len(found), "start": best[0], "length": best[1], "period": best[2],
            "exponent_milli": 1000 * best[1] // best[2] if found else None,
            "runs_sha256": hashlib.sha256("".join("%d,%d,%d\n" % r for r in found).encode()).hexdigest(),
            "collapsed_sha256": hashlib.sha256(text).hexdigest(),
            "runs": [dict(zip(("start", "length", "period"), r)) for r in found], "collapsed": text.decode("utf-8") if "collapsed" in outputs else None,
        }

    def run(batches):
        for batch in batches:
            texts, ids = T.column(batch, "text"), batch.column("doc_id")
            for lo, hi, data, offsets in T.groups(texts):
                words = T.Words(data, offsets)
                spans, data = np.column_stack([words.start, words.end]), data.tobytes()
                rows = [results(data, spans[a:b], words.hash[a:b], i.as_py()) for a, b, i in zip(words.first[:-1], words.first[1:], ids.slice(lo, hi - lo))]
                cols = [pa.array([r[o] for r in rows], arrow[kinds[o]]) for o in outputs]
                yield pa.RecordBatch.from_arrays([ids.slice(lo, hi - lo), *cols], ["doc_id", *outputs])

    return docs.select("doc_id", "text").mapInArrow(run, schema)
