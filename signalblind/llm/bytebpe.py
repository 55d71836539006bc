"""Byte-level BPE as a tree reduction: halves are encoded, then joined at their boundary.

A sequence of tokens is the encoding of its bytes exactly when every token and every two
neighbours encode to themselves, because two independent halves merge in the same order
together as apart until a merge crosses their boundary, and that merge only looks at the
tokens beside it. Encodings therefore form a monoid. To join two of them, only a window
around the boundary is encoded again. Where the window's outermost token comes out as it
was, its outer neighbour keeps a neighbour it is known to be compatible with, so everything
outside is settled; otherwise the window doubles on that side.
"""

import base64
import functools
import hashlib
import heapq
import re

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from signalblind.llm import text as T
from signalblind.llm.bpe import BEYOND_LATIN, unassigned

CUT = 1 << 20
FAN = 256
LEAF = 5
REMEMBERED = 400_000
_NEVER = 1 << 40


class Ranks:
    """Byte strings with their ranks, which are the token ids."""

    def __init__(self, path):
        with open(path, "rb") as f:
            self.rank = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        lacking = [b for b in range(256) if bytes([b]) not in self.rank]
        if lacking:
            raise ValueError(f"{path} has no rank for the bytes {lacking[:5]}")
        self.token = [b""] * (max(self.rank.values()) + 1)
        for t, i in self.rank.items():
            self.token[i] = t
        self.known, self.windows = {}, {}

    # --- encoding

    def halves(self, data):
        """Encoding of a byte string: both halves, then their join; the leaves are a few bytes."""
        if len(data) <= LEAF:
            return self.windows.get(data) or self.merged(data)
        h = len(data) >> 1
        return self.join(self.halves(data[:h]), self.halves(data[h:]))

    def join(self, a, b):
        """Encoding of two neighbours that are encodings themselves."""
        i = j = 1
        while True:
            i, j = min(i, len(a)), min(j, len(b))
            data = self.token[a[-1]] + self.token[b[0]] if i == j == 1 else self.decode(a[-i:] + b[:j])
            window = self.windows.get(data) or self.merged(data)
            left = i == len(a) or window[0] == a[-i]
            right = j == len(b) or window[-1] == b[j - 1]
            if left and right:
                return a[:-i] + window + b[j:]
            i, j = (i if left else 2 * i), (j if right else 2 * j)

    def merged(self, data):
        """Exact merging of a window: always the lowest rank, leftmost first."""
        if len(data) > 200:
            return self._merged_long(data)
        parts, get = [data[i : i + 1] for i in range(len(data))], self.rank.get
        ranks = [get(x + y, _NEVER) for x, y in zip(parts, parts[1:])]
        while ranks and (r := min(ranks)) != _NEVER:
            i = ranks.index(r)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del ranks[i]
            if i:
                ranks[i - 1] = get(parts[i - 1] + parts[i], _NEVER)
            if i < len(ranks):
                ranks[i] = get(parts[i] + parts[i + 1], _NEVER)
        found = tuple(self.rank[p] for p in parts)
        if len(data) <= 16:
            if len(self.windows) > REMEMBERED:
                self.windows.clear()
            self.windows[data] = found
        return found

    def _merged_long(self, data):
        """The same with a heap and ends instead of lists that move."""
        n, get = len(data), self.rank.get
        end, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = []

        def offer(i):
            j = end[i]
            if j < n and (r := get(data[i : end[j]])) is not None:
                heapq.heappush(heap, (r, i, end[j]))

        for i in range(n):
            offer(i)
        while heap:
            r, i, stop = heapq.heappop(heap)
            j = end[i]
            if j < 0 or j >= n or end[j] != stop:
                continue  # one of the two is part of a longer token by now
            end[i], end[j] = stop, -1
            if stop < n:
                before[stop] = i
            for x in (before[i], i):
                if x >= 0:
                    offer(x)
        out, i = [], 0
        while i < n:
            out.append(self.rank[data[i : end[i]]])
            i = end[i]
        return tuple(out)

    def piece(self, piece):
        """Ids of one match of the pattern as little-endian numbers; a vocabulary entry is one token."""
        found = self.known.get(piece)
        if found is None:
            data = piece.encode("utf-8")
            ids = (self.rank[data],) if data in self.rank else self.halves(data)
            found = np.array(ids, "<u4").tobytes()
            if len(self.known) > REMEMBERED:
                self.known.clear()
            if len(piece) <= 64:
                self.known[piece] = found
        return found

    # --- decoding

    def decode(self, ids):
        """Bytes of the tokens, neighbours joined level by level."""
        token = self.token
        parts = [token[i] for i in ids]
        while len(parts) > FAN:
            parts = [b"".join(parts[i : i + FAN]) for i in range(0, len(parts), FAN)]
        return b"".join(parts)


@functools.lru_cache(maxsize=2)
def ranks(path):
    return Ranks(path)


# --- pieces of a text

#: One letter, digit and sign known to every version, standing in for newer characters.
_STANDING_IN = {"L": "ա", "N": "١", "O": "‖"}
_SEAM = re.compile(r"\S \S")


@functools.lru_cache(maxsize=1 << 16)
def stand_in(letter):
    """A character of the same class as one that this Python's tables don't know.

    The pattern's library may have newer tables; it is asked by its own classes.
    """
    import tiktoken

    alone = {bytes([b]): b for b in range(256)}
    for kind in "LN":
        if tiktoken.Encoding(f"class-{kind}", pat_str=rf"\p{{{kind}}}", mergeable_ranks=alone, special_tokens={}).encode_ordinary(letter):
            return _STANDING_IN[kind]
    return _STANDING_IN["O"]


def parts(text):
    """Slices of about a megabyte, cut before a single blank between two other characters.

    No match of the pattern crosses such a place, nor does its look-ahead.
    """
    at = 0
    while len(text) - at > CUT and (seam := _SEAM.search(text, at + CUT)):
        yield text[at : seam.start() + 1]
        at = seam.start() + 1
    yield text[at:]


def pieces(split, text):
    """Matches of the pattern ``split`` (a compiled ``regex``)."""
    if text.isascii() or not BEYOND_LATIN.search(text) or not (new := set(unassigned().findall(text))):
        return split.findall(text)
    like = text.translate({ord(c): stand_in(c) for c in new})
    return [text[m.start() : m.end()] for m in split.finditer(like)]


def encode(docs: DataFrame, path: str, pattern: str, outputs=("n_tokens", "ids_sha256", "decoded_sha256")) -> DataFrame:
    """Encode and decode the whole ``text`` of every row.

    ``path`` names a file of base64 byte strings and ranks, ``pattern`` cuts the text into
    pieces that are encoded separately. ``ids_sha256`` digests the ids as little-endian
    unsigned 32-bit numbers, ``decoded_sha256`` the decoded bytes; ``outputs`` may also name
    ``ids`` (array) and ``decoded`` (binary). Null text is the empty text without tokens.
    Rows keep ``doc_id`` only (null or repeated ids as they are), so other columns never
    clash; a repeated row gives a repeated result, an empty table no rows. No shuffle.
    """
    kinds = {"n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string", "ids": "array<bigint>", "decoded": "binary"}
    make = {
        "n_tokens": lambda ids, out: len(ids),
        "ids_sha256": lambda ids, out: hashlib.sha256(ids.tobytes()).hexdigest(),
        "decoded_sha256": lambda ids, out: hashlib.sha256(out).hexdigest(),
        "ids": lambda ids, out: ids.tolist(),
        "decoded": lambda ids, out: out,
    }
    arrow = {"bigint": pa.int64(), "string": pa.string(), "array<bigint>": pa.list_(pa.int64()), "binary": pa.binary()}
    schema = ", ".join([f"doc_id {docs.schema['doc_id'].dataType.simpleString()}", *(f"{o} {kinds[o]}" for o in outputs)])

    def run(batches):
        vocab, split = ranks(path), regex.compile(pattern)
        for batch in batches:
            texts = T.column(batch, "text")
            for lo, hi, _, _ in T.groups(texts):
                rows = []
                for text in texts.slice(lo, hi - lo).to_pylist():
                    packed = b"".join([b"".join(map(vocab.piece, pieces(split, part))) for part in parts(text)])
                    ids = np.frombuffer(packed, "<u4")
                    rows.append((ids, vocab.decode(ids.tolist())))
                cols = [pa.array([make[o](*r) for r in rows], arrow[kinds[o]]) for o in outputs]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), *cols], ["doc_id", *outputs])

    return docs.select("doc_id", "text").mapInArrow(run, schema)
