"""BPE encoding by speculation: longest matches first, then a check of every adjacent pair.

A token sequence is the BPE encoding of a word exactly when every token encodes itself and
every two neighbours encode to themselves, because a merge only looks at neighbours. So:

1. *speculate*: cut a word greedily into the longest vocabulary entries;
2. *verify*: test all adjacent pairs of all new words at once. Undoing merges from the
   highest rank down gives the pieces left and right of the boundary at each point of
   time; the pair fails when some such pieces have a merge across the boundary that comes
   before the merges that consumed them;
3. *repair*: only words with a failing pair are merged step by step.
"""

import functools
import hashlib
import heapq
import json
import re
import unicodedata

import numpy as np
import pyarrow as pa
import regex
import tokenizers
from pyspark.sql import DataFrame

from signalblind.llm import text as T

SPECIAL = ("<|startoftext|>", "<|endoftext|>")
CUT = 1 << 20
REMEMBERED = 400_000
_NEVER = np.int64(1) << 40


def byte_letters():
    """The printable character that stands for each byte in byte-level vocabularies."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = {b: chr(b) for b in keep}, 256
    for b in range(256):
        if b not in out:
            out[b], extra = chr(extra), extra + 1
    return [out[b] for b in range(256)]


class Vocabulary:
    """Ids, merge ranks and the way each token was put together."""

    def __init__(self, path):
        self.path = path
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.ids = model["vocab"]
        self.suffix = model["end_of_word_suffix"] or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = max(self.ids.values()) + 1
        self.text = [""] * size
        for t, i in self.ids.items():
            self.text[i] = t
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        left = np.array([self.ids[a] for a, _ in pairs], np.int64)
        right = np.array([self.ids[b] for _, b in pairs], np.int64)
        made = np.array([self.ids[a + b] for a, b in pairs], np.int64)
        self.made = made.tolist()
        #: rank of the merge that made a token (-1: a symbol), and its two parts
        self.made_at = np.full(size, -1, np.int64)
        self.left, self.right = np.full(size, -1, np.int64), np.full(size, -1, np.int64)
        order = np.arange(len(made))[::-1]  # of several ways the first merge counts
        self.made_at[made[order]], self.left[made[order]], self.right[made[order]] = order, left[order], right[order]
        key = left * size + right
        self.size, by = size, np.argsort(key)
        self.keys, self.ranks = key[by], by
        self.rank = dict(zip(key.tolist(), range(len(key))))
        self.proposable = self._self_encoding().tolist()
        #: by its first two letters, how long a token can be
        self.reach = {}
        for t in self.ids:
            bare = len(t) - len(self.suffix) * t.endswith(self.suffix)
            self.reach[t[:2]] = max(bare, self.reach.get(t[:2], 1))
        self.letters = byte_letters()
        self.known = {}

    @functools.cached_property
    def library(self):
        return tokenizers.Tokenizer.from_file(self.path)

    def merge_rank(self, a, b):
        key = a * self.size + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], _NEVER)

    def compatible(self, a, b, before=None):
        """For each pair of tokens: does no merge cross their boundary (ahead of ``before``)?"""
        a, b = a.copy(), b.copy()
        until_a = np.full(len(a), _NEVER - 1) if before is None else before.copy()  # when the left piece is consumed
        until_b = until_a.copy()
        good, open_ = np.ones(len(a), bool), np.arange(len(a))
        while len(open_):
            x, y, ua, ub = a[open_], b[open_], until_a[open_], until_b[open_]
            m = self.merge_rank(x, y)
            # of equal ranks the leftmost goes first: left of the boundary before, right of it after
            crosses = (m < ua) & ((m <= ub) if before is None else (m < np.minimum(ua, ub)) | ((m == ub) & (ub < ua)))
            good[open_[crosses]] = False
            rx, ry = self.made_at[x], self.made_at[y]
            undo_left = rx >= ry
            live = ~crosses & ((rx >= 0) | (ry >= 0))
            l, r = open_[live & undo_left], open_[live & ~undo_left]
            until_a[l], a[l] = self.made_at[a[l]], self.right[a[l]]
            until_b[r], b[r] = self.made_at[b[r]], self.left[b[r]]
            open_ = open_[live]
        return good

    def _self_encoding(self):
        """Tokens whose own text encodes to themselves; only these are proposed."""
        ok = np.ones(self.size, bool)
        made = np.flatnonzero(self.made_at >= 0)
        made = made[np.argsort(self.made_at[made])]
        alone = self.compatible(self.left[made], self.right[made], self.made_at[made])
        for t, fine in zip(made.tolist(), alone.tolist()):
            ok[t] = fine and ok[self.left[t]] and ok[self.right[t]]
        return ok

    def symbols(self, word):
        s = [self.letters[b] for b in word.encode("utf-8")]
        s[-1] += self.suffix
        return s

    def propose(self, symbols):
        """Greedy longest match over the symbols."""
        whole, n, out, at = "".join(symbols), len(symbols), [], 0
        ids, ok, reach = self.ids, self.proposable, self.reach
        while at < n:
            for stop in range(min(n, at + reach.get(whole[at : at + 2], 1)), at, -1):
                t = ids.get(whole[at:] if stop == n else whole[at:stop])
                if t is not None and ok[t]:
                    out.append(t)
                    at = stop
                    break
        return out

    def merge(self, symbols):
        """Exact merging: always the lowest rank, leftmost first."""
        out = [self.ids[s] for s in symbols]
        if len(out) > 200:
            return self._merge_long(out)
        size, get, never = self.size, self.rank.get, 1 << 40
        ranks = [get(a * size + b, never) for a, b in zip(out, out[1:])]
        while ranks and (r := min(ranks)) != never:
            i = ranks.index(r)
            out[i : i + 2] = [self.made[r]]
            del ranks[i]
            if i:
                ranks[i - 1] = get(out[i - 1] * size + out[i], never)
            if i < len(ranks):
                ranks[i] = get(out[i] * size + out[i + 1], never)
        return out

    def _merge_long(self, out):
        """The same with a heap, so that a word of a million letters is no trouble."""
        n, size, get = len(out), self.size, self.rank.get
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        heap = [(r, i, out[i], out[i + 1]) for i in range(n - 1) if (r := get(out[i] * size + out[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i] if out[i] == a else -1
            if j < 0 or out[j] != b:
                continue
            out[i], out[j], after[i] = self.made[r], -1, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for x in (before[i], i):
                if x >= 0 and after[x] >= 0 and (q := get(out[x] * size + out[after[x]])) is not None:
                    heapq.heappush(heap, (q, x, out[x], out[after[x]]))
        return [t for t in out if t >= 0]

    def learn(self, words):
        """Encode words not met before: propose all, verify all pairs at once, repair."""
        if len(self.known) > REMEMBERED:
            self.known = {}
        new = [w for w in words if w not in self.known]
        if not new:
            return
        symbols = [self.symbols(w) for w in new]
        tokens = [self.propose(s) for s in symbols]
        sizes = np.array([len(t) for t in tokens])
        flat = np.fromiter((i for t in tokens for i in t), np.int64, sizes.sum())
        owner = np.repeat(np.arange(len(new)), sizes)
        inside = owner[1:] == owner[:-1]
        a, b = flat[:-1][inside], flat[1:][inside]
        pairs, back = np.unique(a * self.size + b, return_inverse=True)
        fine = self.compatible(pairs // self.size, pairs % self.size)[back]
        for w in np.unique(owner[:-1][inside][~fine]).tolist():
            tokens[w] = self.merge(symbols[w])
        for w, t in zip(new, tokens):
            self.known[w] = (len(t), " ".join(map(str, t)), " ".join(self.text[i] for i in t))


@functools.lru_cache(maxsize=2)
def vocabulary(path):
    return Vocabulary(path)


#: Pieces of a normalised text, as the tokenizer file defines them.
PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")


#: Latin letters and common punctuation are known to every version.
BEYOND_LATIN = re.compile("[^\\x00-\u024f\u2010-\u2027]")


@functools.lru_cache(maxsize=1)
def unassigned():
    """Letters that this Python's character tables don't know; the library's may be newer."""
    gaps, last = [], None
    for c in range(0x110000):
        if unicodedata.category(chr(c)) == "Cn":
            if last is None:
                last = c
        elif last is not None:
            gaps.append((last, c - 1))
            last = None
    return re.compile("[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in [*gaps, (last or 0x10FFFF, 0x10FFFF)]) + "]")


def pieces(vocab, text):
    """Normalised pieces of a text; letters unknown here are left to the library's own splitter."""
    if not text.isascii() and BEYOND_LATIN.search(text) and unassigned().search(text):
        norm, split = vocab.library.normalizer, vocab.library.pre_tokenizer
        back = {c: b for b, c in enumerate(vocab.letters)}
        return [bytes(back[c] for c in p).decode() for p, _ in split.pre_tokenize_str(norm.normalize_str(text))]
    return PIECES.findall(normalise(text))


def parts(text):
    """Slices of a text of about a megabyte, cut where a blank follows, never elsewhere."""
    at = 0
    while len(text) - at > CUT:
        stop = text.find(" ", at + CUT)
        if stop < 0:
            break
        yield text[at:stop]
        at = stop
    yield text[at:]


def normalise(text):
    """NFC, then lower case letter by letter (a final sigma is no exception)."""
    if not text.isascii():
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
    return text.lower()


def encoded(vocab, texts):
    """Per text: number of tokens, digest of the ids, digest of the decoded text, ids and decoded text.

    A group of texts is cut first, so that its new words are proposed and verified together.
    """
    split = re.compile("(" + "|".join(map(re.escape, vocab.special)) + ")") if vocab.special else None
    for text in texts if sum(map(len, texts)) > 4 * CUT else [texts]:
        yield from _encoded(vocab, split, [text] if isinstance(text, str) else text)


def _cut(vocab, split, text):
    for part in parts(text):
        for piece in split.split(part) if split and "<|" in part else (part,):
            yield (None, piece) if piece in vocab.special else (pieces(vocab, piece), None)


def _encoded(vocab, split, texts):
    cut = [list(_cut(vocab, split, text)) for text in texts]
    vocab.learn({w for parts in cut for words, _ in parts if words for w in words})
    known = vocab.known
    for parts in cut:
        n, ids, decoded = 0, [], []
        for words, special in parts:
            found = [(1, str(vocab.special[special]), special)] if special else [known[w] for w in words]
            if found:
                n += sum([f[0] for f in found])
                ids.append(" ".join([f[1] for f in found]))
                decoded.append(" ".join([f[2] for f in found]))
        hid, hdec = hashlib.sha256(" ".join(ids).encode()), hashlib.sha256(" ".join(decoded).encode())
        yield n, hid.hexdigest(), hdec.hexdigest(), ids, decoded


def encode(docs: DataFrame, path: str, outputs=("n_tokens", "ids_sha256", "decoded_sha256"), keep_words=True) -> DataFrame:
    """Encode and decode the whole ``text`` of every row with the vocabulary at ``path``.

    ``outputs`` may also name ``ids`` (array of token ids) and ``decoded`` (text). Null text
    is the empty text: no tokens. Rows keep ``doc_id`` only, so other columns never clash;
    a repeated row gives a repeated result. No shuffle. Without ``keep_words`` a worker
    forgets the words of a task when it ends, for less memory.
    """
    kinds = {"n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string", "ids": "array<int>", "decoded": "string"}
    key = docs.schema["doc_id"].dataType.simpleString()
    schema = ", ".join([f"doc_id {key}", *(f"{o} {kinds[o]}" for o in outputs)])

    def run(batches):
        vocab = vocabulary(path)
        for batch in batches:
            texts = T.column(batch, "text")
            for lo, hi, _, _ in T.groups(texts):
                rows = list(encoded(vocab, texts.slice(lo, hi - lo).to_pylist()))
                cols = {
                    "n_tokens": lambda: pa.array([r[0] for r in rows], pa.int64()),
                    "ids_sha256": lambda: pa.array([r[1] for r in rows], pa.string()),
                    "decoded_sha256": lambda: pa.array([r[2] for r in rows], pa.string()),
                    "ids": lambda: pa.array([[int(i) for p in r[3] for i in p.split()] for r in rows], pa.list_(pa.int32())),
                    "decoded": lambda: pa.array([" ".join(r[4]) for r in rows], pa.string()),
                }
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), *(cols[o]() for o in outputs)], ["doc_id", *outputs])

    def forget():
        if not keep_words:
            vocabulary(path).known.clear()

    return docs.select("doc_id", "text").mapInArrow(T.released(run, forget), schema)
