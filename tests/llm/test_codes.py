"""Vector codes, byte-level BPE and periodic runs against brute force and the library."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from signalblind.llm import bytebpe, periods, vectorcodes
from signalblind.llm import text as T

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


# --- operator 11


def codes_by_force(rows, parts=4, entries=256, rounds=4):
    """Plain k-means in whole numbers of any size, every distance computed."""
    kept = [(i, [math.floor(1024 * float(np.float32(x))) for x in v], lab) for i, v, lab in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: r[0])
    w, most = len(kept[0][1]) // parts, 2**63 - 1
    error, code, books, of = {r[0]: 0 for r in kept}, {r[0]: "" for r in kept}, [], {}
    for p in range(parts):
        x = np.array([r[1][p * w : (p + 1) * w] for r in kept], object)
        book = x[:entries].copy()

        def nearest():
            for v in x:
                d = ((book - v) ** 2).sum(axis=1)
                yield min((e, j) for j, e in enumerate(d))

        for _ in range(rounds):
            own = [j for _, j in nearest()]
            for j in set(own):
                of_j = x[[k for k, a in enumerate(own) if a == j]]
                book[j] = [s // len(of_j) for s in of_j.sum(axis=0)]
        for r, (d, j) in zip(kept, nearest()):
            code[r[0]] += f"{j:02x}"
            error[r[0]] += d
        books += [str(v) for e in book for v in e]
    error = {i: min(e, most) for i, e in error.items()}
    for r in kept:
        of[r[2]] = of.get(r[2], 0) + error[r[0]]
    return sorted((r[0], code[r[0]], error[r[0]], min(of[r[2]], most), sha(",".join(books))) for r in kept)


def vectors(spark, rows):
    schema = "vec_id long, embedding array<float>, label int, code string, state string"
    return spark.createDataFrame([(*r, "x", "y") for r in rows], schema).repartition(3)


def random_rows(n, width, outliers=0.0, seed=3):
    rng = np.random.default_rng(seed)
    scale = lambda i: outliers if outliers and i % 40 == 0 else 1.0
    return [(i, [float(np.float32(x)) for x in rng.normal(size=width) * 0.3 * scale(i)], int(i % 3) if i % 7 else None) for i in range(n)]


@pytest.mark.parametrize("outliers", [0.0, 1e8, 1e30])
def test_vector_codes(spark, outliers):
    rows = random_rows(500, 8, outliers)
    rows += [(900 + i, rows[i][1], 1) for i in range(40)]
    rows += [(2000, None, 1), (2001, [1.0, None] + [0.0] * 6, 1), (2002, [float("nan")] * 8, 1), (2003, [float("-inf")] * 8, None)]
    random.Random(1).shuffle(rows)
    report = []
    assert sorted(tuple(r) for r in vectorcodes.compress(vectors(spark, rows), report=report).collect()) == codes_by_force(rows)
    assert len(report) == 4 and (outliers or max(report[1:]) < 0.95)  # bounds spare groups of entries


def test_vector_codes_with_ties_and_few_rows(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(v) for v in rng.integers(-1, 2, 8)], 0) for i in range(300)]
    assert sorted(tuple(r) for r in vectorcodes.compress(vectors(spark, rows)).collect()) == codes_by_force(rows)
    assert sorted(tuple(r) for r in vectorcodes.compress(vectors(spark, rows[:5])).collect()) == codes_by_force(rows[:5])


def test_vector_codes_of_odd_rows(spark):
    nothing = vectorcodes.compress(vectors(spark, []))
    assert nothing.count() == 0 and nothing.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert vectorcodes.compress(vectors(spark, [(1, None, 1), (None, None, None)])).count() == 0
    rows = [(1, [], 2), (1, [1.0] * 8, 2), (1, [1.0] * 8, 2), (None, [1.5] * 8, None), (7, [1.0] * 4, 2), (8, [1.0] * 3, 3)]
    out = {(r.vec_id, r.code, r.error, r.label_error) for r in vectorcodes.compress(vectors(spark, rows)).collect()}
    assert out == {(1, "00000000", 0, 0), (None, "02020202", 0, 0), (1, None, None, 0), (7, None, None, 0), (8, None, None, None)}


def test_bounds_never_exceed_the_distance():
    rng = np.random.default_rng(2)
    book, x = np.floor(rng.normal(size=(100, 4)) * 500), np.floor(rng.normal(size=(400, 4)) * 500)
    history, n = [book.astype(int).tolist()], len(x)
    groups = -(-100 // vectorcodes.GROUP)
    own, stamp, bound = np.zeros(n, np.uint8), np.full((n, groups), 255, np.uint8), np.zeros((n, groups), np.float32)
    for _ in range(6):
        r = vectorcodes.Round(history)
        near, exact, _ = r.assign(x, own, stamp, bound)
        d = ((x[:, None] - r.now[None]) ** 2).sum(axis=2)
        assert not exact and (own == d.argmin(axis=1)).all() and (near == d.min(axis=1)).all()
        d[np.arange(n), own] = np.inf
        for g, (lo, hi) in enumerate(r.groups):
            assert (bound[:, g] - r.way[stamp[:, g], g] <= np.sqrt(d[:, lo:hi].min(axis=1))).all()
        history.append(np.floor(r.now + rng.normal(size=book.shape) * 30).astype(int).tolist())


def test_hot_labels_are_salted(spark, monkeypatch):
    rows = random_rows(60, 4)
    expected = codes_by_force(rows)
    monkeypatch.setattr(vectorcodes, "LABELS", 1)
    assert sorted(tuple(r) for r in vectorcodes.compress(vectors(spark, rows)).collect()) == expected


# --- operator 12


def library(public):
    tiktoken = pytest.importorskip("tiktoken")
    path = public.path("byte_bpe_multi_50k.tiktoken")
    ranks = bytebpe.Ranks(path)
    return path, ranks, tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=ranks.rank, special_tokens={})


def test_byte_bpe_equals_the_library(docs, empty):
    public = pytest.importorskip("public_tokenizers")
    path, ranks, lib = library(public)
    expected = []
    for r in docs.collect():
        ids = lib.encode_ordinary(r.text or "")
        expected.append((r.doc_id, len(ids), sha(np.array(ids, "<u4").tobytes()), sha(lib.decode_bytes(ids))))
    found = bytebpe.encode(docs, path, public.PATTERN)
    assert sorted(map(repr, (tuple(r) for r in found.collect()))) == sorted(map(repr, expected))
    assert bytebpe.encode(empty, path, public.PATTERN).count() == 0
    for r in bytebpe.encode(docs, path, public.PATTERN, ("ids", "decoded", "decoded_sha256")).collect():
        assert ranks.decode(r.ids) == bytes(r.decoded) and sha(bytes(r.decoded)) == r.decoded_sha256


def test_byte_bpe_of_odd_texts():
    public = pytest.importorskip("public_tokenizers")
    _, ranks, lib = library(public)
    import regex

    split, pick = regex.compile(public.PATTERN), random.Random(4)
    tokens = [t for t in ranks.token if t]
    cases = ["a" * 5000, "ha" * 800, "=" * 701, " " * 999, "\n\r\n" * 200, "我" * 400, "x" + " " * 300 + "y", "0123456789" * 90]
    cases += ["".join(chr(pick.choice([pick.randrange(32, 0x2000), pick.randrange(0x10000, 0x32400), 32, 10])) for _ in range(40)) for _ in range(300)]
    cases += [b"".join(pick.choice(tokens) for _ in range(pick.randrange(40))).decode("utf-8", "ignore") for _ in range(1500)]
    cases += ["".join(pick.choice("ein") for _ in range(400)) for _ in range(50)]
    for text in cases:
        ids = np.frombuffer(b"".join(map(ranks.piece, bytebpe.pieces(split, text))), "<u4").tolist()
        assert ids == lib.encode_ordinary(text), text
        assert ranks.decode(ids) == text.encode()


def test_parts_are_cut_where_no_match_crosses(monkeypatch):
    public = pytest.importorskip("public_tokenizers")
    import regex

    monkeypatch.setattr(bytebpe, "CUT", 7)
    split, pick = regex.compile(public.PATTERN), random.Random(5)
    for _ in range(3000):
        text = "".join(pick.choice(["a", "b's", " ", "  ", "\n", "1", ".", "é"]) for _ in range(40))
        assert [p for part in bytebpe.parts(text) for p in bytebpe.pieces(split, part)] == split.findall(text)


# --- operator 13


def runs_by_force(w):
    n, out = len(w), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            s, length = i, j + q - i
            if j > i and length >= max(6, 4 * q) and not any(all(w[x] == w[x + d] for x in range(s, s + length - d)) for d in range(1, q)):
                out.append((s, length, q))
            i = max(j, i) + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def numbered(words):
    h = np.array(words, np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return h, T.mix(h[:-2] + T.mix(h[1:-1] + T.mix(h[2:]))) if len(words) > 2 else h[:0]


@pytest.mark.parametrize("window", [16, 1 << 15])
def test_runs_of_random_words(monkeypatch, window):
    monkeypatch.setattr(periods, "WINDOW", window)
    pick = random.Random(6)
    for _ in range(1500):
        n, s = pick.randrange(120), pick.choice([1, 2, 3, 6, 30])
        w = [pick.randrange(s) for _ in range(n)]
        for _ in range(pick.randrange(3)):
            if n > 8:
                a, p, m = pick.randrange(n), pick.randrange(1, 14), pick.randrange(4, 70)
                w[a : a + m] = [w[a + (i - a) % p] for i in range(a, min(n, a + m))]
        assert periods.runs(*numbered(w)) == runs_by_force(w)


def test_squares_are_nearest_repeats():
    pick = random.Random(7)
    for _ in range(300):
        w = [pick.randrange(2) for _ in range(pick.randrange(40))]
        for i, d in periods.squares(w):
            assert w[i + 1 - d : i + 1] == w[i + 1 - 2 * d : i + 1 - d] and i + 1 >= 2 * d


def test_long_runs_take_linear_time():
    for w, q in (([3] * 300_000, 1), ([i % 9973 for i in range(300_000)], 9973)):
        assert periods.runs(*numbered(w)) == [(0, 300_000, q)]


@pytest.mark.parametrize("plant", [False, True])
def test_periodic_runs(spark, docs, empty, plant):
    from fixtures import sentence

    more = [(1000 + i, sentence(60 + i, 40 + i) + " " + " ".join([sentence(5, 1 + i % 9)] * (3 + i % 5))) for i in range(150)]
    table = docs.select("doc_id", "text", F.col("spans").alias("runs")).unionByName(spark.createDataFrame(more, "doc_id long, text string"), allowMissingColumns=True)
    expected = []
    for r in table.collect():
        w = WORD.findall(r.text or "")
        h = zlib.crc32(str(r.doc_id).encode())
        g = h // 10
        if plant and r.doc_id is not None and h % 10 == 0 and w:
            a = g % len(w)
            p = 1 + (len(w) - a) // (3 + g % 8)
            w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
        found = runs_by_force(w)
        gone = {j for s, n, q in found for j in range(s + q, s + n)}
        s, n, q = min(found, key=lambda x: (-x[1], x[0], x[2]), default=(None, None, None))
        expected.append((r.doc_id, len(found), s, n, q, 1000 * n // q if found else None, sha("".join("%d,%d,%d\n" % x for x in found)), sha(" ".join(x for j, x in enumerate(w) if j not in gone))))
    assert sorted(map(repr, (tuple(r) for r in periods.detect(table, plant).collect()))) == sorted(map(repr, expected))
    assert sum(e[1] for e in expected) > 20 and periods.detect(empty).count() == 0
    for r in periods.detect(table, outputs=("runs", "runs_sha256", "collapsed", "collapsed_sha256")).collect():
        assert sha("".join(f"{x.start},{x.length},{x.period}\n" for x in r.runs)) == r.runs_sha256 and sha(r.collapsed) == r.collapsed_sha256
