"""Every operator against brute force on texts that are null, empty, long, repeated or odd."""

import collections
import hashlib
import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from signalblind.llm import anchors, bpe, components, decontam, langid, licenses, paritysketch, pii, quality, quotes, suffixes

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def same_rows(found, expected):
    assert sorted(map(repr, found)) == sorted(map(repr, expected))


def test_language(docs, empty):
    model = langid.fit(langid.training_rows(docs), per_language=100)
    out = {r.doc_id: r for r in langid.predict(docs, model).collect()}
    assert out[0].lang_pred == out[1].lang_pred == "und" and out[1].score == 0.0
    assert out[5].lang_pred in ("en", "de") and 0 <= out[5].score <= 1
    assert langid.predict(docs, model).count() == docs.count() and langid.predict(empty, model).count() == 0
    assert langid.fit(langid.training_rows(empty)) is None
    assert {r.lang_pred for r in langid.predict(docs, None).collect()} == {"und"}


def test_language_ignores_other_columns(docs):
    model = langid.fit(langid.training_rows(docs), per_language=100)
    other = docs.withColumns({"lang": F.lit("xx"), "source": F.lit("y"), "doc_id": F.col("doc_id") + 1000})
    a = [(r.doc_id, r.lang_pred, r.score) for r in langid.predict(docs, model).collect() if r.doc_id is not None]
    b = [(r.doc_id - 1000, r.lang_pred, r.score) for r in langid.predict(other, model).collect() if r.doc_id is not None]
    same_rows(a, b)


def test_language_held_out_accuracy(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = langid.predict(d, langid.fit(langid.training_rows(d)), ["doc_id", "lang"]).filter(langid.held_out() & F.col("lang").isNotNull())
    assert out.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.97


def test_word_repeats(docs, empty):
    rows = docs.collect()
    words = [WORD.findall(r.text or "") for r in rows]
    seen = collections.Counter(tuple(w[i : i + 35]) for w in words for i in range(len(w) - 34))
    expected = []
    for r, w in zip(rows, words):
        gone = [False] * len(w)
        for i in range(len(w) - 34):
            if seen[tuple(w[i : i + 35])] > 1:
                gone[i : i + 35] = [True] * 35
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        expected.append((r.doc_id, len(w), sum(gone), sha(kept)))
    found = anchors.remove_repeats(docs)
    same_rows([tuple(r) for r in found.collect()], expected)
    assert any(e[2] for e in expected) and anchors.remove_repeats(empty).count() == 0
    for r in anchors.remove_repeats(docs, outputs=("kept", "kept_sha256", "spans")).collect():
        assert sha(r.kept) == r.kept_sha256 and all(b - a >= 35 for a, b in r.spans)


def test_byte_repeats(docs, empty):
    rows = docs.collect()
    least = {}
    order = lambda r: (r.doc_id is None, r.doc_id)
    for r in rows:
        b = (r.text or "").encode()
        for i in range(len(b) - 49):
            least[b[i : i + 50]] = min(least.get(b[i : i + 50], order(r)), order(r))
    expected = []
    for r in rows:
        b = (r.text or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - 49):
            if least[b[i : i + 50]] < order(r):
                gone[i : i + 50] = b"\1" * 50
        spans = sum(1 for i in range(len(b)) if gone[i] and not (i and gone[i - 1]))
        expected.append((r.doc_id, len(b), sum(gone), spans, sha(bytes(x for x, g in zip(b, gone) if not g))))
    same_rows([tuple(r) for r in suffixes.remove_repeats(docs).collect()], expected)
    assert any(e[2] for e in expected) and suffixes.remove_repeats(empty).count() == 0


def test_byte_repeats_of_a_passage_that_many_share(spark, monkeypatch, tmp_path):
    from fixtures import sentence

    passage, answer = sentence(31, 60), suffixes._answer_strings
    rows = [(i, f"{sentence(1000 + i, 25)} {passage} {sentence(3000 + i, 25)}") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)

    def watched(depth):
        run = answer(depth)

        def watch(table):
            with open(tmp_path / f"{table['bucket'][0]}", "w") as f:
                f.write(str(sum(len(x) for x in table["bytes"].to_pylist())))
            return run(table)

        return watch

    monkeypatch.setattr(suffixes, "_answer_strings", watched)
    monkeypatch.setattr(suffixes, "PER_BUCKET", 2048)
    monkeypatch.setattr(suffixes, "HOT", 8, raising=False)
    least, expected = {}, []
    for i, t in rows:
        gone = set()
        for a in range(len(t) - 49):
            if least.setdefault(t[a : a + 50], i) < i:
                gone.update(range(a, a + 50))
        expected.append((i, sha(bytes(ord(c) for a, c in enumerate(t) if a not in gone))))
    same_rows([tuple(r) for r in suffixes.remove_repeats(docs, outputs=("kept_sha256",)).collect()], expected)
    # the passage's outer grams have one string a document, 20 kB in a single bucket
    assert 0 < max(int(f.read_text()) for f in tmp_path.iterdir()) < 8192


def test_quotations(spark):
    rows = [
        (1, 0, "a", "First line.\nSecond line."), (1, 1, "b", "> first  LINE.\nI agree."), (1, 2, "a", "Other topic."), (1, 3, "c", ">> First line.\n> I agree.\nMe too."),
        (1, 4, "d", "> never written\nHm"), (1, 5, "a", None), (2, 0, "x", "First line."), (None, 0, "x", "> First line."), (3, None, "x", ""),
    ]
    d = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("own", F.lit(1))
    out = {(r.conv_id, r.turn): r for r in quotes.conversations(d).collect()}
    assert len(out) == len(rows)
    assert out[1, 1].reply_to == 0 and out[1, 1].text == "I agree." and (out[1, 1].n_quoted, out[1, 1].n_linked) == (1, 1)
    assert out[1, 2].reply_to == 1 and out[1, 3].reply_to == 1 and out[1, 3].text == "Me too." and out[1, 3].n_linked == 2
    assert out[1, 4].n_linked == 0 and out[1, 4].reply_to == 3 and out[1, 5].text == ""
    assert {out[1, t].thread for t in range(6)} == {0} and out[2, 0].reply_to is None
    assert out[None, 0].thread == 0 and out[3, None].reply_to is None
    assert quotes.conversations(d.limit(0)).count() == 0


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def base_spans(text):
    for kind, p in PATTERNS.items():
        for m in re.finditer(p, text):
            d = re.sub("[^0-9]", "", m.group())
            luhn = sum((2 * int(c) - 9 if int(c) > 4 else 2 * int(c)) if i % 2 else int(c) for i, c in enumerate(reversed(d))) % 10 == 0
            if {"email": True, "ip": kind == "ip" and all(int(x) < 256 for x in m.group().split(".")), "card": 13 <= len(d) <= 19 and luhn, "phone": 9 <= len(d) <= 15}[kind]:
                yield kind, m.start(), m.end()


def test_personal_data(docs, empty):
    for model in (None, "fit"):
        found = pii.detect(docs, model, ("doc_id", "text")).collect()
        same_rows([(r.doc_id, [(s.kind, s.start, s.end) for s in r.spans if s.base]) for r in found], [(r.doc_id, list(base_spans(r.text or ""))) for r in docs.collect()])
    assert pii.detect(empty, None).count() == 0 and pii.detect(empty).count() == 0
    out = {r.doc_id: r.text for r in pii.redact(docs, None).collect()}
    assert out[0] is None and out[16] == "Mail me: <EMAIL>, <PHONE> or <IP> and 10.0.0.256."


def test_personal_data_is_fitted_on_every_candidate(spark, monkeypatch):
    """The weights of the rows that reach the trees add up to all candidates, also beyond 20,000."""
    seen = []

    class Trees:
        def __init__(self, weightCol=None, **_):
            self.weight = weightCol

        def fit(self, rows):
            seen.append((rows.agg(F.sum(self.weight)).first()[0], rows.count()))
            raise InterruptedError

    monkeypatch.setattr(pii, "GBTClassifier", Trees)
    text = F.format_string("u%d@b.c and 1234567%d", "id", "id")
    found = pii.candidates(spark.range(30_000).select(F.col("id").alias("doc_id"), text.alias("text")))
    with pytest.raises(InterruptedError):
        pii.fit(found)
    apart = F.pmod(F.xxhash64(F.lit("part"), "x.hit", "x.before"), F.lit(4)) == 0
    every = found.select(F.explode(F.concat(*pii.PATTERNS)).alias("x"))
    assert seen[0][0] == every.filter(~apart).count() > 20_000 and seen[0][1] < 1_000


def test_quality_counts(docs, empty):
    expected = []
    for r in docs.collect():
        t = r.text or ""
        w = WORD.findall(t)
        n = collections.Counter(zip(w, w[1:], w[2:]))
        covered = {j for i in range(len(w) - 2) if n[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
        expected.append((r.doc_id, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered), failed))
    out = quality.judged(docs)
    same_rows([tuple(r) for r in out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect()], expected)
    assert not out.filter("kept and base_failed").count() and quality.judged(empty).count() == 0


def test_quality_agrees_with_labels(spark):
    d = "/root/testdata/sf0.01"
    out = quality.judged(spark.read.parquet(f"{d}/documents.parquet")).select("doc_id", "base_failed", "kept").join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id")
    assert out.filter("not base_failed").agg(F.avg((F.col("kept") == (F.col("quality") == 1)).cast("int"))).first()[0] > 0.95


def test_licences(docs, empty):
    sets = [(n, set(licenses.bigrams(t))) for n, ts in sorted(licenses.TEMPLATES.items()) for t in ts]
    expected = []
    for r in docs.collect():
        lines = (r.text or "").split("\n")
        best, n = None, 0
        for p in lines + ([r.text] if len(lines) > 1 else []):
            g = set(licenses.bigrams(p or ""))
            hits = [(-2 * len(g & s) / (len(g) + len(s)), name) for name, s in sets if g and 2 * len(g & s) >= 0.8 * (len(g) + len(s))]
            n += bool(hits)
            best = min([best, *hits] if best else hits, default=None)
        expected.append((r.doc_id, best and best[1], best and round(-best[0], 6), n))
    same_rows([tuple(r) for r in licenses.scan(docs).collect()], expected)
    assert any(e[1] == "MIT" for e in expected) and licenses.scan(empty).count() == 0


def test_licences_across_lines(spark):
    import textwrap

    from fixtures import sentence

    before, after = sentence(41, 80), sentence(42, 80)
    whole = {n: licenses.TEMPLATES[n] for n in ("MIT", "ISC", "BSD-2-Clause", "BSD-3-Clause", "LGPL-3.0", "AGPL-3.0", "Apache-2.0")}
    rows, expected = [], []
    for n, texts in whole.items():
        wrapped = textwrap.fill(max(texts, key=len), 78)
        for t in (wrapped, f"{n} title\n\nCopyright (c) 2020 someone\n\n{wrapped}\n", "\n".join(["# " + x for x in [before, *wrapped.split("\n"), after]]), f"{before} {' '.join(wrapped.split())} {after}"):
            expected.append((len(rows), n, True))
            rows.append((len(rows), t))
    rows += [(len(rows), f"{before} released under the MIT License, {after}"), (len(rows) + 1, f"{before} {after}")]
    expected += [(len(rows) - 2, "MIT", True), (len(rows) - 1, None, False)]
    out = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.license, r.n_passages > 0) for r in out) == expected
    assert all(r.dice > 0.95 for r in out if r.license)


def test_leaks(spark, docs, empty):
    from fixtures import sentence

    items = [(1, sentence(3, 60)), (2, sentence(2, 40)), (3, "two words"), (4, None), (5, ""), (6, sentence(99, 30))]
    table = spark.createDataFrame(items, "item_id long, text string").withColumn("n", F.lit(1))

    def shingles(t):
        w = WORD.findall((t or "").translate({i: i + 32 for i in range(65, 91)}))
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()

    expected = [(r.doc_id, i, len(shingles(t) & shingles(r.text))) for r in docs.collect() for i, t in items if shingles(t) and len(shingles(t) & shingles(r.text)) >= 0.8 * len(shingles(t))]
    for block in (1 << 20, 10):
        same_rows([(r.doc_id, r.item_id, r.shared) for r in decontam.leaks(docs, table, block_shingles=block).collect()], expected)
    assert len(expected) >= 5 and decontam.leaks(empty, table).count() == 0 and decontam.leaks(docs, table.limit(0)).count() == 0


def test_bpe_equals_the_library(docs, empty):
    public = pytest.importorskip("public_tokenizers")
    tokenizers = pytest.importorskip("tokenizers")
    path = public.path("word_bpe_49k.json")
    t = tokenizers.Tokenizer.from_file(path)
    expected = []
    for r in docs.collect():
        ids = t.encode(r.text or "", add_special_tokens=False).ids
        expected.append((r.doc_id, len(ids), sha(" ".join(map(str, ids))), sha(t.decode(ids, skip_special_tokens=False))))
    same_rows([tuple(r) for r in bpe.encode(docs, path).collect()], expected)
    assert bpe.encode(empty, path).count() == 0
    for r in bpe.encode(docs, path, ("ids", "decoded", "n_tokens", "decoded_sha256")).collect():
        assert len(r.ids) == r.n_tokens and sha(r.decoded) == r.decoded_sha256


def test_bpe_long_words():
    public = pytest.importorskip("public_tokenizers")
    tokenizers = pytest.importorskip("tokenizers")
    path = public.path("word_bpe_49k.json")
    t, v = tokenizers.Tokenizer.from_file(path), bpe.Vocabulary(path)
    for text in ("ha" * 400 + "x", "é" * 300, "!" * 500, "ABC" * 200):
        assert " ".join(map(str, t.encode(text, add_special_tokens=False).ids)) == next(bpe.encoded(v, [text]))[3][0]


def sets_of(text, k=3):
    w = WORD.findall((text or "").translate({i: i + 32 for i in range(65, 91)}))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def linked_by_force(rows, num=90, k=3):
    up = {i: i for i, _ in rows}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    sets = {i: sets_of(t, k) for i, t in rows}
    for a, b in itertools.combinations(sorted(sets), 2):
        shared = len(sets[a] & sets[b])
        if shared and 100 * shared >= num * len(sets[a] | sets[b]):
            x, y = sorted((top(a), top(b)))
            up[y] = x
    return {(i, len(sets[i]), top(i)) for i in sets}


def test_similarity_join(spark, docs, empty):
    from fixtures import sentence

    some = docs.filter("doc_id is not null").distinct()
    assert {tuple(r) for r in paritysketch.linked(some).collect()} == linked_by_force([(r.doc_id, r.text) for r in some.collect()])
    # a drifting chain of near copies: neighbours link, the ends don't
    w, chain = sentence(11, 200).split(), []
    for i in range(40):
        chain.append((100 + i, " ".join(w)))
        w[(i * 5) % 200] = f"new{i}"
    d = spark.createDataFrame(chain, "doc_id long, text string")
    assert {tuple(r) for r in paritysketch.linked(d).collect()} == linked_by_force(chain)
    assert paritysketch.linked(empty).count() == 0
    odd = [r for r in paritysketch.linked(docs).collect() if r.doc_id is None]
    assert len(odd) == 1 and odd[0].component_id == 8


def test_similarity_join_of_hot_keys(spark, monkeypatch):
    """The same components whether frequent keys pass through buckets or not."""
    from fixtures import sentence

    monkeypatch.setattr(paritysketch, "HOT", 40)
    rows = []
    for i in range(120):
        w = sentence(23 + i % 2, 90).split()
        w[i % 90] = f"x{i}"
        rows.append((i, " ".join(w)))
    d = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    profile = paritysketch.profiles(d, 3, paritysketch.Bands())
    assert len(paritysketch.hot_keys(profile, 0)[0])
    assert {tuple(r) for r in paritysketch.linked(d).collect()} == linked_by_force(rows)


def test_short_sketches_bound_the_difference():
    import numpy as np

    rng = np.random.default_rng(1)
    for n in (1, 5, 300, 5000):
        a = rng.integers(0, 1 << 63, n).astype(np.uint64)
        b = np.concatenate([a[: n - n // 3], rng.integers(0, 1 << 63, n // 5 + 1).astype(np.uint64)])
        x, y = paritysketch.short_sketch(a), paritysketch.short_sketch(b)
        size = min(len(x), len(y))
        apart = int(np.bitwise_count(paritysketch.folded([x], size) ^ paritysketch.folded([y], size)).sum())
        differ = len(set(a.tolist()) ^ set(b.tolist()))
        assert 0.3 * differ <= apart <= differ


def test_sets_that_share_a_hash_by_chance(spark):
    rows = [(1, 5, 7, 70, b"a"), (2, 5, 7, 71, b"b"), (3, 5, 7, 71, b"b"), (4, 6, 8, 70, b"c"), (5, 5, 7, 72, b"d")]
    profile = spark.createDataFrame(rows, "doc_id long, n long, h1 long, h2 long, mini binary")
    named, renamed = paritysketch.classes_of(profile)
    out = {(r.h1, r.h2, r.n): (r.name, r.doc) for r in named.collect()}
    assert {k: d for k, (_, d) in out.items()} == {(7, 70, 5): 1, (7, 71, 5): 2, (8, 70, 6): 4, (7, 72, 5): 5}
    assert len({n for n, _ in out.values()}) == 4 and out[8, 70, 6][0] == 8
    assert renamed == {k: n for k, (n, _) in out.items() if n != k[0]} and len(renamed) == 2


def test_similarity_join_of_repeated_ids(spark):
    from fixtures import sentence

    a, c = sentence(25, 100), sentence(26, 100)
    b = " ".join(a.split()[:-1]) + " changed"
    d = spark.createDataFrame([(1, a), (2, b), (2, c), (3, b), (3, c)], "doc_id long, text string")
    out = sorted((r.doc_id, r.component_id, r.component) for r in paritysketch.linked(d.withColumn("m", F.lit(1)), carry=("m",)).collect())
    assert [x[:2] for x in out] == [(1, 1), (2, 1), (2, 2), (3, 1), (3, 2)]
    assert len({x[2] for x in out}) == 2


def test_near_copies_show_their_nearest_partners_first(spark):
    """Many sets near one another, none linked with the smallest, must not come out as all their pairs."""
    import numpy as np

    rng = random.Random(5)
    base = rng.sample(range(1 << 40), 200)
    sets = [base[:-12] + rng.sample(range(1 << 40), 12) for _ in range(120)]
    minis = [paritysketch.short_sketch(paritysketch.T.mix(np.array(x, np.uint64))) for x in sets]
    members = spark.createDataFrame([(7, 120, d, -1, d, 200, bytearray(m)) for d, m in enumerate(minis)], "key long, c long, doc long, rep long, comp long, n long, mini binary")
    every = {tuple(r) for r in paritysketch.unsettled(members, 80, 100).collect()}
    few = {tuple(r) for r in paritysketch.unsettled(members, 80, 100, 1).collect()}
    assert len(every) > 2000 and (None, None) not in every
    assert (None, None) in few and len(few) <= 121 and few - {(None, None)} <= every
    seen, words = [], [f"w{i}" for i in range(200)]
    for d in range(40):
        at = rng.sample(range(200), 3)
        seen.append((d, " ".join(f"x{d}y{i}" if i in at else w for i, w in enumerate(words))))
    d = spark.createDataFrame(seen, "doc_id long, text string")
    assert {tuple(r) for r in paritysketch.linked(d).collect()} == linked_by_force(seen)


def test_blocks_of_a_hot_key(spark, monkeypatch):
    from fixtures import sentence

    monkeypatch.setattr(paritysketch, "BLOCK", 4)
    rows = []
    for i in range(60):
        w = sentence(21, 60).split()
        w[i], w[(i * 7) % 60] = f"x{i}", f"y{i % 9}"
        rows.append((i, " ".join(w)))
    d = spark.createDataFrame(rows, "doc_id long, text string")
    assert {tuple(r) for r in paritysketch.linked(d).collect()} == linked_by_force(rows)


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 90), (90, 95), (7, 7), (None, 3)]
    out = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert out == {**{i: 1 for i in range(1, 41)}, 90: 90, 95: 90, 100: 90}


def test_groups_of_empty_texts_in_a_fresh_session():
    """Nothing is warm in a worker that meets nulls and empty texts first."""
    import os
    import subprocess
    import sys

    code = """
from signalblind.session import local_session
from signalblind.llm import anchors, bytebpe, decontam, paritysketch, periods, suffixes
import public_tokenizers as P
spark = local_session("1", "cold")
for rows in ([(i, None) for i in range(8)], [(i, "") for i in range(8)]):
    d = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    items = spark.createDataFrame([(1, "one two three four five six")], "item_id long, text string")
    assert decontam.leaks(d, items).count() == 0
    for out in (anchors.remove_repeats(d), suffixes.remove_repeats(d), paritysketch.linked(d), periods.detect(d), bytebpe.encode(d, P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)):
        assert out.count() == 8
"""
    pytest.importorskip("public_tokenizers")
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    done = subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True, timeout=600)
    assert done.returncode == 0, done.stderr[-2000:]


def test_forest_connects_alike(spark):
    import random

    rng = random.Random(2)
    group = [(i, j, "x") for i in range(100, 900) for j in rng.sample(range(100), 6) if i % 2 == j % 2]
    edges = group + [(j, j + 2, "x") for j in range(0, 96, 2)] + [(5000, 5000, "x"), (None, 3, "x"), (7000, 6000, "x"), (7000, 6000, "x")]
    d = spark.createDataFrame(edges, "doc long, rep long, n string")
    thin = components.forest(d, "doc", "rep")
    a, b = ({tuple(r) for r in components.components(x, *ends).collect()} for x, ends in ((d, ("doc", "rep")), (thin, ("a", "b"))))
    assert a == b and components.forest(d.limit(0), "doc", "rep").count() == 0 and thin.count() < len(edges)
