"""The pipeline against its stages done by brute force, on the smallest tables."""

import hashlib
import itertools
import re

import pytest

import corpus_pipeline
from signalblind.llm import langid, pii
from test_operators import WORD, linked_by_force, sets_of

SF = "/root/testdata/sf0.001"


def test_pipeline(spark):
    tokenizers = pytest.importorskip("tokenizers")
    public = pytest.importorskip("public_tokenizers")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.fit(langid.training_rows(docs))
    named = {r.doc_id: r.text for r in langid.predict(docs, model, docs.columns).collect() if r.lang_pred != "und" and r.score >= 0.5}
    first = {d for d, _, c in linked_by_force(list(named.items()), 80, 5) if d == c}
    shingles = lambda t: sets_of(t, 5)
    items = [shingles(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    clean = [d for d in first if not any(i and len(i & shingles(named[d])) >= 0.8 * len(i) for i in items)]
    left = docs.filter(docs.doc_id.isin(clean))
    hidden = {r.doc_id: r.text for r in pii.redact(left).collect()}
    assert any(re.search("<(EMAIL|IP|CARD|PHONE)>", t) for t in hidden.values())
    t = tokenizers.Tokenizer.from_file(public.path("word_bpe_49k.json"))
    expected = {d: hashlib.sha256(" ".join(map(str, t.encode(x, add_special_tokens=False).ids)).encode()).hexdigest() for d, x in hidden.items()}
    out = corpus_pipeline.run(spark, SF)
    assert {r.doc_id: r.ids_sha256 for r in out.collect()} == expected and 0 < len(expected) < docs.count()


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns, name
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "ngram_jaccard_join", "benchmark_decontamination", "pii", "bpe"]


def test_near_duplicates_by_five_words(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    kept = sorted(d for d, _, c in linked_by_force(rows, 80, 5) if d == c)
    by_three = {d for d, _, c in linked_by_force(rows) if d == c}
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert sorted(r.doc_id for r in corpus_pipeline.one_of_each_group(spark, docs, SF).collect()) == kept
    assert set(kept) < by_three


def test_ids_of_several_texts(spark):
    from fixtures import sentence

    a, c = sentence(70, 100), sentence(71, 100)
    b = " ".join(a.split()[:-1]) + " changed"
    docs = spark.createDataFrame([(1, a), (2, b), (2, c), (3, b), (2, c), (4, b), (4, a)], "doc_id long, text string")
    kept = [tuple(r) for r in corpus_pipeline.one_of_each_group(spark, docs, SF).collect()]
    assert sorted(kept) == sorted([(1, a), (2, c)])


def stage(name):
    return dict(corpus_pipeline.STAGES)[name]


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_on_odd_rows(spark, name):
    from fixtures import sentence

    schema = "doc_id long, text string, lang string, source string, n_chars long, pack string, hash string, name string, spans string, score string"
    good = [(i, sentence(80 + i, 60), "en", "s", 0, "p", "h", "n", "s", "s") for i in range(4)]
    odd = [(10, None, "en", "s", 0, *"abcde"), (11, "", "en", "s", 0, *"abcde"), (11, "", "en", "s", 0, *"abcde"), (None, None, None, None, None, *"abcde"), good[0], (None, good[1][1], None, None, None, *"abcde")]
    for rows in ([], odd[:4], good + odd):
        docs = spark.createDataFrame(rows, schema)
        out = stage(name)(spark, docs, SF)
        found = out.collect()
        if name != "bpe":
            assert out.columns == docs.columns
        ids = sorted((r.doc_id is None, r.doc_id or 0) for r in found)
        if name in ("benchmark_decontamination", "pii", "bpe"):
            assert len(ids) == len(rows)
        elif name == "ngram_jaccard_join" and rows:
            # of equal rows one stays, and the copy without id gives way to the row that has one
            assert [i for _, i in ids] == ([0, 1, 2, 3] if len(rows) > 4 else []) + [10, 11, 0]


def test_rows_without_id(spark):
    from fixtures import sentence

    item = spark.read.parquet(f"{SF}/benchmark.parquet").first().text
    a, b, c = (sentence(50 + i, 100) for i in range(3))
    near = lambda t: " ".join(t.split()[:-1]) + " changed"
    rows = [(1, a), (None, a), (None, near(a)), (None, b), (None, near(b)), (None, c), (2, c + " " + item), (None, item)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = [tuple(r) for r in corpus_pipeline.one_of_each_group(spark, docs, SF).collect()]
    assert (1, a) in kept and not {(None, a), (None, near(a))} & set(kept)
    assert len({(None, b), (None, near(b))} & set(kept)) == 1 and (None, c) in kept
    clean = corpus_pipeline.decontaminated(spark, docs, SF).collect()
    assert sorted(r.text for r in clean) == sorted(t for _, t in rows[:6])
