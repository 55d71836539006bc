"""From raw documents to token counts: five stages, each written as Parquet and read again."""

from pyspark.sql import functions as F

from signalblind.llm import bpe, decontam, langid, paritysketch, pii
from signalblind.session import cut, scratch_path

LEAST_SCORE = 0.5
VOCABULARY = "word_bpe_49k.json"
#: Near duplicates share 80 of 100 five-word shingles or more; op10_ngram_join has its own rule.
NEAR = {"num": 80, "den": 100, "words": 5}


def identified_language(spark, docs, sf_dir):
    """Drop documents without letters or whose language stays uncertain."""
    model = langid.fit(langid.training_rows(docs))
    # the columns travel as one struct, so none can clash with the prediction
    rows = docs.select(F.struct(*docs.columns).alias("_row"), "text")
    named = langid.predict(rows, model, ["_row"])
    return named.filter((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE)).select("_row.*")


def key():
    """The doc_id; rows without one count as larger and are known by a hash of their text."""
    return F.coalesce(F.col("doc_id").cast("bigint"), F.shiftrightunsigned(F.xxhash64("text"), 2) + F.lit(1 << 62))


def without(docs, rows):
    """``docs`` without the rows whose id and text are those of ``rows`` (__id, __mark)."""
    gone = cut(rows.select("__id", "__mark").distinct())
    many = gone.count() > paritysketch.BROADCAST_ROWS
    return docs.join(gone if many else F.broadcast(gone), (key() == F.col("__id")) & (mark() == F.col("__mark")), "left_anti")


def mark():
    """A hash of the text, telling rows of one id apart."""
    return F.coalesce(F.xxhash64("text"), F.lit(0))


def one_of_each_group(spark, docs, sf_dir):
    """Keep one document of every group of near duplicates: the smallest id, then text hash.

    Texts that are null or without a word are alike to nothing and stay. Of rows with equal
    id and text one stays. Rows without doc_id count as larger than any id.
    """
    ids = docs.select(key().alias("doc_id"), "text", key().alias("__id"), mark().alias("__mark"))
    links = cut(paritysketch.linked(ids, **NEAR, carry=("__id", "__mark")).select("__id", "__mark", "component"))
    first = links.filter("component is not null").groupBy("component").agg(F.min(F.struct("__id", "__mark")).alias("first"), F.max(F.struct("__id", "__mark")).alias("last"))
    several = first.filter("first <> last").select("component", "first")
    left = without(docs, links.join(several, "component").filter(F.struct("__id", "__mark") != F.col("first")))
    twice = cut(links.groupBy("__id", "__mark").count().filter("count > 1").select("__id", "__mark"))
    if twice.isEmpty():
        return left
    same = (key() == F.col("__id")) & (mark() == F.col("__mark"))
    return without(left, twice).unionByName(left.join(twice, same, "left_semi").dropDuplicates(["doc_id", "text"]))


def decontaminated(spark, docs, sf_dir):
    """Drop documents that hold a benchmark item; null and empty texts hold none."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    texts = docs.select(key().alias("doc_id"), "text", mark().alias("__mark"))
    leaks = decontam.leaks(texts, items, carry=("__mark",))
    return without(docs, leaks.select(F.col("doc_id").alias("__id"), "__mark"))


def redacted(spark, docs, sf_dir):
    """Replace personal data by its kind."""
    return pii.redact(docs).withColumn("n_chars", F.length("text").cast("bigint")).select(docs.columns)


def encoded(spark, docs, sf_dir):
    """Token counts and digests of every document left."""
    import public_tokenizers

    return bpe.encode(docs, public_tokenizers.path(VOCABULARY), keep_words=False)


STAGES = [
    ("language_id", identified_language),
    ("ngram_jaccard_join", one_of_each_group),
    ("benchmark_decontamination", decontaminated),
    ("pii", redacted),
    ("bpe", encoded),
]

#: Models and tokenisation cannot be said in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
