"""The registered queries of the operators, thin digests of what the operators return."""

from pyspark.sql import functions as F

from signalblind.llm import anchors, bpe, bytebpe, decontam, langid, licenses, paritysketch, periods, pii, quality, quotes, suffixes, vectorcodes

QUERIES, ORACLES = {}, {}


def query(name, sql=None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def table(spark, sf_dir, name="documents"):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_language_id")
def _(spark, sf_dir):
    docs = table(spark, sf_dir)
    model = langid.fit(langid.training_rows(docs))
    return langid.predict(docs, model).select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score")


@query("op2_substring_dedup")
def _(spark, sf_dir):
    return anchors.remove_repeats(table(spark, sf_dir))


@query("op3_chat_quotes")
def _(spark, sf_dir):
    return quotes.conversations(table(spark, sf_dir, "conversations")).select("conv_id", "turn", "role", "reply_to", "thread", "branch", "n_quoted", "n_linked", F.sha2("text", 256).alias("text_sha256"))


@query("op4_pii")
def _(spark, sf_dir):
    base = F.filter("spans", lambda x: x["base"])
    n = lambda kind: F.size(F.filter(base, lambda x: x["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    return pii.detect(table(spark, sf_dir)).select("doc_id", *map(n, pii.BASE), F.sha2(pii.written(base), 256).alias("base_sha256"), pii.written("spans").alias("spans"))


@query("op5_quality_rules")
def _(spark, sf_dir):
    return quality.judged(table(spark, sf_dir)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality")


@query("op6_license_scan", licenses.scan_sql())
def _(spark, sf_dir):
    return licenses.scan(table(spark, sf_dir))


@query("op7_suffix_dedup")
def _(spark, sf_dir):
    return suffixes.remove_repeats(table(spark, sf_dir))


@query("op8_decontamination")
def _(spark, sf_dir):
    return decontam.leaks(table(spark, sf_dir), table(spark, sf_dir, "benchmark"))


@query("op9_bpe")
def _(spark, sf_dir):
    import public_tokenizers

    return bpe.encode(table(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


@query("op10_ngram_join")
def _(spark, sf_dir):
    return paritysketch.linked(table(spark, sf_dir))


@query("op11_vector_codes")
def _(spark, sf_dir):
    return vectorcodes.compress(table(spark, sf_dir, "embeddings"))


@query("op12_byte_bpe")
def _(spark, sf_dir):
    import public_tokenizers

    return bytebpe.encode(table(spark, sf_dir), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


@query("op13_periodic_runs")
def _(spark, sf_dir):
    return periods.detect(table(spark, sf_dir), plant=True)
