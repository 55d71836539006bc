"""Language identification: sparse multinomial logistic regression on TF-IDF n-grams.

Features are hashed character 1- to 3-grams of the whole lower-cased text, weighted by
TF-IDF and scaled to length one. The weights come from follow-the-regularised-leader with
an L1 and an L2 penalty, so that most of them are exactly zero; a temperature fitted on
rows kept apart turns the logits into calibrated probabilities.

Document frequencies count every training row. The weights are fitted on a bounded sample
of them (``per_language`` rows of each language in expectation, drawn by a hash of the id),
in one task whose size that bound fixes.
"""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from signalblind.llm import text as T

BUCKETS = 1 << 15
ORDERS = 3
_MUL = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], np.uint32)
_SHIFT = np.uint32(32 - 15)
LETTER = regex.compile(r"\p{L}")
TOGETHER = 32


def counts(texts):
    """(first row, matrix rows x BUCKETS of n-gram counts) for some texts at a time."""
    lo = 0
    while lo < len(texts):
        hi, size = lo, 0
        while hi < len(texts) and hi - lo < TOGETHER and (hi == lo or size + len(texts[hi]) < T.GROUP_BYTES):
            size += len(texts[hi])
            hi += 1
        lowered = [t.lower() for t in texts[lo:hi]]
        # one blank mark after each text keeps n-grams from running over its end
        u = np.frombuffer("\0".join(lowered).encode("utf-32-le", "surrogatepass") + b"\0\0\0\0", np.uint32)
        row = np.repeat(np.arange(hi - lo, dtype=np.int64) * BUCKETS, [len(t) + 1 for t in lowered])
        out, inside, code = np.zeros((hi - lo) * BUCKETS, np.int64), u != 0, np.zeros(len(u), np.uint32)
        for n in range(ORDERS):
            size = len(u) - n
            if size <= 0:
                break
            code = (code[:size] ^ (u[n:] + np.uint32(n * 0x632BE5AB))) * _MUL[n]
            code ^= code >> np.uint32(15)
            inside = inside[:size] & (u[n:] != 0)
            out += np.bincount((row[:size] + (code * _MUL[0] >> _SHIFT))[inside], minlength=len(out))
        yield lo, out.reshape(hi - lo, BUCKETS)
        lo = hi


def document_frequencies(docs: DataFrame):
    """(number of rows, rows that hold each bucket) over all rows; one small vector a task."""

    def run(batches):
        rows, df = 0, np.zeros(BUCKETS, np.int64)
        for batch in batches:
            texts = T.column(batch, "text")
            for lo, hi, _, _ in T.groups(texts):
                for _, c in counts(texts.slice(lo, hi - lo).to_pylist()):
                    rows += len(c)
                    df += (c > 0).sum(axis=0)
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array([*some, -1], pa.int32()), pa.array([*df[some], rows], pa.int64())], ["bucket", "n"])

    parts = docs.select("text").mapInArrow(T.released(run), "bucket int, n bigint")
    df, rows = np.zeros(BUCKETS, np.int64), 0
    for r in parts.groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # at most BUCKETS + 1 rows
        if r["bucket"] < 0:
            rows = r["n"]
        else:
            df[r["bucket"]] = r["n"]
    return rows, df


@dataclass
class Model:
    """``weights`` have the idf folded in; ``idf2`` serves to scale a row to length one."""

    languages: list
    weights: np.ndarray
    bias: np.ndarray
    idf2: np.ndarray
    temperature: float

    def logits(self, c):
        x = c.astype(np.float32)
        z = x @ self.weights
        np.square(x, out=x)
        return z / np.sqrt(np.maximum(x @ self.idf2, 1e-12))[:, None] + self.bias

    def probabilities(self, c):
        return softmax(self.logits(c) / self.temperature)


def softmax(z):
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def follow_leader(rows, n_classes, idf, alpha=1.0, beta=1.0, l1=0.02, l2=0.05):
    """One pass of FTRL-proximal with elastic net over (buckets, values, class) rows."""
    z, n = np.zeros((BUCKETS, n_classes)), np.zeros((BUCKETS, n_classes))
    zb, nb = np.zeros(n_classes), np.zeros(n_classes)

    def leader(z, n, l1):
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2))

    for at, value, y in rows:
        x = value * idf[at]
        x /= max(np.sqrt((x * x).sum()), 1e-12)
        w, bias = leader(z[at], n[at], l1), leader(zb, nb, 0.0)
        p = softmax((x @ w + bias)[None, :])[0]
        p[y] -= 1.0
        g = x[:, None] * p
        g2 = g * g
        z[at] += g - (np.sqrt(n[at] + g2) - np.sqrt(n[at])) / alpha * w
        n[at] += g2
        zb += p - (np.sqrt(nb + p * p) - np.sqrt(nb)) / alpha * bias
        nb += p * p
    return leader(z, n, l1), leader(zb, nb, 0.0)


def best_temperature(logits, classes):
    """Temperature of least log loss, by golden section on its logarithm."""
    if not len(classes):
        return 1.0
    at = np.arange(len(classes))

    def loss(t):
        return -np.log(np.maximum(softmax(logits / np.exp(t))[at, classes], 1e-12)).mean()

    a, b, r = np.log(0.02), np.log(20.0), (np.sqrt(5) - 1) / 2
    for _ in range(40):
        c, d = b - r * (b - a), a + r * (b - a)
        a, b = (a, d) if loss(c) < loss(d) else (c, b)
    return float(np.exp((a + b) / 2))


def fit(train: DataFrame, per_language=1500, calibration=0.25, max_languages=None):
    """Fit on rows (doc_id, text, lang) of known language; None without any.

    ``per_language`` bounds the fitted rows of a language in expectation, ``calibration`` is
    the share of them kept for the temperature. Every language is learned; ``max_languages``
    can bound the model to the most frequent ones. Null texts count as empty.
    """
    langs = train.groupBy("lang").count().orderBy(F.desc("count"), "lang")
    langs = (langs.limit(max_languages) if max_languages else langs).collect()
    if not langs:
        return None
    names = sorted(r["lang"] for r in langs)
    rows, df = document_frequencies(train)
    idf = np.log((1.0 + rows) / (1.0 + df)) + 1.0
    u = F.pmod(F.xxhash64(F.lit("fit"), F.col("doc_id").cast("string")), F.lit(1 << 30)) / float(1 << 30)
    share = F.coalesce(*(F.when(F.col("lang") == r["lang"], F.lit(min(1.0, per_language / r["count"]))) for r in langs))
    sample = train.filter(u < share).select(F.xxhash64(F.lit("order"), F.col("doc_id").cast("string")).alias("order"), "lang", "text")

    def features(batches):
        for batch in batches:
            texts = T.column(batch, "text")
            for lo, hi, _, _ in T.groups(texts):
                for at, c in counts(texts.slice(lo, hi - lo).to_pylist()):
                    some = [np.flatnonzero(r) for r in c]
                    cols = [batch.column(k).slice(lo + at, len(c)) for k in ("order", "lang")]
                    cols += [pa.array([s.astype(np.int32).tobytes() for s in some]), pa.array([r[s].astype(np.float32).tobytes() for r, s in zip(c, some)])]
                    yield pa.RecordBatch.from_arrays(cols, ["order", "lang", "at", "value"])

    def learn(batches):
        number = {n: i for i, n in enumerate(names)}
        apart = []

        def rows():
            for batch in batches:
                for r in batch.to_pylist():
                    row = (np.frombuffer(r["at"], np.int32), np.frombuffer(r["value"], np.float32).astype(float), number[r["lang"]])
                    if (r["order"] >> 8) % 1000 < 1000 * calibration:
                        apart.append(row)
                    else:
                        yield row

        w, bias = follow_leader(rows(), len(names), idf)
        logits = [(x @ w[at]) / max(np.sqrt((x * x).sum()), 1e-12) + bias for at, value, _ in apart for x in [value * idf[at]]]
        t = best_temperature(np.array(logits), np.array([y for _, _, y in apart], int))
        yield pa.RecordBatch.from_arrays([pa.array([w.tobytes()]), pa.array([bias.tobytes()]), pa.array([t])], ["w", "bias", "t"])

    # the sample is bounded; its order is a hash, so classes come mixed
    one = sample.mapInArrow(T.released(features), "order bigint, lang string, at binary, value binary").repartition(1).sortWithinPartitions("order", "lang", "at", "value")
    got = one.mapInArrow(learn, "w binary, bias binary, t double").collect()[0]
    w = np.frombuffer(got["w"]).reshape(BUCKETS, len(names))
    return Model(names, (w * idf[:, None]).astype(np.float32), np.frombuffer(got["bias"]).astype(np.float32), (idf * idf).astype(np.float32), got["t"])


def predict(docs: DataFrame, model, keep=("doc_id",)) -> DataFrame:
    """``keep`` columns, lang_pred and score of every row; only the text is looked at.

    ``und`` with score 0 for a text that is null, empty or without any letter, and for
    every text when there was nothing to learn from. Ties go to the first language by name.
    Scores are probabilities after calibration. No shuffle; other columns are ignored.
    """
    keep = list(keep)
    schema = StructType([*(docs.schema[k] for k in keep), StructField("lang_pred", StringType()), StructField("score", DoubleType())])
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS x languages at most

    def run(batches):
        model = shared.value
        for batch in batches:
            texts = T.column(batch, "_text")
            for lo, hi, _, _ in T.groups(texts):
                some = texts.slice(lo, hi - lo).to_pylist()
                lang, score = [], []
                for at, c in counts(some) if model else [(0, np.zeros((len(some), 1)))]:
                    letters = [model is not None and LETTER.search(t) is not None for t in some[at : at + len(c)]]
                    p = model.probabilities(c) if model else c
                    for known, row in zip(letters, p):
                        best = int(row.argmax())
                        lang.append(model.languages[best] if known else "und")
                        score.append(float(min(1.0, row[best])) if known else 0.0)
                kept = [batch.column(i).slice(lo, hi - lo) for i in range(len(keep))]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(lang, pa.string()), pa.array(score, pa.float64())], [*keep, "lang_pred", "score"])

    return docs.select(*keep, F.col("text").alias("_text")).mapInArrow(T.released(run), schema)


def held_out(column="doc_id"):
    """The fifth of the rows that is never learned from."""
    return F.coalesce(F.pmod(F.crc32(F.col(column).cast("string")), F.lit(5)) == 0, F.lit(False))


def training_rows(docs: DataFrame) -> DataFrame:
    return docs.filter(~held_out() & F.col("lang").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", "text", "lang")
