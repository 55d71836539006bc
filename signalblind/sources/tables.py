"""The driver tables in their domain roles (frames, words, results, annotations)."""

import functools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.columns import let
from ..session import spread

try:
    from _md5 import md5  # half the time of hashlib's for a word
except ImportError:
    from hashlib import md5


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def capture_role(label):
    return (
        F.when(label <= 3, "laser").when(label <= 6, "control").when(label == 7, "matched_control")
        .when(label == 8, "sensor_noise").otherwise("synthetic_positive")
    )


def frames(spark, sf_dir) -> DataFrame:
    """Embeddings as 8x8 frames; the label is the capture, ``vec_id`` the source position."""
    e = spread(table(spark, sf_dir, "embeddings"), "vec_id")
    byte = lambda v: F.least(F.lit(255), F.greatest(F.lit(0), F.floor((v.cast("double") + 0.55) * 230))).cast("int")
    return e.select(
        F.concat(F.lit("cap-"), F.col("label")).alias("capture_id"),
        F.format_string("frame-%08d", F.col("vec_id")).alias("frame_id"),
        F.col("vec_id").alias("frame_index"),
        capture_role(F.col("label")).alias("role"),
        F.lit(8).alias("height"), F.lit(8).alias("width"),
        F.transform("embedding", byte).alias("pixels"),
    )


def mosaics(spark, sf_dir) -> DataFrame:
    """64x64 frames, each tiled from 64 consecutive 8x8 ones; missing tiles are black."""
    tiles = frames(spark, sf_dir).groupBy(F.floor(F.col("frame_index") / 64).cast("long").alias("frame_index")).agg(
        F.map_from_entries(F.collect_list(F.struct((F.col("frame_index") % 64).cast("int"), "pixels"))).alias("tiles"))
    blank = F.array_repeat(F.lit(0), 64)
    row = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda t: F.coalesce(F.try_element_at("tiles", t), blank))
    pixels = let(row, lambda ts: F.flatten(F.transform(F.sequence(F.lit(0), F.lit(63)), lambda y: F.flatten(F.transform(
        F.sequence(F.lit(0), F.lit(7)),
        lambda tx: F.slice(ts[F.floor(y / 8).cast("int") * 8 + tx], (y % 8) * 8 + 1, 8))))))
    return tiles.select(
        F.format_string("mosaic-%06d", F.col("frame_index")).alias("frame_id"), "frame_index",
        F.lit(64).alias("height"), F.lit(64).alias("width"), pixels.alias("pixels"),
    )


def words(spark, sf_dir) -> DataFrame:
    """Document words as a recognised-word table; confidence from the quality label."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    quality = table(spark, sf_dir, "labels").select("doc_id", "quality")
    confident = docs.join(quality, "doc_id", "left").withColumn(
        "conf", F.coalesce(F.col("quality") * 100.0, F.lit(-1.0)))
    return confident.select("doc_id", "conf", F.posexplode(F.split("text", " ")).alias("pos", "word"))


#: Bytes of text a task splits into words at once.
TEXT_SLICE = 4 << 20


def _word_buckets(batches):
    """(doc_id, lang, total, counts) of every text with a word: words in each of 64 buckets of md5.

    A word is hashed once a slice; what leaves a task is 64 numbers a text.
    """
    for batch in batches:
        size = pc.fill_null(pc.binary_length(batch["text"]), 0).to_numpy(zero_copy_only=False).astype("int64")
        piece = (np.cumsum(size) - size) // TEXT_SLICE
        borders = np.flatnonzero(np.diff(piece, prepend=-1, append=-1))
        for lo, hi in zip(borders[:-1], borders[1:]):
            part = batch.slice(lo, hi - lo)
            split = pc.split_pattern(part["text"], " ")
            words = split.flatten().dictionary_encode()
            # 64 stands for the empty word between two blanks, which does not count
            named = words.dictionary.cast(pa.large_binary()).to_numpy(zero_copy_only=False)
            bucket = np.array([md5(w).digest()[0] >> 2 if w else 64 for w in named], dtype="int64")
            place = pc.list_parent_indices(split).to_numpy(zero_copy_only=False) * 65 + bucket[words.indices.to_numpy(zero_copy_only=False)]
            counts = np.bincount(place, minlength=(hi - lo) * 65).reshape(-1, 65)[:, :64]
            total = counts.sum(axis=1)
            found = np.flatnonzero(total)
            lists = pa.ListArray.from_arrays(np.arange(len(found) + 1, dtype="int32") * 64, counts[found].ravel())
            keys = part.select(["doc_id", "lang"]).take(pa.array(found))
            yield pa.RecordBatch.from_arrays([*keys.columns, pa.array(total[found]), lists], ["doc_id", "lang", "total", "counts"])


def document_signatures(spark, sf_dir) -> DataFrame:
    """64-bit signature per document: which of 64 word-hash buckets reach the mean count."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "lang", "text"), "doc_id")
    keys = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in ("doc_id", "lang"))
    counts = docs.mapInArrow(_word_buckets, f"{keys}, total bigint, counts array<bigint>")
    each = [F.sum(F.get("counts", F.lit(i))).alias(f"n{i}") for i in range(64)]
    packed = counts.groupBy("doc_id", "lang").agg(F.sum("total").alias("total"), *each)
    bits = [F.when(F.col(f"n{i}") * 64 >= F.col("total"), F.lit((1 << 63 - i) - (1 << 64 if i == 0 else 0))).otherwise(0).cast("bigint") for i in range(64)]
    return packed.select(
        F.col("lang").alias("capture_id"), F.col("doc_id").alias("frame_index"),
        functools.reduce(lambda a, b: a.bitwiseOR(b), bits).alias("signature"), F.col("total").cast("double").alias("mean_intensity"),
    )


def results(spark, sf_dir) -> DataFrame:
    """Line items as detector records: sample = order, variant = line number.

    One role per sample: laser when any line was returned, else control.
    """
    li = table(spark, sf_dir, "lineitem")
    roles = li.groupBy(F.col("l_orderkey").alias("sample_id")).agg(
        F.when(F.max((F.col("l_returnflag") == "R").cast("int")) == 1, "laser").otherwise("control").alias("unblinded_label"))
    scored = li.select(
        F.col("l_orderkey").alias("sample_id"), F.col("l_linenumber").alias("variant"),
        "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate",
        F.round(F.col("l_discount") * 10, 6).alias("score"), F.round(F.col("l_tax") * 10, 6).alias("persistence"),
        F.round(F.col("l_quantity") / 50, 6).alias("symbol"),
        F.round(F.col("l_discount") * 10, 6).alias("diffraction"),
        F.round(F.col("l_tax") * 10, 6).alias("speckle"),
        F.round(F.col("l_quantity") / 100 + F.col("l_tax") * 5, 6).alias("texture"),
    )
    return scored.join(roles, "sample_id")
