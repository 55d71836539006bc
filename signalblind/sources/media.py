"""Image sets and other files as DataFrames, content hashes, JSON records."""

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.columns import stable_json
from ..functions.kernels import unpack_bytes
from ..operators import hashtree

# File extensions an image set may hold.
IMAGE_EXTENSIONS = ["bmp", "jpeg", "jpg", "png", "tif", "tiff", "webp"]


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))


def list_media(spark: SparkSession, path: str, extensions=IMAGE_EXTENSIONS) -> DataFrame:
    """IO1: files of an image set (or a single file); the listing reads no content."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", F.col("length").alias("size_bytes")).filter(extension(F.col("path")).isin(*extensions))


def read_frames(spark: SparkSession, path: str) -> DataFrame:
    """IO1/IO2: decode an image set into packed B, G, R grids; unreadable files drop out."""
    images = spark.read.format("image").option("dropInvalid", True).load(path)
    return images.filter(extension(F.col("image.origin")).isin(*IMAGE_EXTENSIONS)).select(
        F.col("image.origin").alias("path"), F.col("image.height").alias("height"),
        F.col("image.width").alias("width"), F.col("image.nChannels").alias("n_channels"),
        unpack_bytes(F.col("image.data")).alias("pixels"),
    )


def content_hash(df: DataFrame, column: str, name="sha256") -> DataFrame:
    """IO4"""
    return df.withColumn(name, F.sha2(F.col(column), 256))


def hash_files(spark: SparkSession, path: str) -> DataFrame:
    """IO4: SHA-256 of whole files. A file is one row, so it must fit a task."""
    return spark.read.format("binaryFile").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))


def record_hash(df: DataFrame, columns: list, name="record_hash") -> DataFrame:
    """IO5: SHA-256 of the row as key-sorted JSON, the same for any column order."""
    return df.withColumn(name, F.sha2(stable_json({c: F.col(c) for c in columns}), 256))


def group_records(df: DataFrame, by: list, name: str, sha: str) -> DataFrame:
    """IO6: the (name, hash) records of every group as hash tree leaves."""
    return hashtree.leaves(df, F.sha2(F.concat_ws(":", F.col(name), F.col(sha)), 256), by)


def group_fingerprint(df: DataFrame, by: list, name: str, sha: str) -> DataFrame:
    """IO6: one hash per group over its (name, hash) records: the root of their hash tree."""
    nodes = hashtree.tree(group_records(df, by, name, sha), by)
    return hashtree.roots(nodes, by).select(*by, F.col("n").alias("records"), F.col("digest").alias("fingerprint"))


def write_json(df: DataFrame, path: str):
    """IO7: records as JSON lines with keys in sorted order."""
    df.select(*sorted(df.columns)).write.mode("overwrite").json(path)


def read_json(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).json(path)
