import os
import sys

import pytest
from pyspark.sql.types import LongType, StringType, StructField, StructType

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from fixtures import texts  # noqa: E402

#: extra columns whose names clash with columns that operators make
SCHEMA = StructType([StructField("doc_id", LongType()), StructField("text", StringType()), StructField("lang", StringType()), StructField("source", StringType()), StructField("n_chars", LongType()),
                     StructField("pack", StringType()), StructField("hash", StringType()), StructField("spans", StringType()), StructField("score", StringType()), StructField("n", StringType())])


@pytest.fixture(scope="session")
def docs(spark):
    rows = [(i, t, "en" if i % 3 else "de", "s", 0, "p", "h", "s", "s", "n") for i, t in enumerate(texts())]
    rows += [(5, texts()[5], "en", "s", 0, None, None, None, None, None), (None, texts()[8], None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3, "doc_id").cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
