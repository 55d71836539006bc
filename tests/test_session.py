"""Cut points."""

import time

from pyspark.sql import functions as F

from signalblind.session import CLEAN_SHUFFLES, EXCLUDED_RULES, cut


def test_cut_leaves_no_stage_behind(spark):
    """An empty side does not leave the stage of the other side asking for removed shuffle files."""

    def slow(batches):
        for pdf in batches:
            time.sleep(3)
            yield pdf

    before = [spark.conf.get(name, None) for name in (CLEAN_SHUFFLES, EXCLUDED_RULES)]
    empty = spark.range(100).filter("id < 0").withColumn("id", F.col("id") + 0).repartition(4, "id")
    late = spark.range(0, 100, 1, 4).mapInPandas(slow, "id bigint").groupBy((F.col("id") % 10).alias("id")).agg(F.count(F.lit(1)).alias("n"))
    assert cut(empty.join(late.hint("merge"), "id")).count() == 0
    assert list(spark.sparkContext.statusTracker().getActiveStageIds()) == []
    assert [spark.conf.get(name, None) for name in (CLEAN_SHUFFLES, EXCLUDED_RULES)] == before
