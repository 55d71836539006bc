"""Session settings and durable cut points."""

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores="8", app="signalblind"):
    """Session for tests and bench runs; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


def ensure_checkpoint_dir(spark: SparkSession):
    """Use the shared folder the cluster names in ``spark.checkpoint.dir``.

    Only a local run without that setting gets a folder of its own.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None and not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a shared folder before iterative operators")
    sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="signalblind-checkpoint-"))


CLEAN_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
EXCLUDED_RULES = "spark.sql.adaptive.optimizer.excludedRules"
EMPTY_RELATIONS = "org.apache.spark.sql.execution.adaptive.AQEPropagateEmptyRelation"


def cut(df: DataFrame, *keys) -> DataFrame:
    """Write ``df`` out once and drop its lineage; survives executor loss.

    The shuffle files behind it are removed then, for nothing reads them again. So no stage
    may be left running: one whose result an empty side makes needless would ask for removed
    files until its requests time out, two minutes a task, and hold a core meanwhile.
    With ``keys`` a small result is spread over all cores again.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    before = {name: spark.conf.get(name, None) for name in (CLEAN_SHUFFLES, EXCLUDED_RULES)}
    try:
        spark.conf.set(CLEAN_SHUFFLES, "true")
        spark.conf.set(EXCLUDED_RULES, ",".join(filter(None, [before[EXCLUDED_RULES], EMPTY_RELATIONS])))
        out = df.select("*").checkpoint(eager=True)
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)
    return spread(out, *keys) if keys else out


def shuffle_partitions(spark: SparkSession) -> int:
    """Partitions for compute-bound steps that must not be merged for being small."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def spread(df: DataFrame, *keys) -> DataFrame:
    """Use all cores when the input has fewer splits than the cluster has cores.

    Per-frame steps are compute-bound, so a lone small file is worth one hash shuffle of
    its raw rows; a large input has splits enough and is left alone. Meant for scans and
    cut results, whose partition count is known without running anything.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, *keys) if df.rdd.getNumPartitions() < cores else df


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder next to the checkpoints, on storage every executor sees."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"
