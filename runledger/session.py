"""Session set-up and lineage cutting."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings every job here relies on. AQE re-plans joins at run time: it splits the
# partitions of a hot key and turns a small join side into a broadcast by its measured size.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    # Shuffle files of a finished job go with it. Else they stay until the driver happens to collect its garbage.
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
}
# Upper bounds of what one task reads from files and, after AQE joined small partitions, from shuffles, in bytes. Both are
# compressed; hash tables and sorts hold ten to thirty times as much. A session may ask for less.
TASK_BYTES = {"spark.sql.files.maxPartitionBytes": 4 << 20, "spark.sql.adaptive.advisoryPartitionSizeInBytes": 8 << 20}
# The JVM never compiles methods above 8,000 bytes: stages of long expressions (payloads of all types) run faster without whole-stage code.
LONG_CODE = {"spark.sql.codegen.hugeMethodLimit": "8000"}
INITIAL = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"


def configure(spark: SparkSession) -> SparkSession:
    """Apply the run-time settings to an existing session."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def bound_tasks(spark: SparkSession, pieces: int) -> None:
    """Keep what one task reads under TASK_BYTES, and give shuffles to come at least `pieces` partitions; AQE joins small ones."""
    for key, most in TASK_BYTES.items():
        if _size(spark.conf.get(key)) > most:
            spark.conf.set(key, f"{most}b")
    if pieces > int(spark.conf.get("spark.sql.shuffle.partitions")):
        spark.conf.set(INITIAL, pieces)
    else:
        spark.conf.unset(INITIAL)


def _size(text: str) -> int:
    """Bytes of a size as Spark's settings have it."""
    number, unit = re.fullmatch(r"\s*(\d+)\s*([a-z]*)\s*", text.lower()).groups()
    return int(number) << (10 * "bkmgtp".index(unit[0]) if unit else 0)


def local_session(cores: str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("runledger")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark)


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder.

    A machine-local folder is used only in local mode with nothing configured.
    """
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(configured)
        return configured
    current = sc.getCheckpointDir()
    if current:
        return current
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
    folder = tempfile.mkdtemp(prefix="runledger-checkpoint-")
    sc.setCheckpointDir(folder)
    return folder


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write the rows to the shared checkpoint folder and read on from there."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def cut_to_table(df: DataFrame) -> DataFrame:
    """Like `cut_lineage`, but as a Parquet table: for rows that are read several times by different columns."""
    path = f"{shared_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
