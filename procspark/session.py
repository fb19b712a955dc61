"""Session settings and reliable lineage cuts."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.functions import broadcast

# Runtime SQL settings the operators rely on. Skewed join partitions are split by AQE even when
# that costs one more exchange, so that one hot key never decides the length of a stage.
SQL_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def tune(spark: SparkSession) -> SparkSession:
    for key, value in SQL_CONF.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def build(master: str = "local[*]", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A local session for tests and the bench; clusters bring their own."""
    builder = (
        SparkSession.builder.master(master)
        .appName("procspark")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", conf.pop("driver_memory", "8g"))
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    for key, value in {**SQL_CONF, **conf}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors can read, named by ``spark.checkpoint.dir``."""
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    known = sc.getCheckpointDir()
    if known:
        return known
    return tempfile.mkdtemp(prefix="procspark-")


SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def releasing(spark: SparkSession) -> Iterator[None]:
    """Frames made in the block give their shuffle files back when their job ends, not when the driver collects garbage. For frames that run once."""
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(SHUFFLE_CLEANUP)
        else:
            spark.conf.set(SHUFFLE_CLEANUP, before)


def cut(df: DataFrame) -> DataFrame:
    """Materialize ``df`` in the shared folder and drop its lineage; survives lost executors."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    with releasing(spark):
        return df.select("*").checkpoint(eager=True)


Hold = Callable[[DataFrame], DataFrame]


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Hold]:
    """A form of ``cut`` for wide tables that a run reads several times: packed by column in the shared folder, so that a reader takes the columns it
    needs, and removed when the block ends. What leaves the block must be cut or collected in it."""
    folder = f"{shared_folder(spark)}/scratch-{uuid.uuid4().hex}"

    def hold(df: DataFrame) -> DataFrame:
        own, path = df.sparkSession, f"{folder}/{uuid.uuid4().hex}"
        with releasing(own):
            df.select("*").write.option("compression", "zstd").parquet(path)
        return own.read.schema(df.schema).parquet(path)

    try:
        yield hold
    finally:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def spread(scan: DataFrame) -> DataFrame:
    """Deal a scan that comes in fewer tasks than the session shuffles into (small files, few row groups) over
    all of them before heavy per-row work. Large inputs already have more tasks and pass unchanged."""
    width = shuffle_width(scan.sparkSession)
    return scan if scan.rdd.getNumPartitions() >= width else scan.repartition(width)


LOOKUP_ROWS = 200_000


def lookup(df: DataFrame, max_rows: int = LOOKUP_ROWS) -> DataFrame:
    """A side table computed once; broadcast only after its rows were counted and found few."""
    done = cut(df)
    return broadcast(done) if done.limit(max_rows + 1).count() <= max_rows else done
