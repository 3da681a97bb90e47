"""Session defaults, lineage cuts and size checks shared by the operators."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SMALL_BYTES = 64 << 20
"""A plan estimated above this, one advisory partition, is not small."""
SMALL_ROWS = 1_000_000
"""Nor is one of more counted rows; only a small plan may go to a single task."""

_local_folder: str | None = None
_scratch: list[str] = []


# Hot keys in joins are split even where that costs another shuffle.
ADAPTIVE = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # Hash joins without sorting where every built partition is seen to be small.
    "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": "64m",
    # A task after a shuffle reads so much of it, compressed; its hash tables and sorts hold some 20 times that.
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16m",
}
"""What a session should be set to for the operators' joins; see ``tune``."""
SHARED_SHUFFLES = "spark.sql.requireAllClusterKeysForCoPartition"
"""When "false", tables that were shuffled by one of the keys of a join are not shuffled again for it."""


def tune(spark: SparkSession) -> SparkSession:
    """Set the options that the operators count on."""
    for option, value in ADAPTIVE.items():
        spark.conf.set(option, value)
    return spark


def local_session(cores: int | str = 8, app: str = "cartloom") -> SparkSession:
    """A local session for tests and the benchmark; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names for checkpoints, kept through lost executors.

    A folder given to the context by setCheckpointDir serves as well. Only a
    local session with neither may pick one of its own.
    """
    global _local_folder
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder is not None:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a shared folder")
    if _local_folder is None:
        _local_folder = tempfile.mkdtemp(prefix="cartloom-")
    return _local_folder


def scratch_folder(spark: SparkSession) -> str:
    """A fresh path beneath the shared folder; see ``drop_scratch``."""
    path = f"{shared_folder(spark)}/cartloom-{uuid.uuid4().hex}"
    _scratch.append(path)
    return path


def scratch_paths() -> tuple[str, ...]:
    """Scratch folders given out and not dropped since."""
    return tuple(_scratch)


def drop_scratch(spark: SparkSession) -> None:
    """Delete what this program has written to scratch folders so far.

    To be called when no result that reads from them is needed any more; the
    files are kept until then, as lazy results read them.
    """
    while _scratch:
        _delete(spark, _scratch.pop())


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def passing(spark: SparkSession):
    """Scratch tables written within are deleted at its end; a folder named before is kept."""
    kept = len(_scratch)
    try:
        yield
    finally:
        while len(_scratch) > kept:
            _delete(spark, _scratch.pop())


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_freed(spark: SparkSession):
    """What a job has shuffled is deleted at its end, and not when the driver happens to collect its garbage."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def checkpoint_folder(spark: SparkSession) -> None:
    """See that checkpoints go to the shared folder."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))


def stored(table: DataFrame, source: DataFrame | None = None, path: str | None = None) -> DataFrame:
    """The table written to the shared folder and read back.

    A statistics table that later joins big tables is worth storing: its size
    is then known when the join is planned, so a small one is broadcast without
    shuffling the big side, and it is not computed again for every use. Left
    lazy when the ``source`` it was computed from is small. ``path`` is a scratch folder named before.
    """
    if source is not None and is_plain(source):
        return table
    path = path or scratch_folder(table.sparkSession)
    table.write.parquet(path)
    return table.sparkSession.read.schema(table.schema).parquet(path)


def spread(scan: DataFrame) -> DataFrame:
    """A plain scan with fewer splits than cores, dealt out over all cores.

    For CPU-heavy work on inputs of few files; a scan that has enough splits
    is returned as it is, so big tables never pay this shuffle.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan if scan.rdd.getNumPartitions() >= cores else scan.repartition(cores)


def plan_bytes(df: DataFrame) -> int:
    """Size estimate of a plan in bytes.

    The optimizer multiplies the sizes of join inputs; four times the sum of
    all inputs is taken as the ceiling.
    """
    plan = df._jdf.queryExecution().optimizedPlan()
    leaves = plan.collectLeaves()
    inputs = sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))
    return min(int(str(plan.stats().sizeInBytes())), 4 * inputs)


def is_small(df: DataFrame) -> bool:
    """Few bytes by the estimate and few rows by count.

    Estimates see compressed bytes and nothing behind an explode or a join, so
    rows are counted: of a plain scan from the files' footers, of other plans
    by running them without their columns.
    """
    return plan_bytes(df) <= SMALL_BYTES and df.select(F.lit(1)).count() <= SMALL_ROWS


def is_plain(df: DataFrame) -> bool:
    """Estimated as small, with nothing in the plan that multiplies rows unseen."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return plan_bytes(df) <= SMALL_BYTES and not any(x in plan for x in ("Generate ", "Join ", "Expand "))
