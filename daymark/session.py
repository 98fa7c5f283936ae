"""Runtime settings the operators count on.  Only settings that may change on a live session are touched."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession

RUNTIME = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # An aggregate sits above most of our joins.  Without this flag Spark leaves a skewed join alone
    # whenever splitting it would need one more exchange, which is exactly the case of a hot user.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session made by the caller."""
    for key, value in RUNTIME.items():
        spark.conf.set(key, value)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by the cluster.

    Where none is named, a single-machine session (as in tests) gets a temporary folder; on a cluster that would be a
    different disk on each machine, so the caller must name a shared path.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
        if not named and not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("name a folder that all machines share in spark.checkpoint.dir, or call setCheckpointDir")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="daymark-checkpoint-"))
    return sc.getCheckpointDir()


_scratch: list[list[str]] = []


def settle(df: DataFrame) -> DataFrame:
    """The frame written once as a table beside the checkpoints and read back.

    Later passes read only the columns they need, sizes are known to the optimizer, and a lost executor costs no
    recompute of what came before.  Inside `scratch` the tables go when the block ends; else the cluster cleans them
    with the checkpoints.
    """
    path = f"{checkpoint_dir(df.sparkSession)}/daymark-{uuid.uuid4().hex}"
    if _scratch:
        _scratch[-1].append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def settle_all(**frames: DataFrame) -> dict[str, DataFrame]:
    """`settle` for several independent frames, their jobs submitted side by side."""
    if frames:
        checkpoint_dir(next(iter(frames.values())).sparkSession)  # set once, before the threads ask for it
    with ThreadPoolExecutor(max_workers=max(1, len(frames))) as pool:
        return dict(zip(frames, pool.map(settle, frames.values())))


def dealt(df: DataFrame, how: str = "shuffle_hash") -> DataFrame:
    """The frame, whose next join deals both sides out by key instead of sending one whole through the driver to every task.

    Spark judges a table by the compressed bytes of its files, of which a row of a narrow column takes about one, and broadcasts
    what stays under its threshold; the rows take up to a hundred times that on the driver.  For frames with a row per user, session or
    item, however few bytes they are stored in.  The mark reaches the next join through selections, filters and groupings; the
    frame is the side that is hashed, so its key should not repeat much; with `how` "merge" both sides are sorted instead.
    """
    return df.hint(how)


@contextlib.contextmanager
def scratch(spark: SparkSession):
    """Remove the tables that `settle` writes inside the block; write or collect the results before it ends."""
    _scratch.append([])
    try:
        yield
    finally:
        jvm = spark.sparkContext._jvm
        for path in _scratch.pop():
            place = jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


FIT_ROWS, FIT_MOST = 50_000, 1_000_000  # rows of a partition for which a task is worth its start, and at most


def fit_parts(spark: SparkSession, n: int) -> int:
    """Partitions for n rows that a fit reads hundreds of times.

    Each pass is a job of its own, whose time on few rows is the start of its tasks: a small table gets few partitions, a larger
    one a partition per core, and more only where these would grow beyond `FIT_MOST` rows.
    """
    return max(1, min(-(-n // FIT_ROWS), spark.sparkContext.defaultParallelism), -(-n // FIT_MOST))


def shuffle_parts(spark: SparkSession) -> int:
    return max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))


def local(app: str = "daymark", cores: str = "*", partitions: int = 8, memory: str = "16g") -> SparkSession:
    """A local session for tests and the bench."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return tune(spark)
