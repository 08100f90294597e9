"""Session set-up and the shared folder that cuts lineage of iterative jobs."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "odflux", master: str | None = None, **conf) -> SparkSession:
    """A session with the settings the jobs expect; everything can be overridden."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.enabled": "false",
    }
    settings.update({k.replace("__", "."): v for k, v in conf.items()})
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Folder all executors can reach: the one named by ``spark.checkpoint.dir``.

    Only a local session without that setting gets a temporary folder; a cluster
    session without it is refused, since a machine-local folder would be lost with
    its machine.
    """
    context = spark.sparkContext
    named = context.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="odflux-"))
    return context.getCheckpointDir()


_written: list[str] = []  # scratch folders of this process
_tables: list[str] = []  # bucketed scratch tables of this process


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder; ``remove_scratch`` deletes all of them."""
    _written.append(f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}")
    return _written[-1]


def remove_scratch(spark: SparkSession) -> int:
    """Delete the intermediate tables of this process, once the results that read them are
    written. Returns how many folders there were."""
    while _tables:
        spark.sql(f"drop table if exists {_tables.pop()}")
    return _delete_written(spark, 0)


def _delete_written(spark: SparkSession, keep: int) -> int:
    """Delete the scratch folders of this process but the first ``keep``."""
    jvm, conf, gone = spark._jvm, spark._jsc.hadoopConfiguration(), 0
    while len(_written) > keep:
        path = jvm.org.apache.hadoop.fs.Path(_written.pop())
        gone += path.getFileSystem(conf).delete(path, True)
    return gone


@contextmanager
def released(spark: SparkSession):
    """Scratch folders named inside are deleted at the end; results go to a path named before.
    Not for plans that are run later, nor for work in several threads."""
    before = len(_written)
    try:
        yield
    finally:
        _delete_written(spark, before)


def materialize(df: DataFrame, name: str = "table", path: str | None = None) -> DataFrame:
    """Write a table to the shared folder and read it back.

    The copy survives lost executors, has no lineage, and its real size is known to
    the planner, so Spark itself decides whether it may be broadcast.
    """
    spark = df.sparkSession
    target = path or scratch_path(spark, name)
    df.write.mode("overwrite").parquet(target)
    return spark.read.schema(df.schema).parquet(target)


def stored_bytes(df: DataFrame) -> int:
    """What Spark takes the table's size for: that of its files, of a written one."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def bucketed(df: DataFrame, keys, name: str = "bucketed") -> DataFrame:
    """Like ``materialize``, in as many buckets by the keys as shuffles have partitions.

    Joins and sums by exactly these keys read a bucket where a shuffle would put its rows, so in
    a loop only the other side moves. A table below the broadcast limit is written plainly: it
    would only be many small files. The files lie in the shared folder; the session's catalog
    holds their layout.
    """
    spark, written = df.sparkSession, materialize(df, name)
    limit = spark._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
    if stored_bytes(written) <= limit:
        return written
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    _tables.append(f"odflux_{name}_{uuid.uuid4().hex}")
    # Placed first, each bucket is one file.
    (
        written.repartition(n, *keys).write.format("parquet").bucketBy(n, *keys).sortBy(*keys)
        .option("path", scratch_path(spark, name)).saveAsTable(_tables[-1])
    )
    return spark.table(_tables[-1])


def placed(df: DataFrame, key: str, n: int, name: str = "placed") -> DataFrame:
    """Like ``bucketed``, in ``n`` buckets by one key whatever the size, written once as the rows
    come: the rows of a key should be in one partition already."""
    _tables.append(f"odflux_{name}_{uuid.uuid4().hex}")
    df.write.format("parquet").bucketBy(n, key).option("path", scratch_path(df.sparkSession, name)).saveAsTable(_tables[-1])
    return df.sparkSession.table(_tables[-1])


@contextmanager
def shuffles_dropped(spark: SparkSession):
    """Inside, Spark deletes a query's shuffle files when the query ends, not when the driver
    happens to collect its garbage. For loops whose queries write what they find."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


class Rounds:
    """Storage for a loop: each round is written once, two rounds are kept."""

    def __init__(self, spark: SparkSession, name: str):
        self._base = scratch_path(spark, name)
        self._turn = 0

    def keep(self, df: DataFrame) -> DataFrame:
        self._turn += 1
        return materialize(df, path=f"{self._base}/{self._turn % 2}")
