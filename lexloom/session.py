"""Session factory and the shared-folder materialisation used to cut lineage."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: list[tuple[SparkSession, str]] = []


def session(app: str = "lexloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings every operator assumes (UTC, AQE, Arrow)."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    }
    for k, v in {**base, **conf}.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    ship(spark)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session.

    Only where the session names none (tests, a laptop) a local folder is made.
    """
    d = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not d:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        d = "file://" + os.path.join(tempfile.gettempdir(), f"lexloom-{os.getpid()}")
        spark.conf.set("spark.checkpoint.dir", d)
    return d.rstrip("/")


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of a file system Spark knows; an error is raised, so that a full shared folder is noticed."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder's name in the shared folder; what is written there goes when the program ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if not _written:
        atexit.register(_sweep)
    _written.append((spark, path))
    return path


def ship(spark: SparkSession) -> None:
    """Let Python workers find this package, wherever the driver was started from."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([root, *paths])


class Cut:
    """A table written to the shared folder; ``df`` reads it, ``drop`` removes it.

    A written table survives the loss of any executor, unlike a cached or
    locally checkpointed one.
    """

    def __init__(self, df: DataFrame, name: str):
        spark = df.sparkSession
        self._spark, self.path = spark, scratch(spark, name)
        df.write.parquet(self.path)
        self.df = spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        remove(self._spark, self.path)
        _written.remove((self._spark, self.path))


def cut(df: DataFrame, name: str) -> DataFrame:
    """Materialise ``df`` in the shared folder and read it back."""
    return Cut(df, name).df


def _sweep() -> None:
    for spark, path in _written:
        try:
            remove(spark, path)
        except Exception:  # noqa: BLE001 - the session is gone; the folder is left to who ended it
            return


def spread(df: DataFrame) -> DataFrame:
    """Give a scan of few files as many partitions as there are cores.

    A table of one small file is one task; the round-robin exchange is paid only
    when the scan has under half as many partitions as the cluster has cores,
    i.e. only for inputs of a few file splits.
    """
    n = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(n) if df._jdf.rdd().getNumPartitions() * 2 <= n else df


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
