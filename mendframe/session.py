"""Session helpers: local sessions for tests and benches, and the shared folder."""

from __future__ import annotations

import re
import tempfile
import uuid
from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    # "col" is an identifier, as in standard SQL, not a string literal
    "spark.sql.ansi.doubleQuotedIdentifiers": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    # no call-site capture for every column expression
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def local_session(cpus: int | str = 8, memory: str = "8g", app: str = "mendframe") -> SparkSession:
    """A session on this machine, with a shared folder of its own (all its tasks run here)."""
    builder = SparkSession.builder.master(f"local[{cpus}]").appName(app)
    builder = builder.config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="mendframe-"))
    builder = builder.config("spark.driver.memory", memory)
    partitions = cpus if isinstance(cpus, int) else 8
    builder = builder.config("spark.sql.shuffle.partitions", str(partitions))
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can read, as the cluster names it in `spark.checkpoint.dir`.

    Only a session whose tasks all run in this process may do without the setting;
    it gets one temporary folder.  Anywhere else executors would not see the files.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by the cluster")
    return _own_folder(spark.sparkContext.applicationId)


@cache
def _own_folder(application: str) -> str:
    return tempfile.mkdtemp(prefix="mendframe-")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write `df` once to the shared folder and read it back.

    Cuts the lineage, survives lost executors, and gives later joins the real
    size of the table, so the planner broadcasts it only when it is small.
    """
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


STEPS = "mendframe_steps"


def materialize_by(df: DataFrame, key: str, name: str = "table", buckets: int | None = None, placed: bool = False) -> DataFrame:
    """Write `df` once to the shared folder, in buckets of `key`, sorted by it, and read it back.

    Joins and groupings by the key, between tables of one number of buckets, read bucket against
    bucket: nothing moves.  The number is that of shuffle partitions.  `placed` says that rows with equal keys are
    already in one task, as behind a join by the key of such tables; otherwise `df` is dealt out by the key once.
    The table belongs to the database `mendframe_steps`; `drop_steps` removes it with its files.
    """
    spark = df.sparkSession
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {STEPS} LOCATION '{new_path(spark, 'steps')}'")
    table = f"{STEPS}.{re.sub('[^a-z0-9]', '_', name.lower())}_{uuid.uuid4().hex}"
    dealt = df if placed else df.repartition(n, F.col(quoted_name(key)))
    dealt.write.format("parquet").bucketBy(n, key).sortBy(key).saveAsTable(table)
    return spark.table(table)


def quoted_name(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def drop_steps(spark: SparkSession) -> None:
    """Remove every table that `materialize_by` has stored in this session; frames that read them end with it."""
    spark.sql(f"DROP DATABASE IF EXISTS {STEPS} CASCADE")
