"""Session helpers: where intermediate tables go and how work is spread.

``cut`` ends a lineage by writing a Parquet table into the folder the cluster
names in ``spark.checkpoint.dir``. That folder is shared, so the table outlives
any executor. Where the setting is absent, a local session (as in tests) uses a folder of
this process, and a cluster is an error: its executors would each write to their own disk.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_made: list[tuple[SparkSession, str]] = []


def local_session(cores: int | str = "*", **conf: str) -> SparkSession:
    """A local session for tests and the benchmark."""
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.shuffle.partitions": "8",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    } | conf
    builder = SparkSession.builder.master(f"local[{cores}]").appName("annotary")
    for k, v in base.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables, from ``spark.checkpoint.dir``."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    own = getattr(shared_dir, "own", None)
    if own is None:
        own = shared_dir.own = tempfile.mkdtemp(prefix="annotary-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
    return f"file://{own}"


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; ``release`` deletes what is there."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


def cut_path(df: DataFrame, name: str) -> str:
    """Write ``df`` to the shared folder and return where it is."""
    path = shared_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return path


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and return a scan of what was written."""
    return df.sparkSession.read.schema(df.schema).parquet(cut_path(df, name))


def release(spark: SparkSession) -> int:
    """Delete the intermediate tables of this session; returns how many.

    Call it when results that were built on them have been written."""
    mine = [(s, p) for s, p in _made if s is spark]
    jvm = spark.sparkContext._jvm
    for pair in mine:
        path = jvm.org.apache.hadoop.fs.Path(pair[1])
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        _made.remove(pair)
    return len(mine)


def spread(df: DataFrame, always: bool = False) -> DataFrame:
    """At least as many partitions as the cluster has cores, for CPU-heavy maps.

    A scan of a few files can have fewer tasks than cores; then the rows are dealt out evenly.
    Behind a shuffle the partitions are known only by running it, and adaptive execution makes
    them few where rows are small: ``always`` deals those out too."""
    spark = df.sparkSession
    want = spark.sparkContext.defaultParallelism
    if "Exchange" in df._jdf.queryExecution().executedPlan().toString():
        return df.repartition(max(want, int(spark.conf.get("spark.sql.shuffle.partitions")))) if always else df
    return df if df.rdd.getNumPartitions() >= want else df.repartition(want)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
