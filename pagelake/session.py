"""Session settings the jobs rely on."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def prepare(spark: SparkSession) -> SparkSession:
    """Settings that results or plans depend on; cluster sizing stays with whoever runs the cluster."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    # Rows with whole texts: ten thousand of them, as Spark deals by default, take tens of megabytes on either side of each task.
    if spark.conf.get(BATCH, None) is None:
        spark.conf.set(BATCH, "1000")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder the cluster names in ``spark.checkpoint.dir``; a local one only on a local master."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    jsc = spark.sparkContext._jsc.sc()
    if not jsc.getCheckpointDir().isDefined():
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="pagelake-"))
    return jsc.getCheckpointDir().get()


#: Tables that ``written`` made in this process and that are still there.
TABLES: list[str] = []


def written(df: DataFrame) -> DataFrame:
    """The rows of ``df`` as a table written to the shared folder, for plans that read them more than once.

    Later jobs start from the files, so a lost executor costs no recomputation.
    """
    path = f"{checkpoint_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    TABLES.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_by(df: DataFrame) -> set[str]:
    """Folders that ``df`` reads."""
    leaves = df._jdf.queryExecution().analyzed().collectLeaves()
    found: set[str] = set()
    for i in range(leaves.size()):
        leaf = leaves.apply(i)
        if leaf.getClass().getSimpleName() == "LogicalRelation" and leaf.relation().getClass().getSimpleName() == "HadoopFsRelation":
            roots = leaf.relation().location().rootPaths()
            found |= {roots.apply(k).toString() for k in range(roots.size())}
    return found


def drop(spark: SparkSession, tables: list[str]) -> None:
    """Remove tables of ``written`` that nobody reads any more."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for path in tables:
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(conf).delete(where, True)
        if path in TABLES:
            TABLES.remove(path)


def local(cpus: str = "*") -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("pagelake")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        # Recording the Python call site of every column expression costs most of the time to build a plan.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return prepare(spark)
