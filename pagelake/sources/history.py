"""Extraction history with commits: files are staged first and become visible when one small log entry is put in its place.

A folder holds ``data/commit=<name>/`` with the staged files and ``log/<version>.json`` with one entry a commit. A reader sees the
commits of the log up to a version, all of their rows or none. An entry is moved to its final name in one step that fails
if another commit took the version; the commit then tries the next one. A commit with a token that the log already
holds changes nothing, so a job that is run again after a failure leaves one set of rows. Staged files without an
entry are rubbish of failed jobs, see ``orphans``.
"""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


class _Folder:
    """The history's folder in whatever file system its path names."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm, self.root = spark._jvm, path.rstrip("/")
        conf = spark._jsc.hadoopConfiguration()
        self.fs = self.at("").getFileSystem(conf)
        self.context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), conf)
        self.no_options = spark.sparkContext._gateway.new_array(getattr(self.jvm.org.apache.hadoop.fs, "Options$Rename"), 0)

    def at(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def names(self, folder: str) -> list[str]:
        where = self.at(folder)
        return sorted(s.getPath().getName() for s in self.fs.listStatus(where)) if self.fs.exists(where) else []

    def put(self, name: str, text: str) -> bool:
        """Write a file that shows up whole or not at all; False if there is one already."""
        staged = f"staged/{uuid.uuid4().hex}"
        self.fs.mkdirs(self.at(name).getParent())
        out = self.fs.create(self.at(staged), False)
        out.write(bytearray(text.encode()))
        out.close()
        try:
            self.context.rename(self.fs.makeQualified(self.at(staged)), self.fs.makeQualified(self.at(name)), self.no_options)
            return True
        except Py4JJavaError as e:
            if "FileAlreadyExists" not in str(e.java_exception.getClass().getName()):
                raise
            self.fs.delete(self.at(staged), False)
            return False


def versions(spark: SparkSession, path: str) -> DataFrame:
    """version, token, commit, rows of the log; one small entry a commit."""
    schema = "token string, commit string, rows long"
    if not _Folder(spark, path).names("log"):
        return spark.createDataFrame([], f"version long, {schema}")
    log = spark.read.schema(schema).json(f"{path.rstrip('/')}/log")
    return log.select(F.regexp_extract(F.input_file_name(), r"(\d+)\.json$", 1).cast("long").alias("version"), "token", "commit", "rows")


def commit(rows: DataFrame, path: str, token: str) -> int:
    """Add ``rows`` to the history under ``token`` and return the version; the version there is if the token is known."""
    spark = rows.sparkSession
    folder = _Folder(spark, path)

    def known() -> int | None:
        return versions(spark, path).where(F.col("token") == token).agg(F.min("version")).first()[0]

    if (done := known()) is not None:
        return done
    name = uuid.uuid4().hex
    staged = f"{folder.root}/data/commit={name}"
    rows.write.partitionBy("created_on").parquet(staged)
    n = spark.read.schema(rows.schema).parquet(staged).count()
    entry = json.dumps({"token": token, "commit": name, "rows": n})
    while True:
        last = max((int(x.split(".")[0]) for x in folder.names("log") if x.endswith(".json")), default=0)
        if folder.put(f"log/{last + 1:020}.json", entry):
            break
        if (done := known()) is not None:  # the same commit, run twice at once
            return done
    # Two runs of one commit may both have found the token unknown: the earlier entry counts.
    return known()


def read(spark: SparkSession, path: str, schema: StructType, version: int | None = None) -> DataFrame:
    """Rows of all commits up to ``version`` (the newest if not given), as they were then."""
    log = versions(spark, path)
    if version is not None:
        log = log.where(F.col("version") <= version)
    # One name a commit; of a token that two runs committed at once, the first.
    first = log.where("rows > 0").groupBy("token").agg(F.min_by("commit", "version").alias("commit"))
    root = path.rstrip("/")
    paths = [f"{root}/data/commit={r.commit}" for r in first.select("commit").collect()]
    if not paths:
        return spark.createDataFrame([], schema)
    found = spark.read.option("basePath", f"{root}/data").schema(StructType(schema.fields).add("commit", "string")).parquet(*paths)
    return found.select(*schema.names)


def orphans(spark: SparkSession, path: str) -> list[str]:
    """Staged folders that no entry of the log names."""
    listed = {r.commit for r in versions(spark, path).select("commit").collect()}
    return [x for x in _Folder(spark, path).names("data") if x.startswith("commit=") and x.split("=", 1)[1] not in listed]
