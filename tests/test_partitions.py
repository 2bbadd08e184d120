"""How many tasks the pages are dealt to."""

import os

from pyspark.sql import functions as F

from pagelake.operators import html as H


def test_page_partitions_follow_the_bytes(spark, tmp_path):
    """A task of some tens of compressed megabytes took gigabytes for its sorts."""
    sums = [F.sha2(F.concat_ws(":", "id", F.lit(k)), 512) for k in range(4)]
    spark.range(90_000).select(F.col("id").alias("page_id"), F.concat(*sums).alias("html")).write.parquet(f"{tmp_path}/p")
    size = sum(os.path.getsize(f"{tmp_path}/p/{f}") for f in os.listdir(f"{tmp_path}/p"))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        n = H.page_partitions(spark.read.parquet(f"{tmp_path}/p"))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert size > 30 << 20 and size / n <= 16 << 20 and n <= 2 + size // (4 << 20)


def test_a_task_takes_four_megabytes(spark, tmp_path):
    """With 8 MB a task, sorts took a third more memory than on tables of fewer bytes than that a core."""
    sums = [F.sha2(F.concat_ws(":", "id", F.lit(k)), 512) for k in range(4)]
    spark.range(90_000).select(F.col("id").alias("page_id"), F.concat(*sums).alias("html")).write.parquet(f"{tmp_path}/p")
    size = sum(os.path.getsize(f"{tmp_path}/p/{f}") for f in os.listdir(f"{tmp_path}/p"))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        assert size / H.page_partitions(spark.read.parquet(f"{tmp_path}/p")) <= 4.2 * (1 << 20)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
