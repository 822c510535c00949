"""Tables and lineage cuts in the folder that all executors share."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DEFAULT_DIR = "/tmp/checkpoints"


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a local default only where it is unset (tests)."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    return named.rstrip("/") if named else f"file://{DEFAULT_DIR}/{os.getpid()}"


def materialize(df: DataFrame, name: str, bucket_by: str | None = None) -> DataFrame:
    """Write df once as Parquet to the shared folder and return a reader of it.

    With bucket_by it is a bucketed table of as many buckets as the session has
    shuffle partitions: joins and groups on that column read it without a shuffle.

    The result has no lineage before the written files, so lost executors never
    cause the work above to run again, and two consumers see the same rows. The
    shuffle files of that work go when it is written.
    """
    spark = df.sparkSession
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")
    path = f"{shared_dir(spark)}/pagelens/{name}-{uuid.uuid4().hex}"
    if bucket_by:
        table = f"{name.replace('-', '_')}_{uuid.uuid4().hex}"
        buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        df.write.option("path", path).option("compression", "zstd").bucketBy(buckets, bucket_by).format("parquet").saveAsTable(table)
        return spark.table(table)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def materialize_all(parts: list[DataFrame], name: str) -> DataFrame:
    """The rows of all parts as one table, as `materialize` writes it, each part by a job of its own.

    So each is planned alone, and what is done to the table is planned once: an
    expression over a union would be copied into each of its parts.
    """
    spark, columns = parts[0].sparkSession, parts[0].columns
    path = f"{shared_dir(spark)}/pagelens/{name}-{uuid.uuid4().hex}"
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")
    for part in parts:
        part.select(*columns).write.option("compression", "zstd").mode("append").parquet(path)
    return spark.read.schema(parts[0].schema).parquet(path)


def dealt(df: DataFrame, key: str) -> DataFrame:
    """Rows that are small but dear, dealt to as many tasks as the session has shuffle partitions."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def long_rows(spark: SparkSession, rows: int = 1000) -> None:
    """Send rows that hold whole texts to Python in small Arrow batches, unless the session asks for smaller ones."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > rows:
        spark.conf.set(key, str(rows))


def quoted(name: str) -> Column:
    """The column of exactly this name, dots and back quotes included."""
    return F.col(f"`{name.replace('`', '``')}`")
