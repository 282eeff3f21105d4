"""Small helpers that the corpus operators share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Columns that operators add for their own use start with this, so that an input's own columns don't clash.
OWN = "__tw_"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or on one machine without it a folder of our own."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = f"file://{tempfile.gettempdir()}/tidewell"
    return root.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: later jobs start from its files, whatever executors are lost."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, key: str, name: str) -> DataFrame:
    """df as a table in the shared folder, bucketed by a key: joins by it don't shuffle this side, however often it is read."""
    spark, n, name = df.sparkSession, partitions(df.sparkSession), f"tidewell_{name}_{uuid.uuid4().hex}"
    df.repartition(n, key).write.format("parquet").option("compression", "zstd").option("path", f"{shared_dir(spark)}/{name}").bucketBy(n, key).saveAsTable(name)
    return spark.table(name)


def col(name: str) -> Column:
    """A column by its plain name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def id_name(id_col: str, results: list[str]) -> str:
    """What a result calls the id: its own name, with "_id" behind where a result has that name."""
    return f"{id_col}_id" if id_col.lower() in results else id_col


def numbered(docs: DataFrame, first: str, names: list[str]) -> DataFrame:
    """The text column `first` (as a string) and the named columns, called c0, c1, ...: Arrow functions take them by place, so that
    no name of the input can clash with another."""
    return docs.select(col(first).cast("string").alias("c0"), *(col(name).alias(f"c{i}") for i, name in enumerate(names, 1)))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
