"""Column plumbing shared by the operators: results keyed by fresh names, so clashing extra columns survive."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def narrow(docs: DataFrame, *names: str) -> DataFrame:
    """The named columns alone; text is cast to string. Extra columns are dropped before any shuffle."""
    return docs.select(*(F.col(f"`{n}`").cast("string").alias(n) if n in ("text", "source") else F.col(f"`{n}`").alias(n) for n in names))


def id_field(docs: DataFrame) -> str:
    """doc_id with the type that it has in docs, as a field of a schema."""
    return f"doc_id {docs.schema['doc_id'].dataType.simpleString()}"


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder that the driver and all executors share: below spark.checkpoint.dir. A local one only in local mode, where
    that is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    root = root or f"file://{os.path.join(tempfile.gettempdir(), 'tessera-checkpoints')}"
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def cut(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it back, which cuts its lineage and survives lost executors."""
    spark = df.sparkSession
    path = shared_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
