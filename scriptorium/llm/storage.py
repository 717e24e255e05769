"""Shared folders for what the operators write between steps."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from ..session import ensure_checkpoint_dir


def fresh_folder(spark: SparkSession, purpose: str) -> str:
    """A new folder name under the session's checkpoint folder, which driver and executors share."""
    base = ensure_checkpoint_dir(spark)
    return f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def written(df: DataFrame, purpose: str) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read again: cuts the lineage, survives lost executors."""
    folder = fresh_folder(df.sparkSession, purpose)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def unused(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
