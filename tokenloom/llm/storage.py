"""Intermediate tables in the shared folder named by ``spark.checkpoint.dir``.

A stored table survives the loss of any executor and ends the lineage before
it.  A ``Scratch`` keeps the paths that one operator call writes, so that a
superseded table can be removed as soon as the next one is written.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from ..session import ensure_checkpoint_dir, intermediate


class Scratch:
    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.name = f"{name}_{uuid.uuid4().hex}"
        self.base = intermediate(f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm/{self.name}")
        self.count = 0

    def store(self, df: DataFrame, **options: str) -> tuple[DataFrame, str]:
        """Write ``df`` and read it back: (table, path)."""
        path = f"{self.base}/{self.count}"
        self.count += 1
        df.write.options(**options).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path), path

    def drop(self, *paths: str) -> None:
        """Remove tables that no later step reads."""
        jvm = self.spark._jvm
        for path in paths:
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)


def fresh_name(columns: list[str], base: str) -> str:
    """A column name that clashes with none of ``columns``."""
    taken = {c.lower() for c in columns}
    while base.lower() in taken:
        base += "_"
    return base
