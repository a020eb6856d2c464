"""Intermediate tables in the shared folder, so that a lost executor costs no more than a re-read."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from pairloom import session
from pairloom.session import shared_folder

#: rows of an Arrow batch that moves whole texts
TEXT_ROWS = 1024


def bounded_batches(spark: SparkSession) -> None:
    """Keep Arrow batches short in this session: a row is a whole text, and a batch is held several times."""
    session.bounded_batches(spark, TEXT_ROWS)


def _new_path(spark: SparkSession) -> str:
    return f"{shared_folder(spark).rstrip('/')}/tables/{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet below the folder of ``spark.checkpoint.dir`` and read it back."""
    spark = df.sparkSession
    path = _new_path(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Scratch:
    """Tables that one job stores and deletes after their last reader."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.held = spark, []

    def keep(self, df: DataFrame) -> DataFrame:
        """As ``stored``, until ``drop``."""
        path = _new_path(self.spark)
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.held.append((out, path, None))
        return out

    def bucketed(self, df: DataFrame, key: str) -> DataFrame:
        """As ``keep``, in as many buckets of ``key`` as a shuffle has partitions: later joins on it move the other side only."""
        path, name = _new_path(self.spark), f"pairloom_{uuid.uuid4().hex}"
        n = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        df.write.bucketBy(n, key).sortBy(key).option("path", path).format("parquet").saveAsTable(name)
        out = self.spark.table(name)
        self.held.append((out, path, name))
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete these tables, or all that are left."""
        gone = [h for h in self.held if not tables or any(h[0] is t for t in tables)]
        self.held = [h for h in self.held if h not in gone]
        context = self.spark.sparkContext
        for _, path, name in gone:
            if name:
                self.spark.sql(f"DROP TABLE IF EXISTS {name}")
            place = context._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(context._jsc.hadoopConfiguration()).delete(place, True)
