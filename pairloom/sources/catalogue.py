"""Catalogue and pair files: readers with explicit schemas, partitioned writers."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairloom.sources.stores import opens, store_of


def path_exists(spark: SparkSession, path: str) -> bool:
    """Existence on whatever file system the path names."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)


def _first_lines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        heads = []
        for path in batch["path"]:
            system, inside = store_of(path)
            with system.open_input_file(inside) as f:
                head = b""
                while b"\n" not in head and (more := f.read(65536)):
                    head += more
            heads.append(head.split(b"\n")[0].rstrip(b"\r").decode())
        yield pd.DataFrame({"file": batch["path"], "head": heads})


def _headers(spark: SparkSession, path: str) -> list[tuple[str, list[str]]]:
    """(header line, its files) of the CSV files below ``path``: one entry per column order.

    Tasks read the first bytes of each file; of a store that only Spark opens, Spark reads the lines.
    """
    if opens(path):
        files = spark.read.format("binaryFile").load(path).select("path")  # no content is read
        first = spread(files, "path").mapInPandas(_first_lines, "file string, head string")
    else:
        lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"))
        first = lines.where("at = 0").groupBy("file").agg(F.first("value").alias("head"))
    grouped = first.groupBy("head").agg(F.array_sort(F.collect_list("file")).alias("files"))
    return sorted((r["head"], r["files"]) for r in grouped.collect())


def read_catalogue(spark: SparkSession, path: str, schema: T.StructType, multi_line: bool = True) -> DataFrame | None:
    """Catalogue CSV with its schema given; a missing file is no error but None.

    Columns are matched by header name, file by file, so files of a folder may have other column
    orders. Texts may hold line breaks; ``multi_line=False`` promises that none does and lets
    Spark split the files.
    """
    if not path_exists(spark, path):
        return None
    parts = []
    for _, files in _headers(spark, path):
        header = spark.read.option("header", True).csv(files[0]).columns
        known = T.StructType([T.StructField(c, T.StringType()) for c in header])
        raw = spark.read.schema(known).option("header", True).option("multiLine", multi_line).option("escape", '"').csv(files)
        parts.append(raw.select(*[
            (F.col(f.name) if f.name in header else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields
        ]))
    return reduce(lambda a, b: a.unionAll(b), parts) if parts else spark.createDataFrame([], schema)


def _entries(folder: str, recursive: bool) -> list[tuple[str, int, bool]]:
    """(path, length, is folder) as Spark writes paths."""
    system, root = store_of(folder)
    prefix = folder.rstrip("/") if ":" in folder.split("/")[0] else "file:" + root.rstrip("/")
    found = system.get_file_info(pafs.FileSelector(root, recursive=recursive, allow_not_found=True))
    return [
        (prefix + f.path[len(root.rstrip("/")) :], f.size or 0, f.type == pafs.FileType.Directory)
        for f in found
        if f.type in (pafs.FileType.File, pafs.FileType.Directory)
    ]


def _listed(recursive: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for folder in batch["path"]:
                yield pd.DataFrame(_entries(folder, recursive), columns=["path", "length", "is_folder"])

    return run


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt over as many tasks as a shuffle has, however few bytes they are: each stands for a file."""
    return df.repartition(max(8, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))), *keys)


def list_files(spark: SparkSession, folder: str, pattern: str = "*.wav") -> DataFrame:
    """File listing (path, name, length), files of 0 bytes included.

    Spark's file sources leave empty files out, so a file that is there but empty would look
    missing. Folders are listed in tasks: the top one in one, each of its subfolders in another; no content is read.
    A store that only Spark opens is listed by Spark, without its empty files.
    """
    if opens(folder):
        schema = "path string, length long, is_folder boolean"
        top = spark.createDataFrame([(folder,)], "path string").mapInPandas(_listed(False), schema)
        nested = spread(top.where("is_folder").select("path"), "path").mapInPandas(_listed(True), schema)
        files = top.unionAll(nested).where("not is_folder")
    else:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    name = F.element_at(F.split("path", "/"), -1)
    like = "".join({"*": ".*", "?": "."}.get(c, re.escape(c)) for c in pattern)
    return files.select("path", name.alias("name"), "length").where(F.col("name").rlike(f"^{like}$"))


def empty_files(spark: SparkSession, folder: str, pattern: str = "*.wav") -> DataFrame:
    return list_files(spark, folder, pattern).where("length = 0")


def write_pairs(pairs: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite") -> None:
    """Pair table, one folder per split, so a reader of one split prunes the others."""
    writer = pairs.write.mode(mode).partitionBy("split")
    if fmt == "csv":
        writer = writer.option("header", True)
    writer.format(fmt).save(path)


def read_pairs(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    pairs = spark.read.parquet(path)
    return pairs if split is None else pairs.where(F.col("split") == split)


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("ignoreNullFields", "false").json(path)
