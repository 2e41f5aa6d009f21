"""Parse cache and notes as Parquet tables.

The cache holds one row of parsed arrays for each (path, mtime, size) below a folder named after a digest of everything
that parsing depends on, so that a new version never reads old rows. Fresh files are found by an anti-join.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import java

#: What identifies a version of a file.
VERSION = ["path", "mtime", "size"]
NOTE = "project string, node string, status string, text string, at timestamp"


def exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def fresh(files: DataFrame, cached: DataFrame | None) -> DataFrame:
    """The files of which the cache holds no such version."""
    return files if cached is None else files.join(cached.select(*VERSION).distinct(), VERSION, "left_anti")


def parsed_with_cache(files: DataFrame, folder: str, digest: str) -> DataFrame:
    """Parsed rows of `files` (path, mtime, size, content); only fresh files are parsed, and their rows are added."""
    spark, at = files.sparkSession, f"{folder.rstrip('/')}/{digest}"
    old = spark.read.parquet(at) if exists(spark, at) else None
    new = fresh(files, old)
    java.parsed_versions(new).write.mode("append").parquet(at)
    return spark.read.parquet(at).join(files.select(*VERSION).distinct(), VERSION, "left_semi")


def upsert_notes(notes: DataFrame, changes: DataFrame) -> DataFrame:
    """Notes (project, node, status, text, at) after `changes`; of several the last counts, and one without text deletes."""
    both = notes.withColumn("_new", F.lit(0)).unionByName(changes.withColumn("_new", F.lit(1)))
    last = Window.partitionBy("project", "node").orderBy(F.desc("_new"), F.desc("at"), F.desc("text"))
    kept = both.withColumn("_n", F.row_number().over(last)).filter("_n = 1")
    return kept.filter("_new = 0 or coalesce(text, '') <> '' or coalesce(status, '') <> ''").drop("_n", "_new")


def write_notes(notes: DataFrame, folder: str) -> str:
    """Write a new version of the notes beside the old ones and return its path; a reader takes the one it was given."""
    path = f"{folder.rstrip('/')}/notes-{uuid.uuid4().hex}"
    notes.write.parquet(path)
    return path
