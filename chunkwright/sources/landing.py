"""Landing rows as files that all executors can read."""

from __future__ import annotations

import atexit
import hashlib
import shutil
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; only a local master may go without it, in a temporary folder that ends with the process."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    made = tempfile.mkdtemp(prefix="chunkwright-")
    atexit.register(shutil.rmtree, made, ignore_errors=True)
    spark.conf.set("spark.checkpoint.dir", f"file://{made}")
    return f"file://{made}"


def landing_path(spark: SparkSession, *names: str) -> str:
    """A folder by name, the same for the same names, so that repeated runs replace their files."""
    return f"{shared_folder(spark)}/landed/{names[-1]}-{hashlib.md5('|'.join(names).encode()).hexdigest()[:12]}"


def land_lines(df: DataFrame, line: Column, path: str) -> str:
    """One line of text a row; a line may hold line ends of its own."""
    df.select(line.alias("value")).write.mode("overwrite").text(path)
    return path
