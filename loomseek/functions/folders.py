"""The folder that all executors share."""

from __future__ import annotations

import functools
import gc
import re
import tempfile
import uuid

import numpy as np
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder, not yet made, below the folder that all executors share, as a URI with its scheme.

    It is below ``spark.checkpoint.dir`` where the cluster names one; a path without a scheme is on the cluster's default
    file system. Only on one machine (a local master) may that be unset: then a temporary folder is set as the
    checkpoint folder. Elsewhere that is an error, as executors could not read each other's files.
    """
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="loomseek-")
        spark.sparkContext.setCheckpointDir(base)
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}")
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return re.sub("^file:/+", "file:///", fs.makeQualified(path).toString())


def release(spark: SparkSession) -> None:
    """Let go of finished steps' shuffle files: Spark deletes them when the driver's garbage, which has their last handles, is collected."""
    gc.collect()
    spark._jvm.System.gc()


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """The Arrow file system of a URI and the path in it; works in a task as on the driver. Hadoop's names of S3 are Arrow's."""
    return pafs.FileSystem.from_uri(re.sub("^s3[an]:", "s3:", uri))


def shared_matrix(spark: SparkSession, matrix: np.ndarray) -> str:
    """The URI of a file with ``matrix`` in the shared folder."""
    uri = shared_folder(spark, "matrix")
    fs, path = filesystem(uri)
    fs.create_dir(path)
    with fs.open_output_stream(f"{path}/matrix.npy") as out:
        np.lib.format.write_array_header_1_0(out, np.lib.format.header_data_from_array_1_0(matrix))
        for i in range(0, len(matrix), 1 << 14):
            out.write(np.ascontiguousarray(matrix[i: i + (1 << 14)]).tobytes())
    return f"{uri}/matrix.npy"


@functools.lru_cache(maxsize=2)
def mapped(uri: str) -> np.ndarray:
    """The matrix of shared_matrix. Where the folder is a local one the file is mapped, so that the workers of a machine have it in memory once; else it is read."""
    fs, path = filesystem(uri)
    if isinstance(fs, pafs.LocalFileSystem):
        return np.load(path, mmap_mode="r")
    with fs.open_input_file(path) as f:
        return np.load(f)


def written(df: DataFrame, path: str, **options: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives the loss of executors."""
    df.write.mode("overwrite").options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame, most_bytes: int = 32 << 20, row_bytes: int = 64) -> bool:
    """Whether ``df`` (a written table, cheap to count) is small enough for a broadcast of so many bytes."""
    return df.count() * row_bytes <= most_bytes
