"""Intermediate tables in the folder all executors share.

Lineage is cut by writing a Parquet table under ``spark.checkpoint.dir`` and reading it back, so a
lost executor costs at most the unfinished stage. The setting is read from the session. Only a local
session may go without it; it gets a temporary folder of its own.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_made: list[tuple[SparkSession, str]] = []
_local: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of this session."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _local:
        _local[app] = tempfile.mkdtemp(prefix="chanlake-")
        atexit.register(shutil.rmtree, _local[app], True)
    return f"file://{_local[app]}"


def scratch_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/chanlake/{name}-{uuid.uuid4().hex[:12]}"
    _made.append((spark, path))
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read back with its own schema."""
    spark, schema = df.sparkSession, df.schema
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(schema).parquet(path)


def read_bytes(spark: SparkSession, path: str) -> bytes | None:
    """A small file of any file system, or None if there is none."""
    got = spark.read.format("binaryFile").load(path).select("content").first() if exists(spark, path) else None
    return None if got is None else bytes(got[0])


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def write_bytes(spark: SparkSession, path: str, body: bytes) -> None:
    """A file written beside its place and then moved there, so that it is never seen half."""
    fs = spark.sparkContext._jvm.org.apache.hadoop.fs
    p, part = fs.Path(path), fs.Path(f"{path}.{uuid.uuid4().hex[:8]}")
    system = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out = system.create(part, True)
    out.write(bytearray(body))
    out.close()
    if not system.rename(part, p):
        system.delete(part, False)


def release(spark: SparkSession) -> None:
    """Delete all intermediate tables of this session; frames that still read them become invalid."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    for owner, path in list(_made):
        if owner is spark:
            p = hadoop.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
            _made.remove((owner, path))
