"""Session settings the library relies on, and where tables are staged."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession

# Runtime settings. Repeated keys in a JSON object: the last one wins.
RUNTIME_CONF = {
    "spark.sql.variant.allowDuplicateKeys": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session made elsewhere."""
    for name, value in RUNTIME_CONF.items():
        spark.conf.set(name, value)
    return spark


def session(app_name: str = "rowgate", **conf: str) -> SparkSession:
    """Get or create a session with the settings above plus ``conf``."""
    builder = SparkSession.builder.appName(app_name)
    for name, value in {**RUNTIME_CONF, **conf}.items():
        builder = builder.config(name, value)
    return configure(builder.getOrCreate())


def staging_root(spark: SparkSession) -> str:
    """The shared folder of the cluster (``spark.checkpoint.dir``).

    Only a local session that names none gets a temporary folder; on a cluster a
    machine-local folder would be lost with its executor, so that is refused.
    """
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if root:
        return root
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="rowgate-"))
    return context.getCheckpointDir()


def staging_folder(spark: SparkSession) -> str:
    """The folder of this application below the staging root."""
    return f"{staging_root(spark).rstrip('/')}/rowgate-{spark.sparkContext.applicationId}"


def staging_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder of this application."""
    return f"{staging_folder(spark)}/{name}-{uuid.uuid4().hex}"


def qualified(spark: SparkSession, path: str) -> str:
    """``path`` with the scheme and folder that Spark itself would take it for."""
    made = spark._jvm.org.apache.hadoop.fs.Path(path)
    return made.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(made).toString()


def arrow_file_system(uri: str) -> tuple[fs.FileSystem, str]:
    """The Arrow file system of a qualified path, and the path in it; for use inside tasks too."""
    scheme, _, rest = uri.partition(":")
    if not rest or scheme == "file":
        path = rest or uri
        return fs.LocalFileSystem(), "/" + path.lstrip("/") if rest else path
    if scheme in ("s3a", "s3n"):
        uri = f"s3:{rest}"
    return fs.FileSystem.from_uri(uri)


def delete_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder on whatever file system Spark takes the path for, if it is there."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def clear_staging(spark: SparkSession) -> None:
    """Delete what this application has staged. Results that read from it cannot be used after."""
    delete_folder(spark, staging_folder(spark))


@contextmanager
def staged(df: DataFrame, name: str) -> Iterator[DataFrame]:
    """``df`` staged for the length of a block; the folder is deleted at its end."""
    spark = df.sparkSession
    path = staging_path(spark, name)
    try:
        df.write.parquet(path)
        yield spark.read.schema(df.schema).parquet(path)
    finally:
        delete_folder(spark, path)


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as parquet to the staging folder and read it back.

    This cuts the lineage and fixes values that depend on partitioning. Unlike an
    RDD checkpoint the result is columnar, so a later pass over two columns reads
    only those. It outlives lost executors.
    """
    spark = df.sparkSession
    path = staging_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
