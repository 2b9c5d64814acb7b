"""Reading tables, month partitions and shards; cutting lineage in the cluster's shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The Parquet table ``name`` below ``root`` (a file or a directory of files)."""
    return spark.read.parquet(f"{root}/{name}.parquet")


def months(spark: SparkSession, root: str, wanted: tuple[str, ...] = ()) -> DataFrame:
    """A table laid out as ``root/year=YYYY/month=MM/*.parquet``, of the months ``YYYY-MM`` given (all without any): only their folders are listed and read.

    ``year`` and ``month`` are text, so that ``05`` stays as it is.
    """
    reader = spark.read.option("basePath", root)
    paths = [f"{root}/year={m[:4]}/month={m[5:]}" for m in wanted] or [root]
    df = reader.parquet(*paths)
    return df.withColumns({"year": F.lpad(F.col("year").cast("string"), 4, "0"), "month": F.lpad(F.col("month").cast("string"), 2, "0")})


def shards(spark: SparkSession, *paths: str, schema: str | None = None) -> DataFrame:
    """Shard files by folder, file or glob pattern, with ``file_path`` and ``row_index``; older shards may lack columns, which become null.

    The order of a set of shards is that of (``file_path``, ``row_index``): see ``operators.ranking.ordered_offset``.
    """
    reader = spark.read.option("mergeSchema", "true") if schema is None else spark.read.schema(schema)
    return reader.parquet(*paths).select("*", F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.row_index").alias("row_index"))


def write_shards(df: DataFrame, path: str, rows: int = 500_000) -> None:
    """Parquet files of at most ``rows`` rows, compressed with zstd. Every task writes its own, so their number follows the partitions and the rows."""
    df.write.option("compression", "zstd").option("maxRecordsPerFile", rows).parquet(path)


def spread(df: DataFrame, parts: int | None = None) -> DataFrame:
    """The rows in at least ``parts`` partitions (default: one per core): dealt out if the scan has fewer, as a small file of one row group has, else as they are. Only the plan depends on it."""
    parts = parts or df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(parts) if df.rdd.getNumPartitions() < parts else df


def even(df: DataFrame) -> DataFrame:
    """The rows dealt out evenly over as many parts as the cluster runs tasks: before work of a millisecond a row, where adaptive merging of small parts would leave few tasks."""
    spark = df.sparkSession
    return df.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))


def gathered(df: DataFrame) -> DataFrame:
    """The rows in at most as many parts as the cluster runs tasks, without a shuffle: for tasks that each end in one table of fixed size, so that their number does not grow with the input."""
    spark = df.sparkSession
    return df.coalesce(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))


def shared_dir(spark: SparkSession) -> str:
    """A folder of this application below the shared one named by ``spark.checkpoint.dir``; it is removed when the application ends.

    Where the setting is absent, a folder of this machine serves on a single machine; on a cluster that is an error, as the executors would
    not see each other's files.
    """
    context = spark.sparkContext
    known = getattr(context, "_plyforge_dir", None)
    if known:
        return known
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="plyforge-")
    path = f"{base.rstrip('/')}/plyforge-{context.applicationId}"
    at = context._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(context._jsc.hadoopConfiguration()).deleteOnExit(at)
    context._plyforge_dir = path
    return path


def release(spark: SparkSession) -> None:
    """Remove the intermediate tables of this application; results that are still lazy cannot be read afterwards."""
    context = spark.sparkContext
    path = getattr(context, "_plyforge_dir", None)
    if path:
        at = context._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(context._jsc.hadoopConfiguration()).delete(at, True)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: the lineage ends there, and a lost executor costs no recomputation."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
