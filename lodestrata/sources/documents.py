"""Document scans over any file system Spark can reach, and object listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.functions.text import decode_ignore, doc_type

# Fixed value: the suffixes a directory scan keeps (case-sensitive).
DOCUMENT_SUFFIXES = (".txt", ".md", ".pdf", ".docx", ".html")

_OBJECT_SCHEMES = ("s3://", "s3a://", "gs://", "abfs://", "abfss://")


def _path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def _status(spark: SparkSession, path: str):
    hadoop_path = _path(spark, path)
    fs = hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(hadoop_path):
        raise FileNotFoundError(f"source not found: {path}")
    return fs.getFileStatus(hadoop_path)


def is_folder(spark: SparkSession, path: str) -> bool:
    return _status(spark, path).isDirectory()


def _suffix_glob(suffixes) -> str:
    return "*{" + ",".join(suffixes) + "}"


def _files(spark: SparkSession, path: str, glob: str | None = None, recursive: bool = True) -> DataFrame:
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(path)


def _documents(files: DataFrame, text: Column) -> DataFrame:
    return files.select(
        text.alias("content"),
        F.create_map(
            F.lit("size"), F.col("length").cast("string"),
            F.lit("modified"), F.date_format("modificationTime", "yyyy-MM-dd'T'HH:mm:ss.SSS"),
        ).alias("metadata"),
        F.col("path").alias("source"),
        doc_type(F.col("path")).alias("doc_type"),
    )


def scan_local_documents(spark: SparkSession, source: str, suffixes=DOCUMENT_SUFFIXES) -> DataFrame:
    """A directory tree (filtered by suffix) or a single file (never filtered).

    The suffix filter is a path glob, so other files are not opened. Text is read with
    universal newlines.
    """
    directory = _status(spark, source).isDirectory()
    files = _files(spark, source, _suffix_glob(suffixes) if directory else None)
    text = F.regexp_replace(decode_ignore(F.col("content")), "\r\n?", "\n")
    return _documents(files, text)


def scan_object_store_documents(spark: SparkSession, source: str) -> DataFrame:
    """Every object whose key starts with the prefix; no suffix filter, bytes kept as they are."""
    return _documents(_by_prefix(spark, source), decode_ignore(F.col("content")))


def _by_prefix(spark: SparkSession, prefix: str) -> DataFrame:
    # a prefix is not a directory: it may end inside a name, and deeper keys count too
    if prefix.endswith("/"):
        return _files(spark, prefix)
    return _files(spark, prefix + "*")


def list_objects(spark: SparkSession, prefix: str) -> DataFrame:
    """Key, size and time of the objects under a prefix; contents are not read."""
    return _by_prefix(spark, prefix).select(
        F.col("path").alias("key"), F.col("length").alias("size"),
        F.col("modificationTime").alias("last_modified"),
    )


def read_documents(spark: SparkSession, source: str) -> DataFrame:
    """Pick the scan by the form of the source."""
    if source.startswith(_OBJECT_SCHEMES):
        return scan_object_store_documents(spark, source.replace("s3://", "s3a://", 1))
    return scan_local_documents(spark, source)


def spread(df: DataFrame) -> DataFrame:
    """Use every core when the input is one small file.

    A large input already has more splits than cores and passes through unshuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
