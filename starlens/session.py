"""Session settings and lineage cuts."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def build_session(app: str = "starlens", master: str | None = None, **conf) -> SparkSession:
    """A session with adaptive execution and UTC; the cluster's own settings win."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    settings.update(conf)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


_TEMPORARY: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The shared folder named by the cluster; a temporary one only for a local session without one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if context.applicationId not in _TEMPORARY:
        _TEMPORARY[context.applicationId] = tempfile.mkdtemp(prefix="starlens-")
    return _TEMPORARY[context.applicationId]


def spread(df: DataFrame, key: str = "") -> DataFrame:
    """Spread a small table whose rows sit in a few of its splits.

    Text work is bound by the processor, so a file of one row group would leave
    all cores but one idle, however many splits it is read in.  Tables with a
    file for every other core and no file above its share, and tables with more
    bytes than one split per core, are returned as they are.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    files = df.inputFiles()
    if len(files) > 2 * cores:
        return df
    sizes = _file_sizes(spark, files)
    if sum(sizes) > cores * _split_bytes(spark) or 2 * max(sizes, default=0) * cores < 5 * sum(sizes):
        return df
    return df.repartition(cores, F.col(key)) if key else df.repartition(cores)


#: Bytes of texts behind one partition of text work.
PART_BYTES = 4 << 20


def parts_of(df: DataFrame) -> int:
    """So many partitions that each holds the rows of ``PART_BYTES`` of the read texts, one per core at least.

    Given to ``repartition``, the number is kept; without it, adaptive execution
    merges partitions by their bytes before any text is cut into its terms.
    The bytes are those of the strings in Parquet files, since similar texts
    side by side take a small part of theirs on disk, and else of the files.
    """
    spark = df.sparkSession
    files = df.inputFiles()
    size = max(sum(_file_sizes(spark, files)), _text_bytes(spark, files))
    return max(spark.sparkContext.defaultParallelism, -(-size // PART_BYTES))


def _text_bytes(spark: SparkSession, files: list[str]) -> int:
    """Bytes of all strings in Parquet files, which one scan adds up; files of one folder have one schema."""
    folders: dict[str, list[str]] = {}
    for f in files:
        if f.endswith(".parquet"):
            path = spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(f)).toString()
            # a path is read as a pattern
            folders.setdefault(path.rpartition("/")[0], []).append(re.sub(r"([\\\[\]{}*?])", r"\\\1", path))
    total = 0
    for own in folders.values():
        table = spark.read.parquet(*own)
        texts = [F.concat_ws("", f"`{c}`") for c, kind in table.dtypes if kind in ("string", "array<string>")]
        if texts:
            total += table.agg(F.sum(sum(map(F.octet_length, texts)).cast("long"))).first()[0] or 0
    return total


def _file_sizes(spark: SparkSession, files: list[str]) -> list[int]:
    """Bytes of each file, asked from the store that holds it."""
    settings = spark.sparkContext._jsc.hadoopConfiguration()
    paths = [spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(f)) for f in files]
    return [p.getFileSystem(settings).getFileStatus(p).getLen() for p in paths]


def _split_bytes(spark: SparkSession) -> int:
    return spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(
        spark.conf.get("spark.sql.files.maxPartitionBytes", "128m")
    )


def stage(df: DataFrame, key: str | None = None, **options) -> DataFrame:
    """Write a table that several later passes read, and go on from the written files.

    The files lie in the shared folder, so a lost executor costs no
    recomputation of what came before, and later passes read only the columns
    they need.  With a ``key`` (empty for no
    particular one) a small table is spread over the cores again.  ``options``
    are those of the Parquet writer.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/starlens-stage-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    stored = spark.read.schema(df.schema).parquet(path)
    return stored if key is None else spread(stored, key)
