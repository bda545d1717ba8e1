"""What the operators share: tables, the shared folder, and text basics."""

from __future__ import annotations

import gc
import tempfile
import uuid
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that separates words: space and \x09 to \x0D. bytes.split() splits on exactly these.
BLANKS = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables, through Spark's own reader."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a local session (tests) gets one of its own; on a cluster there's no folder to guess."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="starloom-")
        spark.conf.set("spark.checkpoint.dir", folder)
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str, codec: str = "zstd", by: str | None = None) -> DataFrame:
    """Write df as Parquet into the shared folder (in a folder for each value of the column by, its last) and read it back: lineage ends here, and any executor can be lost later."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.option("compression", codec).parquet(path, partitionBy=by)
    found = spark.read.schema(df.schema).parquet(path)
    found._shared_path = path
    return found


def discard(df: DataFrame) -> None:
    """Delete the files of a table that materialise() wrote and nothing reads any more."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df._shared_path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Have the driver look for shuffles that nothing refers to any more: Spark deletes their files only once it has found out, and a driver with memory to spare takes its time."""
    gc.collect()
    spark._jvm.System.gc()


def without(df: DataFrame, names: list[str]) -> DataFrame:
    """df less the columns that an operator is about to add: its own results replace columns of the same name."""
    lower = {n.lower() for n in names}
    return df.drop(*[c for c in df.columns if c.lower() in lower])


def unsigned_crc32(column) -> Column:
    return F.crc32(column.cast("binary")).cast("long")


def id_remainder(doc_id, n: int):
    """crc32 of the id as text, modulo n; ids that are null count as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n
