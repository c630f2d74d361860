"""Tables in the shared folder, which cut lineage in loops."""

from __future__ import annotations

import os
import tempfile
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir.

    Where that is unset, a master of one process (local, local[n], as in tests) gets a temporary
    folder; on a cluster it is an error, since no folder of one machine will do.
    """
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not shared:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        shared = os.path.join(tempfile.gettempdir(), "graphloom-checkpoints")
        spark.sparkContext.setCheckpointDir(shared)
    return shared.rstrip("/")


def own_dir(spark: SparkSession) -> str:
    """This application's part of the shared folder; forget() removes it."""
    return f"{scratch_dir(spark)}/graphloom-{spark.sparkContext.applicationId}"


def forget(spark: SparkSession) -> None:
    """Remove all tables that this application has written to the shared folder; results that read them end with that."""
    _delete(spark, own_dir(spark))


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it again: computed once, and safe when executors are lost."""
    path = f"{own_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def written_by(df: DataFrame, name: str, key: str) -> DataFrame:
    """written(), in buckets of `key`, so that joins on it do not move the table again.

    Buckets need a catalog; where its folder cannot be made, the table is written without them.
    """
    spark = df.sparkSession
    if not _writable(spark, spark.conf.get("spark.sql.warehouse.dir")):
        return written(df, name)
    table = f"graphloom_{name}_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartition(buckets, key)  # a file for each bucket, not one for each task and bucket
    dealt.write.bucketBy(buckets, key).sortBy(key).option("path", f"{own_dir(spark)}/{table}").saveAsTable(table)
    out = spark.table(table)
    out.schema  # noqa: B018  resolved now, for the name is given back at once; the files stay
    spark.sql(f"DROP TABLE {table}")
    return out


def _writable(spark: SparkSession, folder: str) -> bool:
    """Whether the folder is there or can be made."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    try:
        return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(path)
    except Py4JJavaError:
        return False


def mark_text(spark: SparkSession, path: str, text: str) -> None:
    """Write a small text as one file at a Hadoop path."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    where = jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(conf).create(where, True)
    out.write(bytearray(text.encode()))
    out.close()


def read_text(spark: SparkSession, path: str) -> str | None:
    """The text of a small file, None if there is none."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    where = jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(conf).exists(where):
        return None
    row = spark.read.text(path, wholetext=True).first()
    return row[0] if row else ""


def drop_written(df: DataFrame) -> None:
    """Remove the files behind a table made by written(), once nothing reads it any more."""
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        _delete(df.sparkSession, folder)
