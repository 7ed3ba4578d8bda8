"""Tables in the folder that driver and executors share: they cut lineage, survive lost executors and give AQE sizes."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``.  Where it is unset, a temporary folder in local mode, where all tasks see it; else an error."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    master = spark.conf.get("spark.master", "")
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    import tempfile

    return f"file://{tempfile.gettempdir()}/millrace-shared"


def stage_table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.  The folder is removed when the driver's JVM ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/millrace/{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jpath)
    return spark.read.schema(df.schema).parquet(path)


def drop_table(staged: DataFrame) -> None:
    """Remove the folder of a table that ``stage_table`` wrote and that nothing reads any more."""
    spark = staged.sparkSession
    for file in staged.inputFiles()[:1]:
        jpath = spark._jvm.org.apache.hadoop.fs.Path(file).getParent()
        jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)
