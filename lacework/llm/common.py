"""What the operators of this subpackage share: tables, the shared folder, materialised tables."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of the contracts, as the inside of a character class.
SPACE = r"\x20\x09-\x0D"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share. A cluster names it in spark.checkpoint.dir; only where
    that is unset in a local session, as in tests, a temporary folder is made and remembered."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="lacework-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back, which cuts the lineage: a lost
    executor costs the tasks that it ran, not the stages before them."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_table(*tables: DataFrame) -> None:
    """Deletes the files of tables that materialize() wrote, once nothing reads them any more."""
    for df in tables:
        spark, shared = df.sparkSession, shared_dir(df.sparkSession)
        jvm = spark.sparkContext._jvm
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if folder.replace("///", "/").startswith(shared.replace("///", "/")):
                path = jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Lets Spark's cleaner delete the shuffle files of finished steps, which it does when the driver collects garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def packed(df: DataFrame, *more) -> DataFrame:
    """(row, *more): the columns of df as one struct, so that no name of theirs can clash with those used beside it."""
    return df.select(F.struct(*(F.col(quoted(c)) for c in df.columns)).alias("row"), *more)


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def text_or_empty(text_col: str = "text"):
    return F.coalesce(F.col(text_col).cast("string"), F.lit(""))
