"""Written tables: lineage is cut by writing Parquet to the folder all executors share.

The folder is ``spark.checkpoint.dir`` of the session.  Where the session names none, a local master
(a laptop) gets a temporary folder; on a cluster that is an error, as a machine-local folder would
lose its part files with the executor that wrote them.
"""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder, or a new local one where none is set on a local master."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = tempfile.mkdtemp(prefix="sievewright-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


#: Bytes of rows that Spark hands to a Python worker at once (its default is 64 MB, which several copies of it multiply).
BATCH_BYTES = 4 << 20
_BATCH, _DEFAULT = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"


def bounded_batches(spark: SparkSession) -> None:
    """Bound the memory of Python workers, unless the session names a bound itself."""
    if spark.conf.get(_BATCH) == _DEFAULT:
        spark.conf.set(_BATCH, str(BATCH_BYTES))


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and return a reader of it."""
    spark = df.sparkSession
    bounded_batches(spark)
    path = f"{shared_dir(spark)}/sievewright/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._sievewright_path = path
    return out


def released(spark: SparkSession, *tables: DataFrame) -> None:
    """Give back disk: delete tables that ``written`` made and nothing reads any more, and shuffles of ended jobs.

    Spark deletes a shuffle's files when the driver's JVM has collected the plan that made it, which
    else may be half an hour later.
    """
    jvm = spark.sparkContext._jvm
    for table in tables:
        path = jvm.org.apache.hadoop.fs.Path(table._sievewright_path)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    gc.collect()
    jvm.System.gc()


def partitions(spark: SparkSession) -> int:
    """Shuffle partitions of the session, for explicit repartitioning."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
