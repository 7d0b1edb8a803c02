"""Session settings and the shared folder for intermediate tables."""

import os
import shutil
import tempfile
import uuid
from functools import cache

from pyspark.sql import DataFrame, SparkSession

_HERE = os.path.dirname(os.path.abspath(__file__))


def build_session(master: str | None = None, app: str = "navgrid", **conf: str) -> SparkSession:
    """Session with what the operators rely on: UTC, ANSI, adaptive plans with skew-join splitting."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.ansi.enabled": "true",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder: spark.checkpoint.dir, or where it is unset a folder in the session's warehouse.

    With a scheme, so that executors and Spark's readers mean the same place. On a cluster a warehouse on a local disk is no
    such place: spark.checkpoint.dir has to be set there."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    path = spark._jvm.org.apache.hadoop.fs.Path(named or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_shared")
    full = str(path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path)).rstrip("/")
    if not named and full.startswith("file:") and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("Set spark.checkpoint.dir to a folder that the driver and all executors share.")
    return full


@cache
def _package() -> str:
    return shutil.make_archive(os.path.join(tempfile.mkdtemp(), "navgrid"), "zip", os.path.dirname(_HERE), "navgrid")


def ship(spark: SparkSession) -> None:
    """This package's code to every worker, whatever folder the session was started in. Data never goes this way."""
    if not any(f.endswith("/navgrid.zip") for f in spark.sparkContext.listFiles):
        spark.sparkContext.addPyFile(_package())


def materialise(df: DataFrame) -> DataFrame:
    """Write once to the shared folder and read back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/navgrid/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Remove what materialise() wrote for tables that no later step reads."""
    for table in tables:
        spark, hadoop = table.sparkSession, table.sparkSession._jvm.org.apache.hadoop.fs
        root = f"{shared_dir(spark)}/navgrid/"
        for folder in {name.rpartition("/")[0] for name in table.inputFiles()}:
            path = hadoop.Path(folder)
            fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
            if str(fs.makeQualified(path)).startswith(str(fs.makeQualified(hadoop.Path(root)))):
                fs.delete(path, True)


def spread(df: DataFrame, *columns: str) -> DataFrame:
    """Hash rows by group over all shuffle partitions.

    For groups that are small in bytes but heavy in computation: the explicit number keeps the adaptive planner
    from merging them into few tasks, and a following groupBy on the columns needs no further shuffle.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *columns)
