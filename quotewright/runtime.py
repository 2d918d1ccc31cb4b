"""Session helpers shared by all operators: reading tables, shipping code, cutting lineage."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

PACKAGE = Path(__file__).resolve().parent


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One test table as a DataFrame."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship_code(spark: SparkSession) -> None:
    """Make the package importable in Python workers.

    Nothing is sent where the workers find it already: through PYTHONPATH, or, in a single JVM, through
    the working directory. Otherwise the package goes once per session through Spark's own file server.
    """
    root = str(PACKAGE.parent)
    on_path = root in [os.path.abspath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    sc = spark.sparkContext
    if on_path or (sc.master.startswith("local[") and os.path.abspath(os.getcwd()) == root):
        return
    if getattr(sc, "_quotewright_shipped", False):
        return
    target = os.path.join(tempfile.mkdtemp(), f"quotewright-{uuid.uuid4().hex[:8]}.zip")  # on the driver only
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(PACKAGE.rglob("*.py")):
            z.write(p, p.relative_to(PACKAGE.parent))
    sc.addPyFile(target)
    sc._quotewright_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The shared folder for cut lineage: spark.checkpoint.dir as the cluster names it.

    Only where the setting is absent, as in tests on a single machine, a temporary folder takes its place.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(named)
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    own = getattr(spark.sparkContext, "_quotewright_shared", None)
    if own is None:
        own = tempfile.mkdtemp(prefix="quotewright-")
        spark.sparkContext._quotewright_shared = own
        spark.sparkContext.setCheckpointDir(own)
    return own


def written(df: DataFrame, label: str) -> DataFrame:
    """Write `df` once as a Parquet table in the shared folder and return the table.

    The lineage ends there, several readers share one computation, and a lost executor costs no recomputation.
    """
    spark = df.sparkSession
    path = f"{own_dir(spark)}/{label}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def own_dir(spark: SparkSession) -> str:
    """This application's folder within the shared one."""
    return f"{shared_dir(spark).rstrip('/')}/quotewright/{spark.sparkContext.applicationId}"


def clean(spark: SparkSession) -> None:
    """Remove the tables that `written` made for this application; those of others who share the folder stay. Results
    that still read them must be stored first."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(own_dir(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
