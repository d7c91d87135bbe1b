"""Session helpers: where intermediate tables go, and how they are written."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []
_written: set[str] = set()


def build_session(master: str = "local[*]", app: str = "sandhi", **conf: str) -> SparkSession:
    """A session with the settings the library expects; keyword underscores stand for dots."""
    b = SparkSession.builder.master(master).appName(app)
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    }
    for k, v in {**base, **{k.replace("_", "."): v for k, v in conf.items()}}.items():
        b = b.config(k, v)
    return b.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where that is unset, a temporary one, in local mode only: on a
    cluster every executor would write to its own disk."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        if not _own:
            _own.append(tempfile.mkdtemp(prefix="sandhi-"))
            atexit.register(shutil.rmtree, _own[0], ignore_errors=True)
        at = "file://" + _own[0]
    return at.rstrip("/")


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: cuts the lineage and is not
    computed twice; a lost executor costs nothing, as the table outlives it. The tables of an
    application are in one folder, which is removed when the driver's JVM ends, or by ``clean``."""
    spark = df.sparkSession
    path = f"{own_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _hadoop(spark: SparkSession, at: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def own_dir(spark: SparkSession) -> str:
    """This application's folder in the shared one; made, and marked to be deleted in the end, when first asked for."""
    at = f"{shared_dir(spark)}/sandhi/{spark.sparkContext.applicationId}"
    if at not in _written:
        fs, path = _hadoop(spark, at)
        fs.mkdirs(path)
        fs.deleteOnExit(path)
        _written.add(at)
    return at


def clean(spark: SparkSession) -> None:
    """Removes this application's intermediate tables now; DataFrames that read them can no longer be used."""
    at = f"{shared_dir(spark)}/sandhi/{spark.sparkContext.applicationId}"
    fs, path = _hadoop(spark, at)
    fs.delete(path, True)
    _written.discard(at)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
