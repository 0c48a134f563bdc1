"""Session and cluster-folder helpers shared by every operator."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "quillmill", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the library is tuned for: ANSI, AQE, UTC, Kryo."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.ansi.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's ``spark.checkpoint.dir``. Where none is named: a local folder in local mode, else one beside the
    warehouse's tables, which then has to lie on a shared file system."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    named = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if re.fullmatch(r"local(-cluster)?(\[.*\])?", sc.master):
            named = tempfile.mkdtemp(prefix="quillmill-checkpoints-")
            atexit.register(shutil.rmtree, named, ignore_errors=True)
        else:
            named = f"{spark.conf.get('spark.sql.warehouse.dir')}/_checkpoints"
            path = spark._jvm.org.apache.hadoop.fs.Path(named)
            if path.getFileSystem(spark._jsc.hadoopConfiguration()).getScheme() == "file":
                raise RuntimeError("name a folder that all machines share in spark.checkpoint.dir")
    sc.setCheckpointDir(named)


def shared_folder(spark: SparkSession) -> str:
    """The folder of this session's checkpoints, which driver and executors all reach."""
    ensure_checkpoint_dir(spark)
    return spark._jsc.sc().getCheckpointDir().get()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder: survives lost executors, unlike a local one."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
