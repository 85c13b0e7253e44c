"""Session settings and the shared folder used for checkpoints and stream output."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

#: Paths below the shared folder that this driver has handed out.
_handed_out: list[str] = []


def build_session(app: str = "adoptlens", master: str | None = None, **conf: str) -> SparkSession:
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.forceOptimizeSkewedJoin", "true")
        .config("spark.ui.showConsoleProgress", "false")
        # call sites of every column expression cost more than the small jobs themselves
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_root(spark: SparkSession) -> str:
    """The folder every executor can reach: ``spark.checkpoint.dir`` of the session.

    Only a local master may fall back to a temporary folder, since there the
    driver and the executors are one process.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        configured = spark.sparkContext.getCheckpointDir()
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by the cluster")
    folder = tempfile.mkdtemp(prefix="adoptlens-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh path below the shared folder for one run of one job."""
    path = f"{shared_root(spark)}/adoptlens/{purpose}-{uuid.uuid4().hex}"
    _handed_out.append(path)
    return path


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes at its end what was written to the shared folder inside it.

    Results read those tables, so write or collect them inside as well.
    """
    start = len(_handed_out)
    try:
        yield
    finally:
        for path in _handed_out[start:]:
            _delete(spark, path)
        del _handed_out[start:]


def _delete(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def release(df: DataFrame) -> None:
    """Deletes the table that ``cut_lineage`` wrote, once nothing reads it any more."""
    for file in df.inputFiles()[:1]:
        folder = file.rsplit("/", 1)[0]
        if folder.rsplit("/", 1)[1] in {path.rsplit("/", 1)[1] for path in _handed_out}:
            _delete(df.sparkSession, folder)


def cut_lineage(df: DataFrame) -> DataFrame:
    """The frame as a Parquet table in the shared folder.

    Survives the loss of any executor, is computed once (a checkpoint computes its
    last stage twice), and later reads prune columns and know its size.
    """
    path = shared_dir(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
