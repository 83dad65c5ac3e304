"""Session helpers: defaults for local runs and lineage cutting."""
from __future__ import annotations

import atexit
import contextlib
import gc
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(cores: int | str = "*", app: str = "priceloom", **conf: str) -> SparkSession:
    """A single-machine session for tests and benches; clusters bring their own."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    settings = {
        **_DEFAULTS,
        "spark.sql.shuffle.partitions": "8",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "12g",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    session = builder.getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    return session


def shared_dir(spark: SparkSession) -> str:
    """Folder for cut lineage: one per application under the cluster's ``spark.checkpoint.dir``.

    Only a session whose master is ``local`` may do without the setting; it gets a temporary
    folder.  On several machines a local folder would lose rows, so that is an error.
    """
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return f"{configured.rstrip('/')}/priceloom-{context.applicationId}"
    current = context._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    if context.master.split("[")[0] != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    made = tempfile.mkdtemp(prefix="priceloom-")
    atexit.register(shutil.rmtree, made, ignore_errors=True)
    context.setCheckpointDir(made)
    return context._jsc.sc().getCheckpointDir().get()


def drop_scratch(spark: SparkSession) -> None:
    """Remove what this application wrote under the shared folder; call when its results are stored."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def tune_for_wide_pairs(spark: SparkSession) -> None:
    """Pair scoring has many columns; one fused method for all of it would be too big for
    the JVM to compile, so let the engine keep separate projections there."""
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")


@contextlib.contextmanager
def settings(spark: SparkSession, values: dict[str, str]):
    """The session with other settings, which are put back at the end; only for what is written inside."""
    held = {key: spark.conf.get(key, None) for key in values}
    try:
        for key, value in values.items():
            spark.conf.set(key, value)
        yield spark
    finally:
        for key, value in held.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def materialize(df: DataFrame, label: str = "stage", codec: str | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Unlike a cached plan this survives lost executors, keeps column pruning and
    gives the optimizer the true size, so small results are broadcast and large
    ones are not.  ``codec``: how the files are compressed, where the session's way is not meant.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=codec)
    written = spark.read.schema(df.schema).parquet(path)
    written.scratch_path = path
    return written


def discard(written: DataFrame) -> None:
    """Remove what ``materialize`` wrote, once all that reads it is itself written."""
    spark = written.sparkSession
    folder = spark._jvm.org.apache.hadoop.fs.Path(written.scratch_path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def collect_garbage(spark: SparkSession) -> None:
    """Let go of finished steps' plans, in Python and then in the driver's JVM, which gives back the heap they took.

    A long job's driver else grows to its whole heap, whatever it still needs.
    """
    gc.collect()
    spark._jvm.System.gc()
