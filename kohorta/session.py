"""Session settings and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import SparkSession

# Settings that the operators count on. All are run-time SQL settings, so they
# also take effect on a session that somebody else has built.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # A user or id that holds a large share of the rows is split at run time,
    # even where the split makes a further exchange necessary downstream.
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # Ranked cut-offs (latest 3,240, head 20,000) are also taken before the shuffle.
    "spark.sql.optimizer.windowGroupLimitThreshold": "32768",
    # Whole texts differ in length: an Arrow batch ends after so many bytes, too.
    "spark.sql.execution.arrow.maxBytesPerBatch": "8388608",
}


def tune(spark: SparkSession) -> SparkSession:
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    return spark


def local_session(app: str = "kohorta", cores: int = 8, memory: str = "8g") -> SparkSession:
    """Session for tests and the bench; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return tune(spark)


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach, taken from ``spark.checkpoint.dir``.

    Only a local session without that setting (tests) gets a temporary folder; on
    a cluster its executors could not read one.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if context.master != "local" and not context.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="kohorta-")
        context.setCheckpointDir(folder)
        folder = context.getCheckpointDir()
    return folder.rstrip("/")


_scratch: list[str] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    """New, unused path below the shared folder."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    _scratch.append(path)
    return path


@contextmanager
def scratch_scope(spark: SparkSession):
    """Deletes at its end the scratch tables made inside.

    For steps whose result is stored or on the driver by then; a lazy frame must not
    leave the scope.
    """
    first = len(_scratch)
    try:
        yield
    finally:
        made, _scratch[first:] = _scratch[first:], []
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        for path in made:
            where = hadoop.Path(path)
            where.getFileSystem(conf).delete(where, True)


#: Parquet settings for rows of several MB: a writer looks at the size of a row group and of
#: its pages after each row, not after a hundred, so neither writer nor reader holds many.
LARGE_ROWS = {
    "parquet.block.size": str(8 << 20),
    "parquet.page.size.row.check.min": "1",
    "parquet.page.size.row.check.max": "1",
}


def cut_lineage(df, name: str = "cut", **options: str):
    """Write the rows to the shared folder and read them back.

    Iterations start from files that outlive any executor, and the plan behind
    them runs once. ``options`` go to the writer.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
