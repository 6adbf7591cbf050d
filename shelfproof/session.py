"""Session settings the jobs rely on, and how a job cuts its lineage."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

#: Settings that change results or keep tasks within memory.  Everything else
#: is left to the cluster's own defaults.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # A retained page is around 2 MB of HTML, so Arrow batches are bounded by
    # bytes rather than by the default 10 000 rows.
    "spark.sql.execution.arrow.maxBytesPerBatch": str(64 << 20),
}


def build(master: str | None = None, app: str = "shelfproof", **extra: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, val in {**SETTINGS, **extra}.items():
        builder = builder.config(key, val)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, ``spark.checkpoint.dir``.

    On one machine (``local[n]``) without it, a new temporary folder; on a cluster its absence is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith(("local[", "local")) or "cluster" in spark.sparkContext.master:
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="shelfproof-shared-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the folder the cluster names.

    ``spark.checkpoint.dir`` is read from the session.
    """
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)
