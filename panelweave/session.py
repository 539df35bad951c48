"""Session defaults and the cut of a lineage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Runtime settings every job here relies on.  They let Spark choose broadcast
#: joins from measured sizes, split skewed join partitions and merge small
#: shuffle partitions, so no operator hints a join strategy by hand.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(app: str = "panelweave", master: str | None = None, **conf: str) -> SparkSession:
    """Create (or reuse) a session carrying :data:`DEFAULTS`.

    Cluster sizing (executors, ``spark.sql.shuffle.partitions``,
    ``spark.sql.files.maxPartitionBytes``) is left to the submitter; keyword
    arguments override anything, with ``__`` standing for a dot.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in DEFAULTS.items():
        builder = builder.config(key, value)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Checkpoint ``df`` in the folder named by ``spark.checkpoint.dir``.

    A reliable checkpoint survives the loss of executors.  The folder has to be
    one that all executors share, so a missing setting is an error.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir", None)
        if not folder:
            raise RuntimeError("set spark.checkpoint.dir to a shared folder")
        context.setCheckpointDir(folder)
    return df.checkpoint()

