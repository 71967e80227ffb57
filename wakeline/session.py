"""A Spark session with the settings the operators count on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "wakeline", master: str | None = None, **conf: str) -> SparkSession:
    """UTC and adaptive execution; everything else is the cluster's, or given in `conf` with _ for dots."""
    builder = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true")
    if master:
        builder = builder.master(master)
    for k, v in conf.items():
        builder = builder.config(k.replace("_", "."), v)
    return builder.getOrCreate()


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the cluster's shared folder (spark.checkpoint.dir).  In local mode a temporary one if none is set; on a cluster that is an error."""
    import tempfile
    import uuid

    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="wakeline-")
    return f"{where.rstrip('/')}/wakeline-{name}-{uuid.uuid4().hex}"
