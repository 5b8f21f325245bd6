"""SparkSession factory with the settings the engine's semantics rely on, and what every executor must reach."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

#: Semantics the SQL front end is specified against; performance knobs are left to the cluster.
REQUIRED = {
    "spark.sql.ansi.enabled": "false",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to an existing session, and send the package to its executors."""
    for key, value in REQUIRED.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    ship(spark)
    return spark


def get_session(app: str = "millrace", master: str | None = None, **conf: str) -> SparkSession:
    """A configured session; ``master`` and extra conf are optional (dots spelled as ``__``)."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in REQUIRED.items():
        builder = builder.config(key, value)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return configure(builder.getOrCreate())


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once a session, so that Python workers can import it wherever they start."""
    sc = spark.sparkContext
    if getattr(sc, "_millrace_shipped", False):
        return
    top = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="millrace-"), "millrace.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(top):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.join(os.path.basename(top), os.path.relpath(full, top)))
    sc.addPyFile(path)
    sc._millrace_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The folder the driver and every executor can reach: spark.checkpoint.dir, or the context's checkpoint folder.

    A local master without either gets a temporary folder; a cluster without either is an error, as
    executors would write to their own disks and readers would miss those files.
    """
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if path:
        return path.rstrip("/")
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    # core settings cannot change in a running session, so the local folder is kept with the context
    if not hasattr(sc, "_millrace_dir"):
        sc._millrace_dir = "file://" + tempfile.mkdtemp(prefix="millrace-")
    return sc._millrace_dir
