"""Session helpers: table reading, shared checkpoints, internal column names."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession

__all__ = ["read_table", "shared_dir", "cut_lineage", "fresh"]


def reach_workers(spark: SparkSession) -> None:
    """Lets Python workers on this machine import the package from where the driver did.

    On a cluster whose machines lack that folder, ship the package with ``--py-files``.
    """
    home = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = spark.sparkContext.environment
    known = env.get("PYTHONPATH", "")
    if home not in known.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (home, known) if x)


def read_table(spark: SparkSession, base: str, name: str) -> DataFrame:
    """The Parquet table *name* under *base*. Stamps are UTC everywhere, so the session is set to it."""
    reach_workers(spark)
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{base}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The checkpoint folder every executor can see.

    A cluster names it in ``spark.checkpoint.dir``. Only where that is unset (tests on one machine) a
    temporary folder is made and set, which goes when the process ends.
    """
    sc = spark.sparkContext
    known = sc._jsc.sc().getCheckpointDir()
    if known.isDefined():
        return known.get()
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="chatloom-")
        atexit.register(shutil.rmtree, named, ignore_errors=True)
    sc.setCheckpointDir(named)
    return sc._jsc.sc().getCheckpointDir().get()


def cut_lineage(df: DataFrame) -> DataFrame:
    """*df* written to the shared checkpoint folder and read back; survives the loss of executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def fresh(df: DataFrame, *wanted: str) -> list[str]:
    """Names like *wanted* which no column of *df* has (Spark compares them without regard to case)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for w in wanted:
        name = f"__{w}"
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out
