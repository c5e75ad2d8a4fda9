"""Tables in the folder that driver and executors share, which outlive any executor."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Where a session on one machine names no shared folder (as in tests), one is made once and removed at the end.
_LOCAL: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Unset, one is made if all runs in this process; on a cluster that is an error."""
    if named := spark.conf.get("spark.checkpoint.dir", None):
        return named.rstrip("/")
    master = spark.conf.get("spark.master", "")
    if not (master == "local" or master.startswith("local[")):
        raise RuntimeError(f"spark.checkpoint.dir has to name a folder that driver and executors share (master is {master})")
    if not _LOCAL:
        _LOCAL.append(tempfile.mkdtemp(prefix="tallyloom-"))
        atexit.register(shutil.rmtree, _LOCAL[0], ignore_errors=True)
    return f"file://{_LOCAL[0]}"


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/tallyloom/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back.

    This cuts the lineage at a table every executor can read again, so a lost
    executor costs no recomputation, and it gives the planner real sizes, from
    which Spark decides on its own whether a side may be broadcast.
    """
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def forget(*tables: DataFrame) -> None:
    """Remove stored tables that nothing will read again. One that is left behind, as after a failure, goes with the folder."""
    for df in tables:
        if at := getattr(df, "_stored_at", None):
            with contextlib.suppress(Exception):
                jvm = df.sparkSession._jvm
                path = jvm.org.apache.hadoop.fs.Path(at)
                path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
