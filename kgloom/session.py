"""Where intermediate tables go, how lineage is cut, and jobs with a time limit."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, from spark.checkpoint.dir.

    Where it is unset, a local session gets a folder of its own; on a cluster that would not be shared, so it is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if folder or held.isDefined():
        folder = folder or held.get()
    elif spark.sparkContext.master.split("[")[0] == "local":
        folder = "file://" + tempfile.mkdtemp(prefix="kgloom-")
    else:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not held.isDefined():
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def checkpoint(df: DataFrame) -> DataFrame:
    """Materialise in the shared folder and cut the lineage; survives the loss of executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def new_path(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df as written to a Parquet table of its own in the shared folder."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def limited(spark: SparkSession, run: Callable[[], Any], timeout: float | None) -> tuple[bool, Any, str | None]:
    """(success, what run() gives, error); beyond ``timeout`` seconds the jobs that run() has started are cancelled."""
    tag, late, over = f"limited-{uuid.uuid4().hex}", threading.Event(), threading.Event()

    def watch() -> None:
        if not over.wait(timeout):
            late.set()
            while True:  # again and again: a query that is still being planned has no job yet
                spark.sparkContext.cancelJobsWithTag(tag)
                if over.wait(0.5):
                    return

    watcher = threading.Thread(target=watch, daemon=True) if timeout else None
    spark.sparkContext.addJobTag(tag)
    try:
        if watcher:
            watcher.start()
        return True, run(), None
    except Exception as e:  # noqa: BLE001  an interface that reports instead of raising
        return False, None, f"timeout after {timeout:g} s" if late.is_set() else f"{type(e).__name__}: {str(e).splitlines()[0] if str(e) else ''}"
    finally:
        over.set()
        spark.sparkContext.removeJobTag(tag)
