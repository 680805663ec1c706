"""Helpers that the training-data operators share."""

from __future__ import annotations

import tempfile
import threading
import uuid

from pyspark.sql import DataFrame, SparkSession

from ..session import ship, table

#: White space of the word rules: space and the five controls from tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"


#: Paths of the tables that a thread has written, in order.
_made: dict[int, list[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder, ``spark.checkpoint.dir``. Where it is unset a local one is made, but only for a local master:
    elsewhere executors would not see it."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="turnweave-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to a table in the shared folder and read it back: the lineage ends there, and a lost executor
    costs no recomputation of what came before. The table stays until ``remove`` is told of it, as a result may read it late."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/turnweave/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    made().append(path)
    return spark.read.schema(df.schema).parquet(path)


def made() -> list[str]:
    """Paths of the tables that this thread has written and nobody has removed."""
    return _made.setdefault(threading.get_ident(), [])


def remove(spark: SparkSession, paths: list[str], unless_read_by: DataFrame | None = None) -> None:
    """Delete tables of ``materialise``, but those that a frame still reads."""
    read = {f.rsplit("/", 1)[0].split(":", 1)[-1].lstrip("/") for f in unless_read_by.inputFiles()} if unless_read_by is not None else set()
    for path in list(paths):
        if not any(r.startswith(path.split(":", 1)[-1].lstrip("/")) for r in read):
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
            if path in made():
                made().remove(path)


__all__ = ["WORD", "made", "materialise", "remove", "shared_dir", "ship", "table"]
