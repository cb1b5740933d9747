"""Written tables in the folder that all executors share: lineage and size estimates end there.

A checkpoint alone keeps the estimate of the plan that made it, and joins multiply estimates: carried from iteration to
iteration, the number grows until planning takes longer than the work. A written table is estimated by its files.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_planning = False


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder name below spark.checkpoint.dir; only a local session, as in tests, may leave that unset and gets a temporary folder."""
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not base:
        if not re.match(r"local(\[|$)", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='driftmap-')}"
        sc.setCheckpointDir(base)
    return f"{base.rstrip('/')}/driftmap-{name}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Writes df to the shared folder and reads it again: lineage ends there, and a lost executor loses nothing."""
    spark, path = df.sparkSession, shared_dir(df.sparkSession, name)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def released(*tables: DataFrame) -> None:
    """Deletes tables of written() that nothing reads any more."""
    if _planning:
        return
    for df in tables:
        for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            jvm = df.sparkSession._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(where, True)


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """df as a written table, or df itself where only plans are made."""
    return df if _planning else written(df, name, "snappy")


@contextmanager
def planning() -> Iterator[None]:
    """Within it, cut() leaves tables as they are, so that whole plans can be shown without a job."""
    global _planning
    _planning = True
    try:
        yield
    finally:
        _planning = False
