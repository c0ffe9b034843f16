"""Tables kept for a while in a folder that all executors see."""

import atexit
import re
import tempfile
import uuid
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"
# Removes the files of a shuffle as soon as the job that made them is over.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_made: dict[SparkSession, list[str]] = {}
_path_of: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A new path under the folder that the session names for data shared by driver and executors.

    release() deletes it; so does the end of the driver. A session within one process, as in
    local trials, gets a temporary folder if it names none.
    """
    base = spark.conf.get(SETTING, None)
    if not base:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError(f"set {SETTING} to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="run-")
        spark.conf.set(SETTING, base)
    path = f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"
    if not _made:
        atexit.register(release)
    _made.setdefault(spark, []).append(path)
    return path


def release() -> None:
    """Deletes all that settle wrote in this process. Frames that read it cannot be used any more."""
    while _made:
        spark, paths = _made.popitem()
        for path in paths:
            _delete(spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    if spark.sparkContext._jsc is not None:
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def drop(df: DataFrame) -> None:
    """Deletes the table that settle returned, once nothing that reads it is to run again."""
    path = _path_of.pop(df)
    _made.get(df.sparkSession, []).remove(path)
    _delete(df.sparkSession, path)


def settle(df: DataFrame, purpose: str, drop_shuffles: bool = False) -> DataFrame:
    """The rows written to the shared folder and read from there.

    Cuts the lineage, and tells the planner the true size: a side that turned out small is
    broadcast in later joins, one that is not is shuffled, without a hint either way. With
    drop_shuffles the shuffles behind it leave the disk once the rows are written.
    """
    spark = df.sparkSession
    path = shared_folder(spark, purpose)
    before = spark.conf.get(CLEANUP, None)
    if drop_shuffles:
        spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if drop_shuffles:
            spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    settled = spark.read.schema(df.schema).parquet(path)
    _path_of[settled] = path
    return settled
