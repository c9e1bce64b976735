"""Tables that a job keeps while it runs, in the folder that driver and executors share.

A written table cuts lineage, is made once however often it is read, and survives lost executors. What a process has
written goes when it ends, or earlier by ``discard``."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_MADE: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``. Where the session names none, a local master gets a new folder of its
    own; anything else is an error, since each executor would write to its own disk."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="checkpoint")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that goes when the process ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _MADE[path] = spark
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def _delete(path: str, spark: SparkSession) -> None:
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def discard(*tables: DataFrame) -> None:
    """Removes what ``stored`` wrote for these tables; nothing may read them any more."""
    for df in tables:
        if (path := getattr(df, "scratch_path", None)) in _MADE:
            _delete(path, _MADE.pop(path))


@atexit.register
def _clean() -> None:
    for path, spark in list(_MADE.items()):
        try:
            _delete(path, spark)
        except Exception:  # noqa: BLE001  the session may have gone, and its folder with it
            break
    _MADE.clear()
