"""Session helpers: the shared folder for written intermediate tables."""

from __future__ import annotations

import math
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# A broadcast of this many narrow rows stays near 100 MB per executor.
BROADCAST_ROWS = 500_000

_local_folders: dict[str, str] = {}


def checkpoint_root(spark: SparkSession) -> str:
    """The folder the cluster names in `spark.checkpoint.dir`.

    Only a local session without that setting gets a folder of its own: on a
    cluster a machine-local folder would be lost with its machine.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    folder = folder or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("Set spark.checkpoint.dir to a folder all executors share.")
    application = spark.sparkContext.applicationId
    if application not in _local_folders:
        _local_folders[application] = tempfile.mkdtemp(prefix="gleaner-")
    return _local_folders[application]


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder; nothing is created or removed."""
    return f"{checkpoint_root(spark)}/{name}-{uuid.uuid4().hex}"


def write_table(rows: DataFrame, name: str) -> DataFrame:
    """Cut the lineage with a table in the shared folder, which outlives lost executors."""
    path = new_folder(rows.sparkSession, name)
    rows.write.parquet(path)
    return rows.sparkSession.read.parquet(path)


def read_if_there(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame | None:
    """The parquet table at `path`, or None where nothing was written yet; every other error is raised."""
    try:
        return (spark.read.schema(schema) if schema else spark.read).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def broadcast_if_small(rows: DataFrame, n_rows: int) -> DataFrame:
    """A broadcast for a side counted beforehand; a larger one is left to the planner."""
    return F.broadcast(rows) if n_rows <= BROADCAST_ROWS else rows


def broadcast_parts(rows: DataFrame, key: str) -> Iterator[DataFrame]:
    """A written side of a join, however large, in bounded broadcasts: the other side stays where it is and is read once a part."""
    parts = max(1, math.ceil(rows.count() / BROADCAST_ROWS))
    for part in range(parts):
        yield F.broadcast(rows if parts == 1 else rows.where(F.pmod(F.xxhash64(key), F.lit(parts)) == part))


def small_side(rows: DataFrame, name: str) -> DataFrame:
    """A written side of a join with a much larger one, broadcast if its rows are few: the larger one then stays where it is."""
    written = write_table(rows, name)
    return broadcast_if_small(written, written.count())
