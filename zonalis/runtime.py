"""Session settings and lineage cuts shared by iterative operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster shares, from ``spark.checkpoint.dir``.

    Only where that setting is absent and Spark runs on this machine alone (tests), a local folder takes its place;
    on a cluster, where executors don't see each other's disks, that is an error.
    """
    sc = spark.sparkContext
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        at = sc.getCheckpointDir()
        if not at:
            if not sc.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            at = "file://" + tempfile.mkdtemp(prefix="zonalis-")
            sc.setCheckpointDir(at)
    elif sc.getCheckpointDir() is None:
        sc.setCheckpointDir(at)
    return at


def fresh_path(spark: SparkSession, kind: str) -> str:
    """A path under the shared folder that nothing has used yet."""
    return f"{shared_dir(spark).rstrip('/')}/{kind}-{uuid.uuid4().hex}"


#: Tables that cut() has written in this process.
_CUTS: list[str] = []


def release(spark: SparkSession) -> int:
    """Deletes every table that cut() has written so far and returns their number.

    Results that still read them can't be computed again; call it once they are written or collected.
    """
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    done = 0
    while _CUTS:
        path = hadoop(_CUTS.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        done += 1
    return done


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` as a Parquet table in the shared folder and read it back.

    The result has no lineage: a lost executor costs a re-read and no recomputation.
    """
    path = fresh_path(df.sparkSession, "cut")
    df.write.parquet(path)
    _CUTS.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


#: Rows that a task gathers by key at most, where a join or a window sorts them.
TASK_ROWS = 250_000


def tasks_for(df: DataFrame) -> int:
    """Tasks that deal the rows of ``df`` out by TASK_ROWS, and not fewer than Spark's own."""
    return max(shuffle_partitions(df.sparkSession), -(-df.count() // TASK_ROWS))


def own_tasks(spark: SparkSession) -> int:
    """Tasks that Spark deals a shuffle to at least: its partitions, or one a core where adaptive execution joins them."""
    return min(shuffle_partitions(spark), spark.sparkContext.defaultParallelism)


def bounded_tasks(df: DataFrame) -> int:
    """Tasks that deal the rows of ``df`` out by TASK_ROWS, and not fewer than own_tasks()."""
    return max(own_tasks(df.sparkSession), -(-df.count() // TASK_ROWS))


def broadcast_if_small(df: DataFrame, rows: int) -> DataFrame:
    """Marks ``df`` for broadcast if it is counted to have ``rows`` rows at most; a larger one is joined by shuffle."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
