"""Connected components by label propagation with shortcuts."""

from __future__ import annotations

import contextvars
import functools
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _folder(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir; one of our own only where that is unset in a local session (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        import tempfile

        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")

        found = "file://" + tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return f"{found.rstrip('/')}/tidemark-graph"


#: Folders of intermediate tables made in this thread's call of a tidy() function; None outside of one.
_made: contextvars.ContextVar[list[str] | None] = contextvars.ContextVar("made", default=None)


def discard(spark: SparkSession, paths: list[str]) -> None:
    """Delete intermediate tables that nothing reads any more."""
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def tidy(f):
    """``f`` (spark, ...) -> DataFrame; the intermediate tables that it made and that its result doesn't read are deleted at its end. No other call's tables are touched, so calls may be repeated or run side by side."""

    @functools.wraps(f)
    def run(spark, *args):
        token = _made.set([])
        try:
            out = f(spark, *args)
            read = " ".join(out.inputFiles())
            discard(spark, [p for p in _made.get() if p.rpartition("/")[2] not in read])
        finally:
            _made.reset(token)
        return out

    return run


def note_made(path: str) -> str:
    """Tell the tidy() call around, if there is one, of an intermediate table."""
    if _made.get() is not None:
        _made.get().append(path)
    return path


def fresh_folder(spark: SparkSession) -> str:
    return note_made(f"{_folder(spark)}/{uuid.uuid4().hex}")


def written(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared folder: computed once, however often it is read, and nothing is lost with an executor."""
    path = fresh_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def components(edges: DataFrame) -> DataFrame:
    """(v, root) of all vertices of ``edges`` (a, b); root is the least vertex of the component.

    Each round takes the least label around each vertex, then jumps to that label's label, so a path of length n
    takes about log n rounds. Rounds are written tables, and end when nothing changes.
    """
    both = written(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = written(both.groupBy(F.col("a").alias("v")).agg(F.least(F.col("a"), F.min("b")).alias("root")))
    while True:
        around = both.join(labels.toDF("b", "near"), "b").groupBy(F.col("a").alias("v")).agg(F.min("near").alias("near"))
        stepped = labels.join(around, "v").select("v", F.least("root", "near").alias("root"))
        jumped = written(stepped.join(labels.toDF("root", "up"), "root", "left").select("v", F.least("root", F.coalesce("up", "root")).alias("root")))
        changed = jumped.join(labels.withColumnRenamed("root", "was"), "v").where("root <> was").limit(1).count()
        labels = jumped
        if not changed:
            return labels
